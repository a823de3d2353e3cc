import random
import re
import zlib
from collections import Counter

import pytest

from pagesift.llm import spelling as S


def brute_near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if brute_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form is not None else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(r) for w, r in out.items()}


def brute_counts(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def words(rnd, n, letters, low=6, high=11):
    out = set()
    while len(out) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
        out.add(w)
        for _ in range(2):
            at = rnd.randrange(len(w))
            v = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])
            if len(v) >= low:
                out.add(v)
    return sorted(out)


def test_acceptor_is_minimal_and_exact():
    rnd = random.Random(1)
    for _ in range(60):
        ws = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 30))})
        m = S.Acceptor(ws)
        reached, stack, found = set(), [(0, "")], []
        while stack:
            q, s = stack.pop()
            reached.add(q)
            if m.final[q]:
                found.append(s)
            stack += [(to, s + c) for c, to in m.arcs[q].items()]
        assert sorted(found) == ws
        suffixes = {frozenset(w[len(p) :] for w in ws if w.startswith(p)) for w in ws for p in (w[:i] for i in range(len(w) + 1))}
        assert len(reached) == len(suffixes)


@pytest.mark.parametrize("size", [2000, 5])
def test_variants_equal_brute_force(spark, monkeypatch, size):
    """With partitions of five words, almost every window is halved until it has one letter."""
    monkeypatch.setattr(S, "PARTITION_WORDS", size)
    rnd = random.Random(4)
    vocab = words(rnd, 500, "abé") + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÿ" * 40, "ÿ" * 41, "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499]
    counts = {w: rnd.choice([5, 6, 7, 30, 31, 160, 900]) for w in vocab}
    df = spark.createDataFrame([(w, n, "x", 1, "s") for w, n in counts.items()], "word string, n long, form string, length int, shared string").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.group_variants(df).collect()}
    assert got == brute(counts)
    assert sum(r[0] is not None and r[1] != r[0] for r in got.values()) > 10


def test_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "HELD", 20)
    rnd = random.Random(6)
    vocab = words(rnd, 60, "abcÉé")
    rows = []
    for d in range(300):
        picked = rnd.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=rnd.randint(0, 40))
        rows.append((d, "".join(w.title() + rnd.choice([" ", "-", "1", "\n", "×", "ß", "ſ ", "İ"]) for w in picked)))
    rows += [(900, None), (901, ""), (None, "Strasse " * 9), (3, rows[3][1]), (3, rows[3][1]), (902, "verlängert " * 20000), (903, "Q" * 100000)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(df, change=S.slip).collect()}
    want = brute(brute_counts(rows))
    assert got == want and len(want) > 60


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), change=S.slip).count() == 0
