import random
import re

import numpy as np
import xxhash

from pagesift.llm import simhash as S


def brute_fp(text, n=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                comp[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def make_rows(n=250):
    rnd = random.Random(2)
    vocab = ["Ünder", "the", "a", "tree", "K", "x y", "ran", "İ", "Blue", "of\tday", "\x1cq"]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            w = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 2, 4, 60, 120])))))
    return rows


def test_equals_brute_force(spark):
    rows = make_rows() + [(500, None), (None, "a b c d e"), (None, "zz"), (3, "a b"), (3, "a b"), (501, "long word " * 50000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    want = brute(rows, 4)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 40


def test_all_near_pairs_are_found(spark):
    rnd = random.Random(9)
    fps = set()
    for _ in range(150):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(4):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    for bits in (0, 2, 4, 6):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        assert {(r.a, r.b) for r in S.near_pairs(df, bits).collect()} == want


def test_keep_one(spark):
    rows = make_rows(120) + [(3, "a b"), (3, "a b"), (None, "q q q"), (None, "q q q"), (None, "a b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _other string")
    kept = S.keep_one(df).collect()
    groups = {(c, f if c is None else None) for d, f, c in brute(rows, 4)}
    assert len(kept) == len(groups)
    assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c, _ in groups if c is not None}
    assert df.columns == kept[0].__fields__
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_dense_group_is_linked_by_stars(spark, monkeypatch):
    """Five thousand near copies: as many links as fingerprints and cells at most, one component; also if cells overflow."""
    from pagesift.llm.graph import connected_components

    rnd = random.Random(12)
    centre = rnd.getrandbits(64)
    fps = {centre}
    while len(fps) < 5000:
        f = rnd.choice((centre, rnd.choice(sorted(fps)[:50])))
        for b in rnd.sample(range(64), rnd.randint(1, 3)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(500)}
    arr = np.array(sorted(fps), np.uint64)
    label = np.arange(len(arr))
    while True:
        before = label.copy()
        for i in range(len(arr)):
            near = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4)
            label[near] = np.minimum(label[near], label[near].min())
        if (before == label).all():
            break
    want = {}
    for f, c in zip(arr.view(np.int64).tolist(), label.tolist()):
        want.setdefault(c, set()).add(f)
    df = spark.createDataFrame([(f,) for f in arr.view(np.int64).tolist()], "fp long")
    cells = S.cells_of(df, 4).count()
    for most in (4096, 300):
        links = S.near_links(df, 4, most)
        assert links.count() <= 2 * cells
        groups = {}
        for r in connected_components(links).collect():
            groups.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
