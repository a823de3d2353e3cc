import random
import re

from pagesift.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def semi_global(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row


def test_myers_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(300):
        p = [rnd.choice("abcd") for _ in range(rnd.randint(1, 80))]
        t = [rnd.choice("abcde") for _ in range(rnd.randint(0, 100))]
        assert D.edit_ends(p, t) == semi_global(p, t)[1:]


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ÜBER", "x-y", "(a)"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 6, 10, 15, 25, 40, 70])]
    items += [(50, None), (51, ""), (52, "?!"), (6, items[6][1]), (None, " ".join(rnd.choice(vocab) for _ in range(12)))]
    docs = []
    for d in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 2)):
            t = (rnd.choice(items)[1] or "").split(" ")
            for _ in range(rnd.randint(0, max(1, len(t) // 4))):
                k, op = rnd.randrange(len(t)), rnd.random()
                t[k : k + 1] = [] if op < 0.3 else [rnd.choice(vocab)] if op < 0.7 else [t[k].upper(), "new"]
                t = t or ["z"]
            w += t + [rnd.choice(vocab) for _ in range(rnd.randint(0, 10))]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (None, items[6][1]), (3, docs[3][1]), (902, ("w1 " * 40000) + items[7][1])]
    want = set()
    for i, t in items:
        p = words(t)
        for d, x in docs:
            if p:
                best = min(semi_global(p, words(x))) if d != 902 else (0 if i == 7 else None)
                if best is not None and best <= int(0.2 * len(p)):
                    want.add((d, i, len(p), best))
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, distance int")
    bench = spark.createDataFrame([(*r, "q") for r in items], "item_id long, text string, source string")
    got = D.find_contamination(df, bench).collect()
    of = {}
    for d, t in docs:
        of.setdefault(d, words(t))
    assert {(r.doc_id, r.item_id, r.item_words, r.distance) for r in got if r.doc_id != 902 or r.item_id == 7} == want
    for r in got:
        p = next(words(t) for i, t in items if i == r.item_id and t)
        assert semi_global(p, of[r.doc_id][r.start_word : r.end_word])[-1] == r.distance
    monkeypatch.setattr(D, "SHARD_BYTES", 300)
    again = D.find_contamination(df, bench).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = D.drop_contaminated(df, bench)
    bad = {r.doc_id for r in got}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)
    assert kept.columns == df.columns
    assert D.find_contamination(df.limit(0), bench).count() == 0 and D.drop_contaminated(df, bench.limit(0)).count() == len(docs)
