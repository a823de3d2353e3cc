import numpy as np

from pagesift.llm import neighbours as N


def brute(rows, threshold=0.98):
    n = len(rows)
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    links = [0] * n
    unit = []
    for _, v, lab in rows:
        ok = v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)
        scaled = np.array(v) / np.max(np.abs(v)) if ok else None  # squares of huge numbers overflow
        unit.append(scaled / np.linalg.norm(scaled) if ok else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], links[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows)), key=str)


def make_rows(dim=16):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 5)) if c else 90):
            rows.append((centre + rng.standard_normal(dim) * rng.choice([0.0, 0.02, 0.1]), int(c % 3)))
    rows += [(rng.standard_normal(dim), int(i % 3)) for i in range(150)]
    return [(i, v.tolist(), lab) for i, (v, lab) in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<double>, label int, node string, kept int"


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in N.near_duplicate_vectors(df, **k).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 32)
    monkeypatch.setattr(N, "TILE", 20)
    rows = make_rows()
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0] * 16, None), (1005, [1.0] * 16, 7)]
    rows += [(1006, [2.0] * 16, 7), (1007, [1.0] * 8, 7), (1008, [], 7), (1009, [1e300] * 16, 7), (1005, [1.0] * 16, 7), (None, [1.0] * 16, 7), (None, [5.0, 1.0], 9)]
    assert run(spark, rows, list_size=8) == brute(rows)


def test_empty_and_one(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, [1.0, 2.0], 1)]) == [(4, 0, 4, True)]


def pairs(n=60, dim=16):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(n):
        x = rng.standard_normal(dim)
        rows += [x, x + rng.standard_normal(dim) * 0.1]
    return [(i, v.tolist(), 0) for i, v in enumerate(rows)]


def test_what_the_trees_miss_is_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "TILE", 20)
    rows = pairs() + [(900, [1.0] * 16, 1), (901, [1.0] * 15 + [1.1], 1), (902, [1.0] * 15 + [1.1], 1)]
    assert run(spark, rows, trees=1, rounds=0, growths=1, recall=1.0) == brute(rows)


def test_copies_do_not_outweigh_missed_links(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "TILE", 20)
    rng = np.random.default_rng(9)
    x = rng.standard_normal(16)
    rows = pairs() + [(1000 + i, x.tolist(), 0) for i in range(300)] + [(2000 + i, (x + rng.standard_normal(16) * 0.001).tolist(), 0) for i in range(30)]
    assert run(spark, rows, trees=1, rounds=0, growths=1, list_size=8, recall=1.0) == brute(rows)


def test_a_sample_without_links_is_enlarged(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(16).tolist(), 0) for i in range(150)] + [(1000 + i, v, 0) for i, v, _ in pairs(12)]
    assert run(spark, rows, trees=1, rounds=0, growths=1, audit_sample=2) == brute(rows)


def test_a_narrow_cone_is_split_into_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    rng = np.random.default_rng(11)
    x = rng.standard_normal(16) * 5 + rng.standard_normal((600, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, "a", 16, v.tobytes()) for i, v in enumerate(x)], "node long, label string, dim int, x binary")
    leaves = N._leaves(nodes, range(0, 2))
    assert leaves.count() == 1200 and leaves.groupBy("tree", "g").count().agg({"count": "max"}).first()[0] <= 32


def test_an_audit_is_bounded_where_links_are_rare(spark, monkeypatch):
    """Two pairs among 3000 vectors: the audit asks for its sample and for nodes that other trees link, not for all."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(32).tolist(), 0) for i in range(3000)] + [(5000 + i, v, 0) for i, v, _ in pairs(2, 32)]
    asked = []
    audited = N._audited
    monkeypatch.setattr(N, "_audited", lambda *a: (asked.append(a[4]), audited(*a))[1])
    got = run(spark, rows, audit_sample=50)
    assert sum(asked) <= 4 * (50 + N.LINKED)
    assert got == brute(rows)
