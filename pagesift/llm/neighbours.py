"""Embedding near-dedup by NN-descent.

Equal vectors are one node.  A neighbour graph starts from leaves of random
hyperplane trees, whose members are compared with one another, and is refined
by neighbours-of-neighbours joins.  Each node keeps the best entries of its
list; where a list is saturated (all its entries are links) there may be more
links than it holds, and the lists of that component are enlarged to all its
members, compared in tiles.  Recall is audited against brute force on a bounded
sample of vectors, and further trees are grown while it is too low; if it stays
so, all pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut, written
from pagesift.llm.graph import connected_components
from pagesift.session import ship_package

#: Nodes that are compared with each other in one task step; leaves of over twice as many are split by further planes.
LEAF = 512
TILE = 1024
CODE_BITS = 30
#: Linked vectors that an audit has to hold, and the trees that name more of them where its sample holds fewer.
LINKED = 100
AUDIT_TREES = 3

EDGES = "u long, v long, sim double, star boolean"


def _unit_rows(vectors: list) -> tuple[list, list]:
    """Raw bytes and unit vector bytes per row; None where the vector links with nothing."""
    raw, unit = [], []
    for v in vectors:
        x = None if v is None or None in v else np.array(v, np.float64)
        top = np.abs(x).max() if x is not None and len(x) else 0.0
        if not top or not np.isfinite(top):
            raw.append(None)
            unit.append(None)
            continue
        scaled = x / top
        raw.append(x.tobytes())
        unit.append((scaled / math.sqrt(float(scaled @ scaled))).tobytes())
    return raw, unit


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(-1, dim)


def _block_components(close: np.ndarray) -> np.ndarray:
    """Smallest index each index reaches in a symmetric boolean matrix."""
    label = np.arange(len(close))
    while True:
        low = np.where(close, label[None, :], len(close)).min(axis=1)
        low = np.minimum(label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def compare_block(nodes: np.ndarray, x: np.ndarray, threshold: float, explore: float, size: int) -> list[np.ndarray]:
    """Columns ``u, v, sim, star``: each node's ``size`` best others above ``explore``, and a star per group of links."""
    sim = x @ x.T
    np.fill_diagonal(sim, -1.0)
    n = min(size, len(nodes) - 1)
    if n < 1:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, bool)]
    best = np.argpartition(sim, len(nodes) - n, axis=1)[:, len(nodes) - n :]
    value = np.take_along_axis(sim, best, 1)
    at = value >= explore
    i = np.nonzero(at)[0]
    u, v, s = nodes[i], nodes[best[at]], value[at]
    close = sim >= threshold
    linked = np.flatnonzero(close.any(axis=1))
    label = linked[_block_components(close[np.ix_(linked, linked)])] if len(linked) else linked
    far = label != linked
    su, sv = nodes[linked[far]], nodes[label[far]]
    return [np.r_[u, su], np.r_[v, sv], np.r_[s, np.ones(len(su))], np.r_[np.zeros(len(u), bool), np.ones(len(su), bool)]]


def _edge_table(columns: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["u", "v", "sim", "star"])


def _centres(members: DataFrame) -> DataFrame:
    """``(g, dim, n, centre)``: number and mean of the vectors of each group ``g``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for g, dim, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = sums.setdefault((g, dim), [0, np.zeros(dim)])
                own[0] += 1
                own[1] += np.frombuffer(x, np.float64)
        columns = [[k[0] for k in sums], [k[1] for k in sums], [v[0] for v in sums.values()], [v[1].tobytes() for v in sums.values()]]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "dim", "n", "s"])

    def total(table: pa.Table) -> pa.Table:
        n, dim = sum(table.column("n").to_pylist()), table.column("dim")[0].as_py()
        centre = _matrix(table.column("s"), dim).sum(axis=0) / n
        return pa.Table.from_arrays([table.column("g")[:1], table.column("dim")[:1], pa.array([n]), pa.array([centre.tobytes()], pa.binary())], ["g", "dim", "n", "centre"])

    sums = members.select("g", "dim", "x").mapInArrow(partial, "g long, dim int, n long, s binary")
    return sums.groupBy("g", "dim").applyInArrow(total, "g long, dim int, n long, centre binary")


def _split(members: DataFrame, centres: DataFrame, level: int) -> DataFrame:
    """``(node, tree, dim, g)`` after planes through the centre of each group, as many as bring its parts to ``LEAF``."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            tree, dims, n = (b.column(i).to_numpy() for i in (1, 2, 4))
            xs, centre = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            code = np.zeros(b.num_rows, np.int64)
            bits = np.clip(np.ceil(np.log2(n / LEAF)), 0, CODE_BITS).astype(np.int64)
            for t, dim in set(zip(tree.tolist(), dims.tolist())):
                at = np.flatnonzero((tree == t) & (dims == dim))
                if (t, dim) not in planes:
                    planes[t, dim] = np.random.default_rng([t, dim, level]).standard_normal((dim, CODE_BITS))
                x, c = (np.frombuffer(b"".join(v[at]), np.float64).reshape(-1, dim) for v in (xs, centre))
                code[at] = ((x - c) @ planes[t, dim] > 0) @ (1 << np.arange(CODE_BITS, dtype=np.int64)) & ((1 << bits[at]) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(code)], ["node", "tree", "dim", "g", "code"])

    joined = members.join(centres, ["g", "dim"]).select("node", "tree", "dim", "g", "n", "x", "centre")
    coded = joined.mapInArrow(codes, "node long, tree int, dim int, g long, code long")
    return coded.select("node", "tree", "dim", F.xxhash64("g", "tree", "code").alias("g"))


def _leaves(nodes: DataFrame, trees: range) -> DataFrame:
    """``(node, tree, dim, g)``: the leaf ``g`` of each node in each tree; only what no plane tells apart stays over ``2 * LEAF``."""
    start = nodes.select("node", "dim", "x", F.xxhash64("label", "dim").alias("g"))
    each = F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree")
    leaf = cut(_split(start.select("*", each), _centres(start), 0))
    left, level = None, 0
    while True:
        large = cut(leaf.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > 2 * LEAF))
        rows, groups = large.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        # the same rows in as many groups: equal directions
        if not rows or (rows, groups) == left:
            return leaf
        left, level = (rows, groups), level + 1
        over = cut(leaf.join(large, "g", "left_semi").join(nodes.select("node", "x"), "node"))
        leaf = cut(leaf.join(large, "g", "left_anti").unionByName(_split(over, _centres(over), level)))


def _leaf_edges(nodes: DataFrame, trees: range, threshold: float, explore: float, size: int) -> DataFrame:
    """Edges among the members of each leaf of each tree, within a label."""
    leaf = _leaves(nodes, trees)
    # equal directions, which no plane splits, are dealt into parts, differently in each tree
    parts = leaf.groupBy("g").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("int").alias("parts"))
    dealt = leaf.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    dealt = dealt.join(nodes.select("node", "label", "x"), "node").select("label", "dim", "tree", "g", "part", "node", "x")

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"), table.column("dim")[0].as_py())
        return _edge_table(compare_block(table.column("node").to_numpy(), x, threshold, explore, size))

    return dealt.groupBy("label", "dim", "tree", "g", "part").applyInArrow(run, EDGES)


def _best(edges: DataFrame, size: int) -> DataFrame:
    """Both directions of the edges, the ``size`` best per node; stars are kept as they are."""
    plain = edges.where("NOT star").select("u", "v", "sim")
    both = plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    both = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    lists = both.withColumn("r", rank).where(F.col("r") <= size).select("u", "v", "sim", F.lit(False).alias("star"))
    return lists.unionByName(edges.where("star").distinct())


def _descend(nodes: DataFrame, edges: DataFrame, threshold: float, explore: float, size: int) -> DataFrame:
    """One neighbours-of-neighbours join: the members of each node's list are compared with each other."""
    lists = edges.where("NOT star").select(F.col("u").alias("w"), F.col("v").alias("node"))
    lists = lists.unionByName(lists.select("w", F.col("w").alias("node")).distinct())
    members = lists.join(nodes.select("node", "dim", "x"), "node")

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"), table.column("dim")[0].as_py())
        return _edge_table(compare_block(table.column("node").to_numpy(), x, threshold, explore, size))

    return cut(_best(edges.unionByName(members.groupBy("w").applyInArrow(run, EDGES)), size))


def _tiled_links(members: DataFrame, by: list[str], threshold: float, stars: bool = False) -> DataFrame:
    """``(node, v, n, links)`` of all pairs of members of each group, compared tile by tile; no pair is emitted.

    ``n`` counts linked nodes, ``links`` their rows; both are to be summed up
    over a node.  With ``stars``, ``v`` is the first node that a tile's links reach.
    """
    # members are dealt to tiles by hash, so a group of any size is never one task
    placed = cut(members.select(*by, "node", "x", "mult", *[c for c in ("dim",) if c not in by]))
    tiles = placed.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = placed.join(tiles, by).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x"), table.column("dim")[0].as_py())
        node, tile, mult = (table.column(c).to_numpy() for c in ("node", "tile", "mult"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        close = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(close, False)
            out = [(node[a], close.sum(axis=1), close @ mult[b])]
        else:
            out = [(node[a], close.sum(axis=1), close @ mult[b]), (node[b], close.sum(axis=0), mult[a] @ close)]
            both = np.zeros((len(a) + len(b),) * 2, bool)
            both[: len(a), len(a) :], both[len(a) :, : len(a)] = close, close.T
            close = both
        ids, n, links = (np.concatenate(c).astype(np.int64) for c in zip(*out))
        linked = np.flatnonzero(n)
        v = ids[linked]
        if stars and len(linked):
            v = v[_block_components(close[np.ix_(linked, linked)])]
        return pa.Table.from_arrays([pa.array(c) for c in (ids[linked], v, n[linked], links[linked])], ["node", "v", "n", "links"])

    return dealt.groupBy(*by, "i", "j").applyInArrow(run, "node long, v long, n long, links long")


def _summed(tiled: DataFrame) -> DataFrame:
    return tiled.groupBy("node").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int, others: Callable[[], DataFrame]) -> float:
    """Share of the links of sampled nodes that was found, by brute force against all nodes.

    Links count once, whatever the copies of their ends.  The lower one of two
    shares: of all links of the sample, and on average over its linked nodes.
    ``sample`` nodes are drawn by hash.  Where fewer than ``LINKED`` of them
    have links, up to ``LINKED`` nodes are added from ``others()``: nodes that
    trees found links for which the graph was not built from.  So the sample
    stays bounded however rare links are; without any link at all the share is one.
    """
    drawn = [_audited(nodes, links, threshold, nodes, sample)]
    if drawn[0].linked < LINKED:
        drawn.append(_audited(nodes, links, threshold, nodes.join(others(), "node", "left_semi"), LINKED))
    linked, n, found, shares = (sum(r[i] or 0 for r in drawn) for i in range(4))
    return min(found / n, shares / linked) if n else 1.0


def _audited(nodes: DataFrame, links: DataFrame, threshold: float, source: DataFrame, sample: int):
    """Row ``(linked, n, found, shares)`` of the ``sample`` nodes of ``source`` with the least hashes."""
    queries = source.orderBy(F.xxhash64("node"), "node").select("node", "label", "dim", "x").limit(sample).collect()
    asked: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    groups: dict[tuple, list] = {}
    for q in queries:
        groups.setdefault((q.label, q.dim), []).append(q)
    for key, own in groups.items():
        asked[key] = (np.array([q.node for q in own]), np.stack([np.frombuffer(q.x, np.float64) for q in own]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if key in asked:
                    rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                ids, q = asked[key]
                node = b.column(0).to_numpy()[at]
                x = _matrix(b.column(3).take(pa.array(at)), key[1])
                for k in range(0, len(at), TILE):  # a bounded piece of the product at a time
                    close = (x[k : k + TILE] @ q.T >= threshold) & (node[k : k + TILE, None] != ids[None, :])
                    n = close.sum(axis=0)
                    for i in np.flatnonzero(n).tolist():
                        total[int(ids[i])] = total.get(int(ids[i]), 0) + int(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "n"])

    there = nodes.select("node", "label", "dim", "x").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    got = F.least(F.coalesce("got", F.lit(0)), "n")
    joined = there.join(links.select("node", F.col("n").alias("got")), "node", "left")
    return joined.agg(F.count("*").alias("linked"), F.sum("n").alias("n"), F.sum(got).alias("found"), F.sum(got / F.col("n")).alias("shares")).first()


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    explore: float = 0.9,
    list_size: int = 32,
    trees: int = 6,
    rounds: int = 2,
    recall: float = 0.98,
    audit_sample: int = 1000,
    growths: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows with equal labels link if the cosine of their vectors is at least
    ``threshold``; every link is checked in double precision.  A null label, and
    a vector that is null, empty or zero or holds a null or non-finite number,
    links with nothing; vectors of different lengths do not link.
    ``component_id`` is the smallest id reachable, ``kept`` tells whether it is
    the row's own.  Repeated rows keep their rows and link with each other.  A
    null id is reported as it is and never names a component of rows with ids.
    Trees are grown ``growths`` times at most, until the audited recall reaches
    ``recall``; if it never does, all pairs of a label are compared.  An empty table gives no rows; other columns are not read.
    """
    ship_package(vectors.sparkSession)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(1).to_pylist()
            raw, unit = _unit_rows(b.column(2).to_pylist())
            keys = [xxhash.xxh3_128_digest(f"{lab}\0".encode() + r) if r is not None and lab is not None else None for lab, r in zip(labels, raw)]
            unit = [x if k is not None else None for x, k in zip(unit, keys)]
            dims = [len(x) // 8 if x is not None else None for x in unit]
            columns = [b.column(0), pa.array(labels, pa.string()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "key", "dim", "x"])

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>"))
    rows = written(picked.mapInArrow(prepare, "vec_id long, label string, key binary, dim int, x binary"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("x").alias("x")
    )
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def unseen() -> DataFrame:
        """Nodes that trees of later numbers than any growth uses find links for."""
        others = _leaf_edges(nodes, range(growths * trees, growths * trees + AUDIT_TREES), threshold, explore, list_size)
        near = others.where(F.col("star") | (F.col("sim") >= threshold))
        return near.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    edges, links, roots = None, None, None
    for growth in range(growths):
        more = _leaf_edges(nodes, range(growth * trees, (growth + 1) * trees), threshold, explore, list_size)
        edges = cut(_best(more if edges is None else edges.unionByName(more), list_size))
        for _ in range(rounds):
            edges = _descend(nodes, edges, threshold, explore, list_size)
        near = edges.where(F.col("star") | (F.col("sim") >= threshold))
        roots = cut(connected_components(near, "u", "v"))
        listed = near.where("NOT star").select("u", "v")
        listed = listed.unionByName(listed.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        counts = listed.join(nodes.select(F.col("node").alias("v"), "mult"), "v").groupBy("u").agg(F.count("*").alias("n"), F.sum("mult").alias("links"))
        counts = cut(counts.withColumnRenamed("u", "node").join(roots, "node"))
        full = counts.where(F.col("n") >= list_size).select("root").distinct()
        members = roots.join(full, "root", "left_semi").join(nodes.select("node", "dim", "x", "mult"), "node")
        enlarged = _summed(_tiled_links(members, ["root"], threshold))
        links = cut(counts.join(full, "root", "left_anti").select("node", "n", "links").unionByName(enlarged))
        if _audit(nodes, links, threshold, audit_sample, unseen) >= recall:
            break
    else:  # the graph misses too much: every pair is compared
        tiled = cut(_tiled_links(nodes, ["label", "dim"], threshold, stars=True))
        roots, links = cut(connected_components(tiled.select(F.col("node").alias("u"), "v"), "u", "v")), cut(_summed(tiled))

    found = nodes.select("node", "key", "rep", "mult").join(roots, "node", "left").join(links.drop("n"), "node", "left")
    found = found.withColumn("root", F.coalesce("root", "node"))
    lowest = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    result = cut(found.join(lowest, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"))
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = rows.select("vec_id", "key").join(result, "key", "left").withColumn("component_id", own)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
