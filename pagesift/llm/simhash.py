"""SimHash near-dedup by segment popcounts.

A fingerprint is mapped to the number of set bits in each of its segments.
The Manhattan distance of two such vectors is a lower bound of the Hamming
distance, so links are looked for among close vectors: with a bound of ``d``
differing bits, one half of the segments differs by at most ``d // 2``, and two
vectors that close have a common grid cell within ``ceil(d // 2 / 2)`` steps of
both.  Dealing the fingerprints to those cells brings every candidate pair
together; the exact bit distance is checked where a cell is read.

A cell of a dense group of near copies has the square of its size in pairs, so
cells do not send pairs but stars: each fingerprint with the smallest one that
it reaches by links in the cell, at most one row each.  A cell that does not
fit is read in parts, and compared in tiles unless the stars of the first pass
already make it one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut, written
from pagesift.llm.graph import connected_components
from pagesift.llm.shingles import simhash
from pagesift.session import ship_package

#: Segments of two bits: the finest whose counts are not the bits themselves.
SEGMENT_BITS = 2
SALTS = 16
_EVEN_BITS = np.uint64(0x5555555555555555)


def fingerprints(docs: DataFrame, n_words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t.as_py() or b"", n_words, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def popcount_vectors(fps: np.ndarray) -> np.ndarray:
    """The 32 segment counts (0 to 2) of each fingerprint, one per row."""
    packed = (fps & _EVEN_BITS) + ((fps >> np.uint64(1)) & _EVEN_BITS)
    return ((packed[:, None] >> np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)) & np.uint64(3)).astype(np.int8)


def grid_cells(vectors: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """All cells within ``steps`` single steps of each vector: row numbers and cell numbers (base 3)."""
    weights = 3 ** np.arange(vectors.shape[1], dtype=np.int64)
    rows, cells = np.arange(len(vectors)), vectors
    out_rows, out_cells = [rows], [cells @ weights]
    for _ in range(steps):
        next_rows, next_cells = [], []
        for k in range(vectors.shape[1]):
            for step in (-1, 1):
                ok = (cells[:, k] + step >= 0) & (cells[:, k] + step <= SEGMENT_BITS)
                moved = cells[ok].copy()
                moved[:, k] += step
                next_rows.append(rows[ok])
                next_cells.append(moved)
        rows, cells = np.concatenate(next_rows), np.concatenate(next_cells)
        out_rows.append(rows)
        out_cells.append(cells @ weights)
    rows, cells = np.concatenate(out_rows), np.concatenate(out_cells)
    if steps > 1:
        both = np.unique(np.stack([rows, cells], 1), axis=0)
        rows, cells = both[:, 0], both[:, 1]
    return rows, cells


def cells_of(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``(cell, fp)``: every grid cell in which a fingerprint can meet one that differs in at most ``max_bits`` bits."""
    steps = -(-(max_bits // 2) // 2)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                fps = b.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
                vectors = popcount_vectors(fps.view(np.uint64))
                half = vectors.shape[1] // 2
                for k, part in enumerate((vectors[:, :half], vectors[:, half:])):
                    rows, cell = grid_cells(part.astype(np.int64), steps)
                    yield pa.RecordBatch.from_arrays([pa.array(cell * 2 + k), pa.array(fps[rows])], ["cell", "fp"])

    return distinct.select("fp").mapInArrow(cells, "cell long, fp long")


def near_pairs(distinct: DataFrame, max_bits: int) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    As many rows as there are links; ``near_links`` is enough for components.
    """
    grid = cells_of(distinct, max_bits)
    left, right = grid.select("cell", F.col("fp").alias("a")), grid.select("cell", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, "cell").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def _stars(cells: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint and the smallest one it reaches by links in its cell; ``cells`` are sorted, ``fps`` within them."""
    n = len(cells)
    label = np.arange(n)
    bits = fps.view(np.uint64)
    lefts, rights = [], []
    step = 1
    while step < n:
        at = np.flatnonzero(cells[:-step] == cells[step:])
        if not len(at):
            break
        at = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= max_bits]
        lefts.append(at)
        rights.append(at + step)
        step += 1
        if step % 64 == 0:  # keep the pairs in memory few
            lefts, rights = _merge(label, lefts, rights)
    _merge(label, lefts, rights)
    told = label != np.arange(n)
    return fps[told], fps[label[told]]


def _merge(label: np.ndarray, lefts: list, rights: list) -> tuple[list, list]:
    """Give every place the smallest label that it reaches by the pairs and by the labels it has."""
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    own = np.arange(len(label))
    a, b = np.r_[a, own], np.r_[b, label]
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]
        if (before == label).all():
            return [], []


LINKS = "a long, b long, large long"


def _cell_links(grid: DataFrame, max_bits: int, most: int | None) -> DataFrame:
    """``a, b`` stars of every cell; a cell of more than ``most`` fingerprints is read in parts and named in ``large``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def send(cells, fps, large):
            a, b = _stars(cells, fps, max_bits)
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            rows = np.concatenate([pairs, np.zeros((len(large), 2), np.int64)])
            named = pa.array([None] * len(pairs) + large, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), named], ["a", "b", "large"])

        for b in batches:
            cells = np.r_[cells, b.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, b.column(1).to_numpy(zero_copy_only=False)]
            if len(cells) < 20_000:
                continue
            # the last cell may go on in the next batch
            end = int(np.searchsorted(cells, cells[-1]))
            large: list[int] = []
            if most is not None and len(cells) - end > most:
                end, large = len(cells), [int(cells[-1])]
            if end:
                yield send(cells[:end], fps[:end], large)
                cells, fps = cells[end:], fps[end:]
        if len(cells):
            yield send(cells, fps, [])

    return grid.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, LINKS)


def near_links(distinct: DataFrame, max_bits: int, most: int = 4096) -> DataFrame:
    """``(a, b)`` pairs that connect the distinct fingerprints ``fp`` as the links of at most ``max_bits`` bits do.

    The two of a pair are connected by links, not always directly.  At most one
    row per fingerprint and cell; a cell of more than about ``most``
    fingerprints is compared in tiles if it has several components by then.
    """
    grid = cells_of(distinct, max_bits)
    found = cut(_cell_links(grid, max_bits, most))
    links = found.where("large IS NULL").select("a", "b")
    large = cut(found.where("large IS NOT NULL").select(F.col("large").alias("cell")).distinct())
    if large.isEmpty():
        return links
    roots = connected_components(links).withColumnRenamed("node", "fp")
    members = grid.join(large, "cell").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = cut(members)
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = sizes.where("low < high").select("cell", F.ceil(F.col("n") / F.lit(most // 4)).cast("int").alias("k"))
    # every two tiles of a cell meet in one place
    tile = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    met = members.join(sizes, "cell").select("cell", "fp", tile.alias("t"), other.alias("u"))
    met = met.select(F.xxhash64("cell", F.least("t", "u"), F.greatest("t", "u")).alias("cell"), "fp")
    return links.unionByName(cut(_cell_links(met, max_bits, None)).select("a", "b"))


def near_duplicates(
    docs: DataFrame, n_words: int = 4, max_bits: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Texts are compared by the SimHash of their ``n_words``-word shingles; rows
    whose fingerprints differ in at most ``max_bits`` bits are linked, and
    ``component_id`` is the smallest id reachable by links.  Equal fingerprints
    are one node, so a group of copies of any size costs one.  Null texts count
    as empty (fingerprint 0, linked like any other); a row with a null id gets
    the smallest other id of its group, or null; repeated rows keep their
    rows; an empty table gives none; other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = written(fingerprints(docs, n_words, seed, id_col, text_col), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = connected_components(near_links(nodes, max_bits))
    of = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    linked = of.where("root IS NOT NULL")
    lowest = linked.groupBy("root").agg(F.min("lowest").alias("component_id"))
    # a component of very many fingerprints is dealt to several tasks
    spread = lowest.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    alone = of.where("root IS NULL").select("fp", F.col("lowest").alias("component_id"))
    components = cut(salted.join(spread, ["root", "salt"]).select("fp", "component_id").unionByName(alone))
    return rows.join(components, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: the document of each group with its smallest id stays.

    Ids name documents: of rows that repeat a kept id one stays.  A row without
    an id counts as named by its text, after all others.
    """
    ship_package(docs.sparkSession)
    own = f"{OWN}id"
    nameless = F.xxhash64(F.coalesce(text_col, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), nameless))
    found = near_duplicates(named, n_words, max_bits, 42, own, text_col)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias(f"{OWN}n"))
    stay = cut(first.select(F.col("doc_id").alias(own), f"{OWN}n"))
    kept = named.join(stay.select(own), own, "left_semi")
    if not stay.where(F.col(f"{OWN}n") > 1).isEmpty():
        kept = kept.dropDuplicates([own])
    return kept.select(*docs.columns)
