"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A row's score is a bias, linear weights and all pairwise interactions of its
features through low-rank vectors.  The sum over pairs is taken in time linear
in the features: half of (square of the sum minus sum of the squares) in each
of the ``RANK`` dimensions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.session import ship_package

WORD_BUCKETS = 1 << 14
RANK = 8
BINS = 12
FOLDS = 5
N_STATISTICS = 16
SIZE = WORD_BUCKETS + N_STATISTICS * (BINS + 1)

_KIND = np.zeros(256, np.int64)  # 0 symbol, 1 upper, 2 lower, 3 digit, 4 white space, 5 sentence mark, 6 not ASCII
for _c in range(256):
    ch = chr(_c)
    _KIND[_c] = (
        6 if _c >= 128 else 1 if "A" <= ch <= "Z" else 2 if "a" <= ch <= "z" else 3 if ch.isdigit() else 4 if _c <= 32
        else 5 if ch in ".,;:'?\"()-" else 0
    )


def statistics(text: bytes, words: list[bytes], n_chars: int | None) -> np.ndarray:
    """Structure of a text in numbers from 0 to 1; ``n_chars`` is the declared length."""
    n, m = max(len(text), 1), max(len(words), 1)
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    symbol, upper, lower, digit, _, mark, other = (np.bincount(_KIND, octets, 7)).tolist()
    letters = max(upper + lower + other, 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words[1:], words)) if len(words) > 1 else 0
    longest = max(map(len, words), default=0)
    values = (
        np.log1p(len(text)) / 14,
        np.log1p(max(n_chars if n_chars is not None else len(text), 0)) / 14,
        np.log1p(len(words)) / 12,
        sum(map(len, words)) / m / 20,
        longest / 60,
        upper / letters,
        digit / n,
        mark / n * 5,
        symbol / n * 3,
        octets[33] / m,
        octets[124] / m,
        repeated / m,
        len(set(words)) / m,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)) / 8,
        other / n,
    )
    return np.clip(np.array(values, np.float64), 0.0, 1.0)


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a row's features."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    buckets = np.fromiter(map(zlib.crc32, raw.lower().split()), np.int64, len(words)) % WORD_BUCKETS
    index, count = np.unique(buckets, return_counts=True)
    weight = np.log1p(count)
    weight /= max(np.sqrt(weight @ weight), 1e-9)
    stats = statistics(raw, words, n_chars)
    k = np.arange(N_STATISTICS)
    binned = WORD_BUCKETS + k * (BINS + 1) + np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    value = WORD_BUCKETS + k * (BINS + 1) + BINS
    scale = 1 / np.sqrt(N_STATISTICS)
    return np.r_[index, binned, value], np.r_[weight, np.full(N_STATISTICS, scale), stats * scale]


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def empty(cls, seed: int = 0) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        return cls(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        total = v.sum(axis=0)
        z = self.bias + self.linear[index] @ value + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rate: float, penalty: float, batch: int = 128, seed: int = 0) -> None:
        """AdaGrad on the logistic loss over mini-batches of rows in CSR form."""
        rng = np.random.default_rng(seed)
        sums = [1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)]
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                first = np.r_[0, np.cumsum(sizes)[:-1]]
                v = self.factors[index] * value[:, None]
                total = np.add.reduceat(v, first, axis=0)
                pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), first))
                z = self.bias + np.add.reduceat(self.linear[index] * value, first) + pairs
                slope = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]) / len(part)
                each = np.repeat(slope, sizes) * value
                used, back = np.unique(index, return_inverse=True)
                g_linear = np.bincount(back, each, len(used)) + penalty * self.linear[used]
                g_each = each[:, None] * (np.repeat(total, sizes, axis=0) - v)
                g_factors = np.stack([np.bincount(back, g_each[:, f], len(used)) for f in range(RANK)], 1) + penalty * self.factors[used]
                g_bias = float(slope.sum())
                sums[0] += g_bias**2
                sums[1][used] += g_linear**2
                sums[2][used] += g_factors**2
                self.bias -= rate * g_bias / np.sqrt(sums[0])
                self.linear[used] -= rate * g_linear / np.sqrt(sums[1][used])
                self.factors[used] -= rate * g_factors / np.sqrt(sums[2][used])


def fold(id_col: str) -> Column:
    """Remainder of the id's CRC-32 (of its decimal text); a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
    label_col: str = "quality", train_rows: int = 12_000, epochs: int = 8, rate: float = 0.1, penalty: float = 1e-6,
) -> FactorisationMachine:
    """Fit on at most ``train_rows`` labelled rows outside fold 0, drawn by the hash of their ids.

    That bound also bounds what is broadcast (ids) and what reaches the driver
    (features): of rows that share an id the one with the least text hash is
    read.  Ids with contradicting labels are left out.
    """
    ship_package(docs.sparkSession)
    machine = FactorisationMachine.empty()
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).cast("long").alias("_ps_id")).agg(F.min(label_col).alias("_ps_y"), F.max(label_col).alias("_ps_y2"))
    drawn = known.where("_ps_y = _ps_y2").orderBy(F.xxhash64("_ps_id"), "_ps_id").limit(train_rows).select("_ps_id", "_ps_y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), n) for t, n in zip(b.column(1), b.column(2).to_pylist())]
            columns = [b.column(0), b.column(3), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "index", "value"])

    length = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    picked = docs.select(F.col(id_col).cast("long").alias("_ps_id"), F.col(text_col).alias("_ps_text"), length.alias("_ps_n"))
    one = F.min_by(F.struct("_ps_text", "_ps_n", F.col("_ps_y").cast("int").alias("_ps_y")), F.struct(F.xxhash64("_ps_text"), "_ps_n"))
    sample = picked.join(F.broadcast(drawn), "_ps_id").groupBy("_ps_id").agg(one.alias("_ps_one")).select("_ps_id", "_ps_one.*")
    table = sample.mapInArrow(extract, "id long, y int, index array<int>, value array<float>").toArrow()
    if not table.num_rows:
        return machine
    rows = []
    for index, value in zip(table.column("index").combine_chunks(), table.column("value").combine_chunks()):
        rows.append((index.values.to_numpy().astype(np.int64), value.values.to_numpy().astype(np.float64)))
    labels_ = table.column("y").to_numpy().astype(np.float64)
    # the same rows in the same order however the tables are partitioned
    order = np.lexsort(([len(r[0]) for r in rows], table.column("id").to_numpy()))
    machine.fit([rows[i] for i in order], labels_[order], epochs, rate, penalty)
    return machine


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
    length_col: str = "n_chars", label_col: str = "quality", train_rows: int = 12_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    ``score`` is the probability of label 1, ``predicted`` is 1 from
    ``threshold`` on; ``held_out`` rows (fold 0) give no labels to the training.
    Null texts count as empty, a null length as that of the text; empty texts
    are scored by their statistics.  Without any label every score is about one
    half.  Null ids and repeated rows keep their row; an empty table gives no
    rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, length_col, label_col, train_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = machine.value
        for b in batches:
            s = np.array([model.score(*features(t.as_py(), n)) for t, n in zip(b.column(2), b.column(3).to_pylist())], np.float64)
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    length = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col), length)
    return picked.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
