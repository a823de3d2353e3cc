"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Findings of the patterns always stay.  A candidate is any longer run of the
characters that secrets are made of; the network reads it together with the
characters around it and adds it if its calibrated probability reaches the
threshold of its kind of characters.  The network is trained on all labelled
findings of the table: candidates that a pattern confirms against those that
none does.  The confirmed ones are shown once more in the surroundings of an
unconfirmed one, so that it learns to tell a secret without the word that
announces it; on such ones, held out, the probabilities are calibrated and the
thresholds chosen: the highest ones that still find the asked share of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import written
from pagesift.session import prepare

# The patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "learned")
#: Every assignment has one of these in its lower-cased text.
ANNOUNCED = ("passw", "secret", "token", "api")

# both patterns begin where their run begins, which spares a try at every later place of a short run
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
LONG = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{24,}")
#: Code points read before a candidate, of it and after it; a longer one is read in overlapping tiles.
BEFORE, WITHIN, AFTER, STRIDE = 24, 56, 16, 40
WIDTH = BEFORE + WITHIN + AFTER
SPAN, FILTERS = 5, 24
#: Codes of a character: itself if it is printable ASCII, else other or none; again for those of the candidate.
CODES = 98
#: How far the loss of an unconfirmed candidate is bounded: at 1 / DOUBT.
DOUBT = 0.7
_CODE = np.full(256, 96, np.uint8)
_CODE[32:127] = np.arange(95)
_CODE[127:] = 95
_CODE[0] = 97


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the patterns find, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in assignments(text)]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run of hexadecimal digits is found as a whole, so its least length can be asked for at once, of the run around it too
    out += [(m.start(), 2, m.end()) for run in LONG.finditer(text) for m in HEX.finditer(text, *run.span())]
    return sorted(out)


def assignments(text: str) -> list[re.Match]:
    low = text.lower()
    return [m for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN] if any(word in low for word in ANNOUNCED) else []


def candidates(text: str, findings: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of all candidates that no finding touches."""
    at, reach = 0, 0
    spans = sorted((s, e) for s, _, e in findings)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= a:
            yield a, b


def tiles(start: int, end: int) -> range | list[int]:
    """Where the network begins to read a candidate."""
    return range(start, end - WITHIN + STRIDE, STRIDE) if end - start > WITHIN else [start]


def window(text: str, at: int, start: int, end: int) -> tuple[str, int, int]:
    """The characters around ``at`` and where the candidate begins and ends among them."""
    first = at - BEFORE
    shown = text[max(0, first) : at + WITHIN + AFTER] if end > at + WITHIN else text[max(0, first) : end + AFTER]
    return ("\0" * max(0, -first) + shown), max(0, start - first), min(end - first, BEFORE + WITHIN)


def encode(windows: list[tuple[str, int, int]]) -> np.ndarray:
    joined = "".join(w.ljust(WIDTH, "\0") for w, _, _ in windows)
    codes = _CODE[np.frombuffer(joined.encode("latin-1", "replace"), np.uint8).reshape(-1, WIDTH)].astype(np.intp)
    place = np.arange(WIDTH)
    inside = (place >= np.array([s for _, s, _ in windows])[:, None]) & (place < np.array([e for _, _, e in windows])[:, None])
    return codes + CODES * inside


def alphabet(found: str) -> int:
    """Kind of characters: 0 hexadecimal digits, 1 capitals and digits, 2 others."""
    return 0 if re.fullmatch("[0-9a-fA-F]+", found) else 1 if re.fullmatch("[0-9A-Z]+", found) else 2


@dataclass
class Network:
    """One convolution, rectified, its maximum over all places, one output; and what its output means."""

    tables: np.ndarray  # (SPAN, 2 * CODES, FILTERS): a convolution over one-hot codes is a sum of looked-up rows
    shift: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [1.1] * 3)  # above 1: adds nothing

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.3, (SPAN, 2 * CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS))

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter and its place."""
        places = WIDTH - SPAN + 1
        high, at = np.empty((len(codes), FILTERS), self.tables.dtype), np.empty((len(codes), FILTERS), np.intp)
        for i in range(0, len(codes), 32):  # few enough to stay in the cache
            part = codes[i : i + 32]
            total = self.tables[0].take(part[:, :places], axis=0)
            for k in range(1, SPAN):
                total += self.tables[k].take(part[:, k : places + k], axis=0)
            at[i : i + 32] = best = total.argmax(axis=1)
            high[i : i + 32] = np.take_along_axis(total, best[:, None, :], 1)[:, 0]
        return np.maximum(high + self.shift, 0), at

    def outputs(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(codes[i : i + 512])[0] @ self.weights + self.bias for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.outputs(codes) + self.offset, -35, 35)))

    def gradients(self, codes: np.ndarray, labels: np.ndarray, shares: np.ndarray | None = None) -> tuple[float, list]:
        """Mean loss and its slopes for tables, shift, weights and bias; ``shares`` weigh the rows.

        Logistic for confirmed rows.  That no pattern confirms a row does not make it
        harmless: its loss has a bound (``DOUBT``; 0 would be logistic), so that
        secrets among the unconfirmed ones are not learned by heart as harmless.
        """
        high, at = self.pooled(codes)
        z = np.clip(high @ self.weights + self.bias, -35, 35)
        p = 1 / (1 + np.exp(-z))
        shares = np.full(len(labels), 1 / len(labels)) if shares is None else shares / shares.sum()
        sure = np.exp(-DOUBT * np.logaddexp(0, z))  # (1 - p) ** DOUBT
        d = np.where(labels > 0, p - 1, p * sure) * shares
        dh = d[:, None] * self.weights * (high > 0)
        # where the largest values were looked up: table, code, filter
        place = at[:, None, :] + np.arange(SPAN)[:, None]
        looked = np.take_along_axis(codes[:, :, None], place.reshape(len(codes), -1, 1), 1).reshape(place.shape).astype(np.intp)
        cell = (np.arange(SPAN)[:, None] * 2 * CODES + looked) * FILTERS + np.arange(FILTERS)
        g = np.bincount(cell.ravel(), np.broadcast_to(dh[:, None, :], cell.shape).ravel(), self.tables.size).reshape(self.tables.shape)
        loss = float((shares * np.where(labels > 0, np.logaddexp(0, -z), (1 - sure) / DOUBT)).sum())
        return loss, [g, dh.sum(axis=0), high.T @ d, d.sum()]

    def fit(self, codes: np.ndarray, labels: np.ndarray, shares: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over mini-batches."""
        rng = np.random.default_rng(seed)
        values = self.parameters()
        mean, square = np.zeros_like(values), np.zeros_like(values)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                _, slopes = self.gradients(codes[part], labels[part], shares[part])
                g = np.concatenate([np.ravel(x) for x in slopes]).astype(np.float32)
                step += 1
                mean += np.float32(0.1) * (g - mean)
                square += np.float32(0.001) * (g * g - square)
                root = np.sqrt(square / np.float32(1 - 0.999**step))
                values -= np.float32(rate / (1 - 0.9**step)) * mean / (root + np.float32(1e-8))
                self.take(values)

    def parameters(self) -> np.ndarray:
        return np.concatenate([np.ravel(x) for x in (self.tables, self.shift, self.weights, self.bias)]).astype(np.float32)

    def take(self, values: np.ndarray) -> None:
        """Sets what ``parameters`` lists."""
        n = self.tables.size
        self.tables, self.shift = values[:n].reshape(self.tables.shape), values[n : n + FILTERS]
        self.weights, self.bias = values[n + FILTERS : n + 2 * FILTERS], float(values[-1])

    def calibrate(self, label: np.ndarray, kind: np.ndarray, cell: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt's sigmoid, and per kind the highest threshold that finds ``recall`` of its held-out findings.

        The held-out ones come as counts ``n`` per label, kind and cell of ``1 / GRID`` of
        the output; a threshold is the lower end of a cell.  A kind with fewer than
        20 of them takes the threshold of all.
        """
        z = (cell + 0.5) / GRID
        no, yes = n[label == 0].sum(), n[label == 1].sum()
        goal = np.where(label > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method on two parameters
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
            r, w = n * (p - goal), n * (p * (1 - p) + 1e-9)
            h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            change = np.linalg.solve(h, [(r * z).sum(), r.sum()])
            a, b = a - float(np.clip(change[0], -1, 1)), b - float(np.clip(change[1], -1, 1))
        self.slope, self.offset = max(a, 1e-3), b

        def threshold(own: np.ndarray) -> float:
            order = np.argsort(cell[own], kind="stable")
            below = np.cumsum(n[own][order])  # how many lie in a cell or under it
            found = cell[own][order][np.searchsorted(below, np.floor((1 - recall) * below[-1]), side="right")]
            return float(1 / (1 + np.exp(-np.clip(self.slope * found / GRID + self.offset, -35, 35))))

        for k in range(3):
            own = (label > 0) & (kind == k)
            self.thresholds[k] = threshold(own if n[own].sum() >= 20 else label > 0)


def labelled(text: str) -> Iterator[tuple[int, int, tuple[str, int, int]]]:
    """All confirmed and unconfirmed candidates: label, kind of characters, window."""
    found = base_findings(text)
    for label, spans in ((1, [(s, e) for s, k, e in found if k]), (0, candidates(text, found))):
        for s, e in spans:
            yield label, alphabet(text[s:e]), window(text, s, s, e)
    for m in assignments(text):  # an assignment is announced; what is assigned is the candidate
        yield 1, alphabet(m[2]), window(text, m.start(2), *m.span(2))


def moved(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """The codes of one candidate in the surroundings of another."""
    own, place = inner[inner >= CODES], np.flatnonzero(outer >= CODES)
    shown = np.concatenate([outer[: place[0]], own, outer[place[-1] + 1 :][:AFTER]])[:WIDTH]
    return np.concatenate([shown, np.full(WIDTH - len(shown), _CODE[0], np.uint8)])


#: Unconfirmed candidates per shard, and how many confirmed ones it has at least, if there are as many.
SHARD, LEAST = 8192, 512
#: Cells per unit of the network's output when held-out candidates are counted.
GRID = 256
#: The mean of whole numbers does not depend on the order of the shards.
FIXED = 2.0**32


def examples(docs: DataFrame, text_col: str) -> DataFrame:
    """``label, kind, codes``: every labelled candidate of every text as the network reads it, each once."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            label, kind, shown = zip(*rows)
            codes = pa.array([c.tobytes() for c in encode(list(shown)).astype(np.uint8)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(kind, pa.int32()), codes], ["label", "kind", "codes"])

        waiting = []
        for b in batches:
            for text in b.column(0).to_pylist():
                for row in labelled(text):
                    waiting.append(row)
                    if len(waiting) == 4096:
                        yield packed(waiting)
                        waiting.clear()
        if waiting:
            yield packed(waiting)

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(extract, "label int, kind int, codes binary").distinct()


def shards(found: DataFrame) -> DataFrame | None:
    """The ``examples`` in shards of bounded size, one row each; null without ten of both labels.

    A fifth of each label is held out, by hash.  Every other example trains in
    one shard at least; those of a label too rare for ``LEAST`` in every shard
    train in several, so that no shard learns from one label alone.
    """
    held = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "codes"), F.lit(5)) == 0
    salts = range(8)
    totals = {r.label: r for r in found.groupBy("label").agg(F.count("*").alias("n"), *[F.count_if(held(i)).alias(f"h{i}") for i in salts]).collect()}
    n = [totals[y].n if y in totals else 0 for y in (0, 1)]
    if min(n) < 10:
        return None
    # the first split that holds out a tenth of each label or more: a few examples may all fall on one side
    salt = max(salts, key=lambda i: (all(n[y] // 10 <= totals[y][f"h{i}"] <= n[y] // 2 for y in (0, 1)), -i))
    buckets = -(-max(n[0], n[1]) // SHARD)
    copies = [min(buckets, -(-LEAST * buckets // k)) for k in n]
    times = F.when(F.col("held"), 1).when(F.col("label") == 0, copies[0]).otherwise(copies[1])
    bucket = F.pmod(F.pmod(F.xxhash64("codes"), F.lit(buckets)) + F.col("copy"), F.lit(buckets)).cast("int")
    dealt = found.withColumn("held", held(salt)).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("bucket", bucket)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "kind", "codes"])
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, WIDTH)
        label, out = rows["label"].to_numpy(), rows["held"].to_numpy()
        rng = np.random.default_rng([7, key[0]])
        around = codes[label == 0]
        shown = codes.copy()
        if len(around):
            for i, o in zip(np.flatnonzero(label), rng.integers(len(around), size=int(label.sum()))):
                shown[i] = moved(codes[i], around[o])
        kept, kind = np.concatenate([codes[~out], shown[~out & (label == 1)]]), rows["kind"].to_numpy()
        labels = np.concatenate([label[~out], np.ones((~out & (label == 1)).sum())])
        parts = [kept.tobytes(), labels.astype(np.uint8).tobytes(), shown[out].tobytes(), (label[out] * 3 + kind[out]).astype(np.uint8).tobytes()]
        return pd.DataFrame([[key[0], *parts]], columns=["bucket", "codes", "labels", "held", "marks"])

    dealt = dealt.repartition(min(buckets, max(64, 4 * found.sparkSession.sparkContext.defaultParallelism)), "bucket")
    return dealt.groupBy("bucket").applyInPandas(pack, "bucket int, codes binary, labels binary, held binary, marks binary")


def _unpacked(batches: Iterator[pa.RecordBatch], codes: str, marks: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            shown, mark = (np.frombuffer(b.column(c)[i].as_py(), np.uint8) for c in (codes, marks))
            yield b.column("bucket")[i].as_py(), shown.reshape(-1, WIDTH), mark


def averaged(network: Network, dealt: DataFrame, epochs: int, seed: int) -> np.ndarray:
    """The mean of the parameters that every shard reaches from those of ``network``."""
    start = dealt.sparkSession.sparkContext.broadcast(network)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for bucket, codes, labels in _unpacked(batches, "codes", "labels"):
            yes = int(labels.sum())
            if not 0 < yes < len(labels):
                continue
            own = Network.fresh()
            own.take(start.value.parameters())
            own.fit(codes, labels.astype(np.float32), np.where(labels, max(1.0, (len(labels) - yes) / yes), 1.0), epochs, seed=[seed, bucket])
            total, n = total + np.rint(own.parameters() * FIXED).astype(np.int64), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total, n)], pa.list_(pa.int64()))], ["v"])

    sums = dealt.select("bucket", "codes", "labels").mapInArrow(fit, "v array<long>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v"))
    values = np.array([r.v for r in sums.orderBy("pos").collect()], np.float64)
    start.destroy()
    return (values[:-1] / values[-1] / FIXED).astype(np.float32) if len(values) else network.parameters()


def train(docs: DataFrame, text_col: str = "text", recall: float = 0.95, epochs: int = 6) -> Network:
    """A network trained and calibrated on all labelled findings of ``docs``.

    Every distinct candidate of every text is used, each in a shard of bounded
    size.  In every pass each shard trains by Adam from the same parameters and
    Spark averages what the shards reach; a single shard makes its passes at
    once.  A fifth is held out by hash: its outputs are counted in cells, and
    calibration and thresholds come from the counts of all.  Without ten
    confirmed and ten unconfirmed candidates the network adds nothing.
    """
    prepare(docs.sparkSession)
    network = Network.fresh()
    dealt = shards(written(examples(docs, text_col), "secret-examples"))
    if dealt is None:
        return network
    dealt = written(dealt, "secret-shards")
    single = dealt.count() == 1
    for i in range(1 if single else epochs):
        network.take(averaged(network, dealt, epochs if single else 1, i))
    model = docs.sparkSession.sparkContext.broadcast(network)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, marks in _unpacked(batches, "held", "marks"):
            cell = np.floor(np.clip(model.value.outputs(codes), -35, 35) * GRID).astype(np.int32)
            own, n = np.unique(np.stack([marks.astype(np.int32), cell]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int32()), pa.array(own[1], pa.int32()), pa.array(n, pa.int64())], ["mark", "cell", "n"])

    cells = dealt.select("bucket", "held", "marks").mapInArrow(counted, "mark int, cell int, n long").groupBy("mark", "cell").agg(F.sum("n").alias("n"))
    mark, cell, n = np.array(cells.orderBy("mark", "cell").collect(), np.int64).T
    network.calibrate(mark // 3, mark % 3, cell, n, recall)
    return network


class Scorer:
    """Scores the candidates of several texts together."""

    def __init__(self, network: Network):
        self.network = network
        self.active = min(network.thresholds) <= 1

    def learned(self, texts: list[str], found: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, float]]]:
        """Per text the spans and probabilities of all candidates that no pattern found."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if not self.active:
            return out
        waiting: list[tuple[str, int, int]] = []
        owners: list[tuple[int, int, int]] = []

        def flush() -> None:
            for (i, s, e), p in zip(owners, self.network.probabilities(encode(waiting)).tolist() if waiting else []):
                if out[i] and out[i][-1][0] == s:  # another tile of the same candidate
                    p = max(p, out[i].pop()[2])
                out[i].append((s, e, p))
            waiting.clear()
            owners.clear()

        for i, (text, own) in enumerate(zip(texts, found)):
            for s, e in candidates(text, own):
                for at in tiles(s, e):
                    waiting.append(window(text, at, s, e))
                    owners.append((i, s, e))
                if len(waiting) >= 2048:
                    flush()
        flush()
        return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base string, spans string, score double"


def scan_secrets(
    docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", **training
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_learned, base, spans, score`` of every row of ``docs``.

    ``base`` lists the spans of the patterns, ``spans`` those and the learned
    ones, as ``kind:start:end`` in code points by start, then kind; ``score`` is
    the highest probability of a candidate that no pattern found (0 if there is
    none).  Without a ``network`` one is trained on ``docs`` (see ``train``).
    Null texts count as empty; very long candidates are read in tiles and very
    long texts as a whole; null ids and repeated rows keep their row; an empty
    table gives none; other columns are not read.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(network or train(docs, text_col, **training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        limits = scorer.network.thresholds
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [base_findings(t) for t in texts]
                rows = []
                for text, own, scored in zip(texts, found, scorer.learned(texts, found)):
                    added = [(s, 3, e) for s, e, p in scored if p >= limits[alphabet(text[s:e])]]
                    counts = [sum(k == kind for _, k, _ in own) for kind in range(3)]
                    rows.append((*counts, len(added), listed(own), listed(sorted(own + added)), max((p for _, _, p in scored), default=0.0)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                columns = [part.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)

