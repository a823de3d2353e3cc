"""Bulk-synchronous best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; from then on only a narrow row per
piece moves.  Pieces are range-sorted by length over the cluster and ranked.
Best fit runs in supersteps, longest pieces first: all pieces of one length
look up their successor among the open gaps (the smallest gap that holds
them), rank decides which piece gets which gap, and the gaps are updated for
the next superstep.  Lengths and gaps are integers of 1 to ``capacity``, so the
sorted pieces and gaps are run-length coded: a superstep works on runs (equal
gaps with consecutive sequence numbers) and there are at most ``capacity`` of
them however large the corpus is.  The result equals best-fit decreasing over
single pieces.  Every piece then finds its run, sequence and offset from its
rank, in parallel.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, global_rank, written
from pagesift.session import ship_package

#: Texts are split at blanks into slices of about so many characters, and so
#: many distinct words are kept encoded per worker; both only bound memory.
SLICE_CHARS = 1 << 18
CACHE_WORDS = 400_000
END_ID = b"\0\0\0\0"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: A blank-separated word that is Latin letters and then ASCII marks other than
#: the apostrophe: its parts are encoded one by one.  These letters have no
#: other normal form and one lower-case letter each.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(i if i in printable else next(spare)) for i in range(256)]


class WordEncoder:
    """Token ids of texts by a tokenizer that never joins characters across a blank.

    Each distinct blank-separated word is encoded once and its ids are kept as
    little-endian 32-bit bytes.  Plain words go straight to the tokenizer's
    merges, all others through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.merge(spelt)])
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            plain = PLAIN.fullmatch(word)
            if plain:
                ids = self._part(plain[1].lower()) + self._part(plain[2])
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= SLICE_CHARS else text.find(" ", at + SLICE_CHARS)
            end = len(text) if end < 0 else end
            words = text[at:end].replace("\n", " ").split(" ")
            got = list(map(self.known.get, words))
            if None in got:
                got = [self._word(w) if g is None else g for w, g in zip(words, got)]
            out += got
            at = end
        for kept in (self.known, self.parts):
            if len(kept) > CACHE_WORDS:
                kept.clear()
                kept[""] = b""
        return b"".join(out)


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces of at most ``capacity`` ids.

    A document's ids are those of the tokenizer and then id 0; a null text
    counts as empty.  The vocabulary file (a parameter of a few MB) is read by
    the driver and broadcast.
    """
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = memoryview(encoder.ids(text.as_py() or "") + END_ID)
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    end = min(n, start + capacity)
                    for column, v in zip(rows, (doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]))):
                        column.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut_up, PIECES)


def best_fit_runs(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """Placement of the pieces by rank, longest first.

    ``lengths`` has the number of pieces by length.  One row per run: first
    rank, length, pieces per sequence, first sequence, offset in the sequence.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number of sequences)
    open_gaps: list[int] = []  # the gaps in use, ascending

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    runs, rank, opened = [], 0, 0
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            whole = min(n, left // each)
            if whole:
                runs.append((rank, length, each, first, capacity - gap))
                put(gap - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and 0 < left < each:
                runs.append((rank, length, left, first + whole, capacity - gap))
                put(gap - left * length, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            put(gap, first + whole, n - whole)
    return np.array(runs, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_runs(lengths, capacity)
    keys = [F.col("length").desc(), F.col(f"{OWN}row")]
    ranked = global_rank(pieces.withColumn(f"{OWN}row", F.monotonically_increasing_id()), keys, f"{OWN}rank").drop(f"{OWN}row")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy()
            first, length, each, sequence, offset = runs[np.searchsorted(runs[:, 0], rank, "right") - 1].T
            at = rank - first
            columns = [*b.columns[:-1], pa.array(sequence + at // each), pa.array(offset + at % each * length)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` ids as best fit finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  Only documents longer than a sequence are cut.  Null and empty
    texts are the single id 0; null ids and repeated rows are packed like any
    other; equal lengths are placed in any order; an empty table gives no
    rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    return place(written(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces"), capacity)
