"""Benchmark decontamination by pigeonhole edit matching.

An item of ``n`` words may differ in ``k`` words (inserted, lost or replaced).
Cut into ``k + 1`` pieces, at least one piece is untouched in any such copy, so
exact hits of pieces find every candidate place.  The documents are streamed
through one automaton of all pieces; the words around a hit are verified with
Myers' bit-parallel edit distance, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN
from pagesift.session import ship_package

#: Bytes of item text that are broadcast at once; a larger benchmark is matched shard by shard.
SHARD_BYTES = 16 << 20

_BLANKS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def match_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


def edit_ends(pattern: list[bytes], text: list[bytes]) -> list[int]:
    """Myers: for each end in ``text`` the least edits that turn ``pattern`` into some run of words ending there."""
    n = len(pattern)
    masks: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = full, 0, n, []
    for w in text:
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        out.append(score)
    return out


def best_place(pattern: list[bytes], text: list[bytes]) -> tuple[int, int, int]:
    """Least distance of ``pattern`` to a run of ``text``, and the run's start and end (the first end, the shortest run)."""
    ends = edit_ends(pattern, text)
    if not ends:
        return len(pattern), 0, 0
    distance = min(ends)
    if distance >= len(pattern):
        return len(pattern), 0, 0
    end = ends.index(distance) + 1
    back = edit_ends(pattern[::-1], text[:end][::-1])
    return distance, end - (back.index(distance) + 1), end


@dataclass
class Items:
    """Items of one shard: their words, edit budgets and the pieces that lead to them."""

    ids: list
    words: list[list[bytes]]
    budgets: list[int]
    pieces: dict[bytes, list[tuple[int, int]]]

    @classmethod
    def build(cls, rows: list[tuple], max_edit_share: float) -> Items:
        out = cls([], [], [], {})
        for item_id, text in rows:
            words = match_words(text or "")
            if not words:
                continue
            budget = int(max_edit_share * len(words))
            cuts = np.linspace(0, len(words), budget + 2).round().astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                out.pieces.setdefault(b" ".join(words[a:b]), []).append((len(out.ids), a))
            out.ids.append(item_id)
            out.words.append(words)
            out.budgets.append(budget)
        return out

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for piece, at in self.pieces.items():
            a.add_word(f" {piece.decode('latin-1')} ", (piece.count(b" ") + 1, at))
        if self.pieces:
            a.make_automaton()
        return a

    def matches(self, automaton, text: str) -> list[tuple]:
        """``(item id, words of the item, distance, start, end)`` of each item found, at its best place."""
        words = match_words(text)
        hits: dict[int, set[int]] = {}
        if words and self.pieces:
            ends = None
            for end, (n, at) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
                if ends is None:
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                first = int(np.searchsorted(ends, end)) - n + 1
                for item, offset in at:
                    hits.setdefault(item, set()).add(first - offset)
        found = []
        for item, starts in hits.items():
            pattern, budget = self.words[item], self.budgets[item]
            best: tuple | None = None
            low = high = None
            # places whose windows overlap are read as one
            for s in [*sorted(starts), None]:
                if s is not None and high is not None and s - budget <= high:
                    high = max(high, s + len(pattern) + budget)
                    continue
                if low is not None:
                    distance, a, b = best_place(pattern, words[low:high])
                    if distance <= budget and (best is None or distance < best[0]):
                        best = (distance, low + a, low + b)
                if s is not None:
                    low, high = max(0, s - budget), s + len(pattern) + budget
            if best is not None:
                found.append((self.ids[item], len(pattern), *best))
        return sorted(found, key=lambda f: (f[0] is None, f[0] or 0, f[3]))


RESULT = "doc_id long, item_id long, item_words int, distance int, start_word long, end_word long, {own}text_hash long"


def _scan(docs: DataFrame, items: Items) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        automaton = own.automaton()
        for b in batches:
            rows = []
            for doc, text, key in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                rows += [(doc, *m, key) for m in own.matches(automaton, text.as_py() or "")]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 7
            names = ["doc_id", "item_id", "item_words", "distance", "start_word", "end_word", f"{OWN}text_hash"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.mapInArrow(run, RESULT.format(own=OWN))


def _matches(docs: DataFrame, benchmark: DataFrame, max_edit_share: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    shards = int(size // SHARD_BYTES + 1)
    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.col(text_col)))
    out = None
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k).collect()
        found = _scan(picked, Items.build(sorted(rows, key=lambda r: (r.i is None, r.i or 0, r.t or "")), max_edit_share))
        out = found if out is None else out.unionByName(found)
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edit_share: float = 0.2,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``doc_id, item_id, item_words, distance, start_word, end_word``: the place
    with the fewest word edits (the first of these), if they are at most
    ``max_edit_share`` of the item's words, rounded down.  Words are lower-cased
    and lose ASCII punctuation.  Null and empty texts and items match nothing;
    null ids are carried; repeated document rows each give their rows, repeated
    items count once; empty tables give no rows; other columns are not read.
    """
    ship_package(docs.sparkSession)
    return _matches(docs, benchmark, max_edit_share, id_col, text_col, item_col, item_text_col).drop(f"{OWN}text_hash")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, max_edit_share: float = 0.2, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    ship_package(docs.sparkSession)
    found = _matches(docs, benchmark, max_edit_share, id_col, text_col, item_col, item_text_col)
    bad = found.select(F.col("doc_id").alias(f"{OWN}id"), f"{OWN}text_hash").distinct()
    on = F.col(id_col).cast("long").eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{OWN}text_hash"))
    return docs.join(bad, on, "left_anti")
