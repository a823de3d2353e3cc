"""Removal of passages that an earlier document has, by repeated-phrase automata.

A window of ``window`` words recurs only if its least phrase (the ``phrase``-word
run in it with the smallest hash) recurs, so the phrases that are least in some
window are a sample of the corpus that misses no repeat.

1. The documents are dealt into blocks of bounded size, kept as a table that is
   bucketed by block, so that a block's documents and what is found out about
   them meet without moving the texts again.
2. Each block sends its distinct least phrases; those that two documents have
   are confirmed and reported to the blocks that have them.
3. Each block compiles its confirmed phrases into Aho-Corasick automata and
   streams its documents through them, which locates every occurrence.  The
   automata read word numbers, two letters each, which the block gives out;
   they have fewer states than those of the spelled words.  Windows around an occurrence are numbered and sent, one
   row per block with the smallest id there; where they are is sent along as a
   note of the block to itself.
4. The numbers of the windows of which another block has a smaller id come back
   with that note, and the block marks the covered words of each document.

A block sends a phrase or window once however many of its documents have it, so
a passage that very many documents share costs one entry per block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut
from pagesift.llm.shingles import blank_words
from pagesift.session import new_scratch_path, prepare

#: Bytes of text in a block and bytes of text behind one exchange group; they bound a task's memory.
BLOCK_BYTES = 2 << 20
GROUP_BYTES = 32 << 20
#: Phrases in one automaton; a block with more compiles several and streams its documents through each.
SHARD_PHRASES = 100_000
NO_ID = (1 << 63) - 1

# Odd 64-bit multipliers of the rolling and mixing hashes.
_ROLL, _CHECK, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_MOST = np.uint64((1 << 64) - 1)

MESSAGE = f"{OWN}group int, {OWN}block int, {OWN}note boolean, {OWN}data binary"
REPLY = f"{OWN}block int, {OWN}note boolean, {OWN}data binary"
#: Letters of the automata.  A state looks its next state up among as many at worst; two letters name 360,000 words,
#: about as many as a block has, and a block with more takes three.
CHARACTERS = 600


def _rolled(words: np.ndarray, n: int, multiplier: np.uint64) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * multiplier + words[k : k + len(out)]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.r_[True, sorted_values[1:] != sorted_values[:-1]] if len(sorted_values) else np.zeros(0, bool)


def by_id(docs: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """Rows in the same order whenever a block is read: rows that tie have the same words."""
    return docs.take(pc.sort_indices(docs, [(id_col, "ascending"), (text_col, "ascending")], null_placement="at_end"))


def split(docs: pa.Table, text_col: str) -> tuple[list[bytes], np.ndarray]:
    """The words of all documents, one after the other, and where each document's begin and end."""
    words, bounds = [], [0]
    for text in docs.column(text_col):
        words += blank_words(text.as_py() or b"")
        bounds.append(len(words))
    return words, np.array(bounds)


class Block:
    """The words of a block's documents, one after the other, in the order of their ids."""

    def __init__(self, docs: pa.Table, id_col: str, text_col: str, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.ids = docs.column(id_col).combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.words, self.bounds = split(docs, text_col)
        n = len(self.words)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        starts = max(0, n - window + 1)
        # windows that lie in one document
        self.whole = np.flatnonzero(self.row[:starts] == self.row[window - 1 :]) if starts else np.zeros(0, np.int64)

    def least_phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrase at each word, and the smallest of those in each whole window."""
        at = _rolled(self.hashes, self.phrase, _ROLL)
        return at, self._window_min(at)

    def _window_min(self, at: np.ndarray) -> np.ndarray:
        n = max(0, len(self.words) - self.window + 1)
        low = at[:n].copy()
        for k in range(1, self.window - self.phrase + 1):
            np.minimum(low, at[k : k + n], out=low)
        return low[self.whole]

    def window_keys(self) -> np.ndarray:
        """A 96-bit key of each whole window, as (u8, u4) records."""
        keys = np.empty(len(self.whole), [("a", "<u8"), ("b", "<u4")])
        keys["a"] = _rolled(self.hashes, self.window, _ROLL)[self.whole]
        keys["b"] = (_rolled(self.hashes, self.window, _CHECK)[self.whole] >> np.uint64(32)).astype(np.uint32)
        return keys

    def spelled(self, characters: int = CHARACTERS) -> tuple[str, int]:
        """The words' numbers written with ``characters`` digits, and the number of digits of each."""
        distinct, number = np.unique(self.hashes, return_inverse=True)
        width = 1
        while characters**width < len(distinct):
            width += 1
        points = np.empty((len(number), width), "<u4")
        for k in range(width):
            number, points[:, k] = np.divmod(number, characters)
        points[points >= 0xD800] += 0x800
        return points.tobytes().decode("utf-32-le"), width

    def located(self, confirmed: np.ndarray, characters: int = CHARACTERS) -> np.ndarray:
        """Windows (numbers into ``whole``) whose least phrase is a confirmed one, by automata over the documents."""
        import ahocorasick

        at, least = self.least_phrases()
        known = np.flatnonzero(np.isin(at, confirmed))
        _, first = np.unique(at[known], return_index=True)
        text, width = self.spelled(characters)
        phrases = [text[i * width : (i + self.phrase) * width] for i in known[first].tolist()]
        found = np.zeros(len(at), bool)
        for start in range(0, len(phrases), SHARD_PHRASES):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in phrases[start : start + SHARD_PHRASES]:
                automaton.add_word(p)
            automaton.make_automaton()
            for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
                if b - a < self.window:
                    continue
                ends = np.array([end for end, _ in automaton.iter(text[a * width : b * width])], np.int64) + 1
                ends = ends[ends % width == 0] // width
                found[ends + a - self.phrase] = True
        return np.flatnonzero(self._window_min(np.where(found, at, _MOST)) == least)


def _send(groups: int, block: int, records: np.ndarray) -> pa.Table:
    """One message per exchange group with the records whose key falls into it."""
    group = (records["a"] % np.uint64(groups)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    records, group = records[order], group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    parts = [records[a:b].tobytes() for a, b in zip(first, [*first[1:], len(group)])]
    return _messages(group[first].tolist() if len(group) else [], block, False, parts)


def _messages(groups: list[int], block: int, note: bool, parts: list[bytes]) -> pa.Table:
    arrays = [pa.array(groups, pa.int32()), pa.array([block] * len(parts), pa.int32()), pa.array([note] * len(parts), pa.bool_()), pa.array(parts, pa.binary())]
    return pa.Table.from_arrays(arrays, [f"{OWN}group", f"{OWN}block", f"{OWN}note", f"{OWN}data"])


def _received(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    blocks, parts = table.column(f"{OWN}block").to_pylist(), [np.frombuffer(x.as_py(), kind) for x in table.column(f"{OWN}data")]
    records = np.concatenate(parts) if parts else np.zeros(0, kind)
    return records, np.repeat(np.array(blocks, np.int32), [len(x) for x in parts])


def _reply(blocks: np.ndarray, records: np.ndarray) -> pa.Table:
    order = np.argsort(blocks, kind="stable")
    blocks, records = blocks[order], records[order]
    first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, np.int64)
    parts = [records[a:b].tobytes() for a, b in zip(first, [*first[1:], len(blocks)])]
    arrays = [pa.array(blocks[first], pa.int32()), pa.array([False] * len(parts), pa.bool_()), pa.array(parts, pa.binary())]
    return pa.Table.from_arrays(arrays, [f"{OWN}block", f"{OWN}note", f"{OWN}data"])


def _note(starts: np.ndarray, numbers: np.ndarray, gone: np.ndarray) -> bytes:
    """Where the located windows start, their numbers in the block, and which an earlier document of the block has."""
    steps = np.stack([np.diff(starts, prepend=0), np.diff(numbers, prepend=0)]).astype("<i4")
    return zlib.compress(len(starts).to_bytes(8, "little") + steps.tobytes() + np.packbits(gone).tobytes(), 1)


def _noted(note: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(note)
    n = int.from_bytes(raw[:8], "little")
    steps = np.frombuffer(raw, "<i4", 2 * n, 8).reshape(2, n).astype(np.int64)
    return np.cumsum(steps[0]), np.cumsum(steps[1]), np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 8 * n), count=n).astype(bool)


_PHRASE = np.dtype([("a", "<u8"), ("many", "u1")])
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8"), ("number", "<u4")])


def _confirm(table: pa.Table) -> pa.Table:
    """Phrases that two blocks have, or one block in two documents, to each block that has them."""
    records, blocks = _received(table, _PHRASE)
    order = np.argsort(records["a"], kind="stable")
    records, blocks = records[order], blocks[order]
    first = np.flatnonzero(_runs(records["a"]))
    size = np.diff(np.r_[first, len(records)])
    many = np.add.reduceat(records["many"].astype(np.int64), first) if len(first) else size
    keep = np.repeat((size > 1) | (many > 0), size)
    return _reply(blocks[keep], np.ascontiguousarray(records["a"][keep]))


def _window_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, stable within them, and where a new key begins in it."""
    order = np.argsort(keys["a"], kind="stable")
    a, b = keys["a"][order], keys["b"][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((keys["b"], keys["a"]))
        a, b = keys["a"][order], keys["b"][order]
    return order, _runs(a) | _runs(b)


def _earlier(table: pa.Table) -> pa.Table:
    """Numbers of the windows of which another block has a smaller id, to each block that has not; notes go back as they are."""
    is_note = table.column(f"{OWN}note")
    notes = table.filter(is_note).drop_columns([f"{OWN}group"])
    records, blocks = _received(table.filter(pc.invert(is_note)), _WINDOW)
    order, new = _window_order(records)
    records, blocks, first = records[order], blocks[order], np.flatnonzero(new)
    size = np.diff(np.r_[first, len(records)])
    lowest = np.minimum.reduceat(records["id"], first) if len(first) else size
    later = records["id"] > np.repeat(lowest, size)
    return pa.concat_tables([_reply(blocks[later], np.ascontiguousarray(records["number"][later])), notes])


def _numbered(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that equal windows share, the first place of each number, and the smallest id of the block that has it; ids ascend."""
    order, new = _window_order(keys)
    first = order[new]
    # numbered as they come, so that a passage's windows have numbers in a row
    rank = np.argsort(np.argsort(first, kind="stable"), kind="stable")
    numbers = np.empty(len(ids), np.int64)
    numbers[order] = np.repeat(rank, np.diff(np.r_[np.flatnonzero(new), len(ids)]))
    first = np.sort(first)
    return numbers, first, ids[first]


def mark_repeats(
    docs: DataFrame, window: int = 13, phrase: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed`` and ``kept`` added (and replacing columns so named).

    Words are runs of characters other than U+0020 and U+0009 to U+000D.  A
    word goes if it is covered by a window of ``window`` words that also starts
    in a document with a smaller id; ``kept`` has the others, joined by one
    space.  Windows are judged on the input.  Null texts have no words; rows
    without an id come after all others and take nothing from each other;
    repeated rows and rows with equal ids keep each other's words; an empty
    table gives no rows.  The blocks are files of the checkpoint folder, which
    the result reads; no table stays registered.
    """
    if not 1 <= phrase <= window:
        raise ValueError("a phrase has from one word to as many as the window")
    spark = docs.sparkSession
    prepare(spark)
    block, group = f"{OWN}block", f"{OWN}group"
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_blocks, n_groups = size // BLOCK_BYTES + 1, size // GROUP_BYTES + 1
    extra = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    own_id, own_text = f"{OWN}id", f"{OWN}text"
    dealt = docs.select(
        *extra,
        F.col(id_col).cast("long").alias(own_id),
        F.col(text_col).cast("binary").alias(own_text),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int").alias(block),
    ).drop(text_col)
    # a bucket holds as many blocks as it must: Spark limits the number of buckets
    n_buckets = int(min(n_blocks, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    name, path = f"pagesift_blocks_{uuid.uuid4().hex}", new_scratch_path(spark, "blocks")
    (dealt.repartition(n_buckets, block).write.bucketBy(n_buckets, block)
     .option("path", path).option("compression", "zstd").saveAsTable(name))
    texts = spark.table(name)
    # the plan knows the files by now; a table with a path of its own keeps them
    spark.sql(f"DROP TABLE {name}")

    def send_phrases(table: pa.Table) -> pa.Table:
        b = Block(by_id(table, own_id, own_text), own_id, own_text, window, phrase)
        _, least = b.least_phrases()
        ids = b.ids[b.row[b.whole]]
        # neighbouring windows mostly have the same least phrase
        change = _runs(least) | _runs(ids)
        least, ids = least[change], ids[change]
        order = np.argsort(least, kind="stable")
        least, ids = least[order], ids[order]
        first = np.flatnonzero(_runs(least))
        records = np.empty(len(first), _PHRASE)
        records["a"] = least[first]
        # ids ascend within a run, so the first and the last tell whether there are several
        records["many"] = ids[first] != ids[np.r_[first[1:], len(ids)] - 1]
        return _send(n_groups, table.column(block)[0].as_py(), records)

    narrow = texts.select(block, own_id, own_text)
    phrases = narrow.groupBy(block).applyInArrow(send_phrases, MESSAGE)
    confirmed = cut(phrases.groupBy(group).applyInArrow(_confirm, REPLY))

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _send(n_groups, 0, np.zeros(0, _WINDOW))
        known = np.unique(_received(replies, np.dtype("<u8"))[0])
        b = Block(by_id(table, own_id, own_text), own_id, own_text, window, phrase)
        at = b.located(known)
        keys, ids = b.window_keys()[at], b.ids[b.row[b.whole[at]]]
        numbers, first, lowest = _numbered(keys, ids)
        records = np.empty(len(first), _WINDOW)
        records["a"], records["b"], records["id"], records["number"] = keys["a"][first], keys["b"][first], lowest, np.arange(len(first))
        own = table.column(block)[0].as_py()
        note = _note(b.whole[at], numbers, ids > lowest[numbers] if len(at) else np.zeros(0, bool))
        return pa.concat_tables([_send(n_groups, own, records), _messages([own % n_groups], own, True, [note])])

    windows = narrow.groupBy(block).cogroup(confirmed.groupBy(block)).applyInArrow(send_windows, MESSAGE)
    earlier = cut(windows.groupBy(group).applyInArrow(_earlier, REPLY))

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = by_id(table, own_id, own_text)
        words, bounds = split(table, own_text)
        step = np.zeros(len(words) + 1, np.int64)
        is_note = replies.column(f"{OWN}note")
        for note in replies.filter(is_note).column(f"{OWN}data"):
            starts, numbers, gone = _noted(note.as_py())
            told = np.zeros(len(starts) + 1, bool)
            told[_received(replies.filter(pc.invert(is_note)), np.dtype("<u4"))[0]] = True
            starts = starts[gone | told[numbers]]
            np.add.at(step, starts, 1)
            np.add.at(step, starts + window, -1)
        covered = np.cumsum(step[:-1]) > 0
        kept, removed = [], []
        for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            lost = covered[first:end]
            removed.append(int(lost.sum()))
            own = words[first:end]
            kept.append(b" ".join(own if not removed[-1] else [w for w, x in zip(own, lost.tolist()) if not x]))
        out = table.drop_columns([block, own_id, own_text])
        out = out.append_column(text_col, table.column(own_text).cast(pa.string()))
        out = out.append_column("n_words", pa.array(np.diff(bounds), pa.int64()))
        out = out.append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("kept", pa.array(kept, pa.binary()).cast(pa.string()))

    others = [f for f in docs.select(*extra).schema if f.name != text_col]
    schema = docs.select(*[f.name for f in others], F.col(text_col).cast("string"), F.lit(0).cast("long").alias("n_words"),
                         F.lit(0).cast("long").alias("n_removed"), F.lit("").cast("string").alias("kept")).schema
    return texts.groupBy(block).cogroup(earlier.groupBy(block)).applyInArrow(_nonempty(cover, schema), schema)


def _nonempty(cover, schema):
    """Blocks without documents (there may be none) give no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return to_arrow_schema(schema).empty_table()
        return cover(table, replies)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, phrase: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the repeated passages taken out of its text; other texts stay as they are.

    A column ``n_chars`` is set to the new length.
    """
    marked = mark_repeats(docs, window, phrase, id_col, text_col)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text_col))
    out = marked.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
    win AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13)),
    lowest AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
    gone AS (SELECT DISTINCT win.doc_id, win.pos + k AS pos FROM win JOIN lowest USING (s), range(13) r(k) WHERE win.doc_id > low),
    kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed,
                    coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL), '') AS t
             FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""
