"""Spelling variants: words one edit apart, found by composing finite-state machines.

The acceptor of a vocabulary, a transducer that copies letters and makes one
edit, and the acceptor again are composed; the accepted pairs are the near
words.  The transducer has two states, so a state of the composition is either
(q, unedited, q), as both words have had the same letters, or (x, edited, y).

One acceptor of all words would be one task.  The pairs are partitioned by
where their edit is instead: words that share their first ``a`` and their last
``length - z`` letters are one initial state, from which the composition only
enumerates pairs whose edit lies in the window [a, z).  Each word begins with
the two halves of its own length (as the longer word or its equal) and of the
length above (as the shorter one).  A partition with more than
``PARTITION_WORDS`` words is split into the two halves of its window, and again,
until it fits; a window of one letter has no more words than the alphabet has
letters, plus one.  A pair's edit is at the first letter in which its words
differ, so every pair is found in exactly one partition.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut
from pagesift.session import prepare

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
#: Words in one composition, code points of a text read at a time, words counted before they are sent on.
PARTITION_WORDS = 2000
PIECE = 1 << 20
HELD = 100_000
SALTS = 16


# -- words --------------------------------------------------------------------


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces that cut no word."""
    at = 0
    while at < len(text):
        stop = BREAK.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def slip(doc_id: str, run: str) -> str:
    """The run as the document has it: one in 199, dealt by CRC-32, lacks a letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, change: Callable[[str, str], str] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word, n`` of all words of at least ``min_length`` code points and ``min_count`` occurrences in whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower
    case, changed by ``change(id, run)`` if that is given (it may only shorten).
    Null texts have no words, a null id counts as the empty text; repeated rows
    count again.
    """
    prepare(docs.sparkSession)

    def send(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    long_run = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, min_length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                # bytes.lower changes A-Z only
                text = (text.as_py() or b"").lower().decode()
                own = Counter()
                for piece in pieces(text):
                    own.update(long_run.findall(piece))
                for word, n in own.items():
                    if change:
                        word = change(name, word)
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield send(total)
                    total = Counter()
        if total:
            yield send(total)

    picked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string").cast("binary"))
    counts = picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


# -- automata -----------------------------------------------------------------


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words, built one word at a time."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states of the word before, not yet merged with equal ones
        before = ""

        def merge(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                shape = (self.final[state], *self.arcs[state].items())
                same = known.setdefault(shape, state)
                if same != state:
                    self.arcs[path[-1]][before[len(path) - 1]] = same

        for word in words:
            depth = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                depth += 1
            merge(depth)
            for letter in word[depth:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        merge(0)

    def common(self, x: int, y: int) -> Iterator[tuple]:
        """The strings that lead to acceptance from both states, as linked lists of letters from the last one."""
        stack = [(x, y, None)]
        while stack:
            x, y, read = stack.pop()
            if self.final[x] and self.final[y]:
                yield read
            other = self.arcs[y]
            for letter, to in self.arcs[x].items():
                if letter in other:
                    stack.append((to, other[letter], (read, letter)))


def spelled(read: tuple | None) -> str:
    letters = []
    while read:
        read, letter = read
        letters.append(letter)
    return "".join(reversed(letters))


def near_pairs(words: list[str], length: int, a: int, z: int) -> Iterator[tuple[str, str]]:
    """Pairs (longer or equal word, other word) whose one edit lies in [a, z) of a word of ``length`` letters.

    All ``words`` have that length or one letter less, and the same first ``a``
    and last ``length - z`` letters.
    """
    end = length - z
    middles = sorted(w[a : len(w) - end] for w in words)
    prefix, suffix = words[0][:a], words[0][len(words[0]) - end :] if end else ""
    acceptor = Acceptor(middles)
    stack: list[tuple[int, tuple | None, int]] = [(0, None, 0)]
    while stack:
        state, read, depth = stack.pop()
        arcs = list(acceptor.arcs[state].items())
        for k, (letter, to) in enumerate(arcs):
            stack.append((to, (read, letter), depth + 1))
            # replaced: another letter here, then the same rest; of the longer length only
            for other, to_other in arcs[k + 1 :]:
                for rest in acceptor.common(to, to_other):
                    rest = spelled(rest)
                    if depth + 1 + len(rest) == z - a:
                        head = prefix + spelled(read)
                        yield head + letter + rest + suffix, head + other + rest + suffix
            # deleted: this letter, then what the other word has instead, which begins differently
            for rest in acceptor.common(to, state):
                rest = spelled(rest) + suffix
                if rest[:1] != letter:
                    head = prefix + spelled(read)
                    if len(head) + 1 + len(rest) == length:
                        yield head + letter + rest, head + rest


# -- Spark --------------------------------------------------------------------


def _windows(members: DataFrame, windows) -> DataFrame:
    """``members`` (word, n, length) once per window, with the key of the partition it is then in."""
    w = members.select("word", "n", "length", F.explode(windows).alias("w")).select("word", "n", "length", "w.a", "w.z")
    first = F.expr("substring(word, 1, a)")
    last = F.expr("CASE WHEN length > z THEN right(word, length - z) ELSE '' END")
    return w.withColumn("shared", F.concat(first, last))


def _window(a, z):
    return F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))


KEY = ("length", "a", "z", "shared")


def partitions(words: DataFrame) -> DataFrame:
    """``length, a, z, words`` of every partition of two words or more; ``words`` is an array of ``word, n``."""
    own = F.char_length("word")
    roles = words.select("word", "n", F.explode(F.array(own, own + 1)).alias("length"))
    half = F.expr("length div 2")
    members = _windows(roles, F.array(_window(F.lit(0), half), _window(half, F.col("length")))).where("a < z")
    out = None
    while True:
        members = cut(members)
        large = cut(members.groupBy(*KEY).agg(F.count("*").alias("size")).where((F.col("size") > PARTITION_WORDS) & (F.col("z") - F.col("a") > 1)).drop("size"))
        done = large.isEmpty()
        fitting = members
        if not done:
            # a large partition is dealt to several tasks
            salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
            salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
            marks = large.select("*", salts, F.lit(True).alias("large"))
            marked = cut(members.withColumn("salt", salt).join(marks, [*KEY, "salt"], "left").drop("salt"))
            fitting = marked.where("large IS NULL").drop("large")
            middle = F.expr("(a + z) div 2")
            split = marked.where("large").select("word", "n", "length", F.array(_window(F.col("a"), middle), _window(middle, F.col("z"))).alias("w"))
            members = _windows(split, F.col("w"))
        groups = fitting.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
        groups = groups.select("length", "a", "z", "words")
        out = groups if out is None else out.unionByName(groups)
        if done:
            return out


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` of every word that has near words; ``form`` is the most frequent one of them.

    Partitions send what they know of each word, not its pairs.
    """

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for length, a, z, members in zip(*[c.to_pylist() for c in b.columns]):
                n = {m["word"]: m["n"] for m in members}
                found: dict[str, list] = {}
                for pair in near_pairs(list(n), length, a, z):
                    for word, other in (pair, pair[::-1]):
                        entry = found.setdefault(word, [0, (-n[other], other)])
                        entry[0] += 1
                        entry[1] = min(entry[1], (-n[other], other))
                out += [(w, k, best[1], -best[0]) for w, (k, best) in found.items()]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form", "form_n"])

    found = partitions(words).mapInArrow(enumerate_pairs, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form, ``root`` the end of its chain; the steps double in every round."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not steps.where("moved").isEmpty()
        steps = steps.select("word", "root")
        if not moved:
            return steps


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (word, n; words are distinct).

    Near words differ by one inserted, deleted or replaced code point.  The
    form of a word is its near word of largest ``n`` (ties: the smallest in
    code-point order) if that is at least ``ratio`` times its own, else null;
    ``root`` follows the forms to the last, the word itself if it has none.
    An empty table gives none; null words are left out; other columns are not
    read.
    """
    prepare(words.sparkSession)
    words = cut(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    near = words.join(near_words(words), "word", "left")
    high = F.col("form_n") >= ratio * F.col("n")
    found = cut(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("form")).alias("form"), F.when(high, F.col("form_n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, change: Callable[[str, str], str] | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_variants`` of the words of ``docs`` (see ``count_words``)."""
    return group_variants(count_words(docs, min_length, min_count, change, id_col, text_col), ratio)
