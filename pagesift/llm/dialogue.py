"""Repair of conversation structure by alignment to an alternating grammar.

The role initials of a good conversation spell ``(s?(ua)+)?``.  The turns are
aligned to each feasible length of that string by Wagner-Fischer's table of
edit costs, of which only Ukkonen's band around the diagonal is filled: cells
that an alignment no dearer than the incumbent can reach.  The audits (edit
initials) of all lengths of least cost are traced back and compared.

A conversation of any length is cut into chunks of ``CHUNK`` turns.  Every
chunk is aligned from each state of the grammar it may begin in; the tables of
neighbouring chunks compose (costs add up, equal costs are decided by the rank
of the first chunk's audits), ``FAN`` of them at a time, up to one table per
conversation.  Going down again, each chunk learns in which state it begins and
ends.  So no task ever holds more than a chunk or ``FAN`` small tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut, global_rank
from pagesift.session import prepare

#: Turns aligned at once, and chunk tables composed at once.
CHUNK = 64
FAN = 64

# Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the grammar: nothing yet, or the role written last.
STATES = "-sua"
NAMES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


# -- one run of turns ---------------------------------------------------------
#
# A turn is one character: its role initial (o: any other), in upper case if
# the turn is truncated; x if it must go.


def targets(state: str, length: int) -> list[str]:
    """The strings of up to ``length`` roles that may follow ``state``; each of their prefixes is feasible too."""
    after = {"-": ("ua", "sua"), "s": ("ua",), "u": ("au",), "a": ("ua",)}[state]
    return [(t[:1] + t[1:] * length if len(t) == 3 else t * length)[:length] for t in after]


def _band(target: str, turns: str, limit: int, tail: bool) -> list[dict[int, int]]:
    """Least cost of aligning the first i turns to the first j roles, where it can be within ``limit``."""
    table: list[dict[int, int]] = []
    for i in range(len(turns) + 1):
        row: dict[int, int] = {}
        above = table[-1] if table else {}
        turn = turns[i - 1] if i else ""
        own, extra = turn.lower(), TRUNCATED if turn.isupper() else 0
        inserts = tail or i < len(turns)
        for j in range(max(0, i - limit // DELETE), min(len(target), i + limit // INSERT) + 1):
            best = 0 if i == j == 0 else limit + 1
            if j in above:
                best = above[j] + DELETE
            if j and (j - 1) in above and own != "x":
                if own == target[j - 1]:
                    best = min(best, above[j - 1] + extra)
                elif target[j - 1] != "s":
                    best = min(best, above[j - 1] + REROLE + extra)
            if inserts and j and (j - 1) in row and target[j - 1] != "s":
                best = min(best, row[j - 1] + INSERT)
            if best <= limit:
                row[j] = best
        table.append(row)
    return table


def _moves(table, target: str, turns: str, i: int, j: int, tail: bool):
    """The moves out of a cell that are cheapest ways to their cells, in the order of their initials."""
    here = table[i][j]
    if i < len(turns) and table[i + 1].get(j) == here + DELETE:
        yield "D", i + 1, j
    if j < len(target) and target[j] != "s" and (tail or i < len(turns)) and table[i].get(j + 1) == here + INSERT:
        yield "I", i, j + 1
    if i < len(turns) and j < len(target) and turns[i] != "x":
        over = table[i + 1].get(j + 1)
        extra = TRUNCATED if turns[i].isupper() else 0
        if turns[i].lower() == target[j]:
            if over == here + extra:
                yield "K", i + 1, j + 1
        elif target[j] != "s" and over == here + REROLE + extra:
            yield "R", i + 1, j + 1


def _least_audit(table, target: str, turns: str, length: int, tail: bool) -> str:
    """The first audit, in ASCII order, of the cheapest alignments to ``length`` roles."""
    goal = (len(turns), length)
    leads: dict[tuple[int, int], bool] = {goal: True}
    stack = [(0, 0)]
    while stack:  # which cells lead to the goal by cheapest moves
        cell = stack[-1]
        if cell in leads:
            stack.pop()
            continue
        after = [(i, j) for _, i, j in _moves(table, target, turns, *cell, tail) if j <= length]
        unknown = [c for c in after if c not in leads]
        if unknown:
            stack += unknown
        else:
            leads[cell] = any(leads[c] for c in after)
            stack.pop()
    audit, cell = [], (0, 0)
    while cell != goal:
        edit, i, j = next(m for m in _moves(table, target, turns, *cell, tail) if m[2] <= length and leads[m[1:]])
        audit.append(edit)
        cell = (i, j)
    return "".join(audit)


@lru_cache(maxsize=1 << 15)
def align(turns: str, state: str, final: bool) -> dict[str, tuple[int, str]]:
    """For each state that ``turns`` can end in, having begun in ``state``: the least cost and its first audit.

    The last run of a conversation (``final``) may end with inserted turns and
    has one end, ``a``: complete.  Others end with their last turn, so that no
    audit of a run is the beginning of another one.  Ends ``-`` and ``s`` that
    cost more than going on from ``a`` (and deleting an ``s`` there) ever saves
    may be missing: no best alignment uses them.
    """
    most = DELETE * len(turns) + 2 * INSERT  # deleting all and inserting a pair, if the end can be reached at all
    limit = 2 * INSERT
    while True:
        limit = min(limit, most)
        best: dict[str, tuple[int, str]] = {}
        for target in targets(state, len(turns) + limit // INSERT):
            table = _band(target, turns, limit, final)
            ends: dict[str, list[int]] = {}
            for j in table[-1]:
                end = target[j - 1] if j else state
                if final:
                    if end not in "-a":
                        continue
                    end = "a"
                ends.setdefault(end, []).append(j)
            for end, lengths in ends.items():
                cost = min(table[-1][j] for j in lengths)
                if cost > best.get(end, (limit,))[0]:
                    continue
                audit = min(_least_audit(table, target, turns, j, final) for j in lengths if table[-1][j] == cost)
                best[end] = min(best.get(end, (cost, audit)), (cost, audit))
        if limit >= most or ("a" in best and (final or "u" in best and limit >= best["a"][0] + DELETE)):
            return best
        limit *= 2


# -- tables of chunks ---------------------------------------------------------
#
# A table has one number per begin and end state: four times the cost plus the
# rank of its audit among those of the same begin; -1 where there is no way.


def chunk_table(turns: str, final: bool) -> list[int]:
    out = []
    for state in STATES:
        found = align(turns, state, final)
        rank = {end: r for r, (_, end) in enumerate(sorted((audit, end) for end, (_, audit) in found.items()))}
        out += [4 * found[end][0] + rank[end] if end in found else -1 for end in STATES]
    return out


def route(tables: list[list[int]], begin: int, end: int) -> tuple[int, list[int]] | None:
    """Least cost from ``begin`` to ``end`` through the tables and the states in between, ties by the earliest rank."""
    ahead: list = [0 if s == end else None for s in range(4)]
    choice = []
    for table in reversed(tables):
        now, to = [], []
        for s in range(4):
            ways = [((table[4 * s + e] >> 2) + ahead[e], table[4 * s + e] & 3, e) for e in range(4) if table[4 * s + e] >= 0 and ahead[e] is not None]
            now.append(min(ways)[0] if ways else None)
            to.append(min(ways)[2] if ways else None)
        ahead = now
        choice.append(to)
    if ahead[begin] is None:
        return None
    states = [begin]
    for to in reversed(choice):
        states.append(to[states[-1]])
    return ahead[begin], states


def compose(tables: list[list[int]]) -> list[int]:
    """The table of neighbouring chunks from theirs."""
    out = []
    for s in range(4):
        ways = {e: route(tables, s, e) for e in range(4)}
        ways = {e: w for e, w in ways.items() if w}
        ranks = {e: [t[4 * a + b] & 3 for t, a, b in zip(tables, w[1], w[1][1:])] for e, w in ways.items()}
        order = sorted(ways, key=ranks.__getitem__)
        out += [4 * ways[e][0] + order.index(e) if e in ways else -1 for e in range(4)]
    return out


# -- Spark --------------------------------------------------------------------


def _batches(names: list[str], types: list[pa.DataType], rows, size: int = 2000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield _batch(names, types, part)
            part = []
    if part:
        yield _batch(names, types, part)


def _batch(names, types, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _rows(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def key_of(id_col: str) -> Column:
    """A never-null string that tells a null id from every other."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def _described(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    said = rows.select(key_of(id_col).alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    said = said.withColumn("digest", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    # lower case: whole, upper case: truncated, digits: blank
    code = F.when(end == "", F.translate(initial, "suao", "0123")).when(end.isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    return said.withColumn("code", code)


CHUNK_ROWS = "key string, chunk long, n long, turns string, blank long, duplicate long, truncated long, illegal long"


def _chunks(ranked: DataFrame, firsts: DataFrame) -> DataFrame:
    """The turns of each chunk as a string, and its faults."""
    chunk = F.expr(f"pos div {CHUNK}")
    own = ranked.select("key", chunk.alias("chunk"), "pos", "code")
    heard = firsts.select("key", chunk.alias("chunk"), "pos", F.lit("+").alias("code"))
    # the turn before a chunk, whose role its first turn is held against
    before = ranked.where(F.expr(f"pos % {CHUNK} = {CHUNK - 1}")).select("key", (chunk + 1).alias("chunk"), "pos", F.concat(F.lit("<"), "code").alias("code"))
    items = own.unionByName(heard).unionByName(before).groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("items"))

    def run(batches):
        def rows():
            for key, chunk, items in _rows(batches):
                turns, faults, illegal, last, first_at = [], [0, 0, 0], 0, None, -1
                for item in items:
                    code = item["code"]
                    if code == "+":  # sorts before the turn it belongs to
                        first_at = item["pos"]
                        continue
                    initial = {"0": "s", "1": "u", "2": "a", "3": "o"}.get(code[-1], code[-1].lower())
                    if last is not None and last + initial not in ("su", "ua", "au"):
                        illegal += code[0] != "<"
                    last = initial
                    if code[0] == "<":
                        continue
                    fault = 0 if code.isdigit() else 1 if first_at != item["pos"] else 2 if code.isupper() else None
                    if fault is not None:
                        faults[fault] += 1
                    turns.append("x" if fault in (0, 1) else code)
                if turns:
                    yield key, chunk, len(turns), "".join(turns), *faults, illegal

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 4
        yield from _batches([c.split()[0] for c in CHUNK_ROWS.split(", ")], kinds, rows())

    return items.mapInArrow(run, CHUNK_ROWS)


def _ways(chunks: DataFrame) -> DataFrame:
    """``key, chunk, begin, end`` (numbers of states) of each chunk of the conversations that have several."""

    def tables(batches):
        rows = ((key, chunk, chunk_table(turns, chunk + 1 == n)) for key, chunk, turns, n in _rows(batches))
        yield from _batches(["key", "at", "m"], [pa.string(), pa.int64(), pa.list_(pa.int64())], rows)

    def composed(batches):
        rows = ((key, at, compose([k["m"] for k in kids])) for key, at, kids in _rows(batches))
        yield from _batches(["key", "at", "m"], [pa.string(), pa.int64(), pa.list_(pa.int64())], rows)

    def downward(batches):
        def rows():
            for key, kids, begin, end in _rows(batches):
                states = route([k["m"] for k in kids], begin, end)[1]
                yield from ((key, k["at"], a, b) for k, a, b in zip(kids, states, states[1:]))

        yield from _batches(["key", "at", "begin", "end"], [pa.string(), pa.int64(), pa.int32(), pa.int32()], rows())

    table = "key string, at long, m array<long>"
    nodes = cut(chunks.select("key", "chunk", "turns", "n_chunks").mapInArrow(tables, table))
    levels = []
    while not levels or not nodes.where("at > 0").isEmpty():
        families = nodes.groupBy("key", F.expr(f"at div {FAN}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("kids"))
        levels.append(cut(families))
        nodes = cut(levels[-1].mapInArrow(composed, table))
    ways = nodes.select("key", "at", F.lit(STATES.index("-")).alias("begin"), F.lit(STATES.index("a")).alias("end"))
    for families in reversed(levels):
        ways = cut(families.join(ways, ["key", "at"]).select("key", "kids", "begin", "end").mapInArrow(downward, "key string, at long, begin int, end int"))
    return ways.withColumnRenamed("at", "chunk")


AUDITED = "key string, chunk long, n_chunks long, begin int, cost long, audit string"


def _audited(batches):
    def rows():
        for key, chunk, n_chunks, turns, begin, end in _rows(batches):
            cost, audit = align(turns, STATES[begin], chunk + 1 == n_chunks)[STATES[end]]
            yield key, chunk, n_chunks, begin, cost, audit

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    yield from _batches([c.split()[0] for c in AUDITED.split(", ")], kinds, rows())


def written_turns(audit: str, begin: int, first: int, said: dict[int, tuple[str, str]]) -> list[tuple[str, str]]:
    """Role and text of the turns that an audit leaves of a chunk whose first turn has position ``first``."""
    out, at, state = [], first, STATES[begin]
    for edit in audit:
        if edit != "I":
            role, text = said.get(at, ("", ""))
            at += 1
        if edit == "D":
            continue
        if edit != "K":
            state = "a" if state == "u" else "u"
            out.append((NAMES[state], text if edit == "R" else ""))
        else:
            state = role[0]
            out.append((role, text))
    return out


def repair(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The faults of every conversation of ``rows`` and its repaired turns.

    The first table has one row per conversation: ``key`` (``key_of`` its id),
    ``gaps, blank, duplicate, truncated, illegal, n_chunks``.  The second one has
    the repair in chunks: ``key, chunk, n_chunks, cost, audit, turns`` (an array
    of ``role, text``), in the order of ``chunk``.

    Turns are ordered by ``turn_col``, nulls first; turns of equal number by
    a digest of role and text, so repeated rows are neighbours.  A null role or
    text is one space; a null id is a conversation of its own; very long
    conversations are cut into chunks; an empty table gives none; other columns
    are not read.
    """
    prepare(rows.sparkSession)
    said = _described(rows, id_col, turn_col, role_col, text_col)
    tie = f"{OWN}tie"  # repeated rows are alike, but need not be in one partition
    narrow = said.select("key", "turn", "digest", "code", F.monotonically_increasing_id().alias(tie))
    ranked = global_rank(narrow, [F.col("key"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col(tie)], "pos", ["key"])
    ranked = cut(ranked.drop(tie))
    firsts = ranked.groupBy("key", "digest").agg(F.min("pos").alias("pos"))
    chunks = cut(_chunks(ranked, firsts))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    faults = cut(chunks.groupBy("key").agg(*sums, (F.max("chunk") + 1).alias("n_chunks")))
    chunks = chunks.join(faults.select("key", "n_chunks"), "key")

    begin, end = (F.lit(STATES.index(s)).alias(n) for s, n in (("-", "begin"), ("a", "end")))
    short = chunks.where("n_chunks = 1").select("key", "chunk", "n_chunks", "turns", begin, end)
    long = chunks.where("n_chunks > 1")
    if not long.isEmpty():
        long = cut(long)
        short = short.unionByName(long.join(_ways(long), ["key", "chunk"]).select(*short.columns))
    audits = cut(short.mapInArrow(_audited, AUDITED))

    texts = said.select("key", "digest", "role", "text").dropDuplicates(["key", "digest"])
    heard = firsts.join(texts, ["key", "digest"]).select("key", F.expr(f"pos div {CHUNK}").alias("chunk"), F.struct("pos", "role", "text").alias("turn"))
    spoken = heard.groupBy("key", "chunk").agg(F.collect_list("turn").alias("said"))

    def assemble(batches):
        def rows():
            for key, chunk, n_chunks, begin, cost, audit, said in _rows(batches):
                by_pos = {t["pos"]: (t["role"], t["text"]) for t in said or ()}
                turns = written_turns(audit, begin, chunk * CHUNK, by_pos)
                yield key, chunk, n_chunks, cost, audit, [{"role": r, "text": t} for r, t in turns]

        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), turn]
        yield from _batches(["key", "chunk", "n_chunks", "cost", "audit", "turns"], kinds, rows(), 200)

    repaired = audits.join(spoken, ["key", "chunk"], "left").select(*audits.columns, "said").mapInArrow(
        assemble, "key string, chunk long, n_chunks long, cost long, audit string, turns array<struct<role: string, text: string>>")
    number = lambda c: F.col(c).cast("decimal(20,0)")
    span = ranked.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(
        F.coalesce((F.max(number("turn")) - F.min(number("turn")) + 1 - F.count("turn")).try_cast("long"), F.lit(0)).cast("long").alias("gaps"))
    return faults.join(span, "key"), repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``key, cost, audit, repaired_sha256`` of every conversation from its repaired chunks.

    The lines of a chunk are joined where it is; a conversation of several
    chunks is hashed by one task that streams over them in order, as SHA-256
    asks, one joined chunk at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    bodies = cut(repaired.select("key", "chunk", "n_chunks", "cost", "audit", F.size("turns").alias("lines"), lines.alias("body")))
    short = bodies.where("n_chunks = 1").select("key", "cost", "audit", F.sha2(F.col("body").cast("binary"), 256).alias("repaired_sha256"))

    def stream(batches):
        def rows():
            now, cost, audit, digest, some = None, 0, [], None, False
            for key, _, c, a, n, body in _rows(batches):
                if key != now:
                    if now is not None:
                        yield now, cost, "".join(audit), digest.hexdigest()
                    now, cost, audit, digest, some = key, 0, [], hashlib.sha256(), False
                cost += c
                audit.append(a)
                if n:
                    digest.update((b"\n" if some else b"") + body.encode())
                    some = True
            if now is not None:
                yield now, cost, "".join(audit), digest.hexdigest()

        yield from _batches(["key", "cost", "audit", "repaired_sha256"], [pa.string(), pa.int64(), pa.string(), pa.string()], rows())

    long = bodies.where("n_chunks > 1").select("key", "chunk", "cost", "audit", "lines", "body").repartition("key").sortWithinPartitions("key", "chunk")
    return short.unionByName(long.mapInArrow(stream, "key string, cost long, audit string, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the CRC-32 of ``conv_id:turn`` deals out."""
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hit = F.crc32(name.cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(hit == 4, "user").otherwise(role)
    copies = F.explode(F.when(hit == 0, F.array().cast("array<int>")).when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(f"{OWN}copy")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop(f"{OWN}copy")


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id``, faults, cost, audit and digest of every conversation of ``conversations`` as repaired in ``rows``.

    A conversation without rows there has zeros, an empty audit and the digest of nothing.
    """
    faults, repaired = repair(rows)
    ids = conversations.select("conv_id").distinct().withColumn("key", key_of("conv_id"))
    found = ids.join(faults, "key", "left").join(digests(repaired), "key", "left")
    zeros = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in COLUMNS]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
