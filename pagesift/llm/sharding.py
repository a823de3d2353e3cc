"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards alone.  The jump
hash walks a linear congruential sequence that starts at the key; going from
``n`` to ``n + 1`` shards moves one row in ``n + 1``, each into the new shard.
All of it is column expressions; there is no ring table and no Python on the
workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut, global_rank

# Multiplier of the jump hash's generator, and 2^31.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SCALE = float(1 << 31)
_LIMB = 0xFFFF


def next_state(state: Column) -> Column:
    """``state * JUMP_MULTIPLIER + 1`` modulo 2^64, in 16-bit limbs (no overflow in ANSI mode)."""
    limb = [F.shiftrightunsigned(state, 16 * i).bitwiseAND(F.lit(_LIMB)) for i in range(4)]
    mult = [(JUMP_MULTIPLIER >> (16 * i)) & _LIMB for i in range(4)]
    carry: Column = F.lit(1).cast("long")
    out: Column | None = None
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + limb[j] * F.lit(mult[i - j]).cast("long")
        digit = F.shiftleft(total.bitwiseAND(F.lit(_LIMB)), 16 * i)
        out = digit if out is None else out.bitwiseOR(digit)
        carry = F.shiftrightunsigned(total, 16)
    return out


def with_jump_shards(df: DataFrame, key: str, shards: dict[str, int]) -> DataFrame:
    """Add a shard column per ``{column: number of shards}`` by the jump hash of ``key``.

    ``key`` is a bigint column; null keys count as 0.  One walk serves all the
    counts: the jumps do not depend on the number of shards, only where the
    walk stops does.  It has as many steps as the largest count, the most that
    any key can need.
    """
    if not shards or min(shards.values()) < 1:
        raise ValueError("each number of shards must be at least 1")
    state, jump = f"{OWN}state", f"{OWN}jump"
    out = df.withColumns({state: F.coalesce(F.col(key).cast("long"), F.lit(0)), jump: F.lit(0).cast("long"),
                          **{c: F.lit(0) for c in shards}})
    most = max(shards.values())
    for _ in range(most - 1):
        out = out.withColumn(state, next_state(F.col(state)))
        draw = (F.shiftrightunsigned(F.col(state), 33) + F.lit(1)).cast("double")
        out = out.withColumn(jump, F.floor((F.col(jump) + 1).cast("double") * (F.lit(JUMP_SCALE) / draw)))
        out = out.withColumns({c: F.when(F.col(jump) < n, F.col(jump).cast("int")).otherwise(F.col(c)) for c, n in shards.items()})
    return out.drop(state, jump)


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard now and with one more shard, and its place in the shard.

    Result: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.
    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` the row's rank in its
    shard by id, gapless from 0.  A null text counts as empty, a null id as
    key 0 (slots put it first).  Rows with equal ids share a shard and get
    neighbouring slots in any order; an empty table gives no rows; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias(f"{OWN}row"),
    )
    rows = cut(with_jump_shards(rows, id_col, {"shard": n_shards, "grown_shard": n_shards + 1}))
    order = [F.col("shard"), F.col(id_col).asc_nulls_first(), F.col(f"{OWN}row")]
    placed = global_rank(rows, order, "slot", within=["shard"])
    return placed.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text`` (needs ``crc_table`` in scope)."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS UBIGINT))"
    return (
        f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {octets}),"
        f" lambda c, b: xor(c >> 8, tbl[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT)"
    )


def oracle(n_shards: int = 8) -> str:
    """DuckDB SQL for the rows of ``shard_documents`` (unique ids)."""
    halve = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END"
    bits = ["c0 AS (SELECT n, CAST(n AS UBIGINT) AS v FROM range(256) r(n))"]
    bits += [f"c{i} AS (SELECT n, {halve} AS v FROM c{i - 1})" for i in range(1, 9)]
    steps = []
    for i in range(1, n_shards + 1):
        state = f"(state * {JUMP_MULTIPLIER} + 1) % 18446744073709551616"
        steps.append(
            f"t{i} AS (SELECT doc_id, {state} AS state, jump, shard, grown FROM s{i - 1}),"
            f" u{i} AS (SELECT * REPLACE (CAST(floor((jump + 1) * ({JUMP_SCALE} / CAST((state // 8589934592) + 1 AS DOUBLE))) AS BIGINT) AS jump) FROM t{i}),"
            f" s{i} AS (SELECT * REPLACE (CASE WHEN jump < {n_shards} THEN jump ELSE shard END AS shard,"
            f" CASE WHEN jump < {n_shards + 1} THEN jump ELSE grown END AS grown) FROM u{i})"
        )
    return f"""
    WITH {', '.join(bits)}, crc_table AS (SELECT list(v ORDER BY n) AS tbl FROM c8),
    s0 AS (SELECT doc_id, CAST(doc_id AS UHUGEINT) AS state, 0::BIGINT AS jump, 0::BIGINT AS shard, 0::BIGINT AS grown FROM documents),
    {', '.join(steps)}
    SELECT d.doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
           {crc32_sql("coalesce(text, '')")} AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY d.doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
    FROM documents d JOIN s{n_shards} s ON d.doc_id = s.doc_id, crc_table"""
