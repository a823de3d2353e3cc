"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import new_scratch_path, prepare

#: Prefix of the columns that operators add for their own use; an input column
#: of the caller's never starts with it, so extra columns cannot clash.
OWN = "_ps_"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Whatever reads the result sees one fixed set of rows, also after an
    executor is lost: Spark reads the files again instead of recomputing.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a Parquet table: columns are compressed and can be pruned."""
    spark = df.sparkSession
    prepare(spark)
    path = new_scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def global_rank(df: DataFrame, keys: Sequence[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Gapless 0-based rank of every row in the order of ``keys`` (then of ``within`` groups).

    The rows are range-sorted over the cluster and materialised with their
    position in the partition; the rank adds the number of rows in the
    partitions before, which is a table of one row per partition (and group).
    ``within`` names columns that lead the sort order: the rank then starts at
    0 in each of their groups.  No group has to fit in one task, and equal
    keys may be spread over partitions if ``keys`` ends with a unique one.
    """
    part, pos, base = f"{OWN}part", f"{OWN}pos", f"{OWN}base"
    placed = cut(
        df.orderBy(*keys).select(
            "*",
            F.spark_partition_id().alias(part),
            (F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias(pos),
        )
    )
    groups = [part, *within]
    counts = placed.groupBy(*groups).agg(F.count("*").alias(f"{OWN}n"), F.min(pos).alias(f"{OWN}first"))
    before = F.sum(f"{OWN}n").over(_running(part, within)) - F.col(f"{OWN}n") - F.col(f"{OWN}first")
    bases = counts.select(*[F.col(c).alias(f"{OWN}g{i}") for i, c in enumerate(groups)], before.alias(base))
    on = [F.col(c).eqNullSafe(F.col(f"{OWN}g{i}")) for i, c in enumerate(groups)]
    return placed.join(bases, on, "left").select(*df.columns, (F.col(pos) + F.col(base)).alias(name))


def _running(part: str, within: Sequence[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
