"""Join and layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSE_PARTITIONS_CONF = "spark.pagesift.parsePartitions"


def param_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A broadcast DataFrame from a driver-side parameter list (stop words, a profile, a rule).

    The driver holds the list already; its size does not depend on the data.
    """
    return F.broadcast(spark.createDataFrame(rows, schema))


def spread(df: DataFrame) -> DataFrame:
    """Deal CPU-heavy rows out to a fixed number of partitions, if the session names one.

    Large tables have splits enough and need no shuffle; a session over one
    small file sets ``spark.pagesift.parsePartitions``.
    """
    n = df.sparkSession.conf.get(PARSE_PARTITIONS_CONF, None)
    return df if df.isStreaming or not n else df.repartition(int(n))


DEAL_ROWS = 2000


def deal(df: DataFrame) -> DataFrame:
    """Deal the narrow rows of a scan out to all cores, some ``DEAL_ROWS`` or more to a task.

    A row of a few dozen bytes may ask for a millisecond of work, but splits are cut
    by bytes: a table of a million such rows is read by one task or two.  The rows
    are counted from the files' footers; round robin, so that no key decides.
    """
    n = min(df.count() // DEAL_ROWS, max(64, 4 * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(n) if n > 1 else df
