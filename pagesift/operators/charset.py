"""Charset detection and byte decoding of raw pages.

Detection is a regex over the bytes viewed as ISO-8859-1 (one char per byte,
lossless), JVM-side.  Decoding stays in Spark for UTF-8, the common case; a
declared charset Spark cannot decode (GBK, GB2312, Shift_JIS, …) goes through
one Arrow-batched pandas UDF, and only those rows do.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.text import col_
from pagesift.session import ship_package

# The declaration patterns (first ``<meta … charset=…>``, else an XML declaration).
META_CHARSET_RE = "(?i)<meta.*?charset=[\"']*(.+?)[\"'>]"
XML_ENCODING_RE = "^<\\?xml.*?encoding=[\"']*(.+?)[\"'>]"
UTF8_NAMES = ("utf-8", "utf8")


def declared_charset(text) -> Column:
    t = col_(text)
    meta = F.regexp_extract(t, META_CHARSET_RE, 1)
    xml = F.regexp_extract(t, XML_ENCODING_RE, 1)
    return F.lower(F.coalesce(F.nullif(meta, F.lit("")), F.nullif(xml, F.lit(""))))


def detect_charset(text) -> Column:
    """Declared charset of an already-decoded page, else ``utf-8``."""
    return F.coalesce(declared_charset(text), F.lit("utf-8"))


def charset_sql(expr: str) -> str:
    from pagesift.plans.sqlparts import q

    meta = f"regexp_extract({expr}, {q(META_CHARSET_RE)}, 1)"
    xml = f"regexp_extract({expr}, {q(XML_ENCODING_RE)}, 1)"
    return f"lower(coalesce(nullif({meta}, ''), nullif({xml}, ''), 'utf-8'))"


def _decode_one(b, cs):
    if b is None:
        return None, None
    try:
        codecs.lookup(cs)
        text = bytes(b).decode(cs)
        return text, cs
    except (LookupError, UnicodeDecodeError):
        return bytes(b).decode("utf-8", errors="replace"), "utf-8"


@F.pandas_udf(T.StructType([T.StructField("html", T.StringType()), T.StructField("charset", T.StringType())]))
def _decode_other(content: pd.Series, charset: pd.Series) -> pd.DataFrame:
    pairs = [_decode_one(b, c) for b, c in zip(content, charset)]
    return pd.DataFrame({"html": [p[0] for p in pairs], "charset": [p[1] for p in pairs]})


def html_decode(df: DataFrame, content_col: str) -> DataFrame:
    """Add ``charset`` and decoded ``html`` for a binary ``content`` column.

    A declared charset is used if the bytes decode with it, else UTF-8 with
    replacement characters.  (The reference's statistical guess for pages of
    under ten text bytes needs a per-row detector library and is not built.)
    """
    ship_package(df.sparkSession)
    staged = df.withColumn("_declared", declared_charset(F.decode(F.col(content_col), "ISO-8859-1")))
    is_utf8 = F.col("_declared").isNull() | F.col("_declared").isin(*UTF8_NAMES)
    # Python gets the bytes of the other charsets only, a null for the rest: one pass over the rows.
    staged = staged.withColumn("_d", _decode_other(F.when(~is_utf8, F.col(content_col)), F.col("_declared")))
    return staged.withColumn("charset", F.when(is_utf8, F.lit("utf-8")).otherwise(F.col("_d.charset"))).withColumn(
        "html", F.when(is_utf8, F.make_valid_utf8(F.col(content_col).cast("string"))).otherwise(F.col("_d.html"))
    ).drop("_declared", "_d")
