"""Column expressions for text: whitespace, tags, entities, tokens, shape.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen.  The same regular expressions run unchanged under RE2 (DuckDB), which
the SQL oracle relies on.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\s`` is Unicode-aware, Java's and RE2's are ASCII: spell the class out.
WS_CLASS = (
    "[ \\t\\n\\r\\f\\x{000B}\\x{001C}-\\x{001F}\\x{0085}\\x{00A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
TAG_RE = "<[^>]+>"
TOKEN_RE = "[\\p{L}\\p{N}]+"
# Han ideographs, by code point ranges that Java and RE2 read alike.
HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"

# Named character references of HTML 4, by the standard library's table, and ``&apos;``.
ENTITY_CHARS = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
ENTITY_RE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Runs of whitespace become one space (not trimmed)."""
    return F.regexp_replace(col_(c), WS_CLASS + "+", " ")


def strip_tags(c) -> Column:
    return F.regexp_replace(col_(c), TAG_RE, "")


def _reference(part: Column) -> Column:
    """Text after an ``&`` with the reference it starts with decoded, or null if it starts with none."""
    name = F.regexp_extract(part, ENTITY_RE, 1)
    rest = F.substring(part, F.length(name) + 2, F.length(part))
    digits = F.regexp_replace(name, "^#[xX]?", "")
    code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).cast("long")
    # 0, surrogates and numbers past the last code point read as U+FFFD
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    octets = F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0"))
    table = F.create_map(*[F.lit(x) for pair in ENTITY_CHARS.items() for x in pair])
    char = F.when(name.startswith("#"), F.decode(octets, "UTF-32")).when(name != "", F.try_element_at(table, name))
    return F.concat(char, rest)


def decode_entities(c) -> Column:
    """Character references (named ones of HTML 4, decimal, hexadecimal; with their semicolon) as characters, once."""
    c = col_(c)
    parts = F.split(c, "&")
    decoded = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.coalesce(_reference(p), F.concat(F.lit("&"), p)))
    return F.when(c.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))).otherwise(c)


def tokens(c) -> Column:
    """Lower-cased letter/digit runs, as an array; a run of Han characters gives its bigrams.

    Han text has no blanks between words.  Overlapping pairs meet a keyword's
    own pairs wherever the keyword stands; a single character stays as it is.
    """
    c = col_(c)
    plain = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)
    apart = F.regexp_extract_all(F.regexp_replace(F.lower(c), f"({HAN}+)", " $1 "), F.lit(TOKEN_RE), 0)

    def pairs(t: Column) -> Column:
        both = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(f"^{HAN}") & (F.length(t) > 1), both).otherwise(F.array(t))

    return F.when(c.rlike(HAN), F.flatten(F.transform(apart, pairs))).otherwise(plain)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda an expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def term_runs(toks: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, within the row.

    Equal tokens are neighbours once sorted; a run's length is the distance to
    the start of the next, so the work is linear after the sort.
    """

    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

    def runs(s: Column, first: Column) -> Column:
        return F.transform(
            first,
            lambda at, k: F.struct(F.get(s, at - 1).alias("term"),
                                   (F.coalesce(F.get(first, k + 1), F.size(s) + 1) - at).cast("long").alias("tf")),
        )

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    some = bound(F.array_sort(F.filter(toks, lambda t: t.isNotNull())),
                 lambda s: F.when(F.size(s) > 0, bound(starts(s), lambda first: runs(s, first))).otherwise(none))
    return some


def text_shape(c) -> dict[str, Column]:
    """Character length, UTF-8 byte length, their ratio and the CJK flag (ratio >= 1.4)."""
    c = col_(c)
    n = F.length(c)
    b = F.octet_length(c)
    ratio = F.try_divide(b.cast("double"), n.cast("double"))
    return {
        "n_chars": n,
        "n_bytes": b,
        "byte_ratio": ratio,
        "is_cjk": F.coalesce(ratio >= 1.4, F.lit(False)),
    }


# Fixed value: the URL pattern of the reference, matched at the start only.
LEGAL_URL_RE = "^http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


def legal_url(c) -> Column:
    return F.coalesce(col_(c).rlike(LEGAL_URL_RE), F.lit(False))


def log_severity(c) -> Column:
    """traceback / error / warning / plain; a keyword at column 0 does not count."""
    low = F.lower(col_(c))
    return (
        F.when(F.locate("traceback", low) > 1, "traceback")
        .when(F.locate("error", low) > 1, "error")
        .when(F.locate("warning", low) > 1, "warning")
        .otherwise("plain")
    )
