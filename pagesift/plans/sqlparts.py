"""DuckDB SQL fragments for the oracle, mirroring the Column builders.

Each function returns SQL text for the same computation as its Spark twin
(same regular expressions, same entity table), so that an oracle query is an
independent set-based restatement of the operator.
"""

from __future__ import annotations

from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.functions.stopwords import DEFAULT_LANGS, default_stopwords


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], cols: str) -> str:
    """``(VALUES …) AS t(cols)``; one dummy row filtered out when empty."""
    names = [c.strip() for c in cols.split(",")]
    if not rows:
        nulls = ", ".join("NULL" for _ in names)
        return f"(SELECT * FROM (VALUES ({nulls})) AS v({cols}) WHERE false)"

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({cols}))"


def regexp_replace_all(expr: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({expr}, {q(pat)}, {q(rep)}, 'g')"


def clean_html(expr: str) -> str:
    for pat in (H.COMMENT_RE, H.SCRIPT_RE, H.STYLE_RE, H.LINK_TAG_RE):
        expr = regexp_replace_all(expr, pat)
    return expr


def strip_tags(expr: str) -> str:
    return regexp_replace_all(expr, T.TAG_RE)


def decode_entities(expr: str) -> str:
    names = ", ".join(f"{q(k)}: {q(v)}" for k, v in T.ENTITY_CHARS.items())
    name = f"regexp_extract(dp, {q(T.ENTITY_RE)}, 1)"
    digits = f"regexp_replace({name}, '^#[xX]?', '')"
    code = f"(CASE WHEN regexp_matches({name}, '^#[xX]') THEN CAST('0x' || {digits} AS BIGINT) ELSE CAST({digits} AS BIGINT) END)"
    number = f"(CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE chr(CAST({code} AS INTEGER)) END)"
    char = f"(CASE WHEN starts_with({name}, '#') THEN {number} WHEN {name} <> '' THEN MAP {{{names}}}[{name}] END)"
    one = f"coalesce({char} || substr(dp, length({name}) + 2), '&' || dp)"
    # a lambda over a one-item list binds the text once; subqueries may not stand inside lambdas
    whole = f"string_split(dt, '&')[1] || array_to_string(list_transform(string_split(dt, '&')[2:], lambda dp: {one}), '')"
    return f"(list_transform([{expr}], lambda dt: CASE WHEN contains(dt, '&') THEN {whole} ELSE dt END)[1])"


def collapse_ws(expr: str) -> str:
    return regexp_replace_all(expr, T.WS_CLASS + "+", " ")


def page_text(expr: str) -> str:
    return collapse_ws(decode_entities(strip_tags(clean_html(expr))))


def page_title(expr: str) -> str:
    t = decode_entities(f"regexp_extract({expr}, {q(H.TITLE_RE)}, 1)")
    return (
        f"CASE WHEN coalesce(regexp_matches({expr}, {q(H.TITLE_RE)}) AND trim({t}) <> '', false) "
        f"THEN {t} ELSE 'Untitled' END"
    )


def tokens(expr: str) -> str:
    plain = f"regexp_extract_all(lower({expr}), {q(T.TOKEN_RE)}, 0)"
    apart = f"regexp_extract_all(regexp_replace(lower({expr}), {q('(' + T.HAN + '+)')}, ' \\1 ', 'g'), {q(T.TOKEN_RE)}, 0)"
    pairs = "list_transform(range(1, length(tk)), lambda ti: substr(tk, ti, 2))"
    split = f"CASE WHEN regexp_matches(tk, {q('^' + T.HAN)}) AND length(tk) > 1 THEN {pairs} ELSE [tk] END"
    return f"(CASE WHEN regexp_matches({expr}, {q(T.HAN)}) THEN flatten(list_transform({apart}, lambda tk: {split})) ELSE {plain} END)"


def stopword_values(langs=None) -> str:
    words = default_stopwords(DEFAULT_LANGS if langs is None else langs)
    return values([(w,) for w in words], "term")


def profile_counts_sql(profile_values: str, group: str | None = None) -> str:
    """``(group?, word, n)`` from a ``(group?, term, weight)`` relation."""
    g = f"{group}, " if group else ""
    over = f"PARTITION BY {group}" if group else ""
    word = f"CASE WHEN regexp_matches(pw, {q(T.HAN)}) THEN {tokens('pw')} ELSE [pw] END"
    words = f"flatten(list_transform(string_split_regex(lower(trim(term)), '\\s+'), lambda pw: {word}))"
    return f"""(
      SELECT {g}word, sum(n) AS n FROM (
        SELECT {g}unnest({words}) AS word, n FROM (
          SELECT {g}term, CAST(floor(weight / sum(weight) OVER ({over}) * 100) AS BIGINT) AS n
          FROM {profile_values}
        ) WHERE n > 0
      ) WHERE word <> '' GROUP BY {g}word
    )"""


def similarity_sql(docs: str, id_col: str, text_col: str, profile: dict, anchors, stopwords: bool = True) -> str:
    """``(id, sim)`` for every row of the ``docs`` relation (set-based form)."""
    prof = values([(k, float(v)) for k, v in profile.items()], "term, weight")
    anch = values([(a,) for a in anchors], "term")
    stop_filter = f"WHERE term NOT IN (SELECT term FROM {stopword_values()})" if stopwords else ""
    return f"""(
      WITH words AS {profile_counts_sql(prof)},
      anch AS {anch},
      info AS (
        SELECT coalesce(w.word, a.term) AS term, coalesce(w.n, 0) AS n, a.term IS NOT NULL AS is_anchor
        FROM words w FULL OUTER JOIN anch a ON w.word = a.term
      ),
      c AS (SELECT coalesce(sum(CASE WHEN is_anchor AND n > 0 THEN 4.0 * n * n END), 0) AS c_anchor FROM info),
      tok AS (SELECT {id_col} AS id, unnest({tokens(f"trim({text_col})")}) AS term FROM {docs}),
      tf AS (SELECT id, term, count(*) AS tf FROM tok {stop_filter} GROUP BY id, term),
      j AS (
        SELECT tf.id, tf.tf, coalesce(info.n, 0)::DOUBLE AS n, coalesce(info.is_anchor, false) AS is_anchor,
               CASE WHEN coalesce(info.is_anchor, false) THEN 1.0 ELSE 2.0 END AS idf
        FROM tf LEFT JOIN info ON tf.term = info.term
      ),
      agg AS (
        SELECT id, sum(power(tf * idf, 2)) AS dn2, sum(tf * n * idf * idf) AS dot,
               sum(CASE WHEN n > 0 THEN power(n * idf, 2) - CASE WHEN is_anchor THEN 4.0 * n * n ELSE 0 END END) AS qpart
        FROM j GROUP BY id
      )
      SELECT d.{id_col} AS id,
             round(CASE WHEN coalesce(agg.dn2, 0) > 0 AND coalesce(agg.qpart, 0) + c.c_anchor > 0
                        THEN agg.dot / (sqrt(agg.dn2) * sqrt(coalesce(agg.qpart, 0) + c.c_anchor)) ELSE 0 END, 6) AS sim
      FROM {docs} d CROSS JOIN c LEFT JOIN agg ON agg.id = d.{id_col}
    )"""


def posexplode_sql(src: str, key: str, list_expr: str, pos: str = "pos", val: str = "val") -> str:
    """``(key, pos, val)`` rows for the elements of ``list_expr`` (0-based positions)."""
    return f"""(SELECT {key}, _i - 1 AS {pos}, _l[_i] AS {val} FROM (
                  SELECT {key}, _l, generate_subscripts(_l, 1) AS _i FROM (
                    SELECT {key}, {list_expr} AS _l FROM {src})))"""


def tokens_sql() -> str:
    from pagesift.operators import tokens as TK

    tk = posexplode_sql("pages", "page_id", f"regexp_extract_all(html, {q(H.TOKEN_STREAM_RE)}, 0)", "pos", "token")
    return f"""(SELECT page_id, pos,
        CASE WHEN starts_with(token, '<!--') THEN 'comment'
             WHEN regexp_matches(token, '(?is)^<script') THEN 'script'
             WHEN regexp_matches(token, '(?is)^<style') THEN 'style'
             WHEN regexp_matches(token, {q(TK.END_TAG_RE)}) THEN 'end'
             WHEN regexp_matches(token, {q(TK.TAG_NAME_RE)}) THEN 'start'
             WHEN starts_with(token, '<') THEN 'other' ELSE 'text' END AS kind,
        lower(coalesce(nullif(regexp_extract(token, {q(TK.TAG_NAME_RE)}, 1), ''),
                       nullif(regexp_extract(token, {q(TK.END_TAG_RE)}, 1), ''))) AS tag,
        token FROM {tk})"""


def attr_sql(tok: str, name: str) -> str:
    from pagesift.operators import tokens as TK

    pat = q(TK.attr_re(name))
    return " || ".join(f"regexp_extract({tok}, {pat}, {i})" for i in (1, 2, 3))


def start_tags_sql() -> str:
    return f"""(SELECT page_id, pos, tag, {attr_sql('token', 'class')} AS class, {attr_sql('token', 'id')} AS id
               FROM {tokens_sql()} WHERE kind IN ('start', 'script', 'style'))"""


def tag_score_sql(tag: str) -> str:
    from pagesift.functions import scoring as SC

    whens = " ".join(
        f"WHEN lower({tag}) IN ({', '.join(q(t) for t in tags)}) THEN {score}" for tags, score in SC.TAG_SCORES
    )
    return f"(CASE {whens} ELSE 0 END)"


def css_score_sql(cls: str, ident: str) -> str:
    from pagesift.functions import scoring as SC

    def one(x):
        return (
            f"(CASE WHEN coalesce({x}, '') = '' THEN 0 WHEN regexp_matches({x}, {q(SC.POSITIVE_RE)}) THEN 25 "
            f"WHEN regexp_matches({x}, {q(SC.NEGATIVE_RE)}) THEN -25 ELSE 0 END)"
        )

    return f"({one(cls)} + {one(ident)})"


def boilerplate_sql(cls: str, ident: str, tag: str) -> str:
    from pagesift.functions import scoring as SC

    def one(x):
        return (
            f"(coalesce({x}, '') <> '' AND regexp_matches({x}, {q(SC.EXCLUDE_RE)}) "
            f"AND NOT regexp_matches({x}, {q(SC.ALLOW_RE)}))"
        )

    keep = ", ".join(q(t) for t in SC.BOILERPLATE_KEEP_TAGS)
    return f"(({one(cls)} OR {one(ident)}) AND lower({tag}) NOT IN ({keep}))"


def url_join_sql(base: str, href: str) -> str:
    from pagesift.functions import urls as U

    scheme = f"regexp_extract({base}, {q(U.BASE_SCHEME_RE)}, 1)"
    netloc = f"regexp_extract({base}, {q(U.BASE_NETLOC_RE)}, 1)"
    bpath = f"regexp_extract({base}, {q(U.BASE_PATH_RE)}, 1)"
    bquery = f"regexp_extract({base}, {q(U.BASE_QUERY_RE)}, 1)"
    origin = f"({scheme} || '://' || {netloc})"
    hpath = f"regexp_extract({href}, {q(U.PATH_PART_RE)}, 1)"
    suffix = f"regexp_extract({href}, {q(U.SUFFIX_RE)}, 1)"
    bparts0 = f"string_split({bpath}, '/')"
    bparts = f"(CASE WHEN {bparts0}[-1] <> '' THEN {bparts0}[1:len({bparts0}) - 1] ELSE {bparts0} END)"
    merged0 = f"list_concat({bparts}, string_split({hpath}, '/'))"
    merged = f"list_filter({merged0}, lambda x, i: i = 1 OR i = len({merged0}) OR x <> '')"
    segs = f"(CASE WHEN starts_with({hpath}, '/') THEN string_split({hpath}, '/') ELSE {merged} END)"
    folded0 = (
        f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] "
        f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])"
    )
    folded = f"(CASE WHEN coalesce({segs}[-1] IN ('.', '..'), false) THEN list_append({folded0}, '') ELSE {folded0} END)"
    path0 = f"array_to_string({folded}, '/')"
    path1 = f"(CASE WHEN {path0} = '' THEN '/' ELSE {path0} END)"
    path = f"(CASE WHEN starts_with({path1}, '/') THEN {path1} ELSE '/' || {path1} END)"
    return f"""(CASE WHEN {href} IS NULL THEN NULL
                 WHEN {href} = '' THEN {base}
                 WHEN regexp_matches({href}, {q(U.SCHEME_RE)}) THEN {href}
                 WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href}
                 WHEN starts_with({href}, '#') THEN {origin} || {bpath} || {bquery} || {href}
                 WHEN starts_with({href}, '?') THEN {origin} || {bpath} || {href}
                 ELSE {origin} || {path} || {suffix} END)"""
