"""DuckDB SQL fragments for the oracle side of the text operators.

Written directly in DuckDB's dialect (RE2 regexes, 'g' flag, lambdas). They take
the same fixed values (tag lists, thresholds, entities) as the Spark side so an
oracle checks the operator's logic, not a second choice of constants.
"""

from __future__ import annotations

from trendspark.functions import text as T

TRIM_SET = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"
WS = "'[ \\t\\n\\x0B\\f\\r]+'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def php_trim(x: str) -> str:
    return f"trim({x}, {TRIM_SET})"


def strip_tags(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script[ \\t\\n\\r\\f]*>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<style\\b[^>]*>.*?</style[ \\t\\n\\r\\f]*>', '', 'g')"
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def decode(x: str) -> str:
    names = sorted(T.ENTITIES)
    name = "regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', 1)"
    cp = (f"(CASE WHEN {name} LIKE '#x%' OR {name} LIKE '#X%' THEN try_cast('0x' || ltrim(substr({name}, 3), '0') AS integer) "
          f"ELSE try_cast(substr({name}, 2) AS integer) END)")
    ok = (f"({cp} IN (9, 10, 12) OR {cp} BETWEEN 32 AND 126 OR ({cp} BETWEEN 160 AND 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
          f"AND NOT ({cp} BETWEEN 64976 AND 65007) AND {cp} % 65536 < 65534))")
    part = (f"CASE WHEN i = 1 THEN p WHEN {name} = '' THEN '&' || p "
            f"WHEN {name} LIKE '#%' THEN CASE WHEN {ok} THEN chr({cp}) || substr(p, length({name}) + 2) ELSE '&' || p END "
            f"ELSE coalesce(list_extract({_list(T.ENTITIES[n] for n in names)}, list_position({_list(names)}, {name})) "
            f"|| substr(p, length({name}) + 2), '&' || p) END")
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {part}), '')"


def romanised(x: str) -> str:
    """``x`` in lower case with every character of the table replaced."""
    table = sorted(T.ROMAN_TABLE)
    one = f"CASE WHEN unicode(c) < 128 THEN c ELSE coalesce(list_extract({_list(T.ROMAN_TABLE[c] for c in table)}, list_position({_list(table)}, c)), c) END"
    return f"array_to_string(list_transform(string_split(lower({x}), ''), lambda c: {one}), '')"


def html_to_text(x: str) -> str:
    return f"regexp_replace({php_trim(decode(strip_tags(x)))}, {WS}, ' ', 'g')"


def page_title(h: str) -> str:
    raw = f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    return html_to_text(raw)


def main_content(h: str) -> str:
    body = f"regexp_extract({h}, '(?is)<body\\b[^>]*>(.*)</body>', 1)"
    x = f"(CASE WHEN {body} = '' THEN {h} ELSE {body} END)"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script[ \\t\\n\\r\\f]*>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<style\\b[^>]*>.*?</style[ \\t\\n\\r\\f]*>', '', 'g')"
    for el in T.BOILERPLATE_ELEMENTS:
        x = f"regexp_replace({x}, '(?is)<{el}\\b[^>]*>.*?</{el}[ \\t\\n\\r\\f]*>', '', 'g')"
    words = "|".join(T.BOILERPLATE_CLASS_WORDS)
    x = f"regexp_replace({x}, '(?is)<div\\b[^>]*class=\"(?:[^\"]*[ ])?(?:{words})(?:[ ][^\"]*)?\"[^>]*>.*?</div[ \\t\\n\\r\\f]*>', '', 'g')"
    tags = "|".join(T.BLOCK_TAGS)
    x = f"regexp_replace({x}, '(?i)</?(?:{tags})\\b[^>]*>', chr(1), 'g')"
    tl = f"length(regexp_replace({php_trim(strip_tags('b'))}, {WS}, ' ', 'g'))"
    links = "array_to_string(regexp_extract_all(b, '(?is)<a\\b[^>]*>(.*?)</a>', 1), '')"
    ll = f"length(regexp_replace({php_trim(strip_tags(links))}, {WS}, ' ', 'g'))"
    keep = f"{tl} >= {T.MIN_BLOCK_CHARS} AND {ll} < {tl} * {T.MAX_LINK_SHARE}"
    return f"array_to_string(list_filter(string_split({x}, chr(1)), lambda b: {keep}), chr(10))"


def scraped_piece(h: str, content: str) -> str:
    """``content`` is a column already holding main_content(h)."""
    text = html_to_text(content)
    title = page_title(h)
    title = f"(CASE WHEN {title} IS NULL OR {title} IN ('', '0') THEN 'Untitled Article' ELSE {title} END)"
    meaningful = f"NOT ({php_trim(strip_tags(content))} = '' AND octet_length(encode({content})) < 100)"
    return (f"(CASE WHEN {h} IS NULL OR {php_trim(h)} = '' THEN '' WHEN NOT ({meaningful}) THEN '' "
            f"WHEN {text} = '' THEN '' ELSE {title} || chr(10) || chr(10) || {text} END)")
