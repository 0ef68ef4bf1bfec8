"""Text expressions: trimming, HTML to text, prompt and answer handling, slugs."""

from __future__ import annotations

import html.entities
import json
import unicodedata
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark.params import TAGS_SEPARATOR, TITLE_SEPARATOR, UNTITLED_ARTICLE

__all__ = [
    "PHP_TRIM_CHARS", "php_trim", "collapse_ws", "strip_tags", "decode_entities", "html_to_text",
    "page_title", "main_content", "scraped_piece", "meaningful", "fill_template", "parse_response", "split_tags",
    "parse_translation", "translation_prompt", "slugify", "html_escape", "is_blank",
]

# PHP trim() character set, and the whitespace class of PCRE \s.
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"
WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"

# Lower-case Latin letters without a Unicode decomposition and their transliteration.
SPECIAL_TRANSLIT = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ł", "l"), ("þ", "th"), ("ð", "d"), ("ħ", "h"), ("ı", "i"),
                    ("ŋ", "ng")]


# Romanisation of lower-case letters of other scripts. Cyrillic, Greek, Arabic and Persian, Hebrew.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ђ": "dj", "є": "ye", "ѕ": "dz", "і": "i", "ј": "j",
    "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "ґ": "g",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "ا": "a", "ب": "b", "ة": "h", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z",
    "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l",
    "م": "m", "ن": "n", "ه": "h", "و": "w", "ى": "a", "ي": "y", "ء": "", "پ": "p", "چ": "ch", "ژ": "zh", "ک": "k", "گ": "g", "ی": "y",
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "h", "ט": "t", "י": "y", "ך": "k", "כ": "k", "ל": "l",
    "ם": "m", "מ": "m", "ן": "n", "נ": "n", "ס": "s", "ע": "a", "ף": "p", "פ": "p", "ץ": "ts", "צ": "ts", "ק": "q", "ר": "r",
    "ש": "sh", "ת": "t",
}


def _roman_table(top: int = 0x3100) -> dict[str, str]:
    """What each lower-case character below ``top`` becomes, by rule: letters of its compatibility decomposition, each ASCII or
    in :data:`ROMAN` (é -> e, ѝ -> i, ά -> a, أ -> a, ﬁ -> fi); marks that combine vanish; kana are read from their Unicode names."""
    special = dict(SPECIAL_TRANSLIT)
    out = {}
    for cp in range(0x80, top):
        ch = chr(cp)
        parts = unicodedata.normalize("NFKD", ch)
        name = unicodedata.name(ch, "").split()
        if ch in ROMAN or ch in special:
            out[ch] = ROMAN.get(ch, special.get(ch))
        elif unicodedata.category(ch) == "Mn":
            out[ch] = ""
        elif name[:1] in (["HIRAGANA"], ["KATAKANA"]) and "LETTER" in name:
            out[ch] = "" if name[-2] == "SMALL" and name[-1] == "TU" else name[-1].lower()
        else:
            letters = [c if c.isascii() and c.isalnum() else ROMAN.get(c.lower(), "" if unicodedata.category(c) == "Mn" else None) for c in parts]
            if parts != ch and None not in letters and any(letters):
                out[ch] = "".join(letters)
    return out


ROMAN_TABLE = _roman_table()
#: HTML5 named entities (name without & and ;) and their text. Entities without a semicolon aren't decoded.
ENTITIES = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_ENTITY_BUCKETS = 1 << 12


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often ``body`` uses it: Spark would compute an expression that
    branches of a condition share once for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(rows: list, kind: str) -> Column:
    """A nested table as a literal: parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def _entity_table() -> Column:
    """The names by hash bucket, so that a look-up tests one or two of them."""
    rows: list[list] = [[] for _ in range(_ENTITY_BUCKETS)]
    for n, v in sorted(ENTITIES.items()):
        rows[zlib.crc32(n.encode()) % _ENTITY_BUCKETS].append({"n": n, "v": v})
    return _literal(rows, "array<array<struct<n:string,v:string>>>")


def php_trim(c: Column) -> Column:
    """PHP ``trim``: strips space, TAB, LF, CR, NUL and VT (Spark ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(PHP_TRIM_CHARS))


def is_blank(c: Column) -> Column:
    """PHP ``empty()`` on a string: NULL, '' or '0'."""
    return c.isNull() | c.isin("", "0")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, WS_CLASS + "+", " ")


def strip_tags(c: Column) -> Column:
    """Drop comments, script/style bodies and every tag."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script[ \t\n\r\f]*>", "")
    c = F.regexp_replace(c, r"(?is)<style\b[^>]*>.*?</style[ \t\n\r\f]*>", "")
    return F.regexp_replace(c, r"<[^>]*>", "")


def code_point_text(cp: Column) -> Column:
    """One Unicode code point as a string: UTF-8 bytes by integer arithmetic, then decoded."""
    def byte(v: Column) -> Column:
        return F.lpad(F.hex(v), 2, "0")

    def cont(shift: int) -> Column:
        return byte(F.shiftright(cp, shift).bitwiseAND(0x3F).bitwiseOR(0x80))

    hexs = (
        F.when(cp < 0x80, byte(cp))
        .when(cp < 0x800, F.concat(byte(F.shiftright(cp, 6).bitwiseOR(0xC0)), cont(0)))
        .when(cp < 0x10000, F.concat(byte(F.shiftright(cp, 12).bitwiseOR(0xE0)), cont(6), cont(0)))
        .otherwise(F.concat(byte(F.shiftright(cp, 18).bitwiseOR(0xF0)), cont(12), cont(6), cont(0)))
    )
    return F.decode(F.unhex(hexs), "UTF-8")


def _code_point(e: Column) -> Column:
    """``#65`` or ``#x41`` -> 65; NULL for what is longer than any code point."""
    dec = F.regexp_extract(e, r"^#0*([0-9]{1,7})$", 1)
    hx = F.regexp_extract(e, r"^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
    return F.when(dec != "", dec.try_cast("int")).when(hx != "", F.conv(hx, 16, 10).try_cast("int"))


def _allowed(cp: Column) -> Column:
    """Characters that HTML5 lets a numeric entity stand for: no controls but TAB, LF and FF, no surrogates, no non-characters."""
    low = cp.isin(0x09, 0x0A, 0x0C) | cp.between(0x20, 0x7E)
    high = cp.between(0xA0, 0x10FFFF) & ~cp.between(0xD800, 0xDFFF) & ~cp.between(0xFDD0, 0xFDEF) & (cp.bitwiseAND(0xFFFE) != 0xFFFE)
    return low | high


def decode_entities(c: Column) -> Column:
    """Named (all of HTML5) and numeric entities in one pass: the text is cut at ``&``, and each part that starts with an entity
    and its semicolon has it replaced. What is decoded isn't looked at again (``&amp;lt;`` becomes ``&lt;``); what is no
    entity stays as written."""
    table = _entity_table()

    def named(e: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(e.cast("binary")), F.lit(_ENTITY_BUCKETS)).cast("int"))
        return F.get(F.filter(bucket, lambda x: x["n"] == e), F.lit(0))["v"]

    def part(p: Column, i: Column) -> Column:
        def of(e: Column) -> Column:
            numeric = let(_code_point(e), lambda cp: F.when(_allowed(cp), code_point_text(cp)))
            text = F.when(e == "", F.lit(None)).when(F.startswith(e, F.lit("#")), numeric).otherwise(named(e))
            return let(text, lambda v: F.when(v.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(v, F.substr(p, F.char_length(e) + 2))))

        name = F.regexp_extract(p, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.when(i == 0, p).otherwise(let(name, of))

    return F.array_join(F.transform(F.split(c, "&", -1), part), "")


def html_to_text(c: Column) -> Column:
    """strip tags -> decode entities -> trim -> collapse whitespace (O-X6)."""
    return collapse_ws(php_trim(decode_entities(strip_tags(c))))


def page_title(html: Column) -> Column:
    """Text of the first <title>, decoded and trimmed; '' when absent (O-X8)."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return collapse_ws(php_trim(decode_entities(strip_tags(raw))))


# Fixed values of the main-text block scorer (O-X7): elements dropped whole, the
# class words marking boilerplate, the tags that start a new block, and the
# thresholds a block must meet to count as article text.
BOILERPLATE_ELEMENTS = ["head", "nav", "header", "footer", "aside", "form", "noscript"]
BOILERPLATE_CLASS_WORDS = ["ad", "ads", "advert", "banner", "sponsor", "promo", "sidebar", "comment", "share", "social", "related", "cookie"]
BLOCK_TAGS = ["p", "div", "article", "section", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br",
              "table", "tr", "td", "blockquote", "pre"]
MIN_BLOCK_CHARS = 25
MAX_LINK_SHARE = 0.5
BLOCK_MARK = "\u0001"


def _drop_boilerplate(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script[ \t\n\r\f]*>", "")
    c = F.regexp_replace(c, r"(?is)<style\b[^>]*>.*?</style[ \t\n\r\f]*>", "")
    for el in BOILERPLATE_ELEMENTS:
        c = F.regexp_replace(c, rf"(?is)<{el}\b[^>]*>.*?</{el}[ \t\n\r\f]*>", "")
    words = "|".join(BOILERPLATE_CLASS_WORDS)
    c = F.regexp_replace(c, rf"(?is)<div\b[^>]*class=\"(?:[^\"]*[ ])?(?:{words})(?:[ ][^\"]*)?\"[^>]*>.*?</div[ \t\n\r\f]*>", "")
    return c


def _strip_in_blocks(c: Column) -> Column:
    """:func:`strip_tags` inside each block of a marked text: nothing is matched across a mark."""
    c = F.regexp_replace(c, rf"<!--[^{BLOCK_MARK}]*?-->", "")
    c = F.regexp_replace(c, rf"(?i)<script\b[^>{BLOCK_MARK}]*>[^{BLOCK_MARK}]*?</script[ \t\n\r\f]*>", "")
    c = F.regexp_replace(c, rf"(?i)<style\b[^>{BLOCK_MARK}]*>[^{BLOCK_MARK}]*?</style[ \t\n\r\f]*>", "")
    return F.regexp_replace(c, rf"<[^>{BLOCK_MARK}]*>", "")


def _block_lengths(marked: Column) -> Column:
    """Characters of each block's stripped, collapsed text (entities undecoded)."""
    return F.transform(F.split(collapse_ws(_strip_in_blocks(marked)), BLOCK_MARK, -1), lambda b: F.char_length(php_trim(b)))


def main_content(html: Column) -> Column:
    """O-X7 re-aimed: the article part of a page, as HTML of the kept blocks.

    The body is cut into blocks at block-level tags; a block is kept when its text
    has at least MIN_BLOCK_CHARS characters and less than MAX_LINK_SHARE of it is
    link text. All in-row array functions: no explode, no shuffle. The text of all blocks is measured in one pass over the
    marked body, that of their links in a second."""
    tags = "|".join(BLOCK_TAGS)
    body = let(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body>", 1), lambda b: F.when(b == "", html).otherwise(b))
    marked = F.regexp_replace(_drop_boilerplate(body), rf"(?i)</?(?:{tags})\b[^>]*>", BLOCK_MARK)
    links = rf"(?i)<a\b[^>{BLOCK_MARK}]*>[^{BLOCK_MARK}]*?</a>|{BLOCK_MARK}"

    def kept(m: Column) -> Column:
        link_text = F.array_join(F.regexp_extract_all(m, F.lit(links), 0), "")
        lengths = F.struct(_block_lengths(m).alias("all"), _block_lengths(link_text).alias("link"))
        return let(lengths, lambda n: F.array_join(F.filter(
            F.split(m, BLOCK_MARK, -1),
            lambda b, i: (F.get(n["all"], i) >= MIN_BLOCK_CHARS) & (F.get(n["link"], i) < F.get(n["all"], i) * MAX_LINK_SHARE)), "\n"))

    return let(marked, kept)


def meaningful(content_html: Column) -> Column:
    """O-F10: content counts unless its stripped text is blank and it is < 100 bytes."""
    blank_text = php_trim(strip_tags(content_html)) == ""
    return ~(blank_text & (F.octet_length(content_html) < 100))


def scraped_piece(html: Column, content_html: Column) -> Column:
    """One scraped page as ``title\\n\\ntext``; '' for blank pages, pages without
    meaningful content, or content whose text is empty after clean-up."""
    def piece(text: Column) -> Column:
        title = let(page_title(html), lambda x: F.when(is_blank(x), F.lit(UNTITLED_ARTICLE)).otherwise(x))
        return F.when(text == "", F.lit("")).otherwise(F.concat(title, F.lit("\n\n"), text))

    return (
        F.when(html.isNull() | (php_trim(html) == ""), F.lit(""))
        .when(~meaningful(content_html), F.lit(""))
        .otherwise(let(html_to_text(content_html), piece))
    )


def fill_template(template: str, *values: Column) -> Column:
    """Positional ``%s`` fill (O-X9); ``%%`` is a literal percent. The template is a
    job parameter, so it is split on the driver and the fill is a plain concat."""
    pieces, cur, i, n_slots = [], [], 0, 0
    while i < len(template):
        if template.startswith("%%", i):
            cur.append("%")
            i += 2
        elif template.startswith("%s", i):
            pieces.append("".join(cur))
            cur, n_slots, i = [], n_slots + 1, i + 2
        else:
            cur.append(template[i])
            i += 1
    pieces.append("".join(cur))
    if n_slots != len(values):
        raise ValueError(f"template has {n_slots} %s slots, {len(values)} values given")
    parts = [F.lit(pieces[0])]
    for v, p in zip(values, pieces[1:]):
        parts += [F.coalesce(v.cast("string"), F.lit("")), F.lit(p)]
    return F.concat(*parts)


def split_tags(s: Column) -> Column:
    """Comma split, trim each, drop '' and '0' (O-X11)."""
    parts = F.transform(F.split(s, ",", -1), lambda x: php_trim(x))
    return F.filter(parts, lambda x: ~x.isin("", "0"))


def parse_response(resp: Column, fallback_title: Column) -> Column:
    """Split an answer into STRUCT<title, body, tags> (O-X10).

    First title separator splits title | rest; the first tags separator splits
    rest into body | tags. No title separator: fallback title, whole trimmed
    answer as body, no tags."""
    has_title = F.instr(resp, TITLE_SEPARATOR) > 0
    parts = F.split(resp, F.lit(_re_quote(TITLE_SEPARATOR)), 2)
    rest = F.element_at(parts, 2)
    has_tags = F.instr(rest, TAGS_SEPARATOR) > 0
    bt = F.split(rest, F.lit(_re_quote(TAGS_SEPARATOR)), 2)
    title = F.when(has_title, php_trim(F.element_at(parts, 1))).otherwise(fallback_title)
    body = F.when(has_title & has_tags, php_trim(F.element_at(bt, 1))).when(has_title, php_trim(rest)).otherwise(php_trim(resp))
    tags = F.when(has_title & has_tags, split_tags(php_trim(F.element_at(bt, 2)))).otherwise(F.array().cast("array<string>"))
    return F.struct(title.alias("title"), body.alias("body"), tags.alias("tags"))


def parse_translation(resp: Column, title: Column, body: Column) -> Column:
    """O-X12: separator present -> trimmed halves, else the original title/body."""
    has = F.instr(resp, TITLE_SEPARATOR) > 0
    parts = F.split(resp, F.lit(_re_quote(TITLE_SEPARATOR)), 2)
    return F.struct(
        F.when(has, php_trim(F.element_at(parts, 1))).otherwise(title).alias("title"),
        F.when(has, php_trim(F.element_at(parts, 2))).otherwise(body).alias("body"),
    )


# Fixed value: the translation request text, with positional %s for language, title, body.
TRANSLATION_TEMPLATE = (
    "Translate the following article to %s. Maintain the HTML formatting in the body.\n\n"
    "Title: %s\n\nBody:\n%s\n\nProvide the translation in this exact format:\n"
    "Translated Title\n---TITLE_SEPARATOR---\nTranslated Body (with HTML)"
)


def translation_prompt(language_name: Column, title: Column, body: Column) -> Column:
    return fill_template(TRANSLATION_TEMPLATE, language_name, title, body)


def slugify(c: Column, max_len: int = 100) -> Column:
    """lower -> transliterate -> non [a-z0-9] runs to '-' -> trim '-' -> first 100 chars (O-X15). Letters of other scripts are
    romanised character by character; what has no romanisation becomes '-'."""
    first, last = 0x80, max(map(ord, ROMAN_TABLE))
    table = _literal([ROMAN_TABLE.get(chr(k)) for k in range(first, last + 1)], "array<string>")

    def roman(x: Column) -> Column:
        def one(ch: Column) -> Column:
            at = F.ascii(ch) - first
            return F.when(at < 0, ch).otherwise(F.coalesce(F.get(table, at), ch))

        plain = F.octet_length(x) == F.char_length(x)
        return F.when(plain, x).otherwise(F.array_join(F.transform(F.split(x, "", -1), one), ""))

    t = let(F.lower(c), roman)
    t = F.btrim(F.regexp_replace(t, r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(t, 1, max_len)


def html_escape(c: Column) -> Column:
    """htmlspecialchars(ENT_QUOTES): & first, then < > \" '."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _re_quote(s: str) -> str:
    import re

    return re.escape(s)
