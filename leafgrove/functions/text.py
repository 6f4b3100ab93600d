"""Text functions as Columns, and the same rules as DuckDB SQL for the oracles.

Normalisation is Unicode-aware: case folding (not lower-casing), ASCII punctuation to spaces, any white space collapsed.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 ASCII punctuation characters.
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space in the sense of Unicode, with the four information separators; first what is ASCII, then the rest.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Case folding where it differs from lower-casing, from Python's own tables.
_FOLDS = {chr(c): chr(c).casefold() for c in range(sys.maxunicode + 1) if chr(c).lower().casefold() != chr(c).lower() and len(chr(c).lower()) == 1 and chr(c) == chr(c).lower()}
_ONE = {a: b for a, b in _FOLDS.items() if len(b) == 1}
_MANY = {a: b for a, b in _FOLDS.items() if len(b) > 1}


def _ranges(chars: set[str], gap: int = 6) -> str:
    """A class of few ranges that holds all the characters (and some between them)."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c - spans[-1][1] <= gap:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


#: Characters of the long way; the sharp s is common and has a way of its own.
_RARE = _ranges(set(_FOLDS) - {"ß"})


def _ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def _replaced(x: Column, by: dict[str, str]) -> Column:
    """Each key replaced by its value, one after another; a fold over a constant array, as a chain would be too much code."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in by.items()))
    return F.aggregate(pairs, x, lambda text, p: F.replace(text, p["a"], p["b"]))


def casefold(x: Column) -> Column:
    """Unicode case folding. ASCII texts are lower-cased; only texts with a rare character take the long way."""
    low = F.lower(x)
    folded = _replaced(F.translate(low, "".join(_ONE), "".join(_ONE.values())), _MANY)
    return F.when(_ascii(low), low).when(low.rlike(_RARE), folded).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def _blanks(x: Column) -> Column:
    """All white space as blanks, without a pattern: a search for one character is far cheaper."""
    blank = _replaced(x, dict.fromkeys(SPACES, " "))
    return F.when(_ascii(x), blank).otherwise(_replaced(blank, dict.fromkeys(WIDE_SPACES, " ")))


def _words(x: Column) -> Column:
    return F.array_remove(F.split(_blanks(x), " "), "")


def collapse(x: Column) -> Column:
    return F.array_join(_words(x), " ")


def key_of(x: Column) -> Column:
    """Case-folded, punctuation kept."""
    return collapse(casefold(x))


def _unpunctuated(x: Column) -> Column:
    return F.translate(casefold(x), PUNCT, " " * len(PUNCT))


def normalize(x: Column) -> Column:
    return collapse(_unpunctuated(x))


def punct_key(x: Column) -> Column:
    """Without punctuation; `__empty__` if nothing is left."""
    return F.coalesce(F.nullif(collapse(F.translate(casefold(x), PUNCT, "")), F.lit("")), F.lit("__empty__"))


def tokens(x: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words of the normalised text, repeats kept, without the stop words."""
    own = _words(_unpunctuated(x))
    return F.filter(own, lambda t: ~t.isin(*stop_words)) if stop_words else own


def overlap(text_tokens: Column, query_tokens: Column) -> Column:
    """Share of the query's tokens (repeats count) that the text has; 0 if either side is empty."""
    n = F.size(query_tokens)
    return F.when((n > 0) & (F.size(text_tokens) > 0), F.size(F.filter(query_tokens, lambda t: F.array_contains(text_tokens, t))) / n).otherwise(F.lit(0.0))


def word_count(x: Column) -> Column:
    return F.size(_words(x)).cast("long")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sentence(x: Column) -> Column:
    """With a full stop unless it ends in one of `.!?`."""
    return F.when(F.substring(x, -1, 1).isin(".", "!", "?"), x).otherwise(F.concat(x, F.lit(".")))


def source_kind(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    return F.when(end == ".pdf", "pdf").when(end.isin(".md", ".markdown"), "markdown")


def page_label(start: Column, end: Column) -> Column:
    """1-based, `a` or `a-b`, of a 0-based inclusive span."""
    return F.when(start == end, (start + 1).cast("string")).otherwise(F.concat_ws("-", (start + 1).cast("string"), (end + 1).cast("string")))


#: The patterns of headings, breaks, section anchors and tables.
HEADING = "^(#{1,6})[ \\t]+(.+?)(?:[ \\t]+#+[ \\t]*)?$"
BREAK = "^\\s*([*_-])(?:\\s*\\1){2,}\\s*$"
ANCHOR = "<!--\\s*SECTION_ANCHOR:\\s*level\\s*=\\s*(\\d+)\\s*,\\s*title\\s*=\\s*['\"]([^'\"]+)['\"]\\s*-->"
TABLE = "\\|.*\\|.*\\n\\s*\\|[\\s:]*-+[\\s:|-]*\\|"


def heading(line: Column) -> tuple[Column, Column]:
    """Level and title of an ATX heading; level 0 for other lines."""
    return F.length(F.regexp_extract(F.trim(line), HEADING, 1)), F.trim(F.regexp_extract(F.trim(line), HEADING, 2))


def thematic_break(line: Column) -> Column:
    return line.rlike(BREAK)


def has_table(text: Column) -> Column:
    return text.rlike(TABLE)


def has_image(text: Column) -> Column:
    return F.contains(text, F.lit("!["))


def section_anchors(text: Column) -> Column:
    """Array of (level, title, offset) of anchors with a level and a title, in order; offset in characters."""
    marks = F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(0))
    levels, titles = (F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(k)) for k in (1, 2))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("seen"))
    # Each mark is sought behind the one before.
    found_at = lambda a, m: F.call_function("locate", m, text, a["seen"] + 1)
    walk = F.aggregate(marks, start, lambda a, m: F.struct(F.concat(a["at"], F.array(found_at(a, m) - 1)).alias("at"), (found_at(a, m) - 1 + F.length(m)).alias("seen")))
    offsets = walk["at"]
    found = F.transform(F.arrays_zip(levels.alias("l"), titles.alias("t"), offsets.alias("o")), lambda x: F.struct(x["l"].cast("int").alias("level"), F.trim(x["t"]).alias("title"), x["o"].alias("offset")))
    return F.filter(found, lambda x: (x["level"] >= 1) & (x["title"] != ""))


def node_id(document: Column, path: Column, level: Column, page: Column, start: Column, end: Column, span_start: Column) -> Column:
    """Stable id: SHA-256 over the document, the folded path and the place."""
    folded = F.array_join(F.transform(path, key_of), "|")
    return F.sha2(F.concat_ws("|", document, folded, *(x.cast("string") for x in (level, page, start, end, span_start))), 256)


def request_id(unit: Column, query: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", unit, query), 256), F.lit(24))


def trust_tier(track: Column, authority: Column, confidence: Column) -> Column:
    """Trust tier of content by its source: native, external OCR by confidence (0.9, 0.75), or interpretation."""
    ocr = F.when(confidence >= 0.9, "external_ocr_high").when(confidence >= 0.75, "external_ocr_medium").otherwise("external_ocr_low")
    native = F.when(authority == "authoritative", "native_exact").otherwise("native_layout_backed")
    return F.when(track == "native", native).when(track == "external_ocr", ocr).otherwise("visual_interpretive")


def artifact_ref(run_type: Column, run: Column, document: Column, path: Column) -> Column:
    return F.concat(F.lit("pg://"), F.concat_ws("/", *(F.url_encode(x) for x in (run_type, run, document)), path))


def parse_ref(ref: Column) -> Column:
    """(run_type, run_id, document_id, path) of a ref."""
    parts = F.split(F.substring(ref, 6, 1 << 30), "/", 4)
    return F.struct(*(F.url_decode(F.get(parts, k)).alias(n) for k, n in enumerate(("run_type", "run_id", "document_id"))), F.get(parts, 3).alias("path"))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(2.0), F.lit(0.25) * F.pow(F.lit(2.0), attempt - 1))


# The same rules for DuckDB; ß is the only character of the tables that folds otherwise than it lower-cases.
_P = PUNCT.replace("'", "''")
_S = "[\\s\\x1c-\\x1f\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}]+"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_key(x: str) -> str:
    return sql_fold(sql_collapse(x))


def sql_normalize(x: str) -> str:
    return sql_collapse(f"translate({sql_fold(x)}, '{_P}', '{' ' * len(PUNCT)}')")


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_normalize(x)}, ' '), lambda t: t <> '')"
