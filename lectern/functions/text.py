"""Column expressions on text: cleaning, predicates, titles, tokens and names.

All are built-in functions, so they stay inside generated code. Patterns say ``(?d)`` where ``^``
and ``$`` must break at newlines only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TERM = "[a-z0-9]+"
PAGE_MARKER = r"<!--\s*Page\s+\d+\s*-->"
SECTION_LINE = r"^\d+\.\d+(?:\.\d+)?\s+[A-Z][a-z].{1,69}$"
FORM_TITLE = r"^[A-Z][A-Z0-9 &/()',.\-]{7,}$"
#: Lines that may be headings once white space and marks before them are gone: others are not looked at closely.
MAY_HEAD = r"^\s*(?:#{1,4}\s+)?(?:\d+\.\d|[A-Z][A-Z0-9 &/()',.\-]{7})"
MAY_OWN = r"""(?md)^(?:[^\S\n]|[*\-"])*+\d+\.\d[^\n]*"""
FAQ_START = r"(?md)(?=^\s*\d+\.\s+.+\?\s*$)"
FOLLOWUP_WORDS = ("it", "that", "this", "next", "then", "also", "too", "again", "and")
THINK = r"(?is)<think\b[^>]*>.*?(?:</think\s*>|\z)"
THINK_PAGED = rf"(?is)<think\b(?:(?!{PAGE_MARKER})[^>])*>.*?(?:</think\s*>|(?={PAGE_MARKER})|\z)"
MIN_FAQ_ENTRIES = 3
MIN_BODY_CHARS = 10
MIN_NATIVE_CHARS = 20
TITLE_CHARS = 45
SHORT_LINE_CHARS = 35


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(col(c), r"^\s+|\s+\z", "")


def newlines(c) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def strip_thinking(c) -> Column:
    """Without reasoning blocks; an unclosed one goes to the end. Null gives an empty text."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), THINK, "")


def strip_thinking_paged(c) -> Column:
    """Without reasoning blocks; none reaches over a page marker."""
    return F.regexp_replace(col(c), THINK_PAGED, "")


def without_hashes(c) -> Column:
    return F.regexp_replace(col(c), r"^#{1,4}\s+", "")


def is_section_line(c) -> Column:
    return col(c).rlike(f"(?d){SECTION_LINE}")


def is_form_title(c, boilerplate=()) -> Column:
    """All-caps line with two words of three letters at least, and no letterhead line."""
    words = F.filter(F.split(strip(c), r"\s+"), lambda x: x.rlike(r"^[A-Z]{3,}$"))
    ok = col(c).rlike(f"(?d){FORM_TITLE}") & (F.size(words) >= 2)
    return ok & ~F.lower(col(c)).isin(*boilerplate) if boilerplate else ok


def first_match(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def own_heading(c) -> Column:
    """The first line that is a section heading as a whole, bare of bullets and quotes; else null."""
    bare = lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"^[*\-]+", "")), r'^"+|"+\z', ""))
    return first_match(F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(MAY_OWN), F.lit(0)), bare), lambda x: x.rlike(f"(?d){SECTION_LINE}")))


def _bold(x: Column) -> Column:
    return strip(F.regexp_replace(strip(x), r":+\z", ""))


def chunk_title(c, source, boilerplate=()) -> Column:
    """The first of: markdown heading, own heading, bold line with a digit, bold line, first line, source."""
    text = col(c)
    some = lambda x: F.nullif(x, F.lit(""))
    bolds = F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^\*\*([^*]{3,80})\*\*"), F.lit(1)), _bold)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(f"(?i)^{PAGE_MARKER}"))
    if boilerplate:
        lines = F.filter(lines, lambda x: ~F.lower(x).isin(*boilerplate))
    heading = F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^#{1,4}\s+(.+)$"), F.lit(1)), strip)
    return F.coalesce(
        first_match(heading), own_heading(c), first_match(F.filter(bolds, lambda x: x.rlike(r"\d"))), first_match(bolds),
        F.substring(F.regexp_replace(some(first_match(lines)), r"^#+\s*", ""), 1, 80), col(source),
    )


def is_faq(c) -> Column:
    return F.regexp_count(col(c), F.lit(FAQ_START)) >= MIN_FAQ_ENTRIES


def faq_question(c) -> Column:
    """The text of the first numbered question, its white space made single; null if there is none."""
    return F.nullif(strip(F.regexp_replace(F.regexp_extract(col(c), r"(?msd)^\s*\d+\.\s+(.+?\?)", 1), r"\s+", " ")), F.lit(""))


def has_body(c) -> Column:
    """Whether MIN_BODY_CHARS characters follow the first line."""
    return F.length(strip(F.regexp_extract(strip(c), r"(?s)^[^\n]*\n(.*)\z", 1))) >= MIN_BODY_CHARS


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TERM), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def extension(c) -> Column:
    """With its dot, in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(F.regexp_extract(col(c), r"[^/]*\z", 0), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1))


def stem(c) -> Column:
    return F.when(extension(c) != "", F.regexp_replace(col(c), r"\.[^.]*\z", "")).otherwise(col(c))


def safe_filename(c) -> Column:
    base = F.regexp_extract(F.regexp_replace(col(c), r"\\", "/"), r"[^/]*\z", 0)
    return F.coalesce(F.nullif(strip(F.regexp_replace(strip(base), r"[^A-Za-z0-9 ._-]", "_")), F.lit("")), F.lit("upload"))


def content_key(c) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def percentage(x: Column) -> Column:
    """With one decimal; exact halves go to the even digit."""
    return F.format_string("%.1f%%", F.bround(x * 100, 1))


def base64_text(c) -> Column:
    """A text's UTF-8 bytes in base64, in one line: Spark breaks it every 76 characters unless a session setting forbids it."""
    return F.translate(F.base64(col(c).cast("binary")), "\r\n", "")


def text_of_base64(c) -> Column:
    return F.unbase64(col(c)).cast("string")


def quota_headers(c) -> Column:
    """The entries of a map of response headers that tell of rates: their names hold ratelimit or retry-after, case ignored."""
    return F.map_filter(col(c), lambda k, _: F.lower(k).contains("ratelimit") | F.lower(k).contains("retry-after"))


def secret_list(c) -> Column:
    """The parts of a comma-separated setting, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")


def is_rate_limit(c) -> Column:
    return F.lower(col(c)).contains("429") | F.lower(col(c)).contains("rate_limit")


def is_followup(c) -> Column:
    """Six words at most, or a first word that leans on what came before."""
    words = F.filter(F.split(strip(c), r"\s+"), lambda x: x != "")
    first = F.lower(F.regexp_replace(first_match(words), r"^[?.,!]+|[?.,!]+\z", ""))
    return (F.size(words) <= 6) | F.coalesce(first.isin(*FOLLOWUP_WORDS), F.lit(False))


def snippet(c, phrase: str, before: int = 100, after: int = 200) -> Column:
    """Text around the first occurrence of a phrase, case ignored; null if there is none."""
    text, at = col(c), F.instr(F.lower(col(c)), phrase.lower())
    start = F.greatest(at - 1 - before, F.lit(0))
    cut = F.substring(text, start + 1, at - 1 + len(phrase) + after - start)
    return F.when(at > 0, F.translate(cut, "\n", " "))


def conversation_title(c, limit: int = TITLE_CHARS) -> Column:
    text = strip(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
