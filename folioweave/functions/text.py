"""Column expressions on text: sentences, comments, control tokens, digits, tables, clipping. All of them run inside the
JVM; where a pattern needs Python's idea of white space or letters, the class is spelled out.

Null texts give null unless stated; empty texts give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions import lexicon as lx

# White space as Python sees it, inside a character class of Java's patterns.
WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# A letter, digit or underscore.
W = r"\p{L}\p{N}_"
DIGIT_RUN = r"\p{Nd}{6,}"
CONTROL = rf"(?i)<[|｜][^>]{{0,80}}?[|｜]>|</?[{WS}]*(?:{lx.CONTROL_NAMES})[{WS}]*>"
FENCE = rf"(?i)<<<[{WS}]*(?:{lx.FENCE_NAMES})[{WS}]*>>>"
SENTENCE_BREAK = rf"(?<=[.!?])[{WS}]+(?=[A-Z0-9])|(?<=[।。！？])[{WS}]*"
_MASK = "\x00"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space at either end (Python's idea of it)."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def words(c: Column) -> Column:
    """Pieces between white space, in order."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def without_comments(c: Column) -> Column:
    """Markup comments removed, over lines too."""
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def sentences(c: Column) -> Column:
    """pieces between sentence ends, stripped, none empty."""
    return F.filter(F.transform(F.split(strip(c), SENTENCE_BREAK), strip), lambda s: s != "")


def sentences_abbreviated(c: Column) -> Column:
    """as F3, but no end right after an abbreviation; white space collapsed, pieces kept where empty."""
    masked = F.regexp_replace(c, rf"(?<![{W}])({'|'.join(lx.ABBREVIATIONS)})\.", f"$1{_MASK}")
    return F.transform(F.split(masked, SENTENCE_BREAK), lambda s: strip(F.regexp_replace(F.replace(s, F.lit(_MASK), F.lit(".")), f"[{WS}]+", " ")))


def scrubbed(c: Column) -> Column:
    """control tokens removed until none re-forms (five times at most), runs of white space collapsed, stripped; null is empty."""
    out = F.coalesce(c, F.lit(""))
    for _ in range(5):
        out = F.regexp_replace(out, CONTROL, "")
    return strip(F.regexp_replace(out, f"[{WS}]{{2,}}", " "))


def defanged(c: Column) -> Column:
    """fence delimiters made harmless; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), FENCE, "[delim]")


def redacted(c: Column) -> Column:
    """F16: long runs of digits of any script hidden; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), DIGIT_RUN, "[number]")


def reordered(c: Column) -> Column:
    """The one sequence that correct Bengali never has, set right."""
    return F.replace(c, F.lit("রম্ন"), F.lit("রু"))


def tabular(c: Column) -> Column:
    """A table's row or a line with a long number."""
    pipes = F.regexp_count(c, F.lit(r"\|"))
    short = F.size(F.filter(F.split(c, r"\|"), lambda x: F.size(words(x)).between(1, 3)))
    return (pipes >= 3) | c.rlike(DIGIT_RUN) | ((pipes >= 2) & (short >= 3))


def low_value(c: Column) -> Column:
    """Of 40 words or more, and repetitive, a roster, a metadata dump or mostly numbers."""
    w = words(c)
    n = F.size(w)
    runs, pipes = F.regexp_count(c, F.lit(DIGIT_RUN)), F.regexp_count(c, F.lit(r"\|"))
    repetitive = F.size(F.array_distinct(F.transform(w, F.lower))) / n < 0.12
    roster = ((pipes >= 4) & (runs >= 2)) | (runs >= 5)
    dump = c.rlike("|".join(lx.METADATA_TAGS)) | (F.size(F.filter(w, lambda x: x.rlike("^[0-9A-Fa-f]{12,}$"))) >= 2)
    numbers = F.size(F.filter(w, lambda x: x.rlike(r"^[-+(]?\p{Nd}[\p{Nd}.,%/:()\-]*\)?$"))) / n > 0.55
    return F.coalesce((n >= 40) & (repetitive | roster | dump | numbers), F.lit(False))


def clipped(c: Column, limit: int) -> Column:
    """the longest prefix of at most `limit` bytes of UTF-8 that splits no character; null is empty."""
    c = F.coalesce(c, F.lit(""))
    if limit <= 0:
        return F.lit("")
    cut = F.substring(F.encode(c, "UTF-8"), 1, limit)
    # Of the bytes cut off in mid-character at most three are left over.
    tries = F.array(*[F.expr("0") if i == 0 else F.lit(i) for i in range(4)])
    whole = F.transform(tries, lambda i: F.try_validate_utf8(F.substring(cut, F.lit(1), F.length(cut) - i).cast("string")))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.element_at(F.filter(whole, lambda s: s.isNotNull()), 1))


def basename(c: Column) -> Column:
    """what follows the last slash."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def extension(c: Column) -> Column:
    """The suffix of a file name in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(c), r"[^/.][^/]*\.([^./]+)$", 1))


def slug(c: Column) -> Column:
    """a project's name as a folder name; empty and null give `default`."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9._-]+", "-")
    s = F.substring(F.lower(F.regexp_replace(s, "^[-_.]+|[-_.]+$", "")), 1, 120)
    return F.when(s == "", "default").otherwise(s)


def source_of(first: Column, name: Column) -> Column:
    """The source that a document's first line names, else its own name without `.md`."""
    held = F.regexp_extract(first, "^<!-- source:\\s*([^·]*?)\\s*(?:·.*)?-->", 1)
    return F.when(held != "", held).otherwise(F.regexp_replace(name, r"\.md$", ""))


def method_of(first: Column) -> Column:
    """The method that a document's first line names, else empty."""
    return F.when(first.startswith("<!-- source:"), F.regexp_extract(first, "·\\s*method:\\s*([^·]*?)\\s*(?:·.*)?-->", 1)).otherwise("")


def skip_category(name: Column) -> Column:
    """Media, font, gdrive-pointer or junk by name alone; null for a file to convert."""
    ext, low = extension(name), F.lower(basename(name))
    return (
        F.when(ext.isin(lx.IMAGE_EXTENSIONS + lx.VIDEO_EXTENSIONS + lx.AUDIO_EXTENSIONS), "media")
        .when(ext.isin(lx.FONT_EXTENSIONS), "font")
        .when(ext.isin(lx.POINTER_EXTENSIONS), "gdrive-pointer")
        .when(ext.isin(lx.JUNK_EXTENSIONS) | low.isin(lx.JUNK_NAMES), "junk")
    )


def html_text(c: Column) -> Column:
    """The text of an HTML page: comments, scripts, styles and tags removed, blocks on lines of their own, headings
    and list items marked as Markdown does, entities of markup and numbers resolved."""
    t = F.regexp_replace(without_comments(c), r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", " ")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|h[1-6]|ul|ol|table|tr|section|article|header|footer|blockquote|pre)\b[^>]*>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)</?[a-zA-Z!][^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " ?\n ?", "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def broken_bengali(c: Column) -> Column:
    """Of 60 Bengali characters and 10 vowel signs or more, more than 15 % of the signs stand after no consonant."""
    signs = "[ািীুূৃেৈোৌৗ]"
    alone = rf"(?<![ক-নপ-রলশ-হড়ঢ়য়ৎংঃঁ়্]){signs}"
    n = F.regexp_count(c, F.lit(signs))
    return (F.regexp_count(c, F.lit("[ঀ-৿]")) >= 60) & (n >= 10) & (F.regexp_count(c, F.lit(alone)) / n > 0.15)


# Characters that carry letters in legacy Bengali fonts; dashes, curly quotes and the like are left out on purpose.
LEGACY_LETTER = "[\\x{a0}-\\x{ff}\\x{152}-\\x{178}\\x{192}\\x{2c6}\\x{2dc}]"


def legacy_density(c: Column) -> Column:
    """Share of legacy-font letters among what is no space; 0 below 20 characters."""
    solid = F.regexp_replace(c, f"[{WS}]+", "")
    return F.when(F.length(solid) >= 20, F.regexp_count(solid, F.lit(LEGACY_LETTER)) / F.length(solid)).otherwise(F.lit(0.0))
