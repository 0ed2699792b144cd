"""Column functions over text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks legal and front-matter text, as patterns over lower-cased text.
BOILERPLATE = [
    r"\blicen[sc]e\b", r"\bcopyright\b", r"\bcreative commons\b", r"\bcc by-nd\b", r"\bcc-by\b", r"\bcopyright\s+synopsys\b", r"\bsynopsys\s+copyright\b", r"\bportions\s+copyright\b",
    r"\bcolophon\b", r"\bbuild-date\b", r"\bbuild-version\b", r"\bdisclaimer\b", r"\bindemnif\w*\b", r"\bhigh risk activities\b", r"\ball rights reserved\b", r"\btable of contents\b",
    r"\biçindekiler\b", r"\bfihrist\b", r"\btelif hakkı\b", r"\blisans\b", r"\bgaranti muafiyeti\b", r"\byasal uyarı\b", r"\bstandard terms\b",
]
# What a text must hold for any of these patterns to match; a search for them is much faster than the patterns.
BOILERPLATE_LITERALS = [
    "licen", "copyright", "creative commons", "cc by-nd", "cc-by", "colophon", "build-date", "build-version", "disclaimer", "indemnif", "high risk activities", "all rights reserved",
    "table of contents", "içindekiler", "fihrist", "telif hakkı", "lisans", "garanti muafiyeti", "yasal uyarı", "standard terms",
]
# Titles and openings of articles without content.
BOILERPLATE_TITLES = ["colophon", "table of contents", "içindekiler", "fihrist", "disclaimer", "revision history", "document history"]
BOILERPLATE_OPENINGS = ["colophon", "creative commons attribution", "portions copyright"]
# Openings by which a persona introduces itself.
PERSONA_INTROS = [
    r"^(?:As a|I am a|Being a)\s+Senior\s+[^.\n]+\.?\s*",
    r"^İşte\s+[^.\n]+\s+sunan\s+(?:bir\s+)?belge:\s*",
    r"^İşte\s+[^.\n]+\s+teknik\s+açıklama:\s*",
    r"^Here is a comprehensive architecture[^.\n]+:\s*",
    r"^Here is a detailed static analysis[^.\n]+:\s*",
]
# Words of Turkish, and summaries that say nothing.
TURKISH_WORDS = "nedir nelerdir nasıl veya ile bir için bu ne ve de da".split()
EMPTY_SUMMARIES = ["özet bulunamadı.", "özet bulunamadı", "summary unavailable.", "summary unavailable", ""]


def strip(c: Column) -> Column:
    """``c`` without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def is_boilerplate(c: Column) -> Column:
    """FLT-04: legal or front-matter words anywhere in the text; null is not.

    The lower-cased text is one element of an array, so that it is made once a row in filters too; the patterns run only on
    texts that hold one of the literals they need.
    """

    def found(low: Column) -> Column:
        held = F.lit(False)
        for k in BOILERPLATE_LITERALS:
            held = held | low.contains(k)
        return F.when(held, low.rlike("(?U)" + "|".join(BOILERPLATE))).otherwise(False)

    return F.coalesce(F.exists(F.array(F.lower(c)), found), F.lit(False))


def is_boilerplate_article(title: Column, text: Column) -> Column:
    """FLT-05: by the title, or by the first 400 characters."""
    t, head = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 400))
    found = F.lit(False)
    for k in BOILERPLATE_TITLES:
        found = found | t.contains(k)
    for k in BOILERPLATE_OPENINGS:
        found = found | head.contains(k)
    return found


def is_toc_line(line: Column) -> Column:
    """FLT-12: dot leaders with a page number, four dots anywhere, or nothing but dots."""
    s = strip(F.replace(line, F.lit(" "), F.lit(" ")))
    return s.rlike(r"(?:\.\s*){3,}\d+\z|(?:\.\s*){4,}|\A(?:\.\s*){3,}\z")


def is_table_row(line: Column) -> Column:
    """STR-09: a row of a Markdown table, with or without outer pipes."""
    s = strip(line)
    return ~s.startswith("#") & s.contains("|") & ~((s.startswith("- ") | s.startswith("* ") | s.startswith("> ")) & ~(s.startswith("|") & s.endswith("|")))


def preview(c: Column, n: int = 400) -> Column:
    """PRJ-04: the first n characters, marked where more follow."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """STR-12: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_token_estimate(c: Column) -> Column:
    """STR-13: 1.35 tokens a word, rounded down."""
    return F.floor(F.size(words(c)) * F.lit(1.35)).cast("int")


def slug(c: Column) -> Column:
    """STR-25: stripped, lower-cased, spaces as underscores."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def strip_persona(c: Column) -> Column:
    """STR-06: without persona openings and a leading rule."""
    out = strip(F.coalesce(c, F.lit("")))
    for p in PERSONA_INTROS:
        out = strip(F.regexp_replace(out, "(?iumd)" + p, ""))
    return strip(F.regexp_replace(out, r"\A(?:---\s*\n)+", ""))


def strip_line_numbers(c: Column) -> Column:
    """STR-28: a number at the start of lines goes if at least half of the lines have one."""
    lines = F.split(c, "\n")
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\d+\s+")))
    return F.when(2 * numbered >= F.size(lines), F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*\d+\s", "")), "\n")).otherwise(c)


def is_turkish(c: Column) -> Column:
    """FLT-35: holds one of a dozen whole words."""
    return F.coalesce(F.lower(c).rlike(r"(?U)\b(?:" + "|".join(TURKISH_WORDS) + r")\b"), F.lit(False))


def summary_usable(c: Column) -> Column:
    """FLT-29: over 20 characters and none of the summaries that say nothing."""
    s = strip(F.coalesce(c, F.lit("")))
    return ~F.lower(s).isin(EMPTY_SUMMARIES) & (F.length(s) > 20)


def first_non_empty(*cs: Column) -> Column:
    """PRJ-02: the first that isn't null or blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cs])


def ocr_joined(c: Column) -> Column:
    """STR-05, the hyphen tier: a word broken at a line end by a hyphen is joined again."""
    return F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def word_jaccard(a: Column, b: Column) -> Column:
    """AG-20: likeness of lower-cased word sets; 1 if both are empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)))


def knowledge_gain(a: Column, b: Column) -> Column:
    """AG-20: what a second answer adds, in percent from 10 to 95."""
    return F.greatest(F.lit(10), F.least(F.lit(95), F.floor((1 - word_jaccard(a, b)) * 100).cast("int")))


def size_bucket(n: Column) -> Column:
    """AG-12: the order of magnitude of a sample count."""
    return F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")
