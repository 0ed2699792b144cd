"""Cleaning of model replies (STR-07, STR-21) and of scanned text (STR-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import ocr_joined, strip

# The marks of reasoning regions, control tokens and openings of a monologue.
REGIONS = [("<think>", "</think>"), ("<｜thought｜>", "<｜end of thought｜>")]
CONTROL_TOKENS = [
    "<|im_start|>user", "<|im_start|>assistant", "<|im_start|>system",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|grounding|>",
    "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>",
    "<|eot_id|>", "<|begin_of_text|>",
    "<｜begin of sentence｜>", "<｜end of sentence｜>",
    "<｜User｜>", "<｜Assistant｜>",
    "<think>", "</think>",
]
OPENINGS = ["let me", "i will", "analyzing", "looking at"]
MONOLOGUE = ["let me", "i will", "the user wants", "analyzing", "reconstruct", "looking at", "carefully"]

# Suffixes that a scan parts from their words, words that are no stem of one, and misread words.
SUFFIXES = "lar|ler|lık|lik|luk|lük|mda|mde|nda|nde|nin|nın|nün|nun|yu|yü|cı|ci|cu|cü|lüğü|luğu|liğe|liğine|sının|sinin|ları|leri|yeti|yati|liği|lığı"
DOUBTFUL_SUFFIXES = "ten|tan|den|dan|ya|ye"
NO_STEMS = (
    "pin for all greater less hold step top at to in on and is was with by see wait each every about than line channel bank byte bit core clock port buffer item page"
).split()
CORRECTIONS = [
    (r"\bİke\s*susl?\s*ar?\b", "İksoslar"),
    (r"\bİkesusla\s*rın\b", "İksosların"),
    (r"\bTep\s+de\s*vri\b", "Teb devri"),
    (r"\binh\s*itat\b", "inhitat"),
    (r"\bBeşin\s+ci\b", "Beşinci"),
    (r"\bmedeni\s+yeti\b", "medeniyeti"),
    (r"\bm\s+usiki\b", "musiki"),
    (r"\bimpa\s*rator\s*luk?\b", "imparatorluk"),
    (r"\bim\s*paratorlu\s*ğu\b", "imparatorluğu"),
    (r"\bSan['’\s]*at\s*ler\b", "Sanatları"),
    (r"\bS\.\s*lll\.\b", "S. III."),
    (r"\bM\.\s*E\.\b", "M.Ö."),
    (r"(?-i:circu it)", "circuit"),
    (r"(?-i:transi stor)", "transistor"),
    (r"(?-i:resis tor)", "resistor"),
    (r"(?-i:capaci tor)", "capacitor"),
    (r"\bsw1ng1ng\b", "swinging"),
    (r"\bc1rcu1t\b", "circuit"),
    (r"\bc1rcu1ts\b", "circuits"),
    (r"\bd1stortion\b", "distortion"),
    (r"\bd1g1tal\b", "digital"),
    (r"\bampl1f1er\b", "amplifier"),
    (r"\btrans1stor\b", "transistor"),
    (r"\bres1stor\b", "resistor"),
    (r"\bcapac1tor\b", "capacitor"),
    (r"\brnicro\b", "micro"),
    (r"\bcligital\b", "digital"),
    (r"\banaclog\b", "analogue"),
    (r"\bF1gute\b", "Figure"),
    (r"\bf1gure\b", "figure"),
]
#: How what is corrected begins.
CORRECTED = r"\b[İTiBmSMcrsdaf]|c(?:ircu it|apaci tor)|transi stor|resis tor"
_LETTERS = "a-zA-ZçğıöşüÇĞİÖŞÜ"


def _quoted(words: list[str]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def without_regions(c: Column, opening: str, closing: str) -> Column:
    """``c`` without the regions between two marks, nested ones with what surrounds them, and without all that follows a mark
    that is never closed. Closing marks with nothing open stay.

    A fold over the text cut at its marks: the open marks are a stack of how much was kept when each was met, so a closing mark
    takes back what was kept since, and the first open one left at the end takes the rest.
    """
    kind = "struct<open:array<int>,kept:array<string>>"
    parts = F.split(c, rf"(?=\Q{opening}\E)|(?<=\Q{opening}\E)|(?=\Q{closing}\E)|(?<=\Q{closing}\E)")

    def step(acc: Column, part: Column) -> Column:
        some = F.size(acc["open"]) > 0
        deeper = F.struct(F.concat(acc["open"], F.array(F.size(acc["kept"]))), acc["kept"])
        closed = F.struct(F.slice(acc["open"], 1, F.size(acc["open"]) - 1), F.slice(acc["kept"], 1, F.element_at(acc["open"], -1)))
        more = F.struct(acc["open"], F.concat(acc["kept"], F.array(part)))
        return F.when(part == opening, deeper.cast(kind)).when((part == closing) & some, closed.cast(kind)).otherwise(more.cast(kind))

    start = F.struct(F.array().cast("array<int>"), F.array().cast("array<string>")).cast(kind)
    left = F.aggregate(parts, start, step, lambda a: F.array_join(F.when(F.size(a["open"]) > 0, F.slice(a["kept"], 1, a["open"][0])).otherwise(a["kept"]), ""))
    return F.when(F.contains(c, F.lit(opening)), left).otherwise(c)


def without_reasoning(c: Column) -> Column:
    """STR-21: without think regions, nested ones too, and the fence around an answer."""
    marks = F.regexp_replace(F.regexp_replace(c, "(?i)<think(?:ing)?>", "<think>"), "(?i)</think(?:ing)?>", "</think>")
    out = strip(F.replace(without_regions(marks, "<think>", "</think>"), F.lit("</think>"), F.lit("")))
    return strip(F.regexp_replace(out, r"(?s)\A```[a-zA-Z]*\s*\n(.*?)\n?```\z", "$1"))


def clean_reply(c: Column) -> Column:
    """STR-07: a reply without reasoning, fullwidth brackets, role headers, control tokens, file marks and the monologue before
    its first heading or paragraph. Repeated lines are :func:`millrace.operators.lines.without_repeats`'s."""
    out = F.coalesce(c, F.lit(""))
    for opening, closing in REGIONS:
        out = without_regions(out, opening, closing)
    out = F.regexp_replace(out, r"【.*?】", "")
    out = F.regexp_replace(out, r"(?s)<\|start_header_id\|>.*?<\|end_header_id\|>", "")
    # Longer tokens come before those that start them; one pass is enough, as no removal makes a new token but by nesting.
    out = F.regexp_replace(out, _quoted(CONTROL_TOKENS), "")
    out = F.regexp_replace(out, r"<\|file:[^>]+>", "")
    out = F.regexp_replace(out, rf"(?isu)\A(?:{_quoted(OPENINGS)}).*?(?=\n#|\n\n|\z)", "")
    heading = F.regexp_instr(out, F.lit(r"(?mU)^#{1,3}\s+"))
    before = F.lower(F.substr(out, F.lit(1), heading - 1))
    monologue = (heading > 1) & before.rlike(_quoted(MONOLOGUE))
    return strip(F.when(monologue, F.substr(out, heading, F.length(out))).otherwise(out))


def replaced_once(c: Column, pairs: list[tuple[str, str]], flags: str = "iuU", starts: str = "") -> Column:
    """``c`` with every match of a dictionary's patterns replaced, in one pass of one combined pattern.

    At each place the first pattern of the list that matches wins, so longer ones go before their beginnings. Only matches are
    looked up; replacements are never searched again. ``starts`` is what every match begins with, so that most places are passed over.
    """
    bound = r"\b"
    every = f"(?{flags})(?={starts})(?:" + "|".join(f"(?:{p})" for p, _ in pairs) + ")"

    def new(m: Column) -> Column:
        out = m
        for p, r in reversed(pairs):
            # What surrounds a match was looked at when it was found.
            out = F.when(m.rlike(rf"(?{flags})\A(?:{p.removeprefix(bound).removesuffix(bound)})\z"), F.lit(r)).otherwise(out)
        return out

    def joined(text: Column, found: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, every, -1), F.concat(F.transform(found, new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    each = lambda text: _once(F.regexp_extract_all(text, F.lit(every), F.lit(0)), lambda found: F.when(F.size(found) > 0, joined(text, found)).otherwise(text))
    return _once(c, each)


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is made once a row, as one element of an array, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def clean_scan(c: Column) -> Column:
    """STR-05: scanned text with broken words joined: at line ends, before suffixes (doubtful ones only in a text with Turkish
    letters, and never after NO_STEMS), and with misread words corrected."""
    # Letters and white space exclude each other, so neither gives anything back (++) when no suffix follows.
    out = F.regexp_replace(ocr_joined(c), rf"(?iuU)\b([{_LETTERS}]{{3,}}+)\s++({SUFFIXES})\b", "$1$2")
    kept = rf"(\b(?:{'|'.join(NO_STEMS)})\s+(?:{DOUBTFUL_SUFFIXES})\b)"
    pattern = rf"(?iuU){kept}|\b([{_LETTERS}]{{3,}}+)\s++({DOUBTFUL_SUFFIXES})\b"
    joined = _once(out, lambda x: F.when(x.rlike("[çğıöşüÇĞİÖŞÜ]"), F.regexp_replace(x, pattern, "$1$2$3")).otherwise(x))
    return replaced_once(joined, CORRECTIONS, starts=CORRECTED)
