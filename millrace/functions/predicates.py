"""Small rules over single columns: what is taken in, how it is named, and how prompts are put together."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

# Kinds of code units, name parts of embedding models, endings of media and assets.
UNIT_TYPES = ("function", "class", "loop", "macro", "namespace")
EMBEDDING_HINTS = ("embed", "bge", "nomic", "minilm", "e5-", "gte-")
# Folders, parts of paths and extensions of media and assets, and the MIME types of pages that aren't text/*.
MEDIA_FOLDERS = ["images/", "img/", "css/", "js/", "fonts/", "style/", "static/", "users/", "api/", "tags/"]
MEDIA_PARTS = ["/img/", "/images/", "/content/img/", "sprite", "favicon"]
MEDIA_EXTENSIONS = [".css", ".js", ".png", ".jpg", ".jpeg", ".svg", ".gif", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".json", ".xml", ".mp3", ".mp4"]
PAGE_TYPES = ["application/xhtml+xml", "application/html"]
#: What a model is told by the category of its task.
SYSTEM_PROMPTS = {
    "explanation": ("Explain the given code step by step.", "Verilen kodu adım adım açıkla."),
    "completion": ("Complete the given code.", "Verilen kodu tamamla."),
    "bug_fix": ("Find the fault in the given code and mend it.", "Verilen koddaki hatayı bul ve düzelt."),
    "unit_test": ("Write tests for the given code.", "Verilen kod için test yaz."),
    "documentation": ("Write documentation for the given code.", "Verilen kodu belgele."),
    "refactoring": ("Make the given code clearer without changing what it does.", "İşlevini değiştirmeden kodu sadeleştir."),
}


def of_types(unit_type: Column, types: list[str]) -> Column:
    """FLT-14: units of the asked types; an unknown type is an error."""
    unknown = [t for t in types if t not in UNIT_TYPES]
    if unknown:
        raise ValueError(f"unknown unit types: {', '.join(unknown)}")
    return unit_type.isin(*types)


def to_embed(text: Column, is_embedded: Column) -> Column:
    """FLT-25: has text and isn't embedded yet."""
    return (strip(F.coalesce(text, F.lit(""))) != "") & (F.coalesce(is_embedded, F.lit(0)) == 0)


def is_page(path: Column, mime: Column) -> Column:
    """FLT-32: no media or asset by its path, and text by its MIME type, if it has one."""
    lowered = F.lower(F.coalesce(path, F.lit("")))
    quoted = lambda words: "|".join(rf"\Q{w}\E" for w in words)
    asset = lowered.rlike(rf"\A(?:{quoted(MEDIA_FOLDERS)})|{quoted(MEDIA_PARTS)}") | F.substring_index(lowered, "?", 1).rlike(rf"(?:{quoted(MEDIA_EXTENSIONS)})\z")
    kind = F.coalesce(mime, F.lit(""))
    return ~asset & ((kind == "") | F.startswith(kind, F.lit("text/")) | kind.isin(*PAGE_TYPES))


def is_chat_model(name: Column) -> Column:
    """FLT-38: no embedding model by its name."""
    return ~F.coalesce(F.lower(name).rlike("|".join(EMBEDDING_HINTS)), F.lit(False))


def reply_status(text: Column, least: int = 25, errors: tuple[str, ...] = ("[error", "error:")) -> Column:
    """FLT-30: failed (empty or an error), low_quality (under ``least`` characters) or success."""
    s = strip(F.coalesce(text, F.lit("")))
    failed = s == ""
    for e in errors:
        failed = failed | F.lower(s).startswith(e)
    return F.when(failed, "failed").when(F.length(s) < least, "low_quality").otherwise("success")


def own_input(text: Column) -> Column:
    """PRJ-03: an input that only repeats the context counts as none."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s.startswith("Context:") | s.startswith("Bağlam:"), "").otherwise(F.coalesce(text, F.lit("")))


def system_prompt(category: Column, turkish: Column | None = None) -> Column:
    """PRJ-08: what a model is told by its task's category, in English or Turkish; null for other categories."""
    english, other = (F.create_map(*[F.lit(x) for k, v in SYSTEM_PROMPTS.items() for x in (k, v[i])]) for i in (0, 1))
    said = F.try_element_at(english, category)
    return said if turkish is None else F.when(turkish, F.try_element_at(other, category)).otherwise(said)


def title_chain(titles: Column) -> Column:
    """PRJ-10: the titles of an outline from the top down to a node, joined; blank ones are left out."""
    return F.array_join(F.filter(F.transform(titles, strip), lambda t: t != ""), " - ")


def worker_of(position: Column, workers: int) -> Column:
    """PRJ-12: which of the workers takes a position."""
    return F.pmod(position, F.lit(workers)).cast("int")


def prompt_text(text: Column, most: int = 4000) -> Column:
    """PRJ-14: what a model call may see of a text (a limit of the model, not of the corpus)."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def question_instruction(title: Column, tags: Column, body: Column) -> Column:
    """PRJ-15: a thread's question as one instruction: title, tags and body."""
    return F.concat_ws("\n\n", title, F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))), F.nullif(strip(F.coalesce(body, F.lit(""))), F.lit("")))


# What tells the language of a code block.
C_SIGNS = ["#include", "void ", "int ", "uint32_t", "uint16_t", "uint8_t", "struct ", "//", "/*", "dma_", "stdio.h"]
PYTHON_SIGNS = ["def ", "import ", "class ", "elif ", "self."]


def code_language(code: Column) -> Column:
    """STR-14: c if any of its signs occurs, else python if one of its signs does, else c."""
    holds = lambda signs: F.coalesce(code.rlike("|".join(rf"\Q{x}\E" for x in signs)), F.lit(False))
    return F.when(~holds(C_SIGNS) & holds(PYTHON_SIGNS), "python").otherwise("c")


def comment_text(block: Column) -> Column:
    """STR-19: a comment block without its markers, line by line."""
    lines = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:/\*\*?|\*/|\*|///?|#)\s?", ""), r"\s*\*/\s*$", ""))
    return strip(F.array_join(lines, "\n"))


def signature(code: Column, lines: int = 3, most: int = 240) -> Column:
    """STR-20: the first lines of a unit up to its body or the end of its head, as one line of bounded length."""
    head = F.array_join(F.slice(F.split(code, "\n"), 1, lines), " ")
    upto = F.regexp_extract(head, r"(?s)^(.*?)(?:[{;]|\)\s*:|$)", 1)
    closed = F.when(F.regexp_extract(head, r"(?s)^(.*?)([{;]|\)\s*:|$)", 2).startswith(")"), ")").otherwise("")
    return F.substring(F.regexp_replace(F.trim(F.concat(upto, closed)), r"\s+", " "), 1, most)


def with_image_root(markdown: Column, root: str) -> Column:
    """STR-26: relative image links of a Markdown text under a root."""
    return F.regexp_replace(markdown, r"!\[([^\]]*)\]\((?!https?://|/)([^)]+)\)", rf"![$1]({root}/$2)")


def instruction_text(instruction: Column, given: Column, output: Column) -> Column:
    """STR-27: a record as plain text for models without a chat template; what is given is a paragraph of the instruction."""
    asked = F.concat(instruction, F.when(strip(F.coalesce(given, F.lit(""))) != "", F.concat(F.lit("\n\n"), given)).otherwise(""))
    return F.concat(F.lit("### Instruction:\n"), asked, F.lit("\n\n### Response:\n"), output)


def iso_utc(at: datetime | Column) -> Column:
    """MH-09: an instant as UTC in ISO form, to the second."""
    c = at if isinstance(at, Column) else F.lit(at)
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
