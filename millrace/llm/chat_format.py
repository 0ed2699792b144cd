r"""Chat formatting with Spark expressions only.

A conversation becomes one string of blocks, one for each run of turns of the same role::

    <|im_start|>role\ntext<|im_sep|>text<|im_end|>\n

Inside roles and texts ``\`` is written ``\\`` and ``<|`` is written ``<\|``, so no text can hold a control string and
the output can be read back exactly. (In roles a line end is written ``<\/``.)

The loss mask is a list of runs ``(n, loss)`` of code points over the whole output; texts of assistant turns have loss.

Defined results: null texts and roles are empty; rows of one turn number are ordered by role, then text; rows with a null
conv_id form a conversation of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\/"))


def _role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def _runs_of(lengths: Column, loss: Column) -> Column:
    """Runs of a block's texts, with the separators between them."""
    return F.flatten(
        F.transform(
            lengths,
            lambda n, i: F.when(i == 0, F.array(F.struct(n.alias("n"), loss.alias("loss")))).otherwise(
                F.array(F.struct(F.lit(len(SEP)).alias("n"), F.lit(False).alias("loss")), F.struct(n.alias("n"), loss.alias("loss")))
            ),
        )
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask for ``turns`` (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    at = F.sequence(F.lit(0), F.size("ts") - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    convs = convs.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, j: F.struct(
            F.get("ts", s)["role"].alias("role"),
            F.transform(F.slice("ts", s + 1, F.coalesce(F.get("starts", j + 1), F.size("ts")) - s), lambda t: escaped(t["text"])).alias("texts"),
        ),
    )
    convs = convs.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), _role_escaped(b["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END))), "")
    plain = lambda n: F.array(F.struct(n.alias("n"), F.lit(False).alias("loss")))
    mask = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(plain(F.length(head(b))), _runs_of(F.transform(b["texts"], lambda t: F.length(t)), b["role"] == TRAINED_ROLE), plain(F.lit(len(END)))),
        )
    )
    return convs.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and masked (each text under the mask) from ``formatted`` and ``loss_mask`` alone.

    mask_fits tells if the runs of the mask have the lengths of the pieces of the output.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    blocks = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("role"),
            F.split(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END)), r"<\|im_sep\|>", -1).alias("texts"),
        ),
    )
    df = formatted.withColumn("blocks", blocks)
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(_role_unescaped(b["role"]).alias("role"), unescaped(t).alias("text")))))
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.concat(F.lit(START), b["role"], F.lit("\n"))),
                F.flatten(F.transform(b["texts"], lambda t, i: F.when(i == 0, F.array(t)).otherwise(F.array(F.lit(SEP), t)))),
                F.array(F.lit(END)),
            ),
        )
    )
    df = df.withColumn("pairs", F.zip_with(pieces, "loss_mask", lambda piece, run: F.struct(piece.alias("piece"), run.alias("run"))))
    masked = F.transform(F.filter("pairs", lambda x: x["run"]["loss"]), lambda x: unescaped(x["piece"]))
    fits = F.forall("pairs", lambda x: F.length(x["piece"]) == x["run"]["n"])
    return df.select("conv_id", "formatted", turns.alias("turns"), masked.alias("masked"), fits.alias("mask_fits"))
