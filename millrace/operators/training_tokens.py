"""Token rows with loss masks (UD-10, UD-11, UD-28, CP-11).

A tokenizer is any function from text to ids, applied to each message between role markers; the answer is what is trained on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = "kind string, tokens array<int>, loss_mask array<int>, n_tokens int, n_prompt_tokens int, n_completion_tokens int, n_trainable_tokens int, truncated boolean"
#: Ids that a worker holds before it hands their rows on.
HELD = 1 << 20
Tokenizer = Callable[[str], list[int]]


def byte_tokenizer(text: str) -> list[int]:
    """UTF-8 bytes as ids: works without any vocabulary."""
    return list(text.encode("utf-8"))


def encoded(turns: list[tuple[str, str, bool]], tokenizer: Tokenizer, longest: int | None, kind: str) -> dict | None:
    """A row of (role, text, trained) turns cut at ``longest`` ids (None: whole); None if nothing that is trained is left."""
    ids: list[int] = []
    mask: list[int] = []
    for role, text, trained in turns:
        head, body = tokenizer(f"<|{role}|>\n"), tokenizer(f"{text.strip()}\n")
        ids += head + body
        mask += [0] * len(head) + [int(trained)] * len(body)
    prompt = mask.index(1) if 1 in mask else len(mask)
    cut = mask[:longest]
    if 1 not in cut:
        return None
    return {"kind": kind, "tokens": ids[:longest], "loss_mask": cut, "n_tokens": len(cut), "n_prompt_tokens": prompt, "n_completion_tokens": sum(cut), "n_trainable_tokens": sum(cut), "truncated": len(cut) < len(ids)}


def _rows(record: dict, tokenizer: Tokenizer, longest: int | None) -> list[dict]:
    get = lambda k: (record.get(k) or "").strip()
    messages = record.get("messages")
    if messages is not None:
        turns = [(m["role"] or "user", m["content"] or "", m["role"] == "assistant") for m in messages]
        out = [encoded(turns, tokenizer, longest, "multi_turn")] if any(t and r.strip() for _, r, t in turns) else []
    elif "chosen" in record:
        out = [encoded([("user", get("prompt"), False), ("assistant", get(k), True)], tokenizer, longest, f"dpo_{k}") for k in ("chosen", "rejected") if get(k)]
    else:
        asked = "\n\n".join(x for x in (get("instruction"), get("input")) if x)
        out = [encoded([("user", asked, False), ("assistant", get("output"), True)], tokenizer, longest, "sft")] if get("output") else []
    return [x for x in out if x]


def token_rows(records: DataFrame, sample_id: str, tokenizer: Tokenizer = byte_tokenizer, longest: int | None = 8192) -> DataFrame:
    """sample_id and the columns of ROWS: up to one row for an instruction or chat record, up to two for a preference record."""
    fields = [c for c in ("instruction", "input", "output", "prompt", "chosen", "rejected", "messages") if c in records.columns]

    chosen = records.select(sample_id, *fields)
    kind = StructType([chosen.schema[sample_id], *StructType.fromDDL(ROWS).fields])
    schema = to_arrow_schema(kind)

    def handed(ids: pa.Array, at: list[int], found: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([ids.take(pa.array(at, pa.int64())), *[pa.array([x[f.name] for x in found], f.type) for f in list(schema)[1:]]], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns = batch.column(0), dict(zip(fields, batch.columns[1:], strict=True))
            at, found, held = [], [], 0
            for i in range(batch.num_rows):
                made = _rows({c: v[i].as_py() for c, v in columns.items()}, tokenizer, longest)
                at += [i] * len(made)
                found += made
                held += sum(x["n_tokens"] for x in made)
                if held >= HELD:
                    yield handed(ids, at, found)
                    at, found, held = [], [], 0
            yield handed(ids, at, found)

    return chosen.mapInArrow(rows, kind)
