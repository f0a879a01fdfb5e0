"""Chat formatting with masks that follow token offsets.

Turns are rendered as ``### role: text </turn>`` lines, whole conversations at a time, encoded once
with offsets; the sorted spans of the turns that count for the loss are intersected with the token
spans by binary search. Control strings inside roles and texts are escaped so that they can be read
back exactly.

A conversation of very many turns is rendered in blocks of consecutive turn numbers, so that no task
holds it whole. A block begins with ``###`` after a line end, where the tokenizer always begins a
new token; the blocks' ids joined are those of the whole conversation.

Defined results: null texts and roles are empty; turns are ordered by number, then role, then text,
null numbers first; repeated rows are repeated turns; rows without ``conv_id`` are one conversation;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive turn numbers rendered as one text.
BLOCK_TURNS = 64
LOSS_ROLE = "assistant"

_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c", "\n": "\\n"}
_BACK = {mark[1]: plain for plain, mark in _ESCAPES.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_MARK = re.compile(r"\\(.)")
_TURN = re.compile(r"### (.*?): (.*?) </turn>\n", re.S)


def escaped(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: _ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return _MARK.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and the spans in it of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escaped(role, role=True)}: ", escaped(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, " </turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def loss_mask(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Which tokens touch a span, and the parts of the spans they cover, each character once.

    Both lists are sorted; for every token the last span that begins before its end is found by
    binary search. Tokens that share the bytes of one character have the same place.
    """
    starts, mask, covered, done = [s for s, _ in spans], [], [], 0
    for start, end in tokens:
        at = bisect_right(starts, end - 1) - 1
        hit = at >= 0 and end > start and spans[at][1] > start
        mask.append(int(hit))
        if not hit:
            continue
        # A token may touch more than one span when the texts between are short.
        first = at
        while first > 0 and spans[first - 1][1] > start:
            first -= 1
        for low, high in spans[first:at + 1]:
            low, high = max(low, start, done), min(high, end)
            if low < high:
                if covered and covered[-1][1] == low and low not in starts[first:at + 1]:
                    covered[-1] = (covered[-1][0], high)
                else:
                    covered.append((low, high))
                done = high
    return mask, covered


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys, across batches."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _formatted(batches: Iterator[pa.RecordBatch], path: str, loss_role: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = _tokenizer(path).encode_batch([r["formatted"] for r in rows], add_special_tokens=False)
        for row, one in zip(rows, found, strict=True):
            row["ids"] = one.ids
            row["mask"], spans = loss_mask(one.offsets, row.pop("spans"))
            row["loss_spans"] = [{"start": a, "end": b} for a, b in spans]
        yield pa.RecordBatch.from_pylist(rows, schema)

    ready, size = [], 0
    for (conv_id, block), turns in _groups(batches, ["conv_id", "block"]):
        text, spans = render([(t["role"], t["text"]) for t in turns], loss_role)
        ready.append({"conv_id": conv_id, "block": block, "n_turns": len(turns), "formatted": text, "spans": spans})
        size += len(text)
        if size > 1 << 20:
            yield from emit(ready)
            ready, size = [], 0
    if ready:
        yield from emit(ready)


def format_conversations(turns: DataFrame, path: str, loss_role: str = LOSS_ROLE, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, block, n_turns, formatted, ids, mask, loss_spans`` per block of a conversation.

    ``mask`` is 1 for tokens that touch a text of ``loss_role``; ``loss_spans`` are the parts of
    ``formatted`` that count, as character places.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("bigint").alias("block"),
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("conv_id", pa.string() if conv == "string" else pa.int32() if conv == "int" else pa.int64()),
        ("block", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8())), ("loss_spans", pa.list_(span)),
    ])
    return rows.drop("turn").mapInArrow(
        partial(_formatted, path=path, loss_role=loss_role, schema=schema),
        f"conv_id {conv}, block bigint, n_turns bigint, formatted string, ids array<int>, "
        "mask array<tinyint>, loss_spans array<struct<start: bigint, end: bigint>>",
    )


def _read_back(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, state = None, None

    def result() -> pa.RecordBatch:
        n, all_turns, chars, loss, size, tokens, masked = state
        return pa.RecordBatch.from_pylist([{
            "conv_id": key, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": chars,
            "loss_sha256": loss.hexdigest(), "formatted_chars": size, "n_tokens": tokens, "loss_tokens": masked,
        }], schema)

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    yield result()
                key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            text = row["formatted"]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            loss = unescaped("".join(text[s["start"]:s["end"]] for s in row["loss_spans"]))
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(text)
            state[5] += len(row["mask"])
            state[6] += sum(row["mask"])
    if state is not None:
        yield result()


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them, a row per conversation.

    The blocks of a conversation pass in order through running digests; no task holds them together.
    """
    conv = formatted.schema["conv_id"].dataType.simpleString()
    names = {"n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
             "formatted_chars": "bigint", "n_tokens": "bigint", "loss_tokens": "bigint"}
    schema = pa.schema([("conv_id", pa.string() if conv == "string" else pa.int32() if conv == "int" else pa.int64()),
                        *((n, pa.string() if k == "string" else pa.int64()) for n, k in names.items())])
    rows = formatted.select("conv_id", "block", "formatted", "mask", "loss_spans")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        partial(_read_back, schema=schema), f"conv_id {conv}, " + ", ".join(f"{n} {k}" for n, k in names.items())
    )
