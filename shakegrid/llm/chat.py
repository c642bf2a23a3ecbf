"""Chat formatting with offset-aligned loss masks (operator 3).

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline. In roles and texts a backslash is put
behind every ``<`` that backslashes or nothing part from a ``|``, so no control string can occur in them, and taking one
backslash away restores them. The whole conversation is rendered and encoded once; control strings are tokens of their
own, so no other token reaches across the border of a text. Offsets are code points. A token is under the loss mask if
binary search puts its span inside a text of an assistant.

Rows are dealt by conversation and sorted by turn (ties: role, then text); tasks read them in this order and hold one
conversation at a time. Null roles and texts are empty, null turns come first, rows with a null id are one
conversation, repeated rows are turns of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Tokenizer, processors

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistants' texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that lie inside a span; both are sorted."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    first, last = np.array(spans).T
    at = np.searchsorted(first, starts, side="right") - 1
    return (at >= 0) & (ends > starts) & (ends <= last[np.maximum(at, 0)])


def format_conversations(df: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text): text, ids, token spans and loss mask."""

    def one(conv_id, turns) -> tuple:
        text, spans = render(turns)
        enc = tokenizer(tokenizer_file).encode(text, add_special_tokens=False)
        offsets = np.array(enc.offsets, dtype=np.int32).reshape(-1, 2)
        return conv_id, len(turns), text, enc.ids, offsets[:, 0], offsets[:, 1], mask_of(offsets[:, 0], offsets[:, 1], spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, turns, size = [], (), [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held != (conv_id,):
                    if held:
                        rows.append(one(held[0], turns))
                        size += len(rows[-1][2])
                    if size > 1 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                    held, turns = (conv_id,), []
                turns.append((role or "", text or ""))
        if held:
            rows.append(one(held[0], turns))
        if rows:
            yield batch_of(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
    names = ["conv_id", "n_turns", "formatted", "ids", "token_start", "token_end", "loss_mask"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = df.select(df.conv_id.cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold: turns from the text, the loss from mask and token spans."""

    def one(conv_id, text, starts, ends, mask) -> tuple:
        turns, at = hashlib.sha256(), 0
        n = 0
        for m in TURN.finditer(text):
            turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            n += 1
        loss, size = hashlib.sha256(), 0
        marked = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, dtype=np.int8), [0]])))
        for at, end in marked.reshape(-1, 2):
            part = unescape(text[starts[at] : ends[end - 1]])
            loss.update(part.encode())
            size += len(part)
        return conv_id, n, turns.hexdigest(), size, loss.hexdigest(), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in READ.split(", ")]
        for batch in batches:
            if batch.num_rows:
                rows = [one(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "token_start", "token_end", "loss_mask")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return formatted.mapInArrow(run, READ)
