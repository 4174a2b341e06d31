"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole, encoded once with offsets, and the tokens under an assistant text
are found by binary search of the sorted turn spans in the sorted token spans. The template is

    <|start|>ROLE<|text|>TEXT<|end|> NEWLINE

for each turn. Inside roles and texts every ``<``, backslashes, ``|`` gets one more backslash, so
no control string of the template (or of the tokenizer, which has the same form) can
appear there, and taking one away gives the text back.

A conversation of any length streams through its task: after about ``segment``
characters the rendered turns are given out as a row and the next row goes on. Behind the final line
break the tokenizer starts afresh, so the rows have the same tokens as the whole would have.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
SEGMENT = 1 << 20
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
ROWS = "conv_id long, segment long, formatted string, ids array<int>, mask array<boolean>, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and where the texts of assistant turns lie in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role) + TEXT
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def token_spans(offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bounds of tokens; a gap before a token (trimmed space) belongs to it."""
    bounds = np.array(offsets, np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(bounds[:, 1]) if len(bounds) else bounds[:, 1]
    starts = np.minimum(bounds[:, 0], np.concatenate([[0], ends[:-1]])) if len(bounds) else bounds[:, 0]
    return np.maximum.accumulate(starts) if len(starts) else starts, ends


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens lie under a span, and the parts of the text that tokens and spans share."""
    mask = np.zeros(len(starts), bool)
    shared = []
    for begin, stop in spans:
        low = int(np.searchsorted(ends, begin, "right"))
        high = int(np.searchsorted(starts, stop, "left"))
        mask[low:high] = True
        if high > low and stop > begin:
            shared.append((max(begin, int(starts[low])), min(stop, int(ends[low:high].max()))))
    return mask, shared


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """``(conversation, number, turns)`` from rows in order."""
    current, number, turns, length = None, 0, [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for conv, role, text in zip(*columns, strict=True):
            if turns and (conv != current or length >= size):
                yield current, number, turns
                number, turns, length = (number + 1 if conv == current else 0), [], 0
            current = conv
            turns.append((role or "", text or ""))
            length += len(text or "")
    if turns:
        yield current, number, turns


def format_chats(conversations: DataFrame, tokenizer_path: str, segment: int = SEGMENT) -> DataFrame:
    """Formatted conversations with token ids and loss masks.

    ``conversations`` has ``conv_id, turn, role, text``. Turns are in the order of ``turn`` (nulls first; equal
    ones by role and text, so repeated rows are repeated turns). Null roles and texts are
    empty; rows without a conversation id form one conversation. One row per conversation
    and segment: ``conv_id, segment, formatted, ids, mask`` (per token) and ``loss``, the
    parts of ``formatted`` under the mask that are assistant text. Rows of a conversation follow each other in one
    partition, by segment. Other columns are ignored; an empty table gives no rows.
    """
    # The file is a fixed vocabulary; every task reads it from the given path on its machine.
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        block = []

        def out(block):
            rendered = [render(turns) for _, _, turns in block]
            encoded = tokenizer.encode_batch([text for text, _ in rendered], add_special_tokens=False)
            marks = [align(*token_spans(e.offsets), spans) for e, (_, spans) in zip(encoded, rendered, strict=True)]
            part = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([b[0] for b in block], pa.int64()), "segment": pa.array([b[1] for b in block], pa.int64()),
                "formatted": pa.array([text for text, _ in rendered], pa.string()), "ids": pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                "mask": pa.array([m for m, _ in marks], pa.list_(pa.bool_())),
                "loss": pa.array([[{"start": a, "end": b} for a, b in shared] for _, shared in marks], pa.list_(part)),
            })

        length = 0
        for item in segments(batches, segment):
            block.append(item)
            length += sum(len(text) for _, text in item[2])
            if len(block) >= 256 or length >= segment:
                yield out(block)
                block, length = [], 0
        if block:
            yield out(block)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, ROWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of whole conversations, read from the rows of ``format_chats`` as they come.

    ``conv_id, n_turns, turns_sha256`` (role, line break, text, line break per turn),
    ``loss_chars, loss_sha256`` (text under the mask) and ``formatted_chars``.
    """

    def run(batches):
        import hashlib

        state: dict = {}

        def closed():
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([state["conv"]], pa.int64()), "n_turns": pa.array([state["turns"]], pa.int64()), "turns_sha256": [state["all"].hexdigest()],
                "loss_chars": pa.array([state["loss_chars"]], pa.int64()), "loss_sha256": [state["loss"].hexdigest()], "formatted_chars": pa.array([state["chars"]], pa.int64()),
            })

        for batch in batches:
            for row in batch.to_pylist():
                if state and row["segment"] == 0:
                    yield closed()
                if row["segment"] == 0:
                    state = {"conv": row["conv_id"], "turns": 0, "chars": 0, "loss_chars": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text in parse(row["formatted"]):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                state["chars"] += len(row["formatted"])
                for part in row["loss"]:
                    text = unescape(row["formatted"][part["start"] : part["end"]])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
        if state:
            yield closed()

    return formatted.select("conv_id", "segment", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
