"""Chat formatting on tokens: segments are encoded one by one and reserved ids put between them.

A turn is ``<s>`` role, newline, text ``</s>``, and its role and text stand between ``[INST]`` and ``[/INST]`` unless
the assistant speaks. Control strings are reserved ids above the tokenizer's own, so that no text can
make one; in the formatted text a control string that occurs in a role or a text is told apart by a backslash
after its bracket, one more than it has already, which is taken out again on reading.

Text is encoded where it lies, before any shuffle. Every turn has marks where its loss begins and ends; the loss mask
is their prefix sum. Turns of a conversation are then brought into order and numbered with
their first token and first character. One conversation passes through one task as a stream, turn by turn, and
is never held whole.

Columns ``conv_id, turn, role, text`` are read. Null role and text count as empty. Turns come in the order of ``turn``, null
first, then role, text; rows that repeat are turns of their own. Rows without a ``conv_id`` are one
conversation with a null id. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .frames import per_batch

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
_PLAIN = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _first_reserved(coder: tiktoken.Encoding) -> int:
    """Ids of control strings begin after the vocabulary and one free id."""
    return coder.max_token_value + 2


TURNS = "conv_id bigint, position bigint, first_token bigint, first_char bigint, ids array<int>, loss array<boolean>, formatted string"


def _assemble(path: str, pattern: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoding(path, pattern)
        begin, end, ask, asked = range(_first_reserved(coder), _first_reserved(coder) + len(CONTROLS))
        conv, turn, roles, texts = (batch.column(i) for i in range(4))
        segments: list[list[int]] = []
        ends, marks, formatted = [0], [], []
        size = 0
        for role, text in zip(roles.to_pylist(), texts.to_pylist(), strict=True):
            # A newline ends the role; one inside it would end it early.
            head = escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
            body, learned = escape(text or ""), role == LOSS_ROLE
            before = [begin] if learned else [begin, ask]
            after = [end] if learned else [asked, end]
            role_ids, text_ids = coder.encode_ordinary(head), coder.encode_ordinary(body)
            if learned:
                at = size + len(before) + len(role_ids)
                marks += [(at, 1), (at + len(text_ids), -1)]
            for part in (before, role_ids, text_ids, after):
                segments.append(part)
                size += len(part)
            ends.append(size)
            formatted.append(f"<s>{head}{body}</s>" if learned else f"<s>[INST]{head}{body}[/INST]</s>")
        steps = np.zeros(size + 1, np.int64)
        if marks:
            np.add.at(steps, [m[0] for m in marks], [m[1] for m in marks])
        mask = np.cumsum(steps)[:-1] > 0
        ids = np.fromiter((i for s in segments for i in s), np.int32, size)
        offsets = pa.array(ends, pa.int32())
        return pa.record_batch(
            {
                "conv_id": conv,
                "turn": turn,
                "ids": pa.ListArray.from_arrays(offsets, pa.array(ids)),
                "loss": pa.ListArray.from_arrays(offsets, pa.array(mask)),
                "formatted": pa.array(formatted, pa.string()),
            }
        )

    return run


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, position, token, char = object(), 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(batch.column("ids").offsets.to_numpy())
        rows = []
        for conv, n, text in zip(batch.column("conv_id").to_pylist(), lengths.tolist(), batch.column("formatted").to_pylist(), strict=True):
            if conv != last:
                last, position, token, char = conv, 0, 0, 0
            rows.append((position, token, char))
            position, token, char = position + 1, token + n, char + len(text)
        extra = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        yield pa.record_batch(
            [batch.column("conv_id"), *extra, batch.column("ids"), batch.column("loss"), batch.column("formatted")],
            ["conv_id", "position", "first_token", "first_char", "ids", "loss", "formatted"],
        )


def format_conversations(turns: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row for each turn: its place, token ids, loss mask and formatted text.

    ``ranks`` is the path, on every executor, of a byte-level vocabulary, ``pattern`` the pattern that goes with it.
    The concatenation of a conversation's rows by ``position`` is the conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    made = per_batch(rows, _assemble(ranks, pattern), "conv_id bigint, turn bigint, ids array<int>, loss array<boolean>, formatted string")
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return durable(ordered.mapInArrow(_numbered, TURNS), "formatted-turns")


def _unescaped_role(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))


def read_turns(formatted: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``conv_id, position, role, text, loss_text, formatted_chars`` of each turn, read from ids and mask."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoding(ranks, pattern)
        first = _first_reserved(coder)
        out = []
        for ids, loss, text in zip(batch.column("ids").to_pylist(), batch.column("loss").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            words = coder.decode_bytes([i for i in ids if i < first]).decode()
            if text != "".join(_spliced(ids, coder, first)):
                raise ValueError("the ids and the formatted text of a turn differ")
            head, _, body = words.partition("\n")
            learned = coder.decode_bytes([i for i, m in zip(ids, loss, strict=True) if m]).decode()
            out.append((_unescaped_role(head), unescape(body), unescape(learned), len(text)))
        columns = list(zip(*out, strict=True))
        return pa.record_batch(
            {
                "conv_id": batch.column("conv_id"),
                "position": batch.column("position"),
                "role": pa.array(columns[0], pa.string()),
                "text": pa.array(columns[1], pa.string()),
                "loss_text": pa.array(columns[2], pa.string()),
                "formatted_chars": pa.array(columns[3], pa.int64()),
            }
        )

    return per_batch(
        formatted.select("conv_id", "position", "ids", "loss", "formatted"), run,
        "conv_id bigint, position bigint, role string, text string, loss_text string, formatted_chars bigint",
    )


def _spliced(ids: list[int], coder: tiktoken.Encoding, first: int) -> Iterator[str]:
    held: list[int] = []
    for i in ids:
        if i >= first:
            yield coder.decode_bytes(held).decode()
            held = []
            yield CONTROLS[i - first]
        else:
            held.append(i)
    yield coder.decode_bytes(held).decode()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    state: list | None = None

    def finished() -> tuple:
        conv, n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        done = []
        for conv, role, text, learned, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(finished())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += size
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if state is not None:
        yield pa.record_batch([pa.array([c], t) for c, t in zip(finished(), types, strict=True)], names)


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation, from ``read_turns``: digests of its turns and of its loss text, in order."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(
        _digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
