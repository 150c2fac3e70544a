"""Chat formatting by columnar byte assembly.

A turn becomes <|im_start|>role, a line end, its text, <|im_end|> and a line end. Control strings inside texts and roles
get a backslash after their first character, and one more if they have some there already, which undoes itself exactly.

For a batch of turns the lengths of headers, texts and footers, their cumulative offsets and the scatter indices are
computed in numpy; headers, footers and texts are then scattered into one preallocated Arrow buffer. A conversation comes out in
parts of about PART_BYTES, whole turns each, so that one of any length passes through a task in bounded memory; in order
they are its formatted text. loss_start and loss_len give the assistant texts of a part in code points.

Defined results: turns are ordered by turn, nulls first, then role and text. A null text or role is empty. Rows with a
null conv_id are one conversation. Repeated rows are turns of their own. Other columns are ignored. No rows give none.
A conversation's digests are a running hash, so its parts pass through one task in order, one part in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates use for control, fixed values, without their first character.
_CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
ESCAPE = (r"([<\[])(\\*)" + _CONTROL, r"\1\\\2\3")
UNESCAPE = (re.compile(r"([<\[])\\(\\*)" + _CONTROL), r"\1\2\3")
PART_BYTES = 1 << 20
LOSS_ROLE = "assistant"
PARTS = "conv_id long, part long, formatted string, loss_start array<long>, loss_len array<long>"


def unescape(text: str) -> str:
    return UNESCAPE[0].sub(UNESCAPE[1], text) if "\\" in text else text


def role_line(role: str) -> str:
    """A role in its header: without line ends, and reversible."""
    return re.sub(*ESCAPE, role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(line))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), at


def _assemble(roles: list[str], texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The bytes of the formatted turns in one Arrow buffer, each turn's bytes, and the code points of each turn's header."""
    names = {r: f"{OPEN}{role_line(r)}\n" for r in set(roles)}
    heads = [np.frombuffer(h.encode(), np.uint8) for h in names.values()]
    foot = np.frombuffer(f"{CLOSE}\n".encode(), np.uint8)
    code = {r: i for i, r in enumerate(names)}
    which = np.array([code[r] for r in roles])
    data, at = _bytes(texts)
    size = np.stack([np.array([h.size for h in heads])[which], np.diff(at), np.full(len(roles), foot.size)], 1)
    to = np.cumsum(size.ravel()).reshape(size.shape) - size
    made = pa.allocate_buffer(int(size.sum()))
    out = np.frombuffer(made, np.uint8)
    for i, head in enumerate(heads):
        out[to[which == i, 0][:, None] + np.arange(head.size)] = head
    out[to[:, 2][:, None] + np.arange(foot.size)] = foot
    said = data[at[0] : at[-1]]
    index = np.arange(said.size, dtype=np.int32 if len(out) < 1 << 31 else np.int64)
    index += np.repeat((to[:, 1] - (at[:-1] - at[0])).astype(index.dtype), size[:, 1])
    out[index] = said
    return made, size.sum(1), np.array([len(h) for h in names.values()])[which]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, parts = None, -1
    for batch in batches:
        a = 0
        bytes_so_far = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))])
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(bytes_so_far, bytes_so_far[a] + 4 * PART_BYTES, "right")) - 1)
            b = min(b, batch.num_rows)
            some, a = batch.slice(a, b - a), b
            texts = pc.replace_substring_regex(some.column("text").fill_null(""), *ESCAPE)
            roles = some.column("role").fill_null("").to_pylist()
            out, size, head = _assemble(roles, texts)
            conv = some.column("conv_id")
            ids, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
            new[0] = last != (ids[0], known[0])
            end = np.cumsum(size)
            conv_no = np.cumsum(new)
            began = np.zeros(conv_no[-1] + 1, np.int64)
            began[conv_no[new]] = (end - size)[new]
            bucket = (end - size - began[conv_no]) // PART_BYTES
            cut = new.copy()
            cut[0] = True
            cut[1:] |= bucket[1:] != bucket[:-1]
            at = np.flatnonzero(cut)
            number = []
            for i in at.tolist():
                parts = 0 if new[i] else parts + 1
                number.append(parts)
            last = (ids[-1], known[-1])
            points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            turn_points = head + points + len(CLOSE) + 1
            before = np.cumsum(turn_points) - turn_points
            part_of = np.cumsum(cut) - 1
            loss = np.flatnonzero(np.array(roles, object) == LOSS_ROLE)
            per_part = np.concatenate([[0], np.cumsum(np.bincount(part_of[loss], minlength=at.size))]).astype(np.int32)
            edges = np.append(end[at] - size[at], end[-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(at)), pa.array(number, pa.int64()), pa.Array.from_buffers(pa.string(), at.size, [None, pa.py_buffer(edges), out]),
                 pa.ListArray.from_arrays(pa.array(per_part), pa.array((before + head - before[at][part_of])[loss])), pa.ListArray.from_arrays(pa.array(per_part), pa.array(points[loss]))],
                ["conv_id", "part", "formatted", "loss_start", "loss_len"],
            )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss_start, loss_len): the conversations' parts, in order within each partition."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_format, PARTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    conv = turns = loss = None
    n = lost = chars = 0

    def flush() -> pa.RecordBatch:
        columns = zip(*done) if done else [[]] * len(names)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)
        done.clear()
        return out

    for batch in batches:
        for row in batch.to_pylist():
            if turns is None or row["part"] == 0 or row["conv_id"] != conv:
                if turns is not None:
                    done.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                conv, turns, loss, n, lost, chars = row["conv_id"], hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            text = row["formatted"]
            chars += len(text)
            for turn in text.split(OPEN)[1:]:
                role, _, said = turn.partition("\n")
                turns.update(f"{role_of(role)}\n{unescape(said[: -len(CLOSE) - 1])}\n".encode())
                n += 1
            for start, size in zip(row["loss_start"], row["loss_len"]):
                own = unescape(text[start : start + size])
                lost += len(own)
                loss.update(own.encode())
        yield flush()
    if turns is not None:
        done.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
    yield flush()


def read_back(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed from format_chats()'s parts, streaming.

    in_order: the parts come straight from format_chats(), so that each partition holds whole conversations in order.
    Stored parts, which a reader may split anywhere, are brought together and sorted.
    """
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
