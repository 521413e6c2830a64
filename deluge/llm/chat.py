"""Chat formatting by token-level assembly.

A conversation reads ``<s>`` and then, per turn, ``[INST]role[/INST]text</s>``.  Segments
(roles and texts) are encoded separately by a lossless byte-level tokenizer, and the control
strings are spliced in as reserved ids past the vocabulary, so no text can produce one.
Control strings inside a text are escaped as well, so that the rendered string can be read
back, too: every control string gets one more backslash after its first character, and
reading takes one away.  The loss mask is a prefix sum over the edges of assistant texts.

Encoding works turn by turn; only the assembly needs a conversation's turns in order, which
a sorted partition streams, so a conversation of any length needs no more memory than a turn.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of
from deluge.llm.pretokens import tokenizer_json

# ---- fixed values: the template's control strings, in the order of their reserved ids ----
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
# --------------------------------------------------------------------------------------------
BEGIN, OPEN, CLOSE, END = range(4)
#: A control string with any number of backslashes after its first character.
_CONTROL = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?INST\])")
#: Different roles remembered.
REMEMBER = 10_000
TURNS = "conv_id long, turn long, position int, token_start long, ids array<int>, loss array<boolean>"


def _with_marks(m: re.Match, more: int) -> str:
    first, marks, rest = ("<", m[1], m[2]) if m[2] else ("[", m[3], m[4])
    return first + "\\" * max(0, len(marks) + more) + rest


def escape(text: str) -> str:
    """One more backslash in every control string, however many it has already."""
    return _CONTROL.sub(lambda m: _with_marks(m, 1), text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: _with_marks(m, -1), text)


class Codec:
    """The tokenizer with its reserved ids."""

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(json_text)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.first = self.tok.get_vocab_size(with_added_tokens=True)
        self.roles: dict[bytes, str] = {}
        self.role_ids: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids) -> str:
        return self.tok.decode(list(ids), skip_special_tokens=False)

    def decode_many(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def role(self, ids: np.ndarray) -> str:
        """A decoded role; there are few different ones, so they are remembered."""
        key = ids.tobytes()
        if key not in self.roles:
            if len(self.roles) >= REMEMBER:
                self.roles.clear()
            self.roles[key] = self.decode(ids.tolist())
        return self.roles[key]

    def split(self, ids: np.ndarray) -> tuple[bool, np.ndarray, int]:
        """(begins a conversation, ids of the role, where its text begins) of one turn's ids; the text ends before the last."""
        begins = bool(ids[0] == self.first + BEGIN)
        close = int(np.argmax(ids == self.first + CLOSE))
        return begins, ids[begins + 1:close], close + 1


_CODECS: dict[int, Codec] = {}


def _codec(json_text: str) -> Codec:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hash(json_text)
    if key not in _CODECS:
        _CODECS[key] = Codec(json_text)
    return _CODECS[key]


def loss_mask(size: int, start: int, end: int, counts: bool) -> np.ndarray:
    """Mask of ``size`` tokens: prefix sums of +1 at ``start`` and -1 at ``end``."""
    edge = np.zeros(size + 1, np.int64)
    if counts:
        edge[start] += 1
        edge[end] -= 1
    return np.cumsum(edge)[:size].astype(bool)


def _lists(column) -> list[np.ndarray]:
    """The rows of an Arrow list column as arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    stops = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return np.split(flat, stops[:-1]) if len(stops) else []


def _column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays as the rows of an Arrow list column."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _slices(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def format_turns(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: (conv_id, turn, position, token_start, ids, loss).

    A conversation's rows lie in one partition in order; its ids one after another are the
    formatted conversation.  Turns are ordered by ``turn`` (nulls first), equal numbers by
    role and text as encoded; repeated rows are turns of their own.  Null roles and texts are
    empty; rows with a null conv_id form one conversation.
    """
    spark = conversations.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    c = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"),
                             conversations["turn"].cast("long").alias("turn"),
                             conversations["role"].cast("string").alias("role"),
                             conversations["text"].cast("string").alias("text"))
    pieces = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("counts", pa.bool_()),
                        ("ids", pa.list_(pa.int32()))])
    turns = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int32()),
                       ("token_start", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])

    def encode(batches):
        codec = _codec(sent.value)
        open_, close, end = (codec.first + k for k in (OPEN, CLOSE, END))
        for batch in _slices(batches, 512):
            conv, turn, role, text = batch.columns
            roles = [escape(r or "") for r in role.to_pylist()]
            new = list({r for r in roles if r not in codec.role_ids})
            if len(codec.role_ids) + len(new) > REMEMBER:
                codec.role_ids, new = {}, list(set(roles))
            codec.role_ids.update(zip(new, codec.encode(new)))
            texts = codec.encode([escape(t or "") for t in text.to_pylist()])
            ids = [np.array([open_, *codec.role_ids[r], close, *b, end], np.int32) for r, b in zip(roles, texts)]
            counts = pa.array([r == loss_role for r in role.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([conv, turn, counts, _column(ids, pa.int32())], schema=pieces)

    def assemble(batches):
        codec = _codec(sent.value)
        now, position, start = object(), 0, 0
        for batch in _slices(batches, 1_000):
            conv, turn, counts = (batch.column(k).to_pylist() for k in range(3))
            ids, masks, positions, starts = [], [], [], []
            for c_, n, piece in zip(conv, counts, _lists(batch.column(3))):
                if c_ != now:
                    now, position, start = c_, 0, 0
                    piece = np.concatenate([[np.int32(codec.first + BEGIN)], piece])
                text = int(np.argmax(piece == codec.first + CLOSE)) + 1
                ids.append(piece)
                masks.append(loss_mask(len(piece), text, len(piece) - 1, n))
                positions.append(position)
                starts.append(start)
                position, start = position + 1, start + len(piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(positions, pa.int32()), pa.array(starts, pa.int64()),
                 _column(ids, pa.int32()), _column(masks, pa.bool_())], schema=turns)

    return (c.mapInArrow(encode, "conv_id long, turn long, counts boolean, ids array<int>")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
            .mapInArrow(assemble, TURNS))


def digest(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per conversation, read back from the formatted ids: turns, their hash, and the text under the mask."""
    import hashlib
    sent = formatted.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])

    def run(batches):
        codec = _codec(sent.value)

        def rows():
            now, held = object(), None
            for batch in _slices(batches, 512):
                ids_, loss_ = _lists(batch.column(1)), _lists(batch.column(2))
                turns = [codec.split(ids) for ids in ids_]
                texts = [ids[at:-1] for ids, (_, _, at) in zip(ids_, turns)]
                read = codec.decode_many([t.tolist() for t in texts])
                for conv, ids, loss, (begins, role, at), text in zip(batch.column(0).to_pylist(), ids_, loss_, turns, read):
                    if conv != now:
                        if held:
                            yield finish(now, held)
                        now, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                    role, plain, masked = codec.role(role), unescape(text), int(loss.sum())
                    # What the mask covers is the text, nothing, or (a mask of another make) decoded for itself.
                    if masked == len(ids) - 1 - at and loss[at:-1].all():
                        under = plain
                    else:
                        under = unescape(codec.decode(ids[loss.astype(bool)].tolist())) if masked else ""
                    held[0] += 1
                    held[1].update(f"{unescape(role)}\n{plain}\n".encode())
                    held[2] += len(under)
                    held[3].update(under.encode())
                    held[4] += len(role) + len(text) + sum(len(CONTROL[k]) for k in (OPEN, CLOSE, END)) \
                        + begins * len(CONTROL[BEGIN])
                    held[5] += len(ids)
                    held[6] += masked
            if held:
                yield finish(now, held)

        def finish(conv, h):
            return conv, h[0], h[1].hexdigest(), h[2], h[3].hexdigest(), h[4], h[5], h[6]

        yield from batches_of(rows(), schema)

    return formatted.select("conv_id", "ids", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
