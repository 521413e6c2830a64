"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens.  How many pieces there are of each
length is a table of at most ``capacity`` rows, whatever the corpus; the packing plan is
made from that histogram alone: for one bin at a time, a bitset dynamic program over the
lengths still available finds the fullest feasible combination, and the combination is then
removed as many times as the counts allow.  The plan is a short list of (combination, times)
and is sent to the tasks, where every piece finds its place from its rank among the pieces
of the same length.  Ranks come from two-level counting, so a length that holds a third of
all pieces is not one task.
"""

from __future__ import annotations

import bisect
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, cut, documents_of, rows_of, salted_rank
from deluge.llm.pretokens import loaded, tokenizer_json

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class IdStream:
    """Whole texts to id arrays through a per-worker table of pre-tokens already cut."""

    def __init__(self, json_text: str, limit: int = 300_000):
        self.text, self.limit = loaded(json_text), limit
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths, self.used = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def _add(self, pretoken: str) -> int:
        got = self.text.pieces(pretoken)
        if self.used + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(got)), np.uint32)])
        self.ids[self.used:self.used + len(got)] = got
        i = len(self.index)
        if i == len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty(i, np.int64)])
            self.lengths = np.concatenate([self.lengths, np.empty(i, np.int64)])
        self.starts[i], self.lengths[i] = self.used, len(got)
        self.used += len(got)
        self.index[pretoken] = i
        return i

    def encode(self, text: str) -> np.ndarray:
        pretokens = self.text.of(text)
        if len(self.index) > self.limit:
            self._clear()
        index = self.index
        at = [index.get(p, -1) for p in pretokens]
        if -1 in at:
            for k, i in enumerate(at):
                if i < 0:
                    p = pretokens[k]
                    at[k] = index[p] if p in index else self._add(p)
        at = np.array(at, np.int64)
        starts, lengths = self.starts[at], self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


_STREAMS: dict[int, IdStream] = {}


def _stream(json_text: str) -> IdStream:
    key = hash(json_text)
    if key not in _STREAMS:
        _STREAMS.clear()
        _STREAMS[key] = IdStream(json_text)
    return _STREAMS[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``capacity``."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_up(rows):
        stream = _stream(sent.value)
        for doc_id, text in rows:
            ids = np.append(stream.encode(text or ""), np.uint32(end_id)).astype("<u4")
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at:at + capacity]
                yield doc_id, k, at, len(part), zlib.crc32(part.tobytes())

    def run(batches):
        yield from batches_of(cut_up(rows_of(batches, "doc_id", "text")), schema)

    return docs.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, with repetition, of the fullest combination that fits; longest lengths first.

    ``reach`` is a bitset whose bit s says that s tokens can be filled.  A length with count
    c enters in chunks of 1, 2, 4, ... copies, so every multiplicity up to c is covered.
    """
    reach, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left:
            take = min(chunk, left)
            new = (reach | reach << (take * length)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left, chunk = left - take, chunk * 2
        if reach >> capacity & 1:
            break
    fill, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            chosen += [length] * take
            fill -= length * take
    return sorted(chosen, reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(combination, times): bins of minimum slack until every piece is placed.

    Each step uses the longest length left (every bin must hold it some time) and fills the
    rest of the bin as full as the remaining lengths allow.
    """
    left, out = dict(histogram), []
    while left:
        top = max(left)
        left[top] -= 1
        rest = fullest({n: c for n, c in left.items() if c and n <= capacity - top}, capacity - top)
        left[top] += 1
        combination = [top, *rest]
        need = {n: combination.count(n) for n in set(combination)}
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((combination, times))
    return out


def places(steps: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[tuple]]]:
    """length -> (first rank of each use, [(first rank, first bin, per bin, offset)]) in rank order."""
    out: dict[int, tuple[list[int], list[tuple]]] = {}
    bins = 0
    for combination, times in steps:
        offsets = [0, *accumulate(combination)]
        for n in dict.fromkeys(combination):
            per = combination.count(n)
            firsts, uses = out.setdefault(n, ([0], []))
            uses.append((firsts[-1], bins, per, offsets[combination.index(n)]))
            firsts.append(firsts[-1] + per * times)
        bins += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is one piece holding ``end_id`` alone.  Repeated rows and null ids
    are packed like any other row; columns beyond the two are ignored.
    """
    # Pieces are numbered as they are written, so that even equal rows can be spread.
    table = cut(pieces(documents_of(docs, id_col, text_col), tokenizer_path, capacity, end_id)
                .withColumn("_at", F.monotonically_increasing_id()))
    histogram = dict(table.groupBy("length").count().toPandas().itertuples(index=False, name=None))
    steps = plan({int(n): int(c) for n, c in histogram.items()}, capacity)
    sent = docs.sparkSession.sparkContext.broadcast(places(steps))
    spread = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = salted_rank(table.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(spread))),
                         ["length"], ["_at"], "_salt", "_rank")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(rows):
        where = sent.value
        for doc_id, piece, start, length, crc, rank in rows:
            firsts, uses = where[length]
            first, base, per, offset = uses[bisect.bisect_right(firsts, rank) - 1]
            copy, slot = divmod(rank - first, per)
            yield doc_id, piece, start, length, crc, base + copy, offset + slot * length

    def run(batches):
        yield from batches_of(place(rows_of(batches, "doc_id", "piece", "start", "length", "ids_crc32", "_rank")),
                              schema)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        run, PIECES + ", sequence_id long, offset long")
