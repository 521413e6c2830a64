"""Content-defined anchors: which stretches of text can repeat at all, and snippets around them.

A *window* is ``window`` consecutive units (words or bytes) of one document.  Each window is
represented by its smallest ``gram``-unit hash, the *anchor*; equal windows have the same
anchor at the same place inside them, wherever they stand.  So an anchor that occurs once
rules out every window it represents, and windows that are equal meet under one key.

1. ``shared``: anchors that occur more than once (one shuffle of 16-byte rows, a fifth of the
   words or a hundredth of the bytes), as a bitmap of at least 32 bits per anchor, up to a largest
   size.  The bitmap only saves work: an anchor let through by chance finds no partner later.
2. ``snippets``: per text, the stretch covering all windows of each such anchor, keyed by the
   anchor.  Where asked for, a *hot* anchor (a common phrase in ever different context) is keyed
   window by window instead, so that no key gathers unboundedly many different snippets.

Equal texts are copies (one text id): they make no anchor shared, and a task that meets a
copy again passes over it, so a large group of copies shrinks before any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, cut, rows_of

_POS_BITS = 24
_POS = np.uint64((1 << _POS_BITS) - 1)
_ODD, _FULL = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Texts are cut into overlapping stretches of so many units, to bound a task's memory.
STRETCH = 1 << 21
#: Stands for a null id: no document is smaller because of it.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Kind:
    """How a text is cut: ``unit`` is 'word' or 'byte'."""

    unit: str
    window: int
    gram: int
    #: A bitmap made by hand has 2^bits bits; ``shared`` sizes its own.
    bits: int = 27
    #: An anchor is hot when it makes up more than 1/hot of all anchors, so there are at most ``hot``.
    hot: int = 20_000


#: Smallest and largest bitmap: 2^20 to 2^29 bits (64 MB).
LEAST_BITS, MOST_BITS = 20, 29
#: Texts and snippets a task remembers, so as to hand a copy on only once.
REMEMBER = 200_000


def text_id(raw: bytes) -> int:
    """Spark's ``xxhash64(text)``: XXH64 with seed 42 as a signed long."""
    h = xxhash.xxh64_intdigest(raw, 42)
    return h - (1 << 64) if h >> 63 else h


def text_id_of(column):
    return F.xxhash64(F.coalesce(column, F.lit("")))


def units_of(kind: Kind, raw: bytes):
    """Units of a text: list of words, or the bytes themselves."""
    return raw.split() if kind.unit == "word" else raw


def unit_hashes(kind: Kind, units) -> np.ndarray:
    if kind.unit == "word":
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w) for w in units], np.uint64)
    return np.frombuffer(units, np.uint8).astype(np.uint64) + np.uint64(1)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values, by doubling."""
    out, done, power, factor = None, 0, h, _ODD
    size = 1
    while True:
        if width & size:
            if out is None:
                out, done = power, size
            else:  # append `size` further units to those hashed so far
                n = len(out) - size
                out = out[:n] * np.uint64(factor) + power[done:done + n]
                done += size
        size *= 2
        if size > width:
            break
        n = len(power) - size // 2
        if n <= 0:
            return np.empty(0, np.uint64)
        power = power[:n] * np.uint64(factor) + power[size // 2:size // 2 + n]
        factor = factor * factor & _FULL
    out = out[:max(0, len(h) - width + 1)]
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(kind: Kind, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place, first window, windows) for runs of windows with one anchor occurrence."""
    empty = np.empty(0, np.int64)
    n = len(h)
    if n < kind.window:
        return np.empty(0, np.uint64), empty, empty, empty
    out = []
    for at in range(0, n - kind.window + 1, STRETCH):
        part = h[at:at + STRETCH + kind.window - 1]
        g = rolling(part, kind.gram)
        key = (g & ~_POS) | (_POS - np.arange(len(g), dtype=np.uint64))
        low = _sliding_min(key, kind.window - kind.gram + 1)
        place = (_POS - (low & _POS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((g[place[first]], place[first] + at, first + at, np.diff(np.append(first, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*out))


def anchor_rows(docs: DataFrame, kind: Kind) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("tid", pa.int64()), ("place", pa.int32())])

    def run(batches):
        held, n, seen = [], 0, set()
        for (text,) in rows_of(batches, "text"):
            raw = (text or "").encode()
            tid = text_id(raw)
            if tid in seen:
                continue
            if len(seen) >= REMEMBER:
                seen.clear()
            seen.add(tid)
            a, place, _, _ = anchors(kind, unit_hashes(kind, units_of(kind, raw)))
            if len(a):
                held.append((a.view(np.int64), np.full(len(a), tid), place.astype(np.int32)))
                n += len(a)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=schema)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=schema)

    return docs.select("text").mapInArrow(run, "anchor long, tid long, place int")


def shared(docs: DataFrame, kind: Kind, within: bool, with_hot: bool = True):
    """Broadcast of (bitmap of anchors that occur more than once, sorted hot anchors).

    ``with_hot``: look for hot anchors, too (else there are none).  ``within``: a repeat inside one text counts.  Positions decide it, so copies of one text
    (same id, same places) count once.
    """
    spark = docs.sparkSession
    found = anchor_rows(docs, kind).groupBy("anchor").agg(
        F.min("tid").alias("t0"), F.max("tid").alias("t1"),
        *([F.min("place").alias("p0"), F.max("place").alias("p1")] if within else []), F.count("*").alias("n"))
    several = (F.col("t0") < F.col("t1")) | ((F.col("p0") < F.col("p1")) if within else F.lit(False))
    found = cut(found.where(several).select("anchor", "n"))
    total, known = found.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    bits = min(max(LEAST_BITS, (32 * known).bit_length()), MOST_BITS)
    mask, chunk_bits = (1 << bits) - 1, 16
    slot = F.col("anchor").bitwiseAND(F.lit(mask))
    hot = np.sort(np.array([r[0] for r in found.where(F.col("n") * F.lit(kind.hot) > F.lit(total))
                            .where(F.col("n") > 1000).select("anchor").collect()], np.int64)) if with_hot else np.empty(0, np.int64)

    def bitmaps(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << chunk_bits, bool)
        bits[table.column("slot").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk").slice(0, 1),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slots = found.select(F.shiftright(slot, chunk_bits).alias("chunk"),
                         slot.bitwiseAND(F.lit((1 << chunk_bits) - 1)).cast("int").alias("slot")).distinct()
    whole = bytearray((mask + 1) // 8)
    for r in slots.groupBy("chunk").applyInArrow(bitmaps, "chunk long, bits binary").toLocalIterator():
        at = r["chunk"] << (chunk_bits - 3)
        whole[at:at + len(r["bits"])] = r["bits"]
    return spark.sparkContext.broadcast((bytes(whole), hot.tobytes()))


def snippet_rows(kind: Kind, sent, raw: bytes):
    """(key, content digest, first unit, units, snippet) of each run of windows with a shared anchor."""
    bitmap, hot = np.frombuffer(sent[0], np.uint8), np.frombuffer(sent[1], np.int64)
    units = units_of(kind, raw)
    h = unit_hashes(kind, units)
    a, _, first, count = anchors(kind, h)
    if not len(a):
        return
    slot = (a & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    ok = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
    keys = a.view(np.int64)[ok]
    is_hot = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(ok), bool)
    whole = rolling(h, kind.window).view(np.int64) if is_hot.any() else None
    join = b" ".join if kind.unit == "word" else bytes
    digest = xxhash.xxh64_intdigest
    for key, hot_one, at, n in zip(keys.tolist(), is_hot.tolist(), first[ok].tolist(), count[ok].tolist()):
        for s, m in [(at + k, 1) for k in range(n)] if hot_one else [(at, n)]:
            snippet = join(units[s:s + m + kind.window - 1])
            yield int(whole[s]) if hot_one else key, digest(snippet, 1) - (1 << 63), s, m + kind.window - 1, snippet


def occurrences(docs: DataFrame, kind: Kind, sent) -> DataFrame:
    """(key, digest, tid, owner, start, size, snippet); owner is the document's id.

    Of a text's copies a task hands on the first and any with a smaller id; of equal snippets
    only those carry the text (others: null), so that the copies in a shuffle are narrow.
    """
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("tid", pa.int64()), ("owner", pa.int64()),
                        ("start", pa.int32()), ("size", pa.int32()), ("snippet", pa.binary())])

    def rows(batches):
        texts, known = {}, {}
        for owner, text in rows_of(batches, "doc_id", "text"):
            raw = (text or "").encode()
            tid, at = text_id(raw), NO_ID if owner is None else owner
            if texts.get(tid, NO_ID + 1) <= at:
                continue
            if len(texts) >= REMEMBER:
                texts.clear()
            texts[tid] = at
            for key, digest, start, size, snippet in snippet_rows(kind, sent.value, raw):
                if known.get(digest, NO_ID + 1) <= at:
                    snippet = None
                else:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[digest] = at
                yield key, digest, tid, at, start, size, snippet

    def run(batches):
        yield from batches_of(rows(batches), schema, 10_000)

    return docs.mapInArrow(
        run, "key long, digest long, tid long, owner long, start int, size int, snippet binary")


def texts_of(docs: DataFrame) -> DataFrame:
    """(tid, first, copies): each different text with its smallest id and its number of rows."""
    return (docs.groupBy(text_id_of(docs["text"]).alias("tid"))
            .agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.count("*").alias("copies")))


def spans_by_text(found: DataFrame) -> DataFrame:
    """(tid, owner, spans) from rows (tid, owner, start, spans array<struct<at, n>>), shifted by start."""
    shifted = F.expr("transform(spans, s -> struct(start + s.at as at, s.n as n))")
    return (found.where(F.size("spans") > 0)
            .groupBy("tid", "owner").agg(F.flatten(F.collect_list(shifted)).alias("spans")))
