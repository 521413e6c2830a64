"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens (lower-cased words without punctuation at their ends).  Each fixed mask
spans ``SPAN`` tokens and ignores some of them, so a substituted token under an ignored place
leaves the hash as it is; the three masks together keep at least one hash alive for every
choice of two substitutions in ``OVERLAP`` aligned tokens.  Hashes of benchmark and documents
are joined, and every hit is verified on the tokens around it: an aligned stretch of
``OVERLAP`` tokens with at most ``substitutions`` differing.  A shorter item must occur
whole: with at most one token changed from ``TOLERANT`` tokens on (a mask per ignored place), below
that unchanged.

The benchmark is the query set: it is taken in blocks of bounded size, and a bitmap of a
block's hashes, sent to the tasks, lets only possible hits of the documents into the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, cut, rows_of

# ---- fixed values: seed masks; any 2 substitutions in 13 tokens leave one of them whole ----
MASKS = ("11101011001", "10011110101", "11010001111")
SPAN, OVERLAP = 11, 13
# ----------------------------------------------------------------------------------------------
#: Shortest items that are found with one token changed.
TOLERANT = 5
#: A filter passes over items of fewer tokens than this: their words occur anywhere in clean texts.
LEAST = 5
#: Seeds of one benchmark block, and the bits of its bitmap (2^27 bits: 16 MB).
BLOCK, BITS = 1 << 20, 27
PUNCTUATION = b".,;:!?'\"()[]{}<>*-_"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_REACH = OVERLAP - SPAN
_CONTEXT = OVERLAP + _REACH


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's tokens; never 0, which stands for a place outside the text."""
    digest = xxhash.xxh64_intdigest
    words = (w.strip(PUNCTUATION) for w in (text or "").lower().encode().split())
    return np.array([digest(w) | 1 for w in words if w], np.uint64)


def masks_for(n_tokens: int) -> list[np.ndarray]:
    """Places each mask looks at; an item shorter than ``OVERLAP`` is taken whole, or but for one place."""
    if n_tokens >= OVERLAP:
        return [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]
    if n_tokens < TOLERANT:
        return [np.arange(n_tokens)] if n_tokens else []
    return [np.delete(np.arange(n_tokens), k) for k in range(n_tokens)]


def allowed(n_tokens: int, substitutions: int) -> int:
    """Tokens that may differ in a verified stretch of an item of ``n_tokens``."""
    return substitutions if n_tokens >= OVERLAP else min(substitutions, 1) if n_tokens >= TOLERANT else 0


def seeds(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hash of every placement of a mask (the mask itself is part of the hash)."""
    width = int(mask[-1]) + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, hash(tuple(mask.tolist())) & 0xFFFFFFFF, np.uint64)
    for at in mask.tolist():
        out = (out + h[at:at + n]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def context(h: np.ndarray, place: int) -> bytes:
    """The tokens that an overlap around a seed at ``place`` can reach; 0 outside the text."""
    out = np.zeros(_CONTEXT, np.uint64)
    a, b = max(0, place - _REACH), min(len(h), place + OVERLAP)
    out[a - place + _REACH:b - place + _REACH] = h[a:b]
    return out.tobytes()


def agreement(doc: bytes, item: bytes, length: int, width: int) -> int:
    """Most equal tokens in an aligned stretch of ``length`` that holds the seed; -1 if none fits."""
    a, b = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
    inside, same = (a != 0) & (b != 0), a == b
    best = -1
    for at in range(max(0, _REACH + width - length), _REACH + 1):
        if at + length <= _CONTEXT and inside[at:at + length].all():
            best = max(best, int(same[at:at + length].sum()))
    return best


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """(hash, item, n, place, width, context) of every mask placement in every different item text."""
    schema = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("n", pa.int32()), ("i_place", pa.int32()),
                        ("width", pa.int32()), ("i_context", pa.binary())])

    def rows(batches):
        for item, text in rows_of(batches, "item_id", "text"):
            h = tokens(text)
            for mask in masks_for(len(h)):
                for place, value in enumerate(seeds(h, mask).view(np.int64).tolist()):
                    yield value, item, len(h), place, int(mask[-1]) + 1, context(h, place)

    def run(batches):
        yield from batches_of(rows(batches), schema)

    return benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), "text").mapInArrow(
        run, "hash long, item_id long, n int, i_place int, width int, i_context binary")


def _bitmap(block: DataFrame) -> bytes:
    """Bitmap of a block's hashes; a block has about ``BLOCK`` of them, so collecting them is bounded."""
    bits = np.zeros(1 << BITS, bool)
    for batch in block.select(F.col("hash").bitwiseAND(F.lit((1 << BITS) - 1)).alias("s")).distinct().toLocalIterator():
        bits[batch[0]] = True
    return np.packbits(bits, bitorder="little").tobytes()


def hits(docs: DataFrame, block: DataFrame) -> DataFrame:
    """Verified rows (row key, item_id, place, agree, length) for one benchmark block."""
    spark = docs.sparkSession
    short = sorted({r[0] for r in block.where(F.col("n") < OVERLAP).select("n").distinct().collect()})
    sent = spark.sparkContext.broadcast((_bitmap(block), short))
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("d_place", pa.int32()),
                        ("d_context", pa.binary())])

    def rows(batches):
        bitmap, short = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        masks = masks_for(OVERLAP) + [m for n in short for m in masks_for(n)]
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            h = tokens(text)
            for mask in masks:
                values = seeds(h, mask)
                slot = (values & np.uint64((1 << BITS) - 1)).astype(np.int64)
                for place in np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).tolist():
                    yield int(values[place].view(np.int64)), doc_id, place, context(h, place)

    def run(batches):
        yield from batches_of(rows(batches), schema)

    found = docs.mapInArrow(run, "hash long, doc_id long, d_place int, d_context binary")
    return found.join(block, "hash")


def contaminated(docs: DataFrame, benchmark: DataFrame, substitutions: int = 2, least: int = 1) -> DataFrame:
    """(doc_id, item_id, n_hits, agree, place): one row per document and benchmark item it holds.

    ``agree`` is the most equal tokens in a verified stretch, ``place`` the first verified
    place in the document, in tokens.  An item of fewer than ``OVERLAP`` tokens must occur
    whole, with at most one token changed, of fewer than ``TOLERANT`` unchanged; items of fewer
    than ``least`` tokens are left out.  Null texts and texts without words have no
    tokens; null ids are reported as they are.  Rows of one id count as one document.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("place", pa.int32()), ("agree", pa.int32())])

    def verify(batches):
        def rows():
            for doc_id, item, n, width, place, d, i in rows_of(
                    batches, "doc_id", "item_id", "n", "width", "d_place", "d_context", "i_context"):
                length = min(OVERLAP, n)
                agree = agreement(d, i, length, width)
                if agree >= length - allowed(n, substitutions):
                    yield doc_id, item, place, agree
        yield from batches_of(rows(), schema)

    table = cut(benchmark_seeds(benchmark).where(F.col("n") >= least))
    blocks = max(1, -(-table.count() // BLOCK))
    out = None
    for k in range(blocks):
        block = table.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k)
        part = hits(docs, block).select("doc_id", "item_id", "n", "width", "d_place", "d_context", "i_context").mapInArrow(
            verify, "doc_id long, item_id long, place int, agree int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_hits"), F.max("agree").cast("long").alias("agree"), F.min("place").cast("long").alias("place"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, substitutions: int = 2) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item of ``LEAST`` tokens or more; rows without an id are judged by their text."""
    # Judged per text, so that rows sharing an id (or having none) are told apart.
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    bad = contaminated(docs.select(key.alias("doc_id"), docs["text"]), benchmark, substitutions, LEAST)
    bad = bad.select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, key == F.col("__bad"), "left_anti")
