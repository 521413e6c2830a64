"""Hard negatives: for an anchor and each of its positives, rows of other labels scoring almost as high.

Vectors are integers; a score is an exact integer inner product.  Most rows are passed over by
codes.  A vector x is written as

    x = a1 c1 + ... + aK cK + r,      ck = Rk^T sign(Rk rk) / sqrt(D),   rk = x - a1 c1 - ... - a(k-1) c(k-1)

with a seeded rotation Rk per level: K one-bit codes, each stored with its alignment ak = <rk, ck> and
the length of what is then left.  For an anchor q rotated by Rk and rounded to ``PLANES`` bits,
<q, ck> is estimated by popcounts of its bit planes with the code.  Cauchy-Schwarz bounds both
errors without chance: rounding by |e|, the rest by |q| |r(k+1)| (on the first level by the parts
of q and r across c1, which is tighter).  So each level gives an interval that certainly holds the score; a
row goes to the next level only while its interval can still matter, and rows that survive
all levels are scored in integers.

Rows lie in packed blocks, anchors in packed chunks; blocks are dealt to slots, and every block meets every chunk
through an equi-join on the slot (the anchors are a stated query set).  What leaves a slot are the few best rows per
anchor, so no anchor or label gathers unboundedly many.  Joins are by sort and merge whatever the
tables' estimated sizes: a packed or copied row is far larger than Spark expects of it.

1. positives: per anchor the best rows of its label.  2. negatives: per anchor and positive the best rows of other labels
with a score between ``low`` percent of the positive's score and all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deluge.llm.common import cut

#: Rows of a block, anchors of a chunk, and levels of one-bit codes.
BLOCK, CHUNK, LEVELS = 4096, 256, 5
#: Slots that blocks are dealt to for each core, and blocks that a slot holds where there are more.
SLOTS, HELD = 8, 32
#: Bits that an anchor's rotated components are rounded to.
PLANES = 8
SEED = 20_240_607
#: What floating point may add to an interval, relative to |q| |x|.
SLACK = 1e-9
#: Scores are exact in doubles below this.
EXACT = 1 << 53


def rotations(dim: int, levels: int = LEVELS, seed: int = SEED) -> list[np.ndarray]:
    """Seeded random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(levels):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words, zero-padded."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), bool)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, turns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(codes per level, alignments (n, K), lengths (n, K + 1)) of the rows of ``x``."""
    rest, root = x.astype(np.float64), np.sqrt(max(1, x.shape[1]))
    codes, aligned, lengths = [], [], [np.linalg.norm(rest, axis=1)]
    for turn in turns:
        bits = rest @ turn.T >= 0
        c = np.where(bits, 1.0, -1.0) @ turn / root
        a = (rest * c).sum(1)
        rest = rest - a[:, None] * c
        codes.append(_words(bits))
        aligned.append(a)
        lengths.append(np.linalg.norm(rest, axis=1))
    n = len(x)
    return (codes, np.array(aligned).T.reshape(n, len(turns)), np.array(lengths).T.reshape(n, len(turns) + 1))


class Query:
    """Anchors of a chunk, rotated and cut into bit planes once per level."""

    def __init__(self, x: np.ndarray, turns: list[np.ndarray]):
        self.x = x.astype(np.float64)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.root = np.sqrt(max(1, x.shape[1]))
        self.levels = []
        top = (1 << PLANES) - 1
        for turn in turns:
            y = self.x @ turn.T
            low = y.min(1, initial=0.0)
            step = np.maximum((y.max(1, initial=0.0) - low) / top, 1e-300)
            u = np.clip(np.rint((y - low[:, None]) / step[:, None]), 0, top).astype(np.int64)
            rounded = low[:, None] + step[:, None] * u
            planes = [_words((u >> b & 1).astype(bool)) for b in range(PLANES)]
            self.levels.append((planes, step, low, rounded.sum(1), np.linalg.norm(y - rounded, axis=1)))

    def estimate(self, level: int, code: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error bound) of <q, c> for pairs of anchors ``q`` and rows ``r`` of ``code``."""
        planes, step, low, total, error = self.levels[level]
        bits = code[r]
        weighed = np.zeros(len(q), np.int64)
        for b, plane in enumerate(planes):
            weighed += np.bitwise_count(plane[q] & bits).sum(1, dtype=np.int64) << b
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        # Components where the bit is set, twice, less all of them: the signs are +1 and -1.
        return (2 * (step[q] * weighed + low[q] * ones) - total[q]) / self.root, error[q]


def _levels(query: Query, index: tuple, q: np.ndarray, r: np.ndarray):
    """Level by level the pairs (q, r) left, their estimate and the room around it that certainly holds the score.

    A caller narrows the pairs by sending back which of them go on.
    """
    codes, aligned, lengths = index
    done, wide = np.zeros(len(q)), np.zeros(len(q))
    for level in range(aligned.shape[1]):
        est, err = query.estimate(level, codes[level], q, r)
        a, left = aligned[r, level], lengths[r, level + 1]
        done, wide = done + a * est, wide + np.abs(a) * err
        across = query.norm[q]
        if level == 0:  # the rest lies across c1, so only the part of q across c1 counts
            along = np.maximum(np.abs(est) - err, 0)
            across = np.sqrt(np.maximum(across * across - along * along, 0))
        ok = yield done, wide + across * left + SLACK * query.norm[q] * lengths[r, 0] + 1e-6
        if ok is not None:
            q, r, done, wide = q[ok], r[ok], done[ok], wide[ok]
            if not len(q):
                return


def surviving(query: Query, index: tuple, q: np.ndarray, r: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Pairs (q, r) whose score may lie in [least, most] of their pair: each level drops what it can."""
    levels = _levels(query, index, q, r)
    try:
        done, room = next(levels)
        while True:
            ok = (done + room >= least) & (done - room <= most)
            q, r, least, most = q[ok], r[ok], least[ok], most[ok]
            done, room = levels.send(ok)
    except StopIteration:
        return q, r


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of equal rows of two integer matrices, which must fit in 64 bits."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("an inner product of these vectors does not fit in a long")
    return np.einsum("ij,ij->i", a, b)


# --- rows and their packed form ------------------------------------------------------------------------------------


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part: label, vector and all components known and finite.

    A component x becomes floor(scale * x), x as a double.
    """
    own = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[label_col].cast("long").alias("label"),
                      rows[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (own.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("ints")))


def _payload(arrays: list[np.ndarray]) -> bytes:
    import io
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(payload: bytes) -> list[np.ndarray]:
    import io
    with np.load(io.BytesIO(payload), allow_pickle=False) as z:
        return [z[n] for n in z.files]


def _small(ints: np.ndarray) -> np.ndarray:
    """The same integers in the shortest type that holds them all."""
    low, high = ints.min(initial=0), ints.max(initial=0)
    return ints.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """Integer lists as a matrix; shorter ones end in zeros."""
    lists = batch.column(batch.schema.get_field_index(name))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dim), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which are null) of a batch."""
    column = batch.column(batch.schema.get_field_index("vec_id"))
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def index_blocks(rows: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """(part, at, n, payload): rows packed with their codes, at most ``size`` in a block, named by (part, at)."""
    schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        part, at, turns = TaskContext.get().partitionId(), 0, rotations(dim)
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                piece = batch.slice(first, size)
                ints = _matrix(piece, "ints", dim)
                codes, aligned, lengths = encode(ints, turns)
                ids, unknown = _ids(piece)
                labels = piece.column(piece.schema.get_field_index("label")).to_numpy()
                payload = _payload([ids, unknown, labels, _small(ints), aligned, lengths, *codes])
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                    (part, at, piece.num_rows, payload), schema)], schema=schema)
                at += 1

    return rows.mapInArrow(run, "part int, at int, n int, payload binary")


def anchor_chunks(anchors: DataFrame, dim: int, size: int = CHUNK) -> DataFrame:
    """(chunk payload rows): anchors packed, at most ``size`` in a row; columns of ``anchors`` as given.

    ``anchors``: (akey, vec_id, label, ints, least array, most array); the last two may be empty lists.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                piece = batch.slice(first, size)
                at = piece.schema.get_field_index
                ids, unknown = _ids(piece)
                spans = [piece.column(at(n)).to_pylist() for n in ("least", "most")]
                width = max((len(s) for s in spans[0]), default=0)
                bounds = [np.array([s + [fill] * (width - len(s)) for s in side], np.int64).reshape(piece.num_rows, width)
                          for side, fill in zip(spans, (1, 0))]  # an empty interval, where there are fewer
                payload = _payload([piece.column(at("akey")).to_numpy(), ids, unknown, piece.column(at("label")).to_numpy(),
                                    _small(_matrix(piece, "ints", dim)), *bounds])
                yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["anchors"])

    return anchors.mapInArrow(run, "anchors binary")


# --- the two searches over a block ------------------------------------------------------------------------------------


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` of every group: higher scores, then smaller ids (null last)."""
    order = np.lexsort((ids, unknown, -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


class Chunk:
    """An unpacked chunk of anchors."""

    def __init__(self, payload: bytes, turns: list[np.ndarray]):
        self.keys, _, _, self.labels, ints, self.least, self.most = _unpacked(payload)
        self.ints = ints.astype(np.int64)
        self.query = Query(self.ints, turns)


class Block:
    """An unpacked block of rows."""

    def __init__(self, payload: bytes):
        self.ids, self.unknown, self.labels, self.ints, aligned, lengths, *codes = _unpacked(payload)
        self.index = (codes, aligned, lengths)


def _positives(block: Block, chunk: Chunk, k: int):
    """Pairs (anchor, place 0, row, score): the best k rows of the anchor's label in this block (its own row may be one).

    The k rows of the best estimates are scored first; the least of their scores is what any other
    row's interval has to reach.
    """
    q, r = np.nonzero(chunk.labels[:, None] == block.labels[None, :])
    if len(q):
        for done, room in _levels(chunk.query, block.index, q, r):
            pass
        first = _best(q, done, r, np.zeros(len(r), bool), k)
        value = scores(chunk.ints[q[first]], block.ints[r[first]].astype(np.int64))
        least, count = np.full(len(chunk.keys), np.inf), np.bincount(q[first], minlength=len(chunk.keys))
        np.minimum.at(least, q[first], value.astype(float))
        ok = (done + room >= least[q]) | (count[q] < k)
        q, r = q[ok], r[ok]
    value = scores(chunk.ints[q], block.ints[r].astype(np.int64))
    best = _best(q, value, block.ids[r], block.unknown[r], k)
    return q[best], np.zeros(len(best), np.int64), r[best], value[best]


def _negatives(block: Block, chunk: Chunk, k: int):
    """Pairs (anchor, place of the interval, row, score): the best k of other labels in each interval."""
    least, most = chunk.least, chunk.most
    if not least.shape[1]:
        none = np.empty(0, np.int64)
        return none, none, none, none
    some = least <= most
    low = np.where(some, least, np.iinfo(np.int64).max).min(1)
    high = np.where(some, most, np.iinfo(np.int64).min).max(1)
    q, r = np.nonzero((chunk.labels[:, None] != block.labels[None, :]) & some.any(1)[:, None])
    q, r = surviving(chunk.query, block.index, q, r, low[q].astype(float), high[q].astype(float))
    value = scores(chunk.ints[q], block.ints[r].astype(np.int64))
    out = []
    for place in range(least.shape[1]):
        ok = np.flatnonzero((value >= least[q, place]) & (value <= most[q, place]))
        best = ok[_best(q[ok], value[ok], block.ids[r[ok]], block.unknown[r[ok]], k)]
        out.append((q[best], np.full(len(best), place, np.int64), r[best], value[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def slots_for(blocks: int, cores: int) -> int:
    """Slots of so many blocks: enough for the cores, and no more copies of the anchors than a slot's memory asks for."""
    return max(1, min(blocks, max(SLOTS * cores, -(-blocks // HELD))))


def search(blocks: DataFrame, chunks: DataFrame, dim: int, what, k: int) -> DataFrame:
    """(akey, place, vec_id, score): ``what`` run on every block with every chunk of anchors.

    ``chunks`` are copied once per slot and joined by the slot; a task holds one block and one chunk at a time,
    and the blocks of a slot follow one another, so of these only the first ``k`` rows of a place are handed on.
    """
    schema = pa.schema([("akey", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def told(chunk: Chunk, found: tuple) -> pa.RecordBatch:
        q, place, ids, unknown, value = found
        return pa.RecordBatch.from_arrays([pa.array(chunk.keys[q], pa.int64()), pa.array(place, pa.int32()),
                                           pa.array(ids, pa.int64(), mask=unknown), pa.array(value, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        turns, last, chunk, found = rotations(dim), None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, payload = (batch.column(c)[i].as_py() for c in range(2))
                if anchors != last:
                    if found is not None:
                        yield told(chunk, found)
                    last, chunk, found = anchors, Chunk(anchors, turns), None
                block = Block(payload)
                q, place, r, value = what(block, chunk, k)
                new = (q, place, block.ids[r], block.unknown[r], value)
                if found is not None:
                    new = tuple(np.concatenate(x) for x in zip(found, new))
                    best = _best(new[0] * max(1, chunk.least.shape[1]) + new[1], new[4], new[2], new[3], k)
                    new = tuple(x[best] for x in new)
                found = new
        if found is not None:
            yield told(chunk, found)

    slots = slots_for(blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism)
    dealt = blocks.withColumn("slot", F.pmod(F.xxhash64("part", "at"), F.lit(slots)))
    copies = chunks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    # The side on the left streams, a slot's rows of the other are held: for a chunk come all blocks of the slot.
    return (copies.hint("merge").join(dealt, "slot").select("anchors", "payload")
            .mapInArrow(run, "akey long, place int, vec_id long, score long"))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``, ``label`` and ``ints``.  An anchor's positives are its first
    ``positives`` other rows of the same label, their negatives the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score; first by score,
    ties by smaller id.

    Rows with an unknown label, vector or component, or one that is not finite, take no part.  An
    unknown id comes after all others in a tie.  Of repeated rows each is a row of its own: an anchor's copy is
    another row, and each copy of an anchor gives its own result rows.  Vectors shorter than the
    longest end in zeros (an empty one is zero).  No anchor, no other row of its label or no
    row in the interval: no result row.  Other columns are ignored.
    """
    own = cut(prepared(rows, id_col, vector_col, label_col, scale))
    dim = own.agg(F.max(F.size("ints"))).first()[0] or 1
    blocks = cut(index_blocks(own, dim, BLOCK))
    zero = F.lit(0).cast("long")
    self_score = F.aggregate("ints", zero, lambda s, x: s + x * x)
    anchors = cut(own.where(is_anchor).withColumn("akey", F.monotonically_increasing_id())
                  .withColumn("self", self_score))
    size = max(16, CHUNK * 64 // max(64, dim))
    parts = -(-max(1, anchors.count()) // size)
    none = F.array().cast("array<long>")
    chunks = anchor_chunks(anchors.withColumns({"least": none, "most": none}).repartition(parts), dim, size)

    found = _first(search(blocks, chunks, dim, _positives, positives + 1), ["akey"], positives + 1)
    best = found.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    known = anchors.hint("merge").join(best, "akey")
    # One entry that is the anchor itself goes: the first with its id and its score with itself.
    itself = F.filter("best", lambda b: b.vec_id.eqNullSafe(F.col("vec_id")) & (b.score == F.col("self")))
    at = F.when(F.size(itself) > 0, F.element_at(itself, 1)["rank"]).otherwise(positives + 1)
    known = known.withColumn("_at", at).withColumn(
        "best", F.slice(F.filter("best", lambda b: b["rank"] != F.col("_at")), 1, positives))
    known = known.select(
        "akey", "vec_id", "label", "ints", "best",
        F.transform("best", lambda b: _divided(b.score, low, True)).alias("least"),
        F.transform("best", lambda b: _divided(b.score, high, False)).alias("most"))
    known = cut(known)
    chunks = anchor_chunks(known.select("akey", "vec_id", "label", "ints", "least", "most").repartition(parts), dim, size)
    found = _first(search(blocks, chunks, dim, _negatives, negatives), ["akey", "place"], negatives)
    named = known.select("akey", F.col("vec_id").alias("anchor_id"), "best")
    positive = F.col("best")[F.col("place")]
    return found.hint("merge").join(named, "akey").select(
        "anchor_id", positive.vec_id.alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive.score.alias("positive_score"), F.col("score").alias("negative_score"))


def _divided(score, percent: int, up: bool):
    """score * percent / 100 as an integer, rounded up or down, without doubles."""
    whole = score * F.lit(percent)
    rest = F.pmod(-whole if up else whole, F.lit(100))
    return F.call_function("div", whole + rest if up else whole - rest, F.lit(100))
