"""SimHash near-dedup: 64-bit fingerprints linked by a binary-trie self-join.

The distinct fingerprints form a binary trie.  Two nodes are traversed together; each level
adds a differing bit when the branches differ, and a pair is pruned as soon as it exceeds
the Hamming budget.  The top of the trie (at most 2^16 prefixes, a bounded table) is
traversed on the driver, splitting every subtree above ``unit_size``; each surviving pair of
subtrees is one unit of work, which a task traverses in NumPy, level by level in bounded
chunks.  Inside a unit a pair of nodes whose leaves already are one component is pruned too,
so a dense cluster costs no quadratic output: a unit returns a spanning star per component,
and the stars are merged by the distributed components job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, cut, documents_of, rows_of
from deluge.llm.components import components

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Node pairs handled at once, and the product of sizes below which leaves are compared directly.
CHUNK, LEAF = 20_000, 48
TOP_BITS = 16


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Majority of the XXH64 bits of the word shingles, repeats included; 0 without words."""
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[:-shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])]
    data = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(data[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        rows = rows_of(batches, "doc_id", "text_key", "text")
        yield from batches_of(((i, k, fingerprint((t or "").encode(), shingle) - (1 << 63)) for i, k, t in rows), schema)

    return docs.withColumn("text_key", _text_key(docs["text"])).mapInArrow(run, "doc_id long, text_key long, fp long")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def top_of_trie(counts: dict[int, int], unit_size: int, budget: int):
    """Subtrees as (prefix, bits) and the pairs of them that the budget leaves."""
    total = np.zeros(1 << TOP_BITS, np.int64)
    for prefix, n in counts.items():
        total[prefix] = n
    sums = np.concatenate([[0], np.cumsum(total)])

    def size(prefix, bits):
        width = TOP_BITS - bits
        return int(sums[(prefix + 1) << width] - sums[prefix << width])

    nodes, pairs, stack = {}, [], [((0, 0), (0, 0), 0)]

    def keep(node):
        return nodes.setdefault(node, len(nodes))

    while stack:
        a, b, diff = stack.pop()
        na, nb = size(*a), size(*b)
        if not na or not nb:
            continue
        split = [n for n, k in ((a, na), (b, nb)) if k > unit_size and n[1] < TOP_BITS]
        if not split:
            pairs.append((keep(a), keep(b)))
            continue
        kids = lambda n: [(2 * n[0], n[1] + 1), (2 * n[0] + 1, n[1] + 1)]
        if a == b:
            l, r = kids(a)
            stack += [(l, l, diff), (r, r, diff), (l, r, diff + 1)]
            continue
        # Both nodes of a pair always have the same depth, so that bits are compared one for one;
        # an unsplit side is therefore split along with the other.
        stack += [(x, y, diff + ((x[0] ^ y[0]) & 1)) for x in kids(a) for y in kids(b)
                  if diff + ((x[0] ^ y[0]) & 1) <= budget]
    return nodes, pairs


class _Sets:
    """Components over the positions of one unit, as an array of smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self._changes()

    def _changes(self):
        self.steps = np.cumsum(np.concatenate([[0], self.root[1:] != self.root[:-1]]))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        root = self.root
        while True:
            a, b = root[i], root[j]
            live = a != b
            if not live.any():
                break
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
        self._changes()

    def one(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether all positions of each range are one component."""
        return self.steps[hi - 1] == self.steps[lo]


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of fingerprints linked within ``budget`` bits: (fingerprint, smallest of its component).

    ``a`` and ``b`` are sorted distinct uint64 arrays of two subtrees; ``b`` None joins ``a``
    with itself.  Only links between the two sides (or inside ``a``) are searched.
    """
    own = b is None
    values = a if own else np.concatenate([a, b])
    sets = _Sets(len(values))
    # Neighbours in sorted order first: clusters become one component early and are then pruned.
    order = np.argsort(values, kind="stable")
    near = np.bitwise_count(values[order[1:]] ^ values[order[:-1]]) <= budget
    sets.link(order[1:][near], order[:-1][near])
    first = (0, len(a), 0, len(a)) if own else (0, len(a), len(a), len(values))
    stack = [(0, np.array([first], np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, box, diff = stack.pop()
        if len(box) > CHUNK:
            stack.append((depth, box[CHUNK:], diff[CHUNK:]))
            box, diff = box[:CHUNK], diff[:CHUNK]
        la, ha, lb, hb = box.T
        done = (sets.root[la] == sets.root[lb]) & sets.one(la, ha) & sets.one(lb, hb)
        small = ~done & ((((ha - la) * (hb - lb)) <= LEAF) | (depth == 64))
        if small.any():
            i, j = _products(box[small])
            hit = np.bitwise_count(values[i] ^ values[j]) <= budget
            sets.link(i[hit], j[hit])
        live = ~done & ~small
        if not live.any():
            continue
        la, ha, lb, hb, diff = la[live], ha[live], lb[live], hb[live], diff[live]
        bit = np.uint64(1) << np.uint64(63 - depth)
        ma, mb = _middle(values, la, ha, bit), _middle(values, lb, hb, bit)
        same = (la == lb) & (ha == hb)
        new = [(la, ma, lb, mb, diff, slice(None)), (ma, ha, mb, hb, diff, slice(None)),
               (la, ma, mb, hb, diff + 1, slice(None)), (ma, ha, lb, mb, diff + 1, ~same)]
        rows, diffs = [], []
        for xa, ya, xb, yb, d, pick in new:
            r = np.stack([xa, ya, xb, yb], 1)[pick]
            d = d[pick]
            ok = (r[:, 1] > r[:, 0]) & (r[:, 3] > r[:, 2]) & (d <= budget)
            rows.append(r[ok])
            diffs.append(d[ok])
        rows, diffs = np.concatenate(rows), np.concatenate(diffs)
        if len(rows):
            stack.append((depth + 1, rows, diffs))
    smallest = np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, sets.root, values)
    return values, smallest[sets.root]


def _middle(values, lo, hi, bit):
    """First position of each range whose bit is set (a range shares all higher bits)."""
    low = values[lo]
    pivot = (low & ~(bit | (bit - np.uint64(1)))) | bit
    at = np.empty(len(lo), np.int64)
    zero = (low & bit) == 0
    one = (values[hi - 1] & bit) != 0
    at[~zero] = lo[~zero]
    at[zero & ~one] = hi[zero & ~one]
    mixed = np.flatnonzero(zero & one)
    if len(mixed):
        left, right, want = lo[mixed].copy(), hi[mixed] - 1, pivot[mixed]
        while (left < right).any():  # binary search in all ranges at once
            mid = (left + right) // 2
            up = values[mid] < want
            left = np.where(up & (left < right), mid + 1, left)
            right = np.where(~up, mid, right)
        at[mixed] = left
    return at


def _products(box):
    """All position pairs of each box; a box of one range with itself gives unordered pairs."""
    la, ha, lb, hb = box.T
    wa, wb = ha - la, hb - lb
    n = wa * wb
    of = np.repeat(np.arange(len(box)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    i, j = la[of] + k // wb[of], lb[of] + k % wb[of]
    keep = (i < j)
    return i[keep], j[keep]


def links(distinct: DataFrame, budget: int, unit_size: int) -> DataFrame:
    """(u, v) spanning links between fingerprints at most ``budget`` bits apart."""
    spark = distinct.sparkSession
    # Fingerprints are stored with the top bit flipped; an arithmetic shift gives -2^15 .. 2^15 - 1.
    prefix = F.shiftright("fp", 64 - TOP_BITS) + F.lit(1 << (TOP_BITS - 1))
    counts = dict(distinct.groupBy(prefix.alias("p"))
                  .count().toPandas().itertuples(index=False, name=None))
    total = sum(counts.values())
    # At least some tens of units, so that small inputs also use the whole cluster.
    nodes, pairs = top_of_trie({int(p): int(n) for p, n in counts.items()},
                               max(256, min(unit_size, total // 8)), budget)
    members: dict[int, list[int]] = {}
    for unit, (x, y) in enumerate(pairs):
        for node in {x, y}:
            members.setdefault(node, []).append(unit)
    ranges = [(p << (TOP_BITS - bits), (p + 1) << (TOP_BITS - bits), k) for (p, bits), k in nodes.items()]
    sent = spark.sparkContext.broadcast((ranges, members))
    schema = pa.schema([("unit", pa.int32()), ("node", pa.int32()), ("fps", pa.binary())])

    def deal(batches):
        ranges, members = sent.value
        for batch in batches:
            fps = np.sort(batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
            top = (fps >> np.uint64(64 - TOP_BITS)).astype(np.int64)
            lows = np.searchsorted(top, [r[0] for r in ranges])
            highs = np.searchsorted(top, [r[1] for r in ranges])

            def rows():
                for (_, _, node), lo, hi in zip(ranges, lows, highs):
                    if hi > lo:
                        data = fps[lo:hi].tobytes()
                        for unit in members[node]:
                            yield unit, node, data
            yield from batches_of(rows(), schema, 2_000)

    def join(table: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for node, data in zip(table.column("node").to_pylist(), table.column("fps").to_pylist()):
            parts.setdefault(node, []).append(np.frombuffer(data, np.uint64))
        sides = [np.sort(np.concatenate(x)) for x in parts.values()]
        u, v = trie_join(sides[0], sides[1] if len(sides) > 1 else None, budget)
        linked = u != v
        flip = np.uint64(1 << 63)
        return pa.table({"u": pa.array((u[linked] ^ flip).view(np.int64)),
                         "v": pa.array((v[linked] ^ flip).view(np.int64))})

    return (distinct.select("fp").mapInArrow(deal, "unit int, node int, fps binary")
            .groupBy("unit").applyInArrow(join, "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, unit_size: int = 1 << 18,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, root, text_key), one row per input row.

    ``root`` tells components apart (rows sharing an id may name two of them), ``text_key`` the
    texts of one id.  ``component_id`` is the smallest id reachable over links of at most ``budget`` bits.
    Texts without words (null, empty, blank) have fingerprint zero and link like any other.
    Null ids never name a component; a component of null ids only has component_id null.
    """
    fps = cut(fingerprints(documents_of(docs, id_col, text_col), shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, budget, unit_size))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(lowest, "root").select("fp", "component_id", "root"))
    # Stored signed with the top bit flipped, so that signed order is the trie's order.
    text = F.lower(F.lpad(F.hex(F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return fps.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id", "root", "text_key")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, then the smallest text hash.

    Rows are judged by id and text, so of two texts under one id each counts in its own component.
    Rows without an id come last: they go where their component has an id, else one of them stays.
    Of rows that agree in id and text one stays (which, if they differ elsewhere, is left open).
    """
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k"))
    first = cut(first.select(F.col("k.doc_id").alias("_keep"), F.col("k.text_key").alias("_keep_text")).distinct())
    keyed = docs.withColumn("_key", _text_key(docs["text"]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])

    def one(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.first(row).alias("_row")).select("_row")
    # Joined and grouped by the same columns: one shuffle for both.
    named = keyed.where("doc_id is not null").join(
        first.where("_keep is not null"), (F.col("doc_id") == F.col("_keep")) & (F.col("_key") == F.col("_keep_text")), "left_semi")
    nameless = keyed.where("doc_id is null").join(
        first.where("_keep is null").select("_keep_text"), F.col("_key") == F.col("_keep_text"), "left_semi")
    kept = one(named, ["doc_id", "_key"]).unionByName(one(nameless, ["_key"]))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
