"""Suffix-array dedup: bytes covered by a ``window``-byte string that also starts elsewhere.

Snippets of bytes around shared anchors (see ``anchors``) meet by anchor, so equal windows do.  A shard's text is
different snippets one after another; its suffix array is refined as Larsson and Sadakane do
(only groups of equal ranks are sorted again, by the rank ``h`` places on, with ``h``
doubling), in NumPy.  Windows are equal where their ranks are when ``h`` has come to ``window``.

An anchor whose different snippets fit a shard goes into one shard with others.  A larger one (a common
phrase in ever different context) is dealt over many shards by snippet, whatever the number of
snippets, and these are merged: each shard cuts its sorted windows, one per class of equal ones, into ranges of their
128-bit hashes, and per range one shard after another is looked up, by binary search, in the windows
merged so far.  A shard and a range hold a bounded number of windows, so memory does not grow with an anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm import anchors as A
from deluge.llm.common import batches_of, covered, cut, documents_of, rows_of

#: Bytes of snippets in a shard.  Sorting takes some 40 bytes of memory for each, in a shard of up to twice that size.
SHARD = 1 << 19
#: Bytes of windows that a task hands on at a time.
OUT_BYTES = 4 << 20


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by their first ``depth`` bytes, rank of each by its first ``window`` bytes).

    ``text`` are bytes, ``ends[i]`` is the end of the snippet that holds position i; a suffix stops there.
    Equal ranks: the first ``window`` bytes, or all of two shorter rests, are equal.
    """
    n = len(text)
    # The first seven bytes as one number; 0 stands past a snippet's end.
    h = min(7, window)
    key = np.zeros(n, np.int64)
    place = np.arange(n, dtype=np.int32)
    for k in range(h):
        key *= 257
        if k < n:  # later symbols stand past every end
            key[:n - k] += np.where(place[k:] < ends[:n - k], text[k:].astype(np.int16) + 1, 0)
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    del key
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, place, 0))
    active = _unsorted(head, place)
    del head, place
    of_window = rank.copy() if h == window else None
    while h < depth and len(active):
        step = min(h, window - h) if h < window else h  # no step passes over the window
        p = sa[active]
        after = np.where(p + step < ends[p], rank[np.minimum(p + step, n - 1)] + 1, 0)
        pair = rank[p].astype(np.int64) * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        sa[active] = p[order]
        pair = pair[order]
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[sa[active]] = active[np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))]
        active = active[_unsorted(head, np.arange(len(active), dtype=np.int32))]
        h += step
        if h == window:
            of_window = rank.copy()
    return sa, rank if of_window is None else of_window


def _unsorted(head: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Members of groups of two or more."""
    follows = np.concatenate([head[1:], [True]])
    return place[~(head & follows)]


class Shard:
    """Different snippets in one text, with the windows that repeat."""

    def __init__(self, snippets: list[bytes], window: int):
        self.window = window
        data = b"".join(snippets)
        self.data, self.text = data, np.frombuffer(data, np.uint8)
        sizes = np.array([len(s) for s in snippets], np.int64)
        stops = np.cumsum(sizes)
        self.starts, self.ends = stops - sizes, np.repeat(stops.astype(np.int32), sizes)
        self.sa, rank = suffix_array(self.text, self.ends, int(sizes.max(initial=0)), window)
        # Whole windows in sorted order: equal ones are neighbours of one rank, which no shorter rest has.
        self.windows = self.sa[self.ends[self.sa] - self.sa >= window]
        ranks = rank[self.windows]
        self.head = np.concatenate([[True], ranks[1:] != ranks[:-1]])[:len(ranks)]
        follows = np.concatenate([self.head[1:], [True]])[:len(ranks)]
        self.repeats = np.zeros(len(data), bool)
        self.repeats[self.windows[~(self.head & follows)]] = True

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first hash, second hash, place) of one window of every class of equal windows; the place of a window that
        stands alone, -1 for a class of several, whose windows are marked already."""
        head = np.flatnonzero(self.head)
        alone = np.diff(np.append(head, len(self.windows))) == 1
        at = self.windows[head]
        first, second = (A.rolling(t[self.text], self.window)[at] for t in _SUBSTITUTES)  # one whole array at a time
        return first, second, np.where(alone, at, -1)

    def spans(self) -> list[list[tuple[int, int]]]:
        """Per snippet its repeated stretches as (first byte, bytes)."""
        out = []
        stops = np.append(self.starts[1:], len(self.data))
        for a, b in zip(self.starts.tolist(), stops.tolist()):
            hit = self.repeats[a:b].astype(np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
            out.append([(int(x), int(y - x + self.window - 1)) for x, y in zip(edge[::2], edge[1::2])])
        return out


#: Windows of one range of hashes, for which so many are expected at most.
RANGE = 500_000
#: Two random substitutions of the bytes, for two independent hashes of a window.
_SUBSTITUTES = np.random.default_rng(1).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sort_shards(found: DataFrame, window: int, shard_bytes: int = SHARD) -> DataFrame:
    """(key, digest, spans) for (key, digest, snippet) rows, of anchors whose different snippets fit a shard."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()),
                        ("spans", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))])

    def groups(rows):
        """(key, [(digest, snippet)]): an anchor's different snippets."""
        key, part, done = None, [], set()
        for k, digest, snippet in rows:
            if k != key:
                if part:
                    yield key, part
                key, part, done = k, [], set()
            if digest not in done:
                done.add(digest)
                part.append((digest, snippet))
        if part:
            yield key, part

    def result(held, shard):
        for (key, digest), spans in zip(held, shard.spans()):
            yield key, digest, [{"at": a, "n": n} for a, n in spans]

    def rows(batches):
        held, snippets, size = [], [], 0
        for key, part in groups(rows_of(batches, "key", "digest", "snippet")):
            if len(part) < 2:
                continue  # no other text has this anchor in another snippet
            held += [(key, d) for d, _ in part]
            snippets += [s for _, s in part]
            size += sum(len(s) for _, s in part)
            if size >= shard_bytes:
                yield from result(held, Shard(snippets, window))
                held, snippets, size = [], [], 0
        if snippets:
            yield from result(held, Shard(snippets, window))

    def run(batches):
        yield from batches_of(rows(batches), schema)

    return (found.where(F.col("snippet").isNotNull()).select("key", "digest", "snippet")
            .repartition("key").sortWithinPartitions("key", "digest")
            .mapInArrow(run, "key long, digest long, spans array<struct<at:int,n:int>>"))


_SHARD_DDL = "shard long, range long, names binary, first binary, second binary, places binary, marks binary"


def _cut_shards(window: int, shard_bytes: int, ranges: int):
    """mapInArrow: snippets to shards; a row with range -1 (names, lengths and marks) and one per range of windows."""
    schema = pa.schema([("shard", pa.int64()), ("range", pa.int64()), *((n, pa.binary()) for n in (
        "names", "first", "second", "places", "marks"))])

    def shard_rows(number, held, snippets):
        shard = Shard(snippets, window)
        names = np.array([(k, d, len(s)) for (k, d), s in zip(held, snippets)], np.int64)
        yield number, -1, names.tobytes(), None, None, None, np.packbits(shard.repeats).tobytes()
        first, second, place = shard.classes()
        of = (first % np.uint64(ranges)).astype(np.int64)
        order = np.lexsort((second, first, of))
        first, second, place, of = first[order], second[order], place[order].astype(np.int32), of[order]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(of)).tolist()):
            yield number, int(of[a]), None, first[a:b].tobytes(), second[a:b].tobytes(), place[a:b].tobytes(), None

    def rows(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held, snippets, size = [], [], 0
        for key, digest, snippet in rows_of(batches, "key", "digest", "snippet"):
            held.append((key, digest))
            snippets.append(snippet)
            size += len(snippet)
            if size >= shard_bytes:
                yield from shard_rows(number, held, snippets)
                held, snippets, size, number = [], [], 0, number + 1
        if snippets:
            yield from shard_rows(number, held, snippets)

    def run(batches):
        held, size = [], 0
        for row in rows(batches):  # a row holds a shard's windows of a range: batches are bounded in bytes
            held.append(row)
            size += sum(len(v) for v in row[2:] if v is not None)
            if size >= OUT_BYTES:
                yield from batches_of(iter(held), schema)
                held, size = [], 0
        yield from batches_of(iter(held), schema)

    return run


def _merge_range(batches):
    """mapInArrow over windows by range and shard: (shard, -2, places) of windows that another shard has, too."""
    schema = pa.schema([("shard", pa.int64()), ("range", pa.int64()), ("places", pa.binary())])

    def hits_of(parts):
        """Looks one sorted shard after another up among those merged so far."""
        none = np.empty(0, np.uint64)
        first, second, shard, place = none, none, np.empty(0, np.int64), np.empty(0, np.int32)
        for number, f, s, p in parts:
            low, high = np.searchsorted(first, f, "left"), np.searchsorted(first, f, "right")
            mine, theirs = [], []
            for k in np.flatnonzero(high > low).tolist():
                for j in range(low[k], high[k]):  # equal first hashes: one, but by chance
                    if second[j] == s[k]:
                        mine.append(k)
                        theirs.append(j)
            if mine:
                yield number, p[mine]
                for other in np.unique(shard[theirs]).tolist():
                    yield other, place[theirs][shard[theirs] == other]
            new = np.ones(len(f), bool)
            new[mine] = False  # a class already there stands for this one
            place[theirs] = -1
            at = low[new]
            first, second = np.insert(first, at, f[new]), np.insert(second, at, s[new])
            shard, place = np.insert(shard, at, number), np.insert(place, at, p[new])

    def parts():
        held, of = [], None
        for number, r, f, s, p in rows_of(batches, "shard", "range", "first", "second", "places"):
            if r != of:
                if held:
                    yield held
                held, of = [], r
            held.append((number, np.frombuffer(f, np.uint64), np.frombuffer(s, np.uint64), np.frombuffer(p, np.int32)))
        if held:
            yield held

    def rows():
        for held in parts():
            found: dict[int, list] = {}
            for number, places in hits_of(held):
                found.setdefault(number, []).append(places[places >= 0])
            for number, places in found.items():
                yield number, -2, np.concatenate(places).tobytes()

    yield from batches_of(rows(), schema, 64)


def _spans_of_shards(window: int):
    """mapInArrow over a shard's own row and its hits: (key, digest, spans)."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()),
                        ("spans", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))])

    def result(names, marks):
        start = 0
        for key, digest, size in names.tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], marks[start:start + size].astype(np.int8), [0]])))
            start += size
            yield key, digest, [{"at": int(a), "n": int(b - a + window - 1)} for a, b in zip(edge[::2], edge[1::2])]

    def rows(batches):
        names = marks = None
        for r, n, p, m in rows_of(batches, "range", "names", "places", "marks"):
            if r == -1:  # sorted after the hits of the shard before, and before its own
                if names is not None:
                    yield from result(names, marks)
                names = np.frombuffer(n, np.int64).reshape(-1, 3)
                marks = np.unpackbits(np.frombuffer(m, np.uint8), count=int(names[:, 2].sum())).astype(bool)
            else:
                marks[np.frombuffer(p, np.int32)] = True
        if names is not None:
            yield from result(names, marks)

    def run(batches):
        yield from batches_of(rows(batches), schema)

    return run


def merge_shards(found: DataFrame, window: int, shard_bytes: int = SHARD) -> DataFrame:
    """(key, digest, spans) for (key, digest, snippet) rows, each once, of any number per anchor."""
    found = cut(found)
    windows = found.agg(F.sum(F.length("snippet") - F.lit(window - 1))).first()[0] or 0
    ranges = windows // RANGE + 1
    shards = cut(found.repartition(F.col("digest")).mapInArrow(_cut_shards(window, shard_bytes, ranges), _SHARD_DDL))
    hits = (shards.where(F.col("range") >= 0).select("shard", "range", "first", "second", "places")
            .repartition("range").sortWithinPartitions("range", "shard")
            .mapInArrow(_merge_range, "shard long, range long, places binary"))
    own = shards.where("range = -1").select("shard", "range", "names", F.lit(None).cast("binary").alias("places"), "marks")
    more = hits.select("shard", "range", F.lit(None).cast("binary").alias("names"), "places", F.lit(None).cast("binary").alias("marks"))
    return (own.unionByName(more).repartition("shard").sortWithinPartitions("shard", F.desc("range"))
            .mapInArrow(_spans_of_shards(window), "key long, digest long, spans array<struct<at:int,n:int>>"))


def duplicate_spans(docs: DataFrame, window: int = 400, gram: int = 200, shard_bytes: int = SHARD) -> DataFrame:
    """(tid, copies, spans): every different text with its repeated byte spans.

    ``gram``, the bytes of an anchor, only decides what is looked at: the longer it is, the
    fewer passages shorter than ``window`` come as far as the shards.
    """
    kind = A.Kind("byte", window, min(gram, max(1, window // 2)))
    found = cut(A.occurrences(docs, kind, A.shared(docs, kind, within=True, with_hot=False)))
    # Equal snippets at two places repeat as a whole; copies of one text share their places.
    places = cut(found.groupBy("key", "digest").agg(
        F.min("tid").alias("t0"), F.max("tid").alias("t1"), F.min("start").alias("s0"), F.max("start").alias("s1"),
        F.max("size").alias("size")))
    several = places.where("t0 < t1 or s0 < s1").select("key", "digest", F.lit(True).alias("several"))
    # Anchors whose different snippets exceed a shard are merged from many; each holds a shard's bytes, so they are few.
    large = cut(places.groupBy("key").agg(F.count("*").alias("different"), F.sum("size").alias("bytes"))
                .where((F.col("bytes") > shard_bytes) & (F.col("different") > 1)).select("key"))
    texts = found.where(F.col("snippet").isNotNull()).select("key", "digest", "snippet")
    if large.isEmpty():
        sorted_ = sort_shards(texts, window, shard_bytes)
    else:
        once = texts.join(large, "key", "left_semi").groupBy("key", "digest").agg(F.first("snippet").alias("snippet"))
        sorted_ = sort_shards(texts.join(large, "key", "left_anti"), window, shard_bytes).unionByName(
            merge_shards(once, window, shard_bytes))
    verdict = cut(several.join(sorted_, ["key", "digest"], "full").where("several or size(spans) > 0"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("size").alias("n")))
    placed = found.select("key", "digest", "tid", "start", "size").join(verdict, ["key", "digest"]).select(
        "tid", F.lit(0).alias("owner"), "start", F.when(F.col("several"), whole).otherwise(F.col("spans")).alias("spans"))
    spans = A.spans_by_text(placed).select(F.col("tid").alias("_tid"), "spans")
    texts = A.texts_of(docs)
    return texts.join(spans, texts["tid"] == spans["_tid"], "left").select("tid", "copies", "spans")


def report(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per input row.

    Null texts are empty.  Repeated rows and null ids are documents of their own: a string in
    two rows starts twice.  Texts shorter than ``window`` bytes lose nothing.
    """
    own = documents_of(docs, id_col, text_col)
    spans = cut(duplicate_spans(own, window))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def rows(batches):
        for doc_id, text, copies, found in rows_of(batches, "doc_id", "text", "copies", "spans"):
            raw = (text or "").encode()
            if copies > 1 and len(raw) >= window:
                found = [{"at": 0, "n": len(raw)}]
            kept, n_spans = raw, 0
            if found:
                gone = covered(np.array([s["at"] for s in found]), np.array([s["n"] for s in found]), len(raw))
                n_spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            yield doc_id, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()

    def run(batches):
        yield from batches_of(rows(batches), schema)

    return (own.withColumn("tid", A.text_id_of(F.col("text"))).join(spans, "tid", "left")
            .select("doc_id", "text", "copies", "spans")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
