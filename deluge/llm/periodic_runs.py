"""Periodic runs in word sequences: stretches that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
that no neighbouring word extends, of at least ``least`` words and ``times`` periods.

Method (descending-LCP Kruskal).  The suffixes of a text are sorted by prefix doubling, only
as far as groups of equal prefixes last; common prefixes (LCP) of neighbours come from Kasai's
recurrence.  Taking neighbours by decreasing LCP l, the classes of their positions are united
(union-find, the smaller class moves), each class being an ordered set of positions.  Two
positions that become adjacent in the united set at distance d <= l share exactly l words, so
the words from the first to l past the second have period d: they seed a run.  It is a run when it
cannot be extended to the left; d is its smallest period, as a smaller one would have put a
position between the two at a larger l.  Every run is seeded at its own start, where
l = length - q >= max(least - q, (times - 1) * q); below the least such value nothing is sorted.

Texts are independent: one map over the documents, no shuffle.  Short texts are sorted together
(their words numbered apart, so that they share nothing).  Memory and time of a task follow
its longest text, n log n in its words.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, covered, documents_of, rows_of

#: Words of texts that are sorted together.
TOGETHER = 1 << 16


def least_prefix(least: int, times: int) -> int:
    """The smallest LCP that can seed a run: min over q of max(least - q, (times - 1) * q)."""
    return max(1, min(max(least - q, (times - 1) * q) for q in range(1, max(2, least + 1))))


def repeated_prefixes(ids: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions in suffix order, first of its group, h) of suffixes whose first h words occur again.

    ``h`` is the largest power of two up to ``words``; ``ends[i]`` is the end of i's text.
    """
    place = np.arange(len(ids))
    sa = np.argsort(ids, kind="stable")
    ordered = ids[sa]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(ids), np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, place, 0))
    # `active` are the places in `sa` that lie in groups of two or more.
    active, h, found = place[~(head & np.append(head[1:], True))], 1, None
    heads = head
    while True:
        if found is None and 2 * h > words:
            found = active, heads[active].copy(), h
        if not len(active):
            break
        p = sa[active]
        after = np.where(p + h < ends[p], rank[np.minimum(p + h, len(ids) - 1)] + 1, 0)
        key = rank[p] * (len(ids) + 1) + after
        order = np.argsort(key, kind="stable")
        sa[active], key = p[order], key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sa[active]] = active[np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))]
        heads[active] = head
        active = active[~(head & np.append(head[1:], True))]
        h *= 2
    places, first, h = found if found else (active, heads[active], h)
    return sa[places], first, h


def common_prefixes(ids: list, ends: list, order: list, first: list, h: int) -> list[tuple[int, int, int]]:
    """(l, p, q): positions p after q in suffix order within a group, sharing exactly l words (Kasai)."""
    before = {p: q for q, p, new in zip(order, order[1:], first[1:]) if not new}
    out, last, run = [], -2, 0
    for p in sorted(before):
        q = before[p]
        run = max(h, run - 1) if p == last + 1 else h
        most = min(ends[p] - p, ends[q] - q)
        while run < most and ids[p + run] == ids[q + run]:
            run += 1
        out.append((run, p, q))
        last = p
    return out


class Positions:
    """An ordered set of positions in chunks, so that a new one moves few others."""

    CHUNK = 1024

    def __init__(self, first: int):
        self.chunks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk

    def add(self, p: int) -> None:
        k = max(0, bisect_right(self.heads, p) - 1)
        chunk = self.chunks[k]
        insort(chunk, p)
        self.heads[k] = chunk[0]
        self.size += 1
        if len(chunk) > self.CHUNK:
            half = len(chunk) // 2
            self.chunks[k:k + 1] = [chunk[:half], chunk[half:]]
            self.heads[k:k + 1] = [chunk[0], chunk[half]]

    def around(self, p: int) -> tuple[int | None, int | None]:
        """The members next to p below and above."""
        k = bisect_right(self.heads, p) - 1
        chunk = self.chunks[k]
        at = bisect_left(chunk, p)
        low = chunk[at - 1] if at else self.chunks[k - 1][-1] if k else None
        high = chunk[at + 1] if at + 1 < len(chunk) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        return low, high


def seeds(edges: list[tuple[int, int, int]]):
    """(i, j, l) for positions that become adjacent in a class when it is united at LCP l, if j - i <= l."""
    of, sets = {}, {}
    for l, p, q in sorted(edges, reverse=True):
        for each in (p, q):
            if each not in of:
                of[each], sets[each] = each, Positions(each)
        a, b = of[p], of[q]
        if sets[a].size < sets[b].size:
            a, b = b, a
        big, moved = sets[a], list(sets.pop(b))
        for each in moved:
            big.add(each)
        for each in moved:
            low, high = big.around(each)
            if low is not None and of[low] == a and each - low <= l:
                yield low, each, l
            if high is not None and of[high] == a and high - each <= l:
                yield each, high, l
        for each in moved:
            of[each] = a


def find(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start and period."""
    ids, stops, base = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids += [base + known.setdefault(w, len(known)) for w in words]
        base += len(known)
        stops.append(len(ids))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not ids:
        return out
    sizes = np.diff(np.array([0, *stops]))
    ends = np.repeat(stops, sizes)
    shortest = least_prefix(least, times)
    order, first, h = repeated_prefixes(np.array(ids), ends, shortest)
    if not len(order):
        return out
    text_of = np.repeat(np.arange(len(texts)), sizes)
    edges = common_prefixes(ids, ends, order.tolist(), first.tolist(), h)
    for i, j, l in seeds([e for e in edges if e[0] >= shortest]):
        period = j - i
        t = int(text_of[i])
        begin = stops[t] - int(sizes[t])
        if l + period >= max(least, times * period) and (i == begin or ids[i - 1] != ids[j - 1]):
            out[t].append((i - begin, int(l) + period, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    start, length, period = np.array(runs).T
    gone = covered(start + period, length - period, len(words)).tolist()
    return [w for w, g in zip(words, gone) if not g]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # in order of start and period, so a tie keeps the earlier one
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _with_runs(rows, least: int, times: int):
    """(row, words, runs) of rows whose second field is a text, short texts being sorted together."""
    held, size = [], 0
    for row in rows:
        words = (row[1] or "").encode().split()
        held.append((row, words))
        size += len(words)
        if size >= TOGETHER or len(held) >= TOGETHER:
            yield from ((r, w, f) for (r, w), f in zip(held, find([w for _, w in held], least, times)))
            held, size = [], 0
    yield from ((r, w, f) for (r, w), f in zip(held, find([w for _, w in held], least, times)))


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>) per input row.

    Null and empty texts have no words and no runs; repeated rows and null ids are rows of
    their own; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
        [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))])

    def run(batches):
        rows = ((row[0], len(words), [dict(zip(("start", "length", "period"), r)) for r in runs])
                for row, words, runs in _with_runs(rows_of(batches, "doc_id", "text"), least, times))
        yield from batches_of(rows, schema, 2_000)

    return documents_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>")


def collapse(docs: DataFrame, least: int = 24, times: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` whose texts keep one period of every run, their words joined by one space.

    Texts without runs stay byte for byte, null texts null; all columns are kept.
    """
    @F.pandas_udf("string")
    def kept(text: pd.Series) -> pd.Series:
        rows = ((k, t) for k, t in enumerate(text))
        return pd.Series([row[1] if not runs else b" ".join(collapsed(words, runs)).decode()
                          for row, words, runs in _with_runs(rows, least, times)], dtype=object)

    return docs.withColumn(text_col, kept(docs[text_col].cast("string")))


def report(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) per input row.

    The run shown is the one of greatest length / period.  Null and empty texts, short texts and
    texts without a run: no run, four nulls, the digest of nothing, the words as they are.  Repeated
    rows and null ids are rows of their own; other columns are ignored.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def rows(batches):
        for row, words, runs in _with_runs(rows_of(batches, "doc_id", "text"), least, times):
            start, length, period = strongest(runs) or (None, None, None)
            listed = "".join("%d,%d,%d\n" % r for r in runs).encode()
            yield (row[0], len(runs), start, length, period, length * 1000 // period if period else None,
                   hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())

    def run(batches):
        yield from batches_of(rows(batches), schema, 2_000)

    return documents_of(docs, id_col, text_col).mapInArrow(
        run, ", ".join(f"{n} long" for n in names) + ", runs_sha256 string, collapsed_sha256 string")
