"""Quality rules: base rules and gradient-boosted trees over document statistics.

The trees are fitted on at most ``rows`` labelled documents (a documented bound; the choice
is by hash of the id), by second-order boosting on binned features.  Features in
``MONOTONE`` may only push the score one way: a split that would turn the direction is
refused, and the middle of its two values bounds all later splits below it.  The fitted
trees are flattened into one set of NumPy node arrays, and a batch of documents walks all
trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, documents_of, rows_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Base statistics of the contract, then the features of the trees.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "punctuation_share", "distinct_share", "letter_share", "words_per_line", "bang_share"]
#: +1: more of it never lowers the quality score; -1: never raises it.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_share": -1}

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_REST = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)  # continuation bytes
_IS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in
       {"symbol": b"#*$%&|<>", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
        "punctuation": b".,;:!?'\"()-", "bang": b"!?"}.items()}


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words in 3-word windows that occur twice or more, different words)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(ids)
    if n < 4:
        return 0, len(known)
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    edge = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(count[at] > 1)
    edge[hit] += 1
    edge[hit + 3] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:n]))), len(known)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(base statistics, features) of one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(count[~_SPACE & ~_REST].sum())
    of = {name: int(count[mask].sum()) for name, mask in _IS.items()}
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct = repeated_words(words)
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    letters = chars - of["symbol"] - of["digit"] - of["punctuation"]
    features = [float(np.log1p(n)), chars * per_word, of["symbol"] * per_char, dup / max(lines, 1), repeat * per_word,
                of["upper"] * per_char, of["digit"] * per_char, of["punctuation"] * per_char, distinct * per_word,
                letters * per_char, n / max(lines, 1), of["bang"] * per_char]
    return [n, chars, of["symbol"], dup, repeat], features


@dataclass
class Trees:
    """Boosted trees as flat arrays; children of node k are ``left[k]`` and ``left[k] + 1``, a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of ``x``: all rows walk all trees together, level by level."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return self.start + self.value[node].sum(axis=1)
            right = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f < 0, node, self.left[node] + right)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15,
              bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees | None:
    """Boosted trees for labels 0/1 under the monotone ``signs``; None if there is only one class."""
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    feature, threshold, left, value, roots = [], [], [], [], []

    def add():
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(add())
        work = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            node, rows, level, low, high = work.pop()
            best = None
            G, H = g[rows].sum(), h[rows].sum()
            if level < depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[rows, f]
                    gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    vl = np.clip(gl / (hl + ridge), low, high)
                    vr = np.clip((G - gl) / (H - hl + ridge), low, high)
                    # Loss of the clipped values, so that bounds are honoured in the choice too.
                    gain = 2 * (gl * vl + (G - gl) * vr) - (hl + ridge) * vl ** 2 - (H - hl + ridge) * vr ** 2
                    fine = (nl >= least) & (len(rows) - nl >= least) & (signs[f] * (vr - vl) >= 0)
                    if fine.any():
                        k = int(np.argmax(np.where(fine, gain, -np.inf)))
                        if best is None or gain[k] > best[0]:
                            best = gain[k], f, k, vl[k], vr[k]
            now = float(np.clip(G / (H + ridge), low, high))
            if best is None or best[0] <= 2 * G * now - (H + ridge) * now ** 2 + 1e-9:
                value[node] = rate * now
                margin[rows] += value[node]
                continue
            _, f, k, vl, vr = best
            a = add()
            add()
            feature[node], threshold[node], left[node] = f, float(edges[f][k]), a
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                      -1: ((middle, high), (low, middle))}[int(signs[f])]
            goes = codes[rows, f] > k
            work += [(a, rows[~goes], level + 1, *bounds[0]), (a + 1, rows[goes], level + 1, *bounds[1])]
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), start)


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, label_col: str = "quality") -> Trees | None:
    """Trees fitted on at most ``rows`` labelled documents; None without both classes."""
    labelled = labels.select(labels["doc_id"].cast("long").alias("doc_id"),
                             labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    n = labelled.count()
    fine = 1 << 30
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(fine)) < F.lit(int(fine * min(1.0, 0.95 * rows / max(n, 1)))))
    # The share leaves room for chance, so the limits only state the bound: at most ``rows`` labels are broadcast,
    # and at most twice as many rows of features, which are worked out where the texts lie, are collected.
    picked = documents_of(docs).join(F.broadcast(sample.limit(rows)), "doc_id")
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        yield from batches_of(((y, statistics(t)[1]) for t, y in rows_of(batches, "text", "y")), schema)

    table = picked.select("text", "y").mapInArrow(run, "y int, x array<double>").limit(2 * rows).toPandas()
    if not len(table):
        return None
    # Rows come in any order; sorted, the same sample always gives the same trees.
    x, y = np.array(table["x"].tolist(), float), table["y"].to_numpy(float)
    order = np.lexsort([y, *x.T])
    return fit_trees(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def base_failed(stats: list[int]) -> bool:
    n, repeat = stats[0], stats[4]
    return n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n


def judge(texts: list[str | None], trees: Trees | None, least: float) -> list[tuple]:
    """(base statistics, base_failed, kept, score) per text; the score is the chance of good quality."""
    both = [statistics(t) for t in texts]
    if trees is None or not both:
        score = np.ones(len(both))
    else:
        score = 1 / (1 + np.exp(-trees.margin(np.array([f for _, f in both]))))
    return [(b, base_failed(b), not base_failed(b) and s >= least, float(s)) for (b, _), s in zip(both, score)]


def report(docs: DataFrame, labels: DataFrame, least: float = 0.5, rows: int = 20_000) -> DataFrame:
    """(doc_id, base statistics, base_failed, kept, score) per input row.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged
    alike.  Without labels of both classes only the base rules decide.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in BASE], ("base_failed", pa.bool_()),
                        ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = judge(part.column(1).to_pylist(), sent.value, least)
                yield from batches_of(((i, *b, f, k, s) for i, (b, f, k, s) in
                                       zip(part.column(0).to_pylist(), found)), schema)

    return documents_of(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE)
                                         + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        return pd.Series([k for _, _, k, _ in judge(list(text), sent.value, least)], dtype=bool)

    return docs.where(kept(docs["text"].cast("string")))
