"""Substring dedup by relative Lempel-Ziv parsing.

The collection is its own reference.  Reference blocks are content-defined: a block gathers
the snippets (short stretches around shared anchors, see ``anchors``) that have one anchor,
so equal windows always lie in one block and a text is only parsed against blocks it can
share something with.  In a block, snippets are taken by ascending owner id; each is factored
greedily against the snippets of smaller ids: the window at the current position is looked up
in the block's index and extended word by word to the longest match.  A factor of at least
``window`` words is a duplicate span.  Greedy factors may hide a window that straddles their
end, so parsing resumes ``window - 1`` words before it and checks every such window.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm import anchors as A
from deluge.llm.common import batches_of, covered, cut, documents_of, rows_of


class Block:
    """Snippets with one anchor, indexed by window; snippets must come by ascending owner."""

    def __init__(self, window: int):
        self.window, self.index, self.words, self.owners, self.waiting = window, {}, [], [], None

    def _windows(self, snippet: bytes, words: list[bytes]):
        ends = list(accumulate(len(w) + 1 for w in words))
        last = self.window - 1
        return [snippet[(ends[i - 1] if i else 0):ends[i + last] - 1] for i in range(len(words) - last)]

    def _learn(self, windows, words, owner):
        r = len(self.words)
        self.words.append(words)
        self.owners.append(owner)
        for i, w in enumerate(windows):
            self.index.setdefault(w, (r, i))

    def factors(self, snippet: bytes, owner: int) -> list[tuple[int, int]]:
        """Duplicate spans (first word, words) of a snippet, which then joins the reference."""
        words = snippet.split(b" ")
        if self.waiting is None and not self.words:
            self.waiting = snippet, words, owner  # a block of one snippet never needs an index
            return []
        if self.waiting is not None:
            first, first_words, first_owner = self.waiting
            self.waiting = None
            self._learn(self._windows(first, first_words), first_words, first_owner)
        windows, spans, i = self._windows(snippet, words), [], 0
        while i < len(windows):
            hit = self.index.get(windows[i])
            if hit is None or self.owners[hit[0]] >= owner:
                i += 1
                continue
            reference, at, n = self.words[hit[0]], hit[1], self.window
            most = min(len(words) - i, len(reference) - at)
            while n < most and words[i + n] == reference[at + n]:
                n += 1
            spans.append((i, n))
            i += n - self.window + 1
        self._learn(windows, words, owner)
        return spans


def parse_blocks(found: DataFrame, window: int) -> DataFrame:
    """(key, digest, low, spans): each different snippet, its smallest owner and that owner's spans."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("low", pa.int64()),
                        ("spans", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))])

    def rows(batches):
        block_key, block, done = None, None, set()
        for key, digest, owner, snippet in rows_of(batches, "key", "digest", "owner", "snippet"):
            if key != block_key:
                block_key, block, done = key, Block(window), set()
            if digest in done:
                continue
            done.add(digest)
            yield key, digest, owner, [{"at": a, "n": n} for a, n in block.factors(snippet, owner)]

    def run(batches):
        yield from batches_of(rows(batches), schema)

    return (found.where(F.col("snippet").isNotNull()).select("key", "digest", "owner", "snippet")
            .repartition("key").sortWithinPartitions("key", "owner", "digest")
            .mapInArrow(run, "key long, digest long, low long, spans array<struct<at:int,n:int>>"))


def duplicate_spans(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """(tid, first, copies, spans): every different text with the spans that its first owner loses."""
    kind = A.Kind("word", window, gram)
    found = cut(A.occurrences(docs, kind, A.shared(docs, kind, within=False)))
    parsed = cut(parse_blocks(found, window))
    # A snippet whose owner is not the smallest one repeats as a whole.
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("size").alias("n")))
    placed = found.select("key", "digest", "tid", "owner", "start", "size").join(parsed, ["key", "digest"]).select(
        "tid", "owner", "start", F.when(F.col("owner") > F.col("low"), whole).otherwise(F.col("spans")).alias("spans"))
    spans = A.spans_by_text(placed).withColumnsRenamed({"tid": "_tid", "owner": "_owner"})
    texts = A.texts_of(docs)
    return texts.join(spans, (texts["tid"] == spans["_tid"]) & (texts["first"] == spans["_owner"]), "left").select(
        "tid", "first", "copies", "spans")


def kept_words(text: str | None, later: bool, spans, window: int) -> tuple[int, list[bytes]]:
    """(number of words, words kept); ``later``: an equal text has a smaller id."""
    words = (text or "").encode().split()
    if later:
        return len(words), [] if len(words) >= window else words
    if not spans:
        return len(words), words
    gone = covered(np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans]), len(words))
    return len(words), [w for w, g in zip(words, gone.tolist()) if not g]


def report(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per input row.

    Null and empty texts have no words.  A null id is larger than every id, so such a row
    loses what any named document has, and never takes words from another.  Repeated rows of
    one id keep the same words.
    """
    own = documents_of(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string())])

    def rows(batches):
        for doc_id, text, first, spans in rows_of(batches, "doc_id", "text", "first", "spans"):
            n, kept = kept_words(text, (A.NO_ID if doc_id is None else doc_id) > first, spans, window)
            yield doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    def run(batches):
        yield from batches_of(rows(batches), schema)

    return joined(own, window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def joined(own: DataFrame, window: int) -> DataFrame:
    spans = cut(duplicate_spans(own, window))
    return (own.withColumn("tid", A.text_id_of(F.col("text"))).join(spans, "tid", "left")
            .select("doc_id", "text", "first", "spans"))


def without_spans(text: str, later: bool, spans, window: int) -> str:
    """The text without its duplicate words; what stays keeps its own white space."""
    import re
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if later:
        return text if len(at) < window else ""
    if spans is None or not len(spans):
        return text
    gone = covered(np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans]), len(at)).tolist()
    out, start = [], 0
    for k, (a, _) in enumerate(at):
        if gone[k] and not (k and gone[k - 1]):
            out.append(raw[start:a])
        elif k and gone[k - 1] and not gone[k]:
            start = a
    if not gone[-1]:
        out.append(raw[start:])
    return b"".join(out).decode().rstrip() if any(gone) else text


def remove(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; texts of which nothing stays are dropped.

    All columns are kept; ``n_chars``, where there is one, follows the new text.
    """
    own = documents_of(docs)
    spans = cut(duplicate_spans(own, window)).select(
        F.col("tid").alias("__tid"), F.col("first").alias("__first"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def kept(text: pd.Series, later: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_spans(t, bool(x), s, window)
                          for t, x, s in zip(text, later, found)], dtype=object)

    both = docs.join(spans, A.text_id_of(docs["text"]) == F.col("__tid"), "left")
    later = F.coalesce(F.col("doc_id"), F.lit(A.NO_ID)) > F.col("__first")
    out = both.withColumn("__text", kept("text", later, "__spans"))
    out = out.where(~((F.trim("__text") == "") & (F.col("text") != F.col("__text"))) | F.col("text").isNull())
    out = out.withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)
