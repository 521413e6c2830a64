"""Token counts: pieces are counted once per distinct pre-token and joined to documents.

Pass 1 gathers every distinct pre-token with its corpus frequency (per-task dictionaries,
then one hash aggregate) and counts its pieces.  Pass 2 counts each document's pre-tokens.
The most frequent pre-tokens, at most ``frequent`` of them whatever the corpus, have their
piece counts sent along as a bounded broadcast, so a hot word never reaches a shuffle.  All rarer pre-tokens are joined
by a shuffle on the pre-token, and the products are summed per document.  No id is ever
materialised.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, cut, documents_of, rows_of
from deluge.llm.pretokens import loaded, tokenizer_json

#: A task hands its pre-token counts on when it holds this many distinct ones.
FLUSH = 300_000


def vocabulary(docs: DataFrame, json_text: str) -> DataFrame:
    """(pretoken, freq, pieces): each distinct pre-token of the corpus, counted once."""
    sent = docs.sparkSession.sparkContext.broadcast(json_text)
    pairs = pa.schema([("pretoken", pa.string()), ("freq", pa.int64())])

    def gather(batches):
        cut_up, seen = loaded(sent.value), {}
        get = seen.get
        for (text,) in rows_of(batches, "text"):
            for p, n in Counter(cut_up.of(text or "")).items():
                seen[p] = get(p, 0) + n
            if len(seen) > FLUSH:
                yield from batches_of(iter(seen.items()), pairs)
                seen.clear()
        yield from batches_of(iter(seen.items()), pairs)

    def count(batches):
        cut_up = loaded(sent.value)
        for b in batches:
            pieces = [len(cut_up.pieces(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int64())],
                                             names=["pretoken", "freq", "pieces"])

    freq = (docs.select("text").mapInArrow(gather, "pretoken string, freq long")
            .groupBy("pretoken").agg(F.sum("freq").alias("freq")))
    return freq.mapInArrow(count, "pretoken string, freq long, pieces long")


def _least_frequent(words: DataFrame, frequent: int) -> int:
    """The frequency from which on there are at most ``frequent`` pre-tokens.

    Found on a logarithmic histogram of a few hundred rows, so nothing is sorted or collected.
    """
    step = F.floor(F.log2("freq") * 16)
    rows = words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("freq").alias("least")).collect()
    taken, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r["step"]):
        taken += r["n"]
        if taken > frequent:
            break
        least = r["least"]
    return least


def count_tokens(docs: DataFrame, tokenizer_path: str, frequent: int = 200_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) per input row.

    Null and empty texts count 0.  Null ids are kept.  Rows that agree in id and text are rows of
    their own, told apart by the task that read them and their number there; other columns are ignored.
    """
    docs = documents_of(docs, id_col, text_col)
    spark = docs.sparkSession
    json_text = tokenizer_json(tokenizer_path)
    words = cut(vocabulary(docs, json_text))
    least = _least_frequent(words, frequent)
    hot = (words.where(F.col("freq") >= F.lit(least)).select("pretoken", "pieces").toPandas()
           .itertuples(index=False, name=None))
    sent = spark.sparkContext.broadcast((json_text, {p: int(n) for p, n in hot}))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("copy", pa.int64()), ("n_bytes", pa.int64()),
                        ("known", pa.int64()), ("pretoken", pa.string()), ("freq", pa.int64())])

    def per_document(rows):
        import xxhash
        from pyspark import TaskContext
        text_of, known = loaded(sent.value[0]), sent.value[1]
        # Equal rows are interchangeable, so their numbers hold however a lost task is run again.
        task, copies = TaskContext.get().partitionId() << 32, Counter()
        for doc_id, text in rows:
            raw, s, rare = (text or "").encode(), 0, []
            for p, n in Counter(text_of.of(text or "")).items():
                k = known.get(p)
                if k is None:
                    rare.append((p, n))
                else:
                    s += k * n
            digest = xxhash.xxh64_intdigest(raw) - (1 << 63)
            # A key with a space is no pre-token: the document's own row finds no partner
            # in the join, and the documents spread over its partitions.
            copy = task + copies[doc_id, digest]
            copies[doc_id, digest] += 1
            yield doc_id, digest, copy, len(raw), s, f" {digest} {copy}", 0
            for p, n in rare:
                yield doc_id, digest, copy, None, 0, p, n

    def run(batches):
        yield from batches_of(per_document(rows_of(batches, "doc_id", "text")), schema)

    parts = docs.mapInArrow(run, "doc_id long, digest long, copy long, n_bytes long, known long, pretoken string, freq long")
    rare_words = words.where(F.col("freq") < F.lit(least)).select("pretoken", "pieces")
    joined = parts.join(rare_words, "pretoken", "left")
    return joined.groupBy("doc_id", "digest", "copy").agg(
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.coalesce(F.col("pieces") * F.col("freq"), F.lit(0))).alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens")
