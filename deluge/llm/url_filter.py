"""URL filter: rules first, then gradient-boosted trees on lexical features.

Everything is a DataFrame expression or Spark ML; no Python code touches a row.  Rules are a
short configured list and become one CASE expression, longest rule first.  The trees are
fitted on labelled URLs, at most ``rows`` of them; the suffix statistics come from the same
bounded sample, so their table is bounded, too, and is broadcast.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import cut

FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens",
            "f_suffix", "f_domain", "f_extension"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path) with its lexical features and the keys of the suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    # Character entropy from the different characters and how often each occurs.
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: F.when(
        c == "", acc).otherwise(acc - (n - F.length(F.replace(url, c))) / n
                                * F.log2((n - F.length(F.replace(url, c))) / n)))
    count = lambda column, chars: F.length(column) - F.length(F.translate(column, chars, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.select(
        "*", n.cast("double").alias("f_length"), F.length("host").cast("double").alias("f_host_length"),
        count(F.col("path"), "/").cast("double").alias("f_depth"),
        count(F.col("host"), ".").cast("double").alias("f_labels"),
        F.coalesce(count(url, "0123456789") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("f_digits"),
        F.when(n > 0, entropy).otherwise(0.0).alias("f_entropy"),
        F.when(query == "", 0).otherwise(count(query, "&") + 1).cast("double").alias("f_params"),
        count(url, "-").cast("double").alias("f_hyphens"),
        F.substring_index("host", ".", -1).alias("k_suffix"), F.substring_index("host", ".", -2).alias("k_domain"),
        F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1).alias("k_extension"))


def with_suffix_statistics(df: DataFrame, sample: DataFrame, weight: float = 20.0) -> DataFrame:
    """Smoothed share of blocked URLs per suffix, domain and file extension of the bounded sample."""
    mean = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("m")).first()["m"]
    for name in ("suffix", "domain", "extension"):
        stats = sample.groupBy(F.col(f"k_{name}").alias("_k")).agg(
            ((F.sum("label") + F.lit(weight * mean)) / (F.count("*") + F.lit(weight))).alias("_s"))
        df = (df.join(F.broadcast(stats), df[f"k_{name}"] == stats["_k"], "left")
              .withColumn(f"f_{name}", F.coalesce("_s", F.lit(float(mean)))).drop("_k", "_s"))
    return df


def train(labelled: DataFrame, rows: int = 20_000, trees: int = 20, depth: int = 4):
    """(model, sample) from labelled URLs (url, host, path, label 0/1); model None without both classes.

    ``rows`` bounds the sample, chosen by hash of the URL among the different ones.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    urls = labelled.groupBy("url", "host", "path").agg(F.max("label").cast("double").alias("label"))
    n, fine = urls.count(), 1 << 30
    share = int(fine * min(1.0, 0.95 * rows / max(n, 1)))  # room for chance: the limit only states the bound
    sample = cut(lexical(urls.where(F.pmod(F.xxhash64("url"), F.lit(fine)) < share)).limit(rows))
    if sample.select("label").distinct().count() < 2:
        return None, sample
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        with_suffix_statistics(sample, sample)).select("features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=42, maxBins=64,
                          cacheNodeIds=False).fit(ready)
    return model, sample


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None,
          rows: int = 20_000, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) per input row.

    ``labelled`` has (url, label); by default the URLs that a rule judges are the labelled
    ones.  Null URLs have empty host and path.  Without labels of both classes URLs outside
    all rules get ``default``.  Repeated rows are judged alike; other columns are ignored.
    """
    from pyspark.ml.feature import VectorAssembler

    def parsed(df):
        host, path = host_and_path(df["url"].cast("string"))
        return df.withColumn("host", host).withColumn("path", path)

    base = parsed(pages.select("page_id", pages["url"].cast("string").alias("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        labels = base.where("rule is not null and url is not null").select(
            "url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        labels = parsed(labelled.select(labelled["url"].cast("string").alias("url"),
                                        labelled["label"].cast("double").alias("label")).where(
            "url is not null and label in (0, 1)"))
    model, sample = train(labels, rows)
    if model is None:
        out = base.withColumn("block_score", F.lit(1.0 if default == "block" else 0.0))
    else:
        from pyspark.ml.functions import vector_to_array
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
            with_suffix_statistics(lexical(base), sample))
        out = model.transform(ready).withColumn("block_score", F.element_at(vector_to_array("probability"), 2))
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
