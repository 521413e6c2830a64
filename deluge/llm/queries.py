"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deluge.llm.common import ship

#: Sequence length of the packed output and the limit that token counts are held against.
SEQUENCE_TOKENS = 2048
#: SimHash near-dedup: words of a shingle and the most bits two linked fingerprints differ in.
SIMHASH_SHINGLE, SIMHASH_BITS = 4, 4
#: URL rules (host and path prefix, verdict); the longest that fits decides.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.token_counts import count_tokens
    out = count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > SEQUENCE_TOKENS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.packing import pack
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.substring_dedup import report
    return report(_table(spark, sf_dir, "documents"), window=13)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.simhash import near_duplicates
    found = near_duplicates(_table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_BITS)
    return found.select("doc_id", "fingerprint", "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.suffix_dedup import report
    return report(_table(spark, sf_dir, "documents"), window=400)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.url_filter import judge
    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.sharding import shard_documents
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.decontaminate import contaminated
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.chat import digest, format_turns
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    path = tokenizer_path("byte_bpe_50k.json")
    return digest(format_turns(turns, path), path).drop("n_tokens", "loss_tokens")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.quality import report
    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.hard_negatives import mine
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Input of operator 12: where crc32(doc_id) ends in 0, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tail = F.expr("""transform(array(filter(split(text, '[ \\t-\\r]+', -1), w -> w != '')), ws ->
        transform(array(named_struct('a', _g % size(ws), 'p', 1 + (size(ws) - _g % size(ws)) div (3 + _g % 8))), s ->
            array_join(transform(ws, (w, i) -> if(i < s.a, w, ws[cast(s.a + (i - s.a) % s.p as int)])), ' '))[0])[0]""")
    words = F.col("text").rlike("[^ \\t-\\r]")
    return (docs.withColumn("_h", h).withColumn("_g", F.expr("_h div 10"))
            .withColumn("text", F.when((F.col("_h") % 10 == 0) & words, tail).otherwise(F.col("text"))).drop("_h", "_g"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.periodic_runs import report
    return report(repeated_tails(_table(spark, sf_dir, "documents")), least=24, times=3)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deluge.llm.pii import report
    return report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii": op13_pii,
}

#: The others are not expressible in SQL over whole tables in reasonable time (tokenizers, fitted
#: models, bit traversal, checksums); tests/llm hold each against brute force instead.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w
  FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, p FROM win JOIN first USING (s), unnest(range(i, i + 13)) u(p) WHERE f < doc_id),
words AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS k, count(gone.p) AS n
  FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY words.r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op8_suffix_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM d, unnest(range(0, n - 399)) t(i) WHERE n >= 400),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM win) WHERE c > 1),
edges AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM starts),
spans AS (SELECT r, s, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS s FROM edges) GROUP BY r, s),
pieces AS (
  SELECT r, b AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1000000000000) AS b FROM spans
  UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r
  UNION ALL SELECT r, 0, 1000000000000 FROM d WHERE r NOT IN (SELECT r FROM spans)),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (least(b, n) - a)), '' ORDER BY a) AS k FROM pieces JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)""",
    "op9_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*/?INST\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op12_periodic_runs": r"""
WITH h AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS h
  FROM documents),
a AS (SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i
    ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
tok AS (SELECT r, i, w[i + 1] AS word FROM d, unnest(range(n)) t(i)),
gram AS (SELECT r, n, i, array_to_string(w[i + 1:i + 16], ' ') AS s FROM d, unnest(range(n - 15)) t(i) WHERE n >= 24),
cand AS (SELECT DISTINCT x.r, y.i - x.i AS q FROM gram x JOIN gram y ON x.r = y.r AND x.s = y.s AND y.i > x.i WHERE 3 * (y.i - x.i) <= x.n),
same AS (SELECT c.r, c.q, x.i FROM cand c JOIN tok x ON x.r = c.r JOIN tok y ON y.r = c.r AND y.i = x.i + c.q AND y.word = x.word),
run AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same)
  GROUP BY r, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (
  SELECT * FROM run x WHERE NOT EXISTS (SELECT 1 FROM run y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
listed AS (SELECT r, count(*) AS m, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + l)) t(i)),
kept AS (SELECT tok.r, string_agg(word, ' ' ORDER BY tok.i) AS k FROM tok ANTI JOIN gone ON gone.r = tok.r AND gone.i = tok.i GROUP BY tok.r)
SELECT doc_id, coalesce(m, 0) AS n_runs, s AS start, CAST(l AS BIGINT) AS length, q AS period, CAST(l * 1000 // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE k <= 5"""}
