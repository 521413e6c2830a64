import zlib

import pytest

import corpus_pipeline
from deluge.llm.decontaminate import LEAST
from deluge.llm import quality
from deluge.llm.queries import QUERIES
from deluge.llm.sharding import shard_documents

from .conftest import SF001, frame
from .test_dedup import _brute_components, _brute_fp, brute_words
from .test_filters import _brute_leaks


def _law_holds(got, rows):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 8
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(docs, messy, empty):
    got = shard_documents(docs).collect()
    _law_holds(got, messy)
    assert shard_documents(empty).collect() == []


def test_groups_stay_together_where_they_fit(spark):
    rows = [(k, f"text {k}") for k in range(100)] + [(200 + k, f"group {k // 5}") for k in range(50)]
    rows += [(400 + k, "a third of all") for k in range(75)]
    got = shard_documents(frame(spark, rows)).collect()
    _law_holds(got, rows)
    text = dict(rows)
    at = {}
    for r in got:
        at.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(at[f"group {k}"]) == 1 for k in range(10))
    assert len(at["a third of all"]) <= 5  # 75 rows cannot fit into fewer than three shards of 28


def _state(spark, groups, unlinked, shards=8):
    """State and capacity as dealt out in turn: (group, rows) and so many rows without a group."""
    import random
    rows = [g for g, n in groups for _ in range(n)] + [None] * unlinked
    random.Random(3).shuffle(rows)
    parts = {}
    for k, g in enumerate(rows):
        if g is not None:
            parts[g, k % shards] = parts.get((g, k % shards), 0) + 1
    state = spark.createDataFrame([(g, s, n) for (g, s), n in parts.items()], "g string, shard long, n long")
    return state, [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]


def _cut_groups(state, capacity, groups):
    """Groups in more than one shard, after the law was checked."""
    at, load, rows = {}, [0] * len(capacity), {}
    for r in state.collect():
        at.setdefault(r.g, set()).add(r.shard)
        load[r.shard] += r.n
        rows[r.g] = rows.get(r.g, 0) + r.n
    assert rows == dict(groups) and all(x <= c for x, c in zip(load, capacity))
    return {g for g, s in at.items() if len(s) > 1}


def test_many_buckets_of_groups_share_the_room(spark, monkeypatch):
    from deluge.llm import sharding
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 2)  # 251 buckets
    groups = [(f"large {k}", 250) for k in range(2)] + [(f"pair {k}", 2) for k in range(500)]
    texts = [g for g, n in groups for _ in range(n)] + [f"text {k}" for k in range(4000)]
    at = {}
    for r in shard_documents(frame(spark, list(enumerate(texts)))).select("doc_id", "shard").collect():
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert [g for g, s in at.items() if len(s) > 1] == []


def test_groups_move_without_unlinked_rows(spark):
    from deluge.llm import sharding
    groups = [(f"pair {k}", 2) for k in range(2000)]
    state, capacity = _state(spark, groups, 0)
    assert len(_cut_groups(sharding.propagate(state, capacity, 1000), capacity, groups)) <= 8  # at most one odd row a shard


def test_pairs_leave_the_shards_of_a_hot_group(spark):
    from deluge.llm import sharding
    groups = [("hot", 1600)] + [(f"pair {k}", 2) for k in range(400)]
    state, capacity = _state(spark, groups, 2400)
    assert _cut_groups(sharding.propagate(state, capacity, 1000), capacity, groups) == {"hot"}  # 1600 rows, shards of 600


def test_flows_never_exceed_the_room():
    import random
    from deluge.llm.sharding import _flows
    rng = random.Random(5)
    for _ in range(200):
        wish = {(i, j): rng.randrange(1, 9) for i in range(5) for j in range(5) if i != j and rng.random() < 0.5}
        free = [rng.choice([0, 0, 3]) for _ in range(5)]
        got = _flows(wish, free)
        assert all(0 < n <= wish[e] for e, n in got.items())
        assert all(sum(n * ((y == s) - (x == s)) for (x, y), n in got.items()) <= free[s] for s in range(5))
    assert _flows({(0, 1): 4, (1, 2): 3, (2, 0): 5}, [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}


def test_a_bound_that_is_reached_warns(spark):
    from deluge.llm import sharding
    state, capacity = _state(spark, [("a", 9), ("b", 2)], 20)
    with pytest.warns(RuntimeWarning, match="after 1 rounds"):
        sharding.propagate(state, capacity, 1)


def _columns_of_documents(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def test_pipeline_against_brute_force(spark):
    """Every stage on its own input: sf0.001, each decision recomputed in plain Python."""
    import duckdb
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    items = duckdb.sql(f"select item_id, text from '{SF001}/benchmark.parquet'").fetchall()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trees = quality.train(docs, labels)
    kept = [(i, t) for (i, t), j in zip(rows, quality.judge([t for _, t in rows], trees, 0.5)) if j[2]]
    comp = _brute_components([_brute_fp(t) for _, t in kept], [i for i, _ in kept], 4)
    kept = [(i, t) for (i, t), c in zip(kept, comp) if i == c]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, SF001)
        assert now.columns == docs.columns, name
        now = now.cache()
        if k == 1:
            assert sorted(r.doc_id for r in now.collect()) == sorted(i for i, _ in kept)
        if k == 2:
            import hashlib
            want = {r[0]: r[3] for r in brute_words(kept, 13)}
            got = {r.doc_id: r.text for r in now.collect()}
            for i, t in got.items():
                assert hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == want[str(i)]
            nothing = hashlib.sha256(b"").hexdigest()
            assert set(map(str, got)) == {i for i, d in want.items() if d != nothing}
            bad = {d for d, _ in _brute_leaks(got.items(), items, least=LEAST)}
    assert sorted(r.doc_id for r in now.collect()) == sorted(set(got) - bad)
    last = corpus_pipeline.run(spark, SF001).collect()
    assert {r.doc_id for r in last} == set(got) - bad


@pytest.mark.parametrize("k", range(5))
def test_stages_take_messy_and_empty_documents(spark, docs, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    for df in (docs, _columns_of_documents(docs), empty):
        out = stage(spark, df, SF001)
        rows = out.count()
        if k < 4:
            assert out.columns == df.columns and rows <= df.count()


def test_every_operator_has_a_query(spark):
    import __spark_entry__
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_tables(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    rows = QUERIES[name](spark, SF001).count()
    if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op8", "op10"):
        assert rows == spark.read.parquet(f"{SF001}/{table}.parquet").count()
    else:
        assert rows > 0
