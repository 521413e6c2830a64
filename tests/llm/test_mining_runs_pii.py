import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from deluge.llm import hard_negatives, periodic_runs, pii
from deluge.llm import queries as Q

from .conftest import SF001, frame

# --- hard negatives ------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, akey string, best string, payload string, self string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], VECTORS).repartition(3)


def brute_negatives(rows, k=5, low=80, high=100):
    own = [(i, l, np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(np.int64)) for i, v, l in rows
           if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, _, v in own), default=0)
    own = [(i, l, np.pad(v, (0, dim - len(v)))) for i, l, v in own]
    out = []
    for n, (a, la, va) in enumerate(own):
        if a is None or a % 100:
            continue
        def first(some):
            return sorted(some, key=lambda m: (-int(own[m][2] @ va), own[m][0] is None, own[m][0] or 0))
        same = first(m for m in range(len(own)) if m != n and own[m][1] == la)[:k]
        others = first(m for m in range(len(own)) if own[m][1] != la)
        for p in same:
            ps = int(own[p][2] @ va)
            fit = [m for m in others if low * ps <= 100 * int(own[m][2] @ va) <= high * ps][:k]
            out += [(a, own[p][0], r, own[m][0], ps, int(own[m][2] @ va)) for r, m in enumerate(fit, 1)]
    return sorted(out, key=repr)


def messy_vectors(n=900, dim=20, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = [(i, (centres[rng.integers(12)] + rng.standard_normal(dim) * 0.4).round(1 if i % 2 else 6).tolist(),
             int(rng.integers(4))) for i in range(n)]
    rows += [rows[100], rows[100], rows[200], (None, rows[3][1], 1), (None, None, 1), (901, None, 2), (902, [], 3),
             (903, [1.0, None] + [0.0] * (dim - 2), 1), (904, [float("nan")] * dim, 1), (905, [float("inf")] * dim, 2),
             (906, rows[5][1], None), (907, [0.5, -0.25], 2), (1000, [0.0] * dim, 9), (1100, [3.0] + [0.0] * (dim - 1), 8)]
    return rows + [(2000 + i, rows[100][1], i % 4) for i in range(300)]  # one very common vector


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    from deluge.llm.common import ship
    ship(spark)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    rows = messy_vectors()
    got = hard_negatives.mine(vectors(spark, rows), "vec_id % 100 = 0").collect()
    assert sorted(map(tuple, got), key=repr) == brute_negatives(rows)


def test_hard_negatives_never_pass_through_the_driver(spark, monkeypatch):
    """Spark expects the copied anchors to be as small as their file; no join may send them by broadcast."""
    from deluge.llm.common import cut, ship
    ship(spark)
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df):
        plans.append(plan(df))
        return cut(df)

    monkeypatch.setattr(hard_negatives, "cut", seen)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = hard_negatives.mine(vectors(spark, messy_vectors(300)), "vec_id % 100 = 0")
        plans += [plan(found), plan(found) if found.collect() else ""]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum("Join" in p for p in plans) == 3 and not any("Broadcast" in p for p in plans)


def test_slots_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """Several blocks in a slot and several chunks: a slot hands on the first rows of each place, ties and nulls included."""
    from deluge.llm.common import ship
    ship(spark)
    assert [hard_negatives.slots_for(n, 6) for n in (0, 1, 20, 150, 5000)] == [1, 1, 20, 48, 157]
    for name, value in (("BLOCK", 64), ("CHUNK", 16), ("HELD", 7), ("SLOTS", 0)):
        monkeypatch.setattr(hard_negatives, name, value)
    handed = []

    def searched(blocks, chunks, dim, what, k):
        out = search(blocks, chunks, dim, what, k)
        handed.append((hard_negatives.slots_for(blocks.count(), 4), out.groupBy("akey", "place").count().agg({"count": "max"}).first()[0], k))
        return out

    search = hard_negatives.search
    monkeypatch.setattr(hard_negatives, "search", searched)
    rows = messy_vectors()
    got = hard_negatives.mine(vectors(spark, rows), "vec_id % 100 = 0").collect()
    assert sorted(map(tuple, got), key=repr) == brute_negatives(rows)
    assert len(handed) == 2 and all(most <= slots * k for slots, most, k in handed) and handed[0][0] > 1


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.mine(vectors(spark, []), "vec_id % 100 = 0").collect() == []
    assert hard_negatives.mine(vectors(spark, [(100, [1.0], 1), (1, None, 2)]), "vec_id % 100 = 0").collect() == []


@pytest.mark.parametrize("dim", [1, 64, 100])
def test_intervals_hold_every_score(dim):
    """No interval of any level leaves its score out; the levels pass over most rows far from the threshold."""
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.integers(-300, 300, (500, dim)), np.zeros((1, dim), int), rng.integers(-9, 9, (5, dim)) * 10**6])
    turns = hard_negatives.rotations(dim)
    query, index = hard_negatives.Query(x[::20], turns), hard_negatives.encode(x, turns)
    q, r = (v.ravel() for v in np.indices((len(query.x), len(x))))
    exact = (x[::20][q] * x[r]).sum(1).astype(float)
    kept, _ = hard_negatives.surviving(query, index, q, r, exact, exact)
    assert len(kept) == len(q)
    high = np.full(len(q), float((x[::20] ** 2).sum(1)[1]))
    assert len(hard_negatives.surviving(query, index, q, r, high, high * 2)[0]) < len(q) / 2


def test_scores_are_exact_or_refused():
    a = np.array([[2**30, 1], [2**30, 3]])
    assert hard_negatives.scores(a, a).tolist() == [2**60 + 1, 2**60 + 9]
    with pytest.raises(ValueError):
        hard_negatives.scores(a * 4, a * 4)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    want = con.execute(Q.ORACLES[name]).df()
    got = Q.QUERIES[name](spark, SF001).toPandas()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    rows = [sorted((tuple(None if v is None or v != v else v for v in r) for r in f[sorted(want.columns)].astype(object).where(
        f[sorted(want.columns)].notna(), None).itertuples(index=False)), key=repr) for f in (got, want)]
    assert rows[0] == rows[1]


# --- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(w, least, times):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(
                    all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(i, text):
    w = (text or "").encode().split()
    runs = brute_runs(w, 24, 3)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (i, len(runs), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            w = [b"w%d" % rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(100))]
            at = rng.randrange(len(w) + 1)
            texts.append(w[:at] + (w[at:at + rng.randrange(1, 12)] * 40)[:rng.randrange(150)] + w[at:])
        least, times = rng.choice([(24, 3), (6, 2), (4, 2), (24, 5), (1, 2)])
        assert periodic_runs.find(texts, least, times) == [brute_runs(w, least, times) for w in texts]


def test_position_sets_stay_ordered_over_many_chunks(monkeypatch):
    monkeypatch.setattr(periodic_runs.Positions, "CHUNK", 4)
    rng = random.Random(1)
    numbers = rng.sample(range(1000), 200)
    held = periodic_runs.Positions(numbers[0])
    for k, p in enumerate(numbers[1:], 2):
        held.add(p)
        line = sorted(numbers[:k])
        at = line.index(p)
        assert list(held) == line and held.size == k
        assert held.around(p) == (line[at - 1] if at else None, line[at + 1] if at + 1 < k else None)


def repeated(i, text):
    """The contract's input of operator 12."""
    w = (text or "").encode().split()
    if i is None or not w or zlib.crc32(str(i).encode()) % 10:
        return text
    g = zlib.crc32(str(i).encode()) // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return b" ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))).decode()


def test_run_report(spark, docs, messy, empty):
    rng = random.Random(4)
    more = [(1000 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9, 90)))) for i in range(80)]
    rows = messy + more + [(2000, "to and fro " * 300), (2001, "x " * 2000), (2000, "to and fro " * 300)]
    got = periodic_runs.report(Q.repeated_tails(frame(spark, rows))).collect()
    want = [brute_report(i, repeated(i, t)) if len((t or "").split()) < 3000 else None for i, t in rows]
    long = [i for (i, t) in rows if len((t or "").split()) >= 3000]
    assert sorted((tuple(r) for r in got if r[0] not in long), key=repr) == sorted(filter(None, want), key=repr)
    assert len(got) == len(rows) and any(r["n_runs"] for r in got)
    assert periodic_runs.report(empty).collect() == [] and Q.repeated_tails(empty).collect() == []


def test_runs_and_collapsed_texts(docs, messy):
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}
    again = next(i for i, t in messy if t and t.startswith("again and again"))
    assert [tuple(r) for r in found[again]["runs"]] == [(0, 600, 3)]
    texts = {r["doc_id"]: r["text"] for r in periodic_runs.collapse(docs).collect()}
    assert texts[again] == "again and again"
    assert all(texts[i] == t for i, t in messy if i is not None and not found[i]["runs"])
    assert periodic_runs.collapse(docs).columns == docs.columns


# --- personal data -------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def fits(kind, s):
        d = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = sum(d[::-1][0::2]) + sum(sum(map(int, str(2 * x))) for x in d[::-1][1::2])
            return 14 <= len(d) <= 19 and doubled % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15
    out = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(BASE.items())
           for m in re.finditer(p, text or "") if fits(kind, m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@pytest.mark.parametrize("alphabet", ["a.@1-+ (9 0é٣", "0123456789 -.+", "a@.", "1.25 "])
def test_base_spans_equal_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text, kinds", [
    ("my iban is GB82 WEST 1234 5698 7654 32 ok", ["iban"]),
    ("DE89370400440532013000", ["iban"]),
    ("iban DE88370400440532013000", []),  # fails mod 97
    ("visa 4222222222222 here", ["card"]), ("order 4222222222222 here", []), ("visa 4222222222223 here", []),
    ("ssn 123-45-6789", ["ssn"]), ("ssn 000-45-6789", []), ("part 123-45-6789", []),
    ("born on 12.03.1980 in", ["birth_date"]), ("born on 42.13.1980 in", []), ("updated 2020-01-02", []),
    ("call 555-3824-123 now", ["phone"]), ("page 555-3824-123 now", []),
    ("device 00:1B:44:11:3A:B7", ["mac"]),
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', ["secret"]),
    ("commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", []),
    ("token internationalization-of-everything", []),
    ("write to a.b@c.example.org or 10.0.0.1 or +1 (743) 555-3824 or 4111 1111 1111 1111", ["email", "ip", "phone", "card"]),
    ("", []), (None, []),
])
def test_scored_kinds(text, kinds):
    base, spans = pii.find(text)
    assert [k for k, _, _ in spans] == kinds
    assert set(base) <= set(spans) and base == brute_spans(text)


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


@pytest.mark.parametrize("piece", ["a", "1", "a@", "1.", "+1 ", "+1" + " " * 50, "12 ", "AB12 ", "(1", "aa:", "1-"])
def test_patterns_take_linear_time(piece):
    import time
    start = time.time()
    pii.find(piece * (400_000 // len(piece)))
    assert time.time() - start < 5


def test_pii_report_and_mask(spark, docs, messy, empty):
    rng = random.Random(6)
    values = ["a.b@c.example.org", "10.0.0.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "300.1.1.1", "word"]
    rows = messy + [(500 + i, " ".join(rng.choice(values) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(700, "😀 call 555-3824-123 a@b.co"), (700, "😀 call 555-3824-123 a@b.co")]
    got = pii.report(frame(spark, rows)).collect()

    def listed(spans):
        return ",".join("%s:%d:%d" % s for s in spans)
    want = []
    for i, t in rows:
        base = brute_spans(t)
        want.append((i, *(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(listed(base).encode()).hexdigest(),
                     listed(pii.find(t)[1]), len(pii.find(t)[1]) - len(base)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_added"] for r in got) == 2
    assert pii.report(empty).collect() == []
    spans = pii.find_spans(frame(spark, rows)).where("doc_id = 700").first()["spans"]
    assert [tuple(s) for s in spans] == [("phone", 7, 19, False), ("email", 20, 26, True)]
    masked = pii.mask(frame(spark, rows))
    assert masked.columns == docs.columns
    assert {r[0] for r in masked.where("doc_id = 700").select("text").collect()} == {"😀 call <phone> <email>"}
    assert masked.where("text is null").count() == sum(t is None for _, t in rows)


def test_queries_equal_brute_force_on_whole_tables(spark):
    table = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, Q.op12_periodic_runs(spark, SF001).collect()))
    small = [(i, t) for i, t in table if len((t or "").split()) < 1500]
    ids = {i for i, _ in small}
    assert len(got) == len(table)
    assert [r for r in got if r[0] in ids] == sorted(brute_report(i, repeated(i, t)) for i, t in small)
    base = {r["doc_id"]: r["base_sha256"] for r in Q.op13_pii(spark, SF001).collect()}
    assert base == {i: hashlib.sha256(",".join("%s:%d:%d" % s for s in brute_spans(t)).encode()).hexdigest() for i, t in table}
