import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from deluge.llm import anchors as A
from deluge.llm import simhash, substring_dedup, suffix_dedup

from .conftest import frame, words

NO_ID = A.NO_ID


def brute_words(rows, window):
    first = {}
    cut = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, NO_ID), i)
    out = []
    for (i, w), (own, _) in zip(cut, rows):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((str(own), len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def brute_bytes(rows, window):
    count = collections.Counter(r[j:j + window] for _, t in rows for r in [(t or "").encode()]
                                for j in range(len(r) - window + 1))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - window + 1):
            if count[raw[j:j + window]] > 1:
                gone[j:j + window] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(i), len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, messy, empty):
    got = substring_dedup.report(docs).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_words(messy, 13)
    assert substring_dedup.report(empty).collect() == []


def test_substring_dedup_with_few_words(spark):
    """A tiny vocabulary: factors start and end everywhere, ids come in any order."""
    rng = random.Random(5)
    rows = [(rng.randrange(50), " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for _ in range(60)]
    got = substring_dedup.report(frame(spark, rows), window=6).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_words(rows, 6)


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_hot_anchors_are_keyed_by_window(hot, monkeypatch):
    """Hot or not, equal windows meet under equal keys."""
    rng = random.Random(2)
    kind = A.Kind("word", 13, 5, bits=10)
    a = [f"w{rng.randrange(9)}" for _ in range(80)]
    raw, other = " ".join(a).encode(), " ".join(["x"] * 7 + a[10:60] + ["y"] * 30).encode()
    full = bytes([255]) * (1 << 7)
    keys = np.unique(A.anchors(kind, A.unit_hashes(kind, A.units_of(kind, raw)))[0].view(np.int64))
    sent = (full, (keys if hot == 1 else keys[:0]).tobytes())

    def windows(text):
        out = {}
        for key, _, at, size, snippet in A.snippet_rows(kind, sent, text):
            w = snippet.split()
            assert len(w) == size
            for j in range(size - 12):
                out[at + j] = (key, tuple(w[j:j + 13]))
        return out

    one, two = windows(raw), windows(other)
    assert len(one) == 80 - 12 and len(two) == 87 - 12
    common = {w: k for k, w in one.values()}
    assert sum(common.get(w) == k for k, w in two.values()) >= 50 - 12


def test_removal_keeps_the_rest_of_a_text(spark, docs, messy):
    rows = {r.doc_id: r for r in substring_dedup.remove(docs).where("doc_id is not null").collect()}
    assert "clash" == rows[5].tid and substring_dedup.remove(docs).columns == docs.columns
    want = {r[0]: r[3] for r in brute_words(messy, 13)}
    for i, r in rows.items():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[str(i)]
        if want[str(i)] == hashlib.sha256(b" ".join((dict(messy)[i] or "").encode().split())).hexdigest():
            assert r.text == dict(messy)[i]  # nothing cut: untouched, white space included
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_suffix_dedup(docs, messy, empty):
    got = suffix_dedup.report(docs, window=400).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_bytes(messy, 400)
    assert suffix_dedup.report(empty).collect() == []


def test_planted_passages_go_by_bytes_not_by_words(spark):
    """Passages of over 50 words, each in two documents: gone from 400 bytes on, however many words; the rest stays."""
    from deluge.llm.common import ship
    ship(spark)
    rng = random.Random(31)
    word = lambda size: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    text = lambda: " ".join(word(6) for _ in range(80))
    # 51 to 57 words: 356 to 398 bytes, and one blank on either side; the last just makes a window of 400.
    passages = [" ".join(word(6) for _ in range(n)) for n in range(51, 58)] + [" ".join(word(9) for _ in range(51))]
    rows = [(10 * k + j, f"{text()} {p} {text()}") for k, p in enumerate(passages) for j in range(2)]
    rows += [(1000 + k, text()) for k in range(6)]
    got = suffix_dedup.report(frame(spark, rows), window=400).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_bytes(rows, 400)
    gone = {r.doc_id: r.n_removed for r in got}
    for k, p in enumerate(passages):
        assert all((gone[10 * k + j] >= len(p) + 2) if len(p) >= 398 else gone[10 * k + j] == 0 for j in range(2))
    assert not any(gone[1000 + k] for k in range(6)) and gone[60] and gone[70] and not gone[50]


def test_suffix_shards():
    rng = random.Random(9)
    for _ in range(8):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 40))) for _ in range(6)]
        shard = suffix_dedup.Shard(parts, 8)
        order = [shard.data[p:shard.ends[p]] for p in shard.sa]
        assert order == sorted(order)
        count = collections.Counter(p[j:j + 8] for p in parts for j in range(len(p) - 7))
        got = [set(j for a, n in spans for j in range(a, a + n)) for spans in shard.spans()]
        want = [set(j + k for j in range(len(p) - 7) if count[p[j:j + 8]] > 1 for k in range(8)) for p in parts]
        assert got == want


def test_one_anchor_over_several_shards(spark):
    """Shards of one anchor are merged by binary search: same result however small they are."""
    rng = random.Random(4)
    core = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(k, "".join(rng.choice("xy") for _ in range(60)) + core + "".join(rng.choice("xy") for _ in range(60)))
            for k in range(12)]
    kind = A.Kind("byte", 60, 32)
    df = frame(spark, rows).select("doc_id", "text")
    found = A.occurrences(df, kind, A.shared(df, kind, within=True)).cache()
    small = sorted(map(tuple, suffix_dedup.sort_shards(found, 60, shard_bytes=150).collect()))
    large = sorted(map(tuple, suffix_dedup.sort_shards(found, 60).collect()))
    assert small == large and any(r[2] for r in small)


@pytest.mark.parametrize("shard_bytes", [150, 4000, 1 << 20])
def test_a_phrase_in_many_contexts(spark, shard_bytes, monkeypatch):
    """One phrase between ever different words, some contexts twice: large anchors are merged from many shards, equal
    runs are one row, and every size of shards and ranges finds the same bytes."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 700)
    rng = random.Random(14)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(45))
    ends = ["".join(rng.choice("xyz") for _ in range(30)) for _ in range(25)]
    rows = [(k, rng.choice(ends) + phrase + rng.choice(ends)) for k in range(300)]
    rows += [(1000 + k, "q" * k + phrase + ends[0] + phrase) for k in range(3)] + [(2000, None), (None, ends[1] + phrase)]
    df = frame(spark, rows).select("doc_id", "text")
    spans = {r.tid: r.spans for r in suffix_dedup.duplicate_spans(df, 60, 32, shard_bytes).collect()}
    count = collections.Counter(t[j:j + 60] for _, t in rows for t in [t or ""] for j in range(len(t) - 59))
    copies = collections.Counter(t or "" for _, t in rows)
    for t in copies:
        want = {j + i for j in range(len(t) - 59) if count[t[j:j + 60]] > copies[t] for i in range(60)}
        got = {i for s in spans[A.text_id(t.encode())] or [] for i in range(s["at"], s["at"] + s["n"])}
        assert got == want


def _brute_components(fps, ids, budget):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), 1 << 62), i)
    return [low.get(find(k)) for k in range(len(fps))]


def _brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, messy, empty):
    fps = [_brute_fp(t) for _, t in messy]
    comp = _brute_components(fps, [i for i, _ in messy], 4)
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(messy, fps, comp))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty).collect() == []


def test_one_row_of_each_group_stays(docs, messy):
    found = simhash.near_duplicates(docs)
    kept = simhash.keep_one(docs, found)
    ids = [r.doc_id for r in kept.collect()]
    want = {r.component_id for r in found.collect() if r.doc_id is not None}
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 0  # every text without an id has a copy with one


def test_rows_without_an_id_stay_once(spark):
    rng = random.Random(22)
    one, two = (" ".join(words(rng, 60, 100_000)) for _ in range(2))
    df = frame(spark, [(None, one)] * 40 + [(None, two)] * 3 + [(9, two)])
    kept = simhash.keep_one(df, simhash.near_duplicates(df))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, one), (9, two)], key=repr)
    assert kept.columns == df.columns


def test_two_texts_under_one_id_are_judged_apart(spark):
    rng = random.Random(21)
    one, two, three = (" ".join(words(rng, 60, 100_000)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (2, two), (3, two), (4, three), (4, one), (5, three + " "), (6, None), (6, "")]
    df = frame(spark, rows)
    kept = simhash.keep_one(df, simhash.near_duplicates(df)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, one), (2, two), (4, three), (6, "")])


def test_trie_join_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 64, 150, dtype=np.uint64)
    more = [base]
    for flips in (2, 4, 6):
        x = base.copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        more.append(x)
    dense = np.full(120, base[0])
    for _ in range(5):
        dense ^= np.uint64(1) << rng.integers(0, 64, len(dense), dtype=np.uint64)
    values = np.unique(np.concatenate([*more, dense]))
    want = _brute_components([int(v) for v in values], list(range(len(values))), 4)
    _, got = simhash.trie_join(values, None, 4)
    assert [int(values[w]) for w in want] == got.tolist()
    # The same through many units, whose stars the components job merges.
    signed = (values ^ np.uint64(1 << 63)).view(np.int64)
    df = spark.createDataFrame([(int(v), k) for k, v in enumerate(signed)], "fp long, first long")
    from deluge.llm.components import components
    roots = {r.node: r.root for r in components(simhash.links(df, 4, 8)).collect()}
    at = {int(v): k for k, v in enumerate(signed)}
    assert [at[roots.get(int(v), int(v))] for v in signed] == want


def test_components_of_chains_and_hubs(spark):
    from deluge.llm.components import components
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(300, 360)] + [(5, 5), (360, 7), (7, 360)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(300, 361)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def _brute_table(texts, window):
    """(n_removed, n_spans, sha) per text by counting a 128-bit hash of every window of every text."""
    rng = np.random.default_rng(77)
    raws = [(t or "").encode() for t in texts]
    hashes, base = [], [int(x) | 1 for x in rng.integers(1, 2 ** 62, 2)]
    for raw in raws:
        c = np.frombuffer(raw, np.uint8).astype(np.uint64)
        n = len(c) - window + 1
        pair = np.zeros((max(n, 0), 2), np.uint64)
        for k in range(2):  # Horner over the window, all windows at once
            h = np.zeros(max(n, 0), np.uint64)
            for j in range(window if n > 0 else 0):
                h = h * np.uint64(base[k]) + c[j:j + n] + np.uint64(7 + k)
            pair[:, k] = h
        hashes.append(pair)
    flat = np.concatenate(hashes)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    same = (flat[order][1:] == flat[order][:-1]).all(1)
    twice = np.zeros(len(flat), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    out, at = [], 0
    for raw, pair in zip(raws, hashes):
        mark, at = twice[at:at + len(pair)], at + len(pair)
        gone = np.convolve(mark, np.ones(window, int))[:len(raw)] > 0 if len(pair) else np.zeros(len(raw), bool)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_on_a_whole_table(spark, monkeypatch):
    """Every document of sf0.01, with shards so small that many anchors are merged from several."""
    from deluge.llm.common import ship
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = table.collect()
    want = {r.doc_id: w for r, w in zip(rows, _brute_table([r.text for r in rows], 400))}
    plain = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(table).collect()}
    assert plain == want
    whole = suffix_dedup.duplicate_spans
    monkeypatch.setattr(suffix_dedup, "duplicate_spans", lambda docs, window: whole(docs, window, shard_bytes=5_000))
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(table).collect()} == want


def test_a_shard_sorts_in_bounded_memory():
    """A shard of the largest size, twice SHARD, of random and repeated snippets: at most 64 MB beside it."""
    import tracemalloc
    rng = np.random.default_rng(4)
    shared_ = rng.integers(97, 101, 500, np.uint8).tobytes()
    parts = [rng.integers(97, 101, 400, np.uint8).tobytes() + shared_ for _ in range(2 * suffix_dedup.SHARD // 900)]
    tracemalloc.start()
    shard = suffix_dedup.Shard(parts, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak
    assert all(s and s[-1][0] + s[-1][1] == 900 and s[-1][0] <= 400 for s in shard.spans())


@pytest.mark.parametrize("window", [3, 7, 8, 20, 33])
def test_equal_windows_are_read_off_the_ranks(window):
    """The rank by ``window`` bytes tells equal windows, whatever lies beyond; no pass over the bytes compares neighbours."""
    rng = random.Random(window)
    for size in (1, 3, 40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 90))) * rng.randrange(1, 3) for _ in range(size)]
        shard = suffix_dedup.Shard(parts, window)
        order, rank = suffix_dedup.suffix_array(shard.text, shard.ends, max(map(len, parts)), window)
        rests = [shard.data[p:shard.ends[p]] for p in range(len(shard.data))]
        assert [rests[p] for p in order] == sorted(rests)
        by_rank, by_bytes = collections.defaultdict(set), collections.defaultdict(set)
        for p, rest in enumerate(rests):
            by_rank[int(rank[p])].add(p)
            by_bytes[rest[:window]].add(p)
        assert sorted(map(sorted, by_rank.values())) == sorted(map(sorted, by_bytes.values()))
        whole = {w: at for w, at in by_bytes.items() if len(w) == window}
        assert {p for p, r in enumerate(shard.repeats) if r} == {p for at in whole.values() if len(at) > 1 for p in at}
        alone = sorted(min(at) for at in whole.values() if len(at) == 1)
        first, second, place = shard.classes()
        assert len(set(zip(first.tolist(), second.tolist()))) == len(whole) and sorted(place[place >= 0].tolist()) == alone
