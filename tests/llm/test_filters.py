import hashlib
import random

import numpy as np

from deluge.llm import chat, decontaminate, quality, url_filter
from deluge.llm.queries import URL_RULES, tokenizer_path

from .conftest import words


def _tokens(text):
    return [w.strip(decontaminate.PUNCTUATION) for w in (text or "").lower().encode().split()
            if w.strip(decontaminate.PUNCTUATION)]


def _brute_leaks(docs, items, substitutions=2, least=1):
    """All aligned stretches of all pairs, those of long items that share four tokens in a row (13 tokens less 2 always do)."""
    out, grams = set(), lambda t: {tuple(t[k:k + 4]) for k in range(len(t) - 3)}
    known = [(i, q, grams(q)) for i, item in items for q in [_tokens(item)] if len(q) >= max(1, least)]
    for d, text in docs:
        t = _tokens(text)
        own = grams(t)
        for i, q, of_item in known:
            if len(q) >= decontaminate.OVERLAP and not own & of_item:
                continue
            n = min(13, len(q))
            allowed = substitutions if len(q) >= decontaminate.OVERLAP else 1 if len(q) >= decontaminate.TOLERANT else 0
            if any(sum(x != y for x, y in zip(t[a:a + n], q[b:b + n])) <= allowed
                   for a in range(len(t) - n + 1) for b in range(len(q) - n + 1)):
                out.add((d, i))
    return out


def test_masks_survive_any_two_substitutions():
    import itertools
    for wrong in itertools.combinations(range(decontaminate.OVERLAP), 2):
        assert any(not ({at + k for k, c in enumerate(m) if c == "1"} & set(wrong))
                   for m in decontaminate.MASKS for at in range(decontaminate.OVERLAP - decontaminate.SPAN + 1))


def test_decontamination(spark, docs, messy, empty):
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, n, 100_000))) for k, n in enumerate([40, 13, 12, 11, 8, 5, 3, 0, 25])]
    items += [(20, None), (0, items[0][1]), (21, items[0][1].upper())]  # a repeated item, an equal one
    rows = [r for r in messy if len(r[1] or "") < 5000]

    def changed(text, places):
        w = text.split()
        for p in places:
            w[p] = "other"
        return " ".join(w)

    long_item = items[0][1]
    rows += [(100, "Start " + long_item.upper() + ", end."), (101, "a b " + changed(" ".join(long_item.split()[5:18]), [3, 7]) + " c"),
             (102, "a b " + changed(" ".join(long_item.split()[5:18]), [3, 5, 7]) + " c"), (103, items[4][1]), (104, items[5][1]),
             (105, changed(items[2][1], [1])), (109, "x " + changed(items[4][1], [0]) + " y"), (110, changed(items[4][1], [2, 5])),
             (111, changed(items[3][1], [10])), (112, changed(items[6][1], [1])), (113, "a " + changed(items[5][1], [4])), (108, changed(items[1][1], [1, 8])), (106, items[6][1]), (107, " ".join(long_item.split()[:12])), (None, items[8][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string")
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, context string, n int")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == _brute_leaks(rows, items)
    clean = decontaminate.keep_clean(df, bench)
    assert {(109, 4), (111, 3), (113, 5), (106, 6)} <= {(r.doc_id, r.item_id) for r in got}
    bad = {d for d, _ in _brute_leaks([(k, t) for k, (_, t) in enumerate(rows)], items, least=decontaminate.LEAST)}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(rows[k][0]) for k in range(len(rows)) if k not in bad)
    assert decontaminate.contaminated(empty, bench).collect() == []
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []


def test_blocks_of_the_benchmark_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(1)
    items = [(k, " ".join(words(rng, 30, 100_000))) for k in range(6)]
    rows = [(k, "pre " + t + " post") for k, t in items]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(k, k) for k in range(6)}


def _naive(text):
    words_ = (text or "").encode().split()
    text = text or ""
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = {}
    for j in range(len(words_) - 2):
        grams.setdefault(tuple(words_[j:j + 3]), []).append(j)
    covered = {j + k for at in grams.values() if len(at) > 1 for j in at for k in range(3)}
    return [len(words_), sum(len(w.decode()) for w in words_), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_quality_statistics(messy):
    for _, text in [*messy, (0, "a\n\na\r\na\n b\n b\n#*$%&|<>\n\x0b\nzz"), (1, "x " * 9)]:
        assert quality.statistics(text)[0] == _naive(text), repr(text)


def test_quality_rules(spark, docs, messy, empty):
    labels = spark.createDataFrame([(None, 1, 0), (5, 1, 0), (5, None, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = quality.report(docs, known).collect()
        want = sorted((str(i), *_naive(t), _naive(t)[0] < 50 or 100 * _naive(t)[4] > 50 * _naive(t)[0]) for i, t in messy)
        assert sorted((str(r.doc_id), *[r[c] for c in quality.BASE], r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
        kept = quality.keep_good(docs, known)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.report(empty, labels).collect() == []


def test_trees_are_monotone_and_hold_out():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=4000) > 0.6).astype(float)
    signs = np.array([1, 0, -1])
    trees = quality.fit_trees(x[:2000], y[:2000], signs)
    assert ((trees.margin(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.9
    for f, sign in ((0, 1), (2, -1)):
        lines = np.repeat(x[2000:2050], 40, axis=0)
        lines[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.margin(lines).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-9).all()
    assert quality.fit_trees(x, np.ones(4000), signs) is None


def test_quality_trees_on_held_out_documents(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.1"
    docs = dict(zip(*[c.to_pylist() for c in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).columns]))
    rows = [r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["quality"] is not None]
    x = np.array([quality.statistics(docs[r["doc_id"]])[1] for r in rows])
    y = np.array([r["quality"] for r in rows], float)
    signs = np.array([quality.MONOTONE.get(f, 0) for f in quality.FEATURES])
    half = np.arange(len(y)) % 2 == 0
    trees = quality.fit_trees(x[half], y[half], signs)
    good = trees.margin(x[~half]) > 0
    assert good[y[~half] == 1].mean() > 0.98 and (~good)[y[~half] == 0].mean() > 0.9


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r, _ in URL_RULES for h, _, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fit, key=len, default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/2",
            "https://xexample.org/en/1", "https://a.com/de/1", "https://com/fr/", "https://a.com/FR/", "http://a.org", "http://a.org?x=/es/",
            "http://É.Com/de/ü", "x://y://z.com/fr/", "http://a.net/b/c.html?p=1&q=2#f", "http://a.net/\n/x", "http://org/", "http://a.org/" + "x" * 50_000]
    urls = urls + urls[:4]
    pages = spark.createDataFrame([(k, u, "h", "c") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule = _judge(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == dict(URL_RULES)[rule] if rule else got[k].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), URL_RULES).collect() == []


def test_url_trees_on_held_out_urls(spark):
    rng = random.Random(2)

    def url(bad):
        host = "".join(rng.choice("abcdefgh0123456789" if bad else "abcdefgh") for _ in range(12))
        return f"http://{host}.net/" + ("?" + "&".join("a=1" for _ in range(4)) if bad and rng.random() < 0.7 else "page")

    rows = [(url(k % 2), float(k % 2)) for k in range(600)]
    labelled = spark.createDataFrame(rows[:400] + rows[:5] + [(None, 1.0), ("http://x.net/", None)], "url string, label double")
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [], labelled).collect()}
    right = sum((got[k] == "block") == (rows[k][1] == 1) for k in range(400, 600))
    assert right > 170
    only = url_filter.judge(pages, [], labelled.where("label = 1")).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_escaping_is_reversible():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "a", "</s>", "[INST]"]) for _ in range(rng.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_chat_formatting(spark):
    rng = random.Random(8)
    rows = [(1, 0, "user", "hi </s> there"), (1, 1, "assistant", "<s>[INST] \\[INST] ok"), (2, 0, None, None), (2, 1, "assistant", ""),
            (None, 0, "user", "no id"), (None, 1, "assistant", "still <|endoftext|> here"), (3, None, "user", "no turn"),
            (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie b"), (5, 0, "as</s>sistant", "odd role")]
    rows += [(6, k, rng.choice(["user", "assistant", "system"]), " ".join(words(rng, 20)) + " é🙂\n") for k in range(300)]
    rows += [(7, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, ids string, loss string")
    from deluge.llm.common import ship
    ship(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    formatted = chat.format_turns(df.repartition(4), path)
    got = {r.conv_id: r for r in chat.digest(formatted, path).collect()}
    assert set(got) == {r[0] for r in rows}
    codec = chat.Codec(open(path, encoding="utf-8").read())
    names = {codec.first + k: c for k, c in enumerate(chat.CONTROL)}
    whole = {}
    for r in sorted(formatted.collect(), key=lambda r: (str(r.conv_id), r.position)):
        assert r.token_start == len(whole.setdefault(r.conv_id, []))
        assert len(r.ids) == len(r.loss)
        whole[r.conv_id] += r.ids
    for conv, r in got.items():
        turns = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        text = "<s>" + "".join(f"[INST]{chat.escape(x[2] or '')}[/INST]{chat.escape(x[3] or '')}</s>" for x in turns)
        assert r.formatted_chars == len(text)
        rendered, run = "", []
        for i in whole[conv] + [-1]:
            if i in names or i < 0:
                rendered += codec.decode(run) + names.get(i, "")
                run = []
            else:
                run.append(i)
        assert rendered == text
    assert chat.digest(chat.format_turns(df.limit(0), path), path).collect() == []
