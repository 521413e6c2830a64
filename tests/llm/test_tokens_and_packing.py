import random
import zlib

import numpy as np

from deluge.llm import packing
from deluge.llm.pretokens import PreTokens, tokenizer_json
from deluge.llm.token_counts import count_tokens


def _ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_pretokens_give_the_librarys_ids(tokenizer):
    path, tok = tokenizer
    cut = PreTokens(tokenizer_json(path))
    odd = ["", "  ", "a'sb 's 'S it'll I'M", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|><|", "é e\u0301 \u0301 ǅ İ ﬁ ß ẞ ŒÆ",
           "a\x1cb\x85c\u00a0d\u2003e", "½²Ⅷ٣ 12,345.67", "🙂👍🏽 a\u200db 你好,世界", "a\tb\nc\x0bd\x0ce\rf", "''' !!!'s...'ve", "ÀÖØÿ÷×µª"]
    rng = random.Random(1)
    odd += ["".join(rng.choice("aB'st 9é½\n.<|>İ") for _ in range(40)) for _ in range(400)]
    for text in odd:
        assert [i for p in cut.of(text) for i in cut.pieces(p)] == _ids(tok, text), repr(text)


def test_another_tokenizer_is_cut_its_own_way_or_refused(tokenizer):
    """Digits kept together: the expression is not used, counts stay the library's.  Pieces across words: refused."""
    import public_tokenizers
    import pytest
    from tokenizers import Tokenizer
    text = tokenizer_json(tokenizer[0])
    other = text.replace("|[\\\\p{N}]|", "|[\\\\p{N}]+|")
    assert other != text
    cut, tok = PreTokens(other), Tokenizer.from_str(other)
    assert not cut._fast and PreTokens(text)._fast
    for t in ("in 1984 it's 12,345.67", "x1y22z333 <|endoftext|> 'S", ""):
        assert [i for p in cut.of(t) for i in cut.pieces(p)] == _ids(tok, t)
    with pytest.raises(ValueError, match="across words"):
        PreTokens(tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))


def test_token_counts(docs, messy, empty, tokenizer):
    path, tok = tokenizer
    want = sorted((str(i), len((t or "").encode()), len(_ids(tok, t))) for i, t in messy)
    for frequent in (3, 200_000):  # nearly everything rare; everything frequent
        got = count_tokens(docs, path, frequent).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert count_tokens(empty, path).collect() == []


def test_packing(docs, messy, empty, tokenizer):
    path, tok = tokenizer
    cap = 256
    got = packing.pack(docs, path, cap).collect()
    want = []
    for i, t in messy:
        ids = np.array([*_ids(tok, t), 0], "<u4")
        want += [(str(i), k, at, len(ids[at:at + cap]), zlib.crc32(ids[at:at + cap].tobytes()))
                 for k, at in enumerate(range(0, len(ids), cap))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= -(-sum(r.length for r in got) // cap) + 1
    assert packing.pack(empty, path, cap).collect() == []


def test_fullest_combination_is_the_best():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        cap = rng.randrange(1, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= cap}
        chosen = packing.fullest(counts, cap)
        assert sum(chosen) == max(sums)
        assert all(chosen.count(n) <= counts[n] for n in set(chosen))


def test_plan_places_every_piece_once():
    histogram = {7: 100, 3: 5, 10: 41, 2: 999}
    steps = packing.plan(histogram, 10)
    placed = {}
    for combination, times in steps:
        assert sum(combination) <= 10
        for n in combination:
            placed[n] = placed.get(n, 0) + times
    assert placed == histogram
