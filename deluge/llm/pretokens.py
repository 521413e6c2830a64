"""Whole texts as pre-tokens of a word tokenizer, exactly as the tokenizers library cuts them.

The tokenizer drops white space and never forms a piece across it, so a text's pieces are
those of its pre-tokens one after another.  Texts made only of ASCII and precomposed Latin-1
letters are cut with one regular expression (the tokenizer's own split pattern with the
classes spelled out); every other text, and every text that may hold a special string,
is cut word by word by the library itself.  Both are tried on a probe when a tokenizer is loaded: where the
expression cuts otherwise than the tokenizer it is not used, and a tokenizer that joins words is refused.
"""

from __future__ import annotations

import re

from tokenizers import Tokenizer

#: Byte-level vocabularies write a byte as a letter: printable ones as themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}

# ---- fixed values: the split pattern of the word tokenizer, over plain Latin-1 ----
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+"
NOT_PLAIN = r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\|"
# -----------------------------------------------------------------------------------
#: Tries every character of a plain text after a letter, a digit, a sign and white space, and contractions.
PROBE = " ".join(["It's I'll we've don't you're he'd I'm 'tis x's's O'S don''t 12's", "naïve ÉLAN straße 3x4 a1b22 ..!? --x", *(
    f"{c}{c} a{c}b 7{c}8 .{c}, {c}" for c in map(chr, [*range(33, 127), *range(192, 256)]) if c not in "<×÷")])


def tokenizer_json(path: str) -> str:
    """The tokenizer file's text; it is read on the driver and sent with the task (1-3 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class PreTokens:
    """Cuts texts into pre-tokens and gives each pre-token's piece ids."""

    def __init__(self, json_text: str, cache_limit: int = 300_000):
        self.tok = Tokenizer.from_str(json_text)
        self.cache_limit = cache_limit
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") \
            if self.specials else None
        self._plain, self._odd = re.compile(PLAIN_SPLIT), re.compile(NOT_PLAIN)
        self._words: dict[bytes, list[str]] = {}
        by_word = [p for w in PROBE.split() for p in self._word(w)]
        self._fast = by_word == self._plain.findall(PROBE.lower())
        ids = [i for p in by_word for i in self.pieces(p)]
        if ids != self.tok.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError("this tokenizer forms pieces across words, or none by pre-token: its texts cannot be counted word by word")

    def of(self, text: str) -> list[str]:
        if self._fast and not self._odd.search(text):
            return self._plain.findall(text.lower())
        out: list[str] = []
        words = self._words
        for w in text.encode().split():
            got = words.get(w)
            if got is None:
                if len(words) >= self.cache_limit // 3:
                    words.clear()
                got = self._word(w.decode())
                if len(w) < 64:
                    words[w] = got
            out += got
        return out

    def _word(self, word: str) -> list[str]:
        """Pre-tokens of one word; a special string inside is one pre-token of its own."""
        out: list[str] = []
        for part in self._cut.split(word) if self._cut else [word]:
            if part in self.specials:
                out.append(part)
            elif part:
                normal = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [normal[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def pieces(self, pretoken: str) -> list[int]:
        """Piece ids of one pre-token, straight from the merge model (no second normalisation)."""
        if pretoken in self.specials:
            return [self.specials[pretoken]]
        return [t.id for t in self.tok.model.tokenize(pretoken.encode().decode("latin-1").translate(BYTE_LETTERS))]


_LOADED: dict[int, PreTokens] = {}


def loaded(json_text: str) -> PreTokens:
    """One instance per Python worker: workers are reused, so pre-token caches stay warm."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hash(json_text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PreTokens(json_text)
    return _LOADED[key]
