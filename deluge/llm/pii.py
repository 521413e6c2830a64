"""Personal data in texts: patterns propose spans, validators confirm them, context words adjust the score.

Two kinds of finding:

* *Base* spans (email, ip, card, phone) have a form that needs nothing else: their pattern and
  validator (parts of an address, Luhn digits, number of digits) decide, and they always stay.
* *Scored* spans start with the prior of their pattern.  A validator rejects a proposal (Luhn,
  IBAN's mod 97, impossible numbers or dates), or confirms it and raises the score; words
  nearby that speak for the kind ("iban", "born", "call") raise it, words that speak against it
  ("order", "isbn") lower it.  What reaches ``THRESHOLD`` and does not overlap a span already
  taken is added, best score first.

Every pattern runs in time linear in the text: it starts only at a character that cannot follow
another start of its own, or around an '@'.  One map over whole texts, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.llm.common import batches_of, documents_of, rows_of

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
#: Characters before and after a proposal in which context words count.
BEFORE, AFTER = 48, 24
NEAR, AGAINST = 0.35, -0.35

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")


def digits_of(value: str) -> str:
    return _NO_DIGITS.sub("", value)


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled (less 9 above 9); the sum ends in 0."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits go to the end, letters count 10 to 35, the rest by 97 is 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: around each '@', the run of allowed characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, in code points, by start and kind."""
    out = [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append((3, *m.span()))
    out.sort(key=lambda s: (s[1], s[0]))
    return [(KINDS[k], a, b) for k, a, b in out]


def _iban(value: str) -> float | None:
    compact = value.replace(" ", "")
    return 0.5 if 15 <= len(compact) <= 34 and mod97(compact) else None


def _short_card(value: str) -> float | None:
    digits = digits_of(value)
    return 0.15 if len(digits) == 13 and luhn(digits) else None


def _social_number(value: str) -> float | None:
    area, group, serial = value.split("-")
    return 0.0 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None


def _date(value: str) -> float | None:
    import datetime
    parts = [int(p) for p in re.split(r"[./-]", value)]
    year, month, day = parts if parts[0] > 31 else parts[::-1]
    for m, d in ((month, day), (day, month)):
        try:
            datetime.date(year, m, d)
            return 0.0
        except ValueError:
            continue
    return None


def _local_phone(value: str) -> float | None:
    return 0.0 if 7 <= len(digits_of(value)) <= 12 else None


def _mac(value: str) -> float | None:
    return None if len(set(value.lower()) - set(":-")) == 1 else 0.2


def _secret(value: str) -> float | None:
    """Keys mix letters and digits; a word or a number is none."""
    digits = len(digits_of(value))
    return 0.1 if 0 < digits < sum(c.isalnum() for c in value) and len(set(value)) >= 8 else None


@dataclass(frozen=True)
class Rule:
    """A proposed kind: pattern, prior score, validator (None: rejected; else added), context words."""

    kind: str
    pattern: str
    prior: float
    check: Callable[[str], float | None]
    near: tuple[str, ...]
    against: tuple[str, ...] = ()
    #: The text must hold one of these for the pattern to be tried (a cheap test).
    needs: tuple[str, ...] = ()


RULES = (
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         0.3, _iban, ("iban", "account", "konto", "cuenta", "compte", "bank", "bic")),
    Rule("card", r"(?<![0-9A-Za-z-])[0-9](?:[\x20-]?[0-9]){12}(?![0-9A-Za-z]|[\x20-][0-9])", 0.1, _short_card,
         ("card", "visa", "credit", "karte", "tarjeta", "carte"), ("isbn", "ean", "order", "ref")),
    Rule("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", 0.3, _social_number,
         ("ssn", "social", "security", "tax"), ("order", "part", "ref", "isbn")),
    Rule("birth_date", r"(?<![0-9A-Za-z./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|"
         r"(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2})(?![0-9A-Za-z/-])", 0.2, _date,
         ("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "nacido", "nacida", "né", "née"),
         ("published", "updated", "version")),
    Rule("phone", r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z]|[\x20.-][0-9])", 0.2,
         _local_phone, ("phone", "tel", "telephone", "mobile", "call", "cell", "fax", "telefon", "móvil", "téléphone"),
         ("order", "isbn", "ref", "version", "page")),
    Rule("mac", r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])", 0.3,
         _mac, ("mac", "device", "ethernet", "address"), (), (":", "-")),
    Rule("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,128}(?![A-Za-z0-9_-])", 0.1, _secret,
         ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "bearer"), ("sha256", "commit", "hash")),
)
_COMPILED = tuple(re.compile(r.pattern) for r in RULES)
_WORD = re.compile(r"\w+")


def score(rule: Rule, text: str, start: int, end: int, proof: float) -> float:
    """Prior, what the validator adds, and at most one step up and one down for words nearby."""
    around = set(_WORD.findall(text[max(0, start - BEFORE):start].lower()))
    around.update(_WORD.findall(text[end:end + AFTER].lower()))
    value = rule.prior + proof
    value += NEAR if not around.isdisjoint(rule.near) else 0.0
    return value + (AGAINST if not around.isdisjoint(rule.against) else 0.0)


def scored_spans(text: str, taken: list[tuple[str, int, int]], threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Spans of ``RULES`` that reach the threshold and overlap neither ``taken`` nor a better one."""
    proposals = []
    for rank, (rule, pattern) in enumerate(zip(RULES, _COMPILED)):
        if rule.needs and not any(n in text for n in rule.needs):
            continue
        for m in pattern.finditer(text):
            proof = rule.check(m.group())
            if proof is not None:
                value = score(rule, text, *m.span(), proof)
                if value >= threshold - 1e-9:
                    proposals.append((-value, m.start(), rank, m.end()))
    if not proposals:
        return []
    # Overlaps: spans kept so far by start, disjoint but for base spans of different kinds.
    held = sorted((a, b) for _, a, b in taken)
    merged: list[list[int]] = []
    for a, b in held:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for _, a, rank, b in sorted(proposals):
        at = bisect_left(merged, [a, a])
        if (at and merged[at - 1][1] > a) or (at < len(merged) and merged[at][0] < b):
            continue
        merged.insert(at, [a, b])
        out.append((RULES[rank].kind, a, b))
    return out


_ORDER = {k: i for i, k in enumerate(dict.fromkeys([*KINDS, *(r.kind for r in RULES)]))}


def find(text: str | None, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    more = scored_spans(text, base, threshold)
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]], s[2])) if more else base


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join("%s:%d:%d" % s for s in spans)


def find_spans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, stop, base>>) per input row; code points, ``stop`` exclusive.

    Null and empty texts have no spans; repeated rows and null ids are rows of their own; other
    columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def rows(batches):
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            base, spans = find(text, threshold)
            fixed = set(base)
            yield doc_id, [{"kind": k, "start": a, "stop": b, "base": (k, a, b) in fixed} for k, a, b in spans]

    return documents_of(docs, id_col, text_col).mapInArrow(
        lambda batches: batches_of(rows(batches), schema),
        "doc_id long, spans array<struct<kind:string,start:long,stop:long,base:boolean>>")


def mask(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans as one.

    Texts without a span stay as they are, null texts null; all columns are kept.
    """
    def one(text):
        if text is None:
            return None
        out, done = [], 0
        for kind, a, b in find(text, threshold)[1]:
            if a >= done:
                out += [text[done:a], f"<{kind}>"]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in text], dtype=object)

    return docs.withColumn(text_col, masked(docs[text_col].cast("string")))


def report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per input row.

    The counts and the digest are those of the base spans; ``spans`` lists all, ``n_added`` counts
    the others.  Null and empty texts have none (the digest is that of nothing).  Repeated rows and
    null ids are rows of their own; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def rows(batches):
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            base, spans = find(text, threshold)
            kinds = [k for k, _, _ in base]
            yield (doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(),
                   _listed(spans), len(spans) - len(base))

    return documents_of(docs, id_col, text_col).mapInArrow(
        lambda batches: batches_of(rows(batches), schema),
        "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
