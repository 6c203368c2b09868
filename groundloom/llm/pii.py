"""Personal data: regular expressions propose spans, checks confirm them, nearby words adjust the score.

Four kinds are fixed: their spans are found left to right without overlap and stay whatever their score. Further kinds (IBAN by
mod 97, 13-digit cards by Luhn, social security numbers, telephone numbers without a plus) are taken where check and context reach
``ACCEPTED`` and no fixed span overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.llm.common import body, give_back, lean

KINDS = ("email", "ip", "card", "phone")
MORE = ("iban", "card13", "ssn", "local_phone")
ACCEPTED = 0.6
NEAR = 48  # characters on either side

_digit = re.compile("[0-9]").search
_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban_start = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_iban_rest = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_iban_end = re.compile(r"(?![A-Za-z0-9])")
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_here = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")

#: Characters of an account number by country, as the registry lists them.
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
#: Words that speak for a kind, fixed values.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "amex"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "card13": ("card", "visa", "credit", "payment"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
#: Words that speak against, fixed values.
AGAINST = ("version", "order", "isbn", "invoice", "sample", "example", "part")
_words = re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From left to right, the account number of each start: mod 97 holds at a word's end, at best at the country's length, else as late as possible.

    The search goes on behind an accepted number, and right behind a rejected start; a start looks at 30 further characters and blanks at most.
    """
    at = 0
    while m := _iban_start.search(text, at):
        at = m.start() + 1
        head = int("".join(str(int(c, 36)) for c in m.group()))
        length, value, best = 4, 0, 0
        rest = _iban_rest.match(text, m.end())
        for k in range(m.end(), rest.end() if rest else m.end()):
            if (c := text[k]) == " ":
                continue
            length += 1
            value = (value * (10 if c.isdigit() else 100) + int(c, 36)) % 97
            if length >= 15 and (value * 1_000_000 + head) % 97 == 1 and _iban_end.match(text, k + 1):
                best = k + 1
                if IBAN_LENGTH.get(m.group()[:2]) == length:
                    break
        if best:
            yield m.start(), best
            at = best


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: no '@' is in a local part, so each one's starts at the run before it, or at the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _local.match(text[start - 1]):
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed kinds by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _digit(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _card.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def context(kind: str, text: str, start: int, end: int) -> float:
    near = set(_words.findall(text[max(0, start - NEAR) : start].lower())) | set(_words.findall(text[end : end + NEAR].lower()))
    return 0.3 * any(w in near for w in CONTEXT[kind]) - 0.3 * any(w in near for w in AGAINST)


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, fixed) in code points, by start, then kind as listed."""
    fixed = base_spans(text)
    out = [(k, a, b, min(1.0, max(0.0, {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7}[k] + context(k, text, a, b))), True) for k, a, b in fixed]
    if not _digit(text):
        return out
    more: list[tuple[str, int, int, float]] = []
    more += [("iban", a, b, 0.8) for a, b in ibans(text)]
    for m in _card.finditer(text):
        if 13 <= m.end() - m.start() <= 26 and len(d := _digits(m.group())) == 13 and luhn(d):
            more.append(("card13", m.start(), m.end(), 0.4))
    more += [("ssn", m.start(), m.end(), 0.4) for m in _ssn.finditer(text)]
    more += [("local_phone", m.start(), m.end(), 0.4) for m in _here.finditer(text)]
    taken = bytearray(len(text))
    for _, a, b in fixed:
        taken[a:b] = b"\1" * (b - a)
    for k, a, b, s in sorted(more, key=lambda x: (x[1], MORE.index(x[0]))):
        s = min(1.0, s + context(k, text, a, b))
        if s >= ACCEPTED and not any(taken[a:b]):
            out.append((k, a, b, s, False))
            taken[a:b] = b"\1" * (b - a)
    return sorted(out, key=lambda x: (x[1], (KINDS + MORE).index(x[0])))


SPAN = "array<struct<kind:string,start:long,end:long,score:double,fixed:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans for every row: (kind, start, end, score, fixed), code points, end exclusive.

    Null text counts as empty; nulls in other columns, repeated rows and columns of any name make no difference; an empty table
    gives an empty one. Time grows with the length of a text, also for long runs of digits or letters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "spans": [[{"kind": k, "start": a, "end": b, "score": s, "fixed": f} for k, a, b, s, f in spans(t)] for t in x["text"]]})

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), body(docs).alias("text")).mapInPandas(lean(run), f"doc_id string, spans {SPAN}")
    return rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "spans")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_kind(kind: str):
    return lambda k: k == kind


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for k, a, b, _, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and n_chars, if there, counted anew; null stays null, all else stays as it is."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        give_back()
        return texts.map(lambda t: None if t is None else redacted(t))

    out = docs.withColumn("text", cleaned(docs["text"]))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(out["text"].isNull(), out["n_chars"]).otherwise(F.length(out["text"]).cast(docs.schema["n_chars"].dataType)))
