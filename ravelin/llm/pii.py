"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, colons, URL schemes, identifier and telephone cues, and digits. Around each anchor a
deterministic local parser finds the boundaries of an email address, a network address, a phone or an account number, and
validates it. Text without anchors costs only the automaton's pass.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import lower, slices
from ravelin.runtime import prepare, spread

CUES = ("ssn", "social security", "passport", "iban", "account", "acct", "konto", "compte", "cuenta", "card", "driver license")
PHONE_CUES = ("tel", "phone", "telephone", "telefon", "téléphone", "teléfono", "mobile", "mobil", "handy", "fax")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://")
MASKS = {"email": "[EMAIL]", "phone": "[PHONE]", "ip": "[IP]", "card": "[CARD]", "iban": "[IBAN]", "ssn": "[SSN]", "url_user": "[URL_USER]", "identifier": "[ID]"}

_HEX = frozenset("0123456789abcdefABCDEF:.")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_DOMAIN = re.compile(r"(?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.)+(?:xn--[a-z0-9-]{2,59}|[^\W\d_]{2,24})(?![^\W_])")
_IP = re.compile(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w]|\.\d)", re.A)
_SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.A)
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w])|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,10}\)?){1,5}(?!\w)", re.A)
_GROUP = re.compile(r"\d+", re.A)
#: A short group with a digit right before: the number is the rest of something longer.
_CONTINUED = re.compile(r"(?<!\w)\w{0,5}\d[ -]$", re.A)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)", re.A)
_SMALL_IBAN = re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}(?!\w)", re.A)
_CUED_SSN = re.compile(r"[\s:#=.]{0,4}(?:no|nr|number|id)?[\s:#=.]{0,4}((?!000|666|9\d\d)\d{3}[ .-]?(?!00)\d\d[ .-]?(?!0000)\d{4})(?![\w-])", re.A | re.I)
_CUED_PHONE = re.compile(r"[\s.:#=]{0,4}(?:no|nr|number)?[\s.:#=]{0,4}(\+?\(?\d(?:[ ()./-]{0,2}\d){5,14})(?!\w)", re.A | re.I)
#: Characters of a country's account numbers.
_IBAN_LENGTHS = {k: n for n, ks in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
                                    25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for k in ks.split()}
_USER = re.compile(r"[^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@(?=[A-Za-z0-9.-])")
_IDENT = re.compile(r"[\s:#=.]{0,4}(?:no|nr|number|id)?[\s:#=.]{0,4}([A-Z0-9][A-Z0-9-]{5,})(?!\w)", re.A | re.I)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word(":", (":", 1))
    for d in "0123456789":
        a.add_word(d, ("#", 1))
    for kind, words in (("s", SCHEMES), ("c", CUES), ("t", PHONE_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(m: re.Match[str]) -> int | None:
    """End of the whole groups of a match that validate, of the country's length if there are any, else the most: words behind an account number may look like groups of it."""
    s = m.group()
    ends = [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")]
    ends.sort(key=lambda e: e - s.count(" ", 0, e) != _IBAN_LENGTHS.get(s[:2]))
    return next((m.start() + e for e in ends if _iban_ok(s[:e])), None)


def _small_iban_end(m: re.Match[str]) -> int | None:
    """The same for a match with lower-case letters: only of a known country's length, since many other codes look like that."""
    s = m.group()
    n = _IBAN_LENGTHS.get(s[:2].upper())
    ends = [i for i in (*range(1, len(s)), len(s)) if i - s.count(" ", 0, i) == n and (i == len(s) or s[i] == " ")]
    return next((m.start() + e for e in ends if _iban_ok(s[:e])), None)


def ipv6_at(text: str, at: int) -> tuple[int, int] | None:
    """Span of the IPv6 address around a colon: the whole run of its characters, if the standard library reads it as one."""
    s = e = at
    while s > 0 and at - s < 40 and text[s - 1] in _HEX:
        s -= 1
    while e < len(text) and e - at < 40 and text[e] in _HEX:
        e += 1
    while e > at and text[e - 1] == "." or text[at:e].endswith(":") and not text[at:e].endswith("::"):
        e -= 1
    run = text[s:e]
    if run.count(":") < 2 or not any(c.isalnum() for c in run) or s and (text[s - 1].isalnum() or text[s - 1] in "_.") or e < len(text) and (text[e].isalnum() or text[e] == "_"):
        return None
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return None
    return s, e


def email_at(text: str, at: int) -> tuple[int, int] | None:
    """Span of the address around an at-sign: the longest valid local part before it, the longest valid domain behind it."""
    s = at
    while s > 0 and text[s - 1] in _LOCAL:
        s -= 1
    while s < at and text[s] in ".!#$%&'*+/=?^`{|}~-":
        s += 1
    if s == at or text[at - 1] == "." or ".." in text[s:at]:
        return None
    m = _DOMAIN.match(text, at + 1)
    return (s, m.end()) if m else None


def _digits_at(text: str, i: int, fresh: bool = False) -> tuple[str, int, int] | None:
    """What a digit belongs to, tried from its run's start: network address, social security, phone, IBAN or card number. Digits that validate as none of these are no personal data unless a cue precedes them. fresh: what stands before was found itself."""
    s = i
    for back in range(0, 6):
        p = s - back
        if p < 0 or (back and text[p] not in "+( " and not (text[p].isascii() and text[p].isalpha())):
            break
        if back == 0 and (m := _IP.match(text, p)) and all(int(x) <= 255 for x in m.groups()):
            return "ip", m.start(), m.end()
        if back == 0 and (m := _SSN.match(text, p)):
            return "ssn", m.start(), m.end()
        if back and text[p] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and (m := _IBAN.match(text, p)) and (end := _iban_end(m)):
            return "iban", m.start(), end
        if back and text[p].islower() and (m := _SMALL_IBAN.match(text, p)) and (end := _small_iban_end(m)):
            return "iban", m.start(), end
        if (back == 0 or text[p] in "+(") and (m := _PHONE.match(text, p)):
            n = sum(c.isdigit() for c in m.group())
            if 8 <= n <= 15 and ("(" in m.group() or "+" in m.group() or n == 10) and not (back == 0 and text[max(0, p - 1) : p] in ("+", "(")):
                return "phone", m.start(), m.end()
    if not (s and (text[s - 1].isalnum() or text[s - 1] in "_.-")) and (fresh or not _CONTINUED.search(text, max(0, s - 9), s)):
        # the longest run of whole groups that validates
        for end, d in reversed(_groups_at(text, s)):
            if 13 <= len(d) and d[0] in "23456" and luhn(d):
                return "card", s, end
    return None


def _groups_at(text: str, s: int) -> list[tuple[int, str]]:
    """(end, digits up to it) of the groups of digits from a position on, up to the 19 digits of the longest card number; a group that runs on
    into something else, and those that hyphens tie to it, don't count."""
    out, digits, fine = [], "", 0
    while m := _GROUP.match(text, s):
        digits += m.group()
        if len(digits) > 19:
            return out
        e = m.end()
        out.append((e, digits))
        after = text[e : e + 2]
        if not after or not (after[0].isalnum() or after[0] == "_" or after[0] in ".-" and after[1:].isdigit()):
            fine = len(out)
        if not (after[:1] in (" ", "-") and after[1:].isascii() and after[1:].isdigit()):
            break
        s = e + 1
    return out[:fine]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, in order and without overlaps; at equal starts the longest counts."""
    out = []
    done = bare = -1
    for end, (kind, n) in _automaton().iter(lower(text)):
        i = end - n + 1
        if kind == "#":
            if i <= done or (i and text[i - 1].isdigit()):
                continue
            if f := _digits_at(text, i, i - done <= 2):
                out.append(f)
                done = f[2] - 1
        elif kind == "@":
            if f := email_at(text, i):
                out.append(("email", *f))
                done = max(done, f[1] - 1)
        elif kind == ":":
            if i > done and i + 1 < len(text) and text[i + 1] in _HEX and (text[i + 1] == ":" or i and text[i - 1] in _HEX) and (f := ipv6_at(text, i)):
                out.append(("ip", *f))
                done = max(done, f[1] - 1)
        elif kind == "t":
            if (i == 0 or not text[i - 1].isalnum()) and (m := _CUED_PHONE.match(text, end + 1)):
                out.append(("phone", m.start(1), m.end(1)))
        elif kind == "s":
            if m := _USER.match(text, end + 1):
                out.append(("url_user", m.start(), m.end() - 1))
        elif text[i].lower() == "s" and (i == 0 or not text[i - 1].isalnum()) and (m := _CUED_SSN.match(text, end + 1)):
            out.append(("ssn", m.start(1), m.end(1)))
        elif end + 10 >= bare and (i == 0 or not text[i - 1].isalnum()) and (m := _IDENT.match(text, end + 1)):
            if sum(c.isdigit() for c in m.group(1)) >= 4:
                out.append(("identifier", m.start(1), m.end(1)))
            else:
                bare = m.end()  # cues well within a run of too few digits have no more
    out.sort(key=lambda f: (f[1], -f[2], f[0] == "identifier"))
    kept: list[tuple[str, int, int]] = []
    for f in out:
        if not kept or f[1] >= kept[-1][2]:
            kept.append(f)
    return kept


def mask_text(text: str) -> str:
    found = find(text)
    if not found:
        return text
    parts, at = [], 0
    for kind, s, e in found:
        parts += [text[at:s], MASKS[kind]]
        at = e
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value) of everything found, positions in characters from 0.

    Null and empty texts give no rows; a null id is kept; repeated rows each give their rows. Other columns are ignored.
    Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "_text"):
            ids = b.column("_id").to_pylist()
            hits = [(i, k, s, e, t[s:e]) for i, t in zip(ids, texts) for k, s, e in find(t)]
            cols = list(zip(*hits)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "kind", "start", "end", "value"])

    return spread(d).mapInArrow(rows, "doc_id bigint, kind string, start bigint, end bigint, value string")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with what scan finds replaced by its kind, all rows and columns kept; null texts stay null."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, text_col):
            null = b.column(at).is_null().to_pylist()
            new = pa.array([None if z else mask_text(t) for z, t in zip(null, texts)], b.column(at).type)
            yield b.set_column(at, b.schema.field(at).name, new)

    return spread(docs).mapInArrow(rows, docs.schema)
