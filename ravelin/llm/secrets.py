"""Secret scan by assignment-aware lexing.

Assignment operators are found in the text and the syntax around each is parsed: the name before it, and behind it
literals, names, decoding calls and their concatenations. XML elements, `export NAME value` commands and private keys that
stand by themselves are pairs too. Literals of names assigned before are propagated into later expressions, until the name
gets a value that isn't known; a name is one constant all over a text, scopes are not told apart. Every name-literal pair
is scored by how sensitive the name is and how random the literal looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import slices
from ravelin.runtime import prepare, spread

THRESHOLD = 0.6
_OPERATOR = re.compile(r"[=:]")
#: What ends before an operator, read backwards from it: a mark, an argument list, a bracket, a quote, and the name. Every pattern here is
#: linear in what it reads, whatever the text.
_NAME_BACK = re.compile(r"[:+?|]?\s*(?:\)[^()\n]*\(\s*)?\]?[\"'`]?((?:[\w$@.-]|[\"']\[)+)")
#: Triple-quoted and backticked literals run over lines, other quotes only around a PEM block.
_STRING = re.compile(r"[rbfuRBFU]{0,2}(?:(?P<q>\"\"\"|''')(?P<a>(?:\\[\s\S]|(?!(?P=q))[^\\])*)(?P=q)|(?P<p>[\"'])(?P<b>-----BEGIN [A-Z0-9 ]+-----[^\"'`]*?-----END [A-Z0-9 ]+-----\s*)(?P=p)|(?P<t>`)(?P<c>(?:\\[\s\S]|[^\\`])*)`|(?P<s>[\"'])(?P<d>(?:\\.|(?!(?P=s))[^\\\n])*)(?P=s))")
_BLOCK = re.compile(r"[|>][0-9+-]{0,2}[ \t]*(?:#[^\n]*)?\n")
_VARIABLE = re.compile(r"\$(?:\{([A-Za-z_]\w*)(?::?-[^}]*)?\}|\(([A-Za-z_]\w*)\)|([A-Za-z_]\w*))")
_BARE_VARIABLE = re.compile(r"(?:\$\{[^}\s]*\}|\$\(\w+\)|[^\s\"'`,;#(){}\[\]<>])+")
_PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PROSE = re.compile(r"(?i)[.!?:]\s*$|\b(?:the|an?|your|you|please|is|are|was|be|to|of|for|in|on|with|and|or|not|must|this|that|it|enter|der|die|das|und|el|la|los|le|les|et|de)\b")
_BARE = re.compile(r"[^\s\"'`,;#(){}\[\]<>]+")
_IDENT = re.compile(r"[A-Za-z_$][\w$.]*")
_JOIN = re.compile(r"\s*(?:\+|\.\.|\.(?=\s*[\"'$])|&|~)\s*|[ \t]+(?=[\"'])")
_TYPE = re.compile(r"\s*[A-Za-z_][\w<>\[\].|?]*\s*=(?!=)")
_TYPED_BACK = re.compile(r"[\w<>\[\].|?]*[A-Za-z_]\s*:\s*([\w$]+)")
#: A call, those that only rewrite their literal, a reference to something that the text doesn't hold, elements, commands and keys.
_CALL = re.compile(r"[A-Za-z_][\w.]*\(\s*")
_DECODE = re.compile(r"(?:decode|bytes|str|b64|unhex|fromhex|encode|quote)\w*\(\s*$", re.I)
_CODE = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)([(\[]|(?![\w@:/+=-]))")
_OTHER = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>|^[ \t]*(?:ENV|ARG|export|setenv|set)[ \t]+([A-Za-z_]\w*)[ \t]+([^\s=]\S*)[ \t]*$|(-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN)[^\"'`<])*?-----END [A-Z0-9 ]+-----)", re.M)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Parts of names and how sensitive they are.
NAMES = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0,
         "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "signature": 0.6, "salt": 0.5, "webhook": 0.6, "dsn": 0.6, "cookie": 0.5, "session": 0.4}
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|null|none|true|false|changeme|example.*|your[-_ ].*|test|todo|password|secret|token|placeholder|dummy|sample.*)$")


def name_score(name: str) -> float:
    """Sensitivity of a name by its parts (camelCase, snake_case, dotted); independent parts add up to 1 at most."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    found = {p: NAMES.get(p) or NAMES.get(p.removesuffix("s"), 0.0) for p in parts}
    return min(1.0, sum(found.values()))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def literal_score(s: str, sensitive: bool = False) -> float:
    """How much a literal looks like a secret: length and entropy by its alphabet; 1 for a private key, 0 for placeholders and prose. Several words are prose unless they are given to a sensitive name and hold no function word."""
    if _PRIVATE_KEY.search(s):
        return 1.0
    if not s or PLACEHOLDERS.match(s) or s.count(" ") > 2 and (not sensitive or "\n" in s or _PROSE.search(s)):
        return 0.0
    most = math.log2(min(max(len(s), 8), 16 if re.fullmatch(r"[0-9a-fA-F-]+", s) else 64))
    mixed = (any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s) + any(not c.isalnum() for c in s)) / 4
    return min(1.0, 0.5 * min(1.0, entropy(s) / most) + 0.3 * min(1.0, len(s) / 20) + 0.4 * mixed)


def _path(s: str) -> bool:
    """Whether dotted words are a path through code rather than a token: none is long or mixes digits with both cases."""
    parts = re.split(r"\.|->|::", s)
    return len(parts) > 1 and not any(len(x) > 24 or re.search(r"\d", x) and re.search("[a-z]", x) and re.search("[A-Z]", x) for x in parts)


def _expand(s: str, known: dict[str, str]) -> tuple[str, bool]:
    """s with $NAME, ${NAME} and $(NAME) of known names replaced, and whether there were any."""
    if "$" not in s:
        return s, False
    find = lambda m: next((known[k] for n in m.groups() if n for k in (n, f"${n}") if k in known), m.group())
    out = _VARIABLE.sub(find, s)
    return out, out != s


def _block(text: str, at: int, indent: int) -> tuple[str, int, int, bool] | None:
    """A YAML block literal: the lines behind its mark that are indented more than its name."""
    m = _BLOCK.match(text, at)
    if not m:
        return None
    lines, pos = [], m.end()
    while pos < len(text):
        stop = text.find("\n", pos)
        line = text[pos : stop if stop >= 0 else len(text)]
        if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
            break
        lines.append(line.strip())
        pos += len(line) + 1
    return "\n".join(lines).strip(), at, min(pos, len(text)), False


def _value(text: str, at: int, known: dict[str, str]) -> tuple[str, int, int, bool] | None:
    """(literal, start, end, propagated) of the expression at a position: strings and known names joined by concatenation, or one bare word."""
    parts, start, end, via = [], at, at, False
    pos = at
    if (call := _CALL.match(text, at)) and _DECODE.search(call.group()[-40:]) and (inner := _STRING.match(text, call.end())) and text[inner.end() : inner.end() + 1] in ("", ")", ","):
        start = pos = call.end()
    while True:
        if m := _STRING.match(text, pos):
            literal = next(x for x in m.group("a", "b", "c", "d") if x is not None)
            literal, expanded = (literal, False) if "'" in (m["q"], m["p"], m["s"]) else _expand(literal, known)
            parts.append(literal)
            via |= expanded
        elif (m := _IDENT.match(text, pos)) and m.group() in known:
            parts.append(known[m.group()])
            via = True
        else:
            break
        end = m.end()
        j = _JOIN.match(text, end)
        if not j:
            break
        pos = j.end()
    if parts:
        return "".join(parts), start, end, via
    if (m := _BARE_VARIABLE.match(text, at)) and (found := _expand(m.group(), known))[1]:
        return found[0], m.start(), m.end(), True
    if (m := _CODE.match(text, at)) and (m[2] or _path(m[1])):
        return None
    if m := _BARE.match(text, at):
        return m.group().rstrip(".,:"), m.start(), m.start() + len(m.group().rstrip(".,:")), False
    return None


def _left(text: str, i: int) -> tuple[str, str]:
    """What stands before an operator in its line, or as much of it as holds the whole name, and the name."""
    line = text.rfind("\n", 0, i) + 1
    reach = 64
    while True:
        at = max(line, i - reach)
        left = text[at:i].rstrip()
        m = _NAME_BACK.match(left[::-1])
        typed = _TYPED_BACK.match(left[::-1])
        whole = m.end() < len(left) and not (typed and typed.end() == len(left)) if m else not left.endswith((")", "]"))
        if at == line or whole:
            return left, m[1][::-1].lstrip("0123456789.-") if m else ""
        reach *= 4


def assignments(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, propagated) of every assignment, in order; start and end enclose the expression."""
    known: dict[str, str] = {}
    done = -1
    for op in _OPERATOR.finditer(text):
        i = op.start()
        if i < done or text[i + 1 : i + 2] == "=" or text[i - 1 : i] in ("=", "!", "<", ">") and i or text.startswith("://", i):
            continue
        left, name = _left(text, i)
        if not name or text[i] == ":" and _TYPE.match(text, i + 1):
            continue
        if text[i] == "=" and (typed := _TYPED_BACK.match(left[::-1])):
            name = typed[1][::-1].lstrip("0123456789")
        at = i + 1
        while at < len(text) and (text[at] in " \t" or at == i + 1 and text[at] in "=>"):
            at += 1
        v = None
        if text[i] == ":" and text[at : at + 1] in ("|", ">"):
            row = text[text.rfind("\n", 0, i) + 1 : i]
            v = _block(text, at, len(row) - len(row.lstrip(" ")))
        v = v or _value(text, at, known)
        target = re.split(r"[\[\"']+", name)[-1]
        if v is None:
            known.pop(target, None)
            continue
        quoted = text[v[1] : v[1] + 1] in "\"'`" or text[v[1] : v[1] + 1].isalpha() and text[v[1] + 1 : v[1] + 2] in ("\"", "'")
        known[target] = v[0]
        # what runs over lines may hold assignments itself
        if (quoted or v[3]) and "\n" not in text[v[1] : v[2]]:
            done = v[2]
        yield target, *v


def others(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """Pairs without an operator: XML elements, commands that set a variable, and private keys, named private_key."""
    for m in _OTHER.finditer(text):
        k = 2 if m[1] else 4 if m[3] else 5
        literal = m[k].strip()
        start = m.start(k) + m[k].find(literal)
        yield (m[1] or m[3] or "private_key").rpartition(":")[2], literal, start, start + len(literal), False


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, str, int, int, bool, float]]:
    """(name, literal, start, end, propagated, score) of likely secrets in order; what an assignment reports isn't reported again."""

    def likely(pairs: Iterator[tuple]) -> list[tuple]:
        out = []
        for name, literal, s, e, via in pairs:
            n = name_score(name)
            if (n := max(n, float(bool(_PRIVATE_KEY.search(literal))))) and (score := n * literal_score(literal, n >= 0.9)) >= threshold * (0.8 if n >= 0.9 else 1.0):
                out.append((name, literal, s, e, via, round(score, 4)))
        return out

    out = likely(assignments(text))
    return sorted(out + [x for x in likely(others(text)) if not any(s < x[3] and x[2] < e for _, _, s, e, _, _ in out)], key=lambda x: x[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, name, literal_sha256, length, start, end, propagated, score) of every likely secret.

    Literals are reported by digest only. Null and empty texts give no rows; a null id is kept; repeated rows and
    repeated assignments each give their rows. Other columns are ignored, whatever their names. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(r"[=:]|</|-----BEGIN|(?:ENV|ARG|export|setenv|set)[ \t]"))
    names = ["doc_id", "name", "literal_sha256", "length", "start", "end", "propagated", "score"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "_text"):
            hits = [
                (i, n, hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), len(v), s, e, via, score)
                for i, t in zip(b.column("_id").to_pylist(), texts)
                for n, v, s, e, via, score in find(t, threshold)
            ]
            cols = list(zip(*hits)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return spread(d).mapInArrow(rows, "doc_id bigint, name string, literal_sha256 string, length bigint, start bigint, end bigint, propagated boolean, score double")
