"""Hash choices, the AES pseudo-random function, string grids and exclusive-or helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


def _unsigned(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def token_choice(term: Column, i: Column) -> Column:
    """First eight bytes, as an unsigned number, of SHA-256 over the term's UTF-8 bytes and i as four big-endian bytes."""
    tail = F.unhex(F.lpad(F.hex(i.cast("bigint")), 8, "0"))
    return _unsigned(F.substring(F.sha2(F.concat(F.encode(term, "UTF-8"), tail), 256), 1, 16))


def bin_of(term: Column, i: Column, bins: int) -> Column:
    return F.pmod(token_choice(term, i), F.lit(bins).cast("decimal(20,0)")).cast("bigint")


def unit_interval(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the first 52 bits of SHA-256 over the parts joined with '|'."""
    h = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def prf(key: Column, tag: Column, x: Column) -> Column:
    """Low 64 bits, little-endian, of AES-128(key, block) xor block, with the block (tag << 35) + x as 16 little-endian bytes."""
    number = F.shiftleft(tag.cast("bigint"), 35) + x.cast("bigint")
    big = F.lpad(F.hex(number), 16, "0")
    little = F.concat(*(F.substring(big, 15 - 2 * k, 2) for k in range(8)))
    block = F.unhex(F.concat(little, F.lit("0" * 16)))
    out = F.hex(F.substring(F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS")), 1, 8))
    swapped = F.concat(*(F.substring(out, 15 - 2 * k, 2) for k in range(8)))
    return F.conv(swapped, 16, -10).cast("bigint").bitwiseXOR(number)


def xor_words(a: Column, b: Column) -> Column:
    """Exclusive or of the common prefix of two word arrays; the longer one's rest stays as it is."""
    short = F.least(F.size(a), F.size(b))
    longer = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    head = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x.bitwiseXOR(y))
    return F.concat(head, F.when(F.size(longer) > short, F.slice(longer, short + 1, F.size(longer))).otherwise(F.slice(longer, F.lit(1), F.lit(0))))


@pandas_udf(LongType())
def fnv1a(x: pd.Series) -> pd.Series:
    """64-bit FNV-1a over the eight little-endian bytes of a number, as a signed long."""

    def one(v):
        h = 0xCBF29CE484222325
        for b in (int(v) % 2**64).to_bytes(8, "little"):
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    return x.map(one)


def grid_width(longest: int) -> int:
    """Words of a row of the string grid: length word and bytes, in multiples of four."""
    return -(-(1 + -(-longest // 8)) // 4) * 4


def to_grid(s: Column, width: int) -> Column:
    """A string as [length in bytes, big-endian packed bytes, zero padding] of width words."""
    raw = F.rpad(F.hex(F.encode(s, "UTF-8")), (width - 1) * 16, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(width - 2)), lambda i: F.conv(F.substr(raw, i * 16 + F.lit(1), F.lit(16)), 16, -10).cast("bigint"))
    return F.concat(F.array(F.octet_length(s).cast("bigint")), words)


def whole_grid(s: Column) -> Column:
    """to_grid with each text's own width (grid_width of its bytes), so that nothing is cut off."""
    width = F.ceil((F.ceil(F.octet_length(s) / 8) + 1) / 4).cast("int") * 4
    raw = F.rpad(F.hex(F.encode(s, "UTF-8")), (width - 1) * 16, F.lit("0"))
    words = F.transform(F.regexp_extract_all(raw, F.lit("[0-9A-F]{16}"), F.lit(0)), lambda h: F.conv(h, 16, -10).cast("bigint"))
    return F.concat(F.array(F.octet_length(s).cast("bigint")), words)


def from_grid(words: Column) -> Column:
    body = F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words) - 1), lambda w: F.lpad(F.hex(w), 16, "0")), "")
    return F.decode(F.unhex(F.substr(body, F.lit(1), words[0].cast("int") * 2)), "UTF-8")
