"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Everything is built-in JVM expressions on one narrow scan: no shuffle and no Python.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.runtime import spread

CRLF = "\r\n"
#: (pattern, replacement), applied in order; the patterns mean the same to Java's engine and to RE2. What is never shown goes with its
#: content, each element up to its own closing tag or, if it is never closed, the end; other tags go and their text stays.
TEXT_STEPS = [
    (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<title\b.*?(?:</title\s*>|\z)|<template\b.*?(?:</template\s*>|\z)", " "),
    (r"(?i)</?(?:p|div|article|section|main|header|footer|nav|aside|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|blockquote|pre|form|br|hr)\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
]
#: Names of characters as HTML 4 has them, and what the numbers 128 to 159 mean in HTML.
ENTITIES = {**html.entities.entitydefs, "apos": "'"}
CP1252 = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
SPACE_STEPS = [(r"[ \t\r]+", " "), (r" ?\n[ \n]*", "\n")]
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(value: Column) -> Column:
    """'sha1:' and the base-32 digest, as WARC digest headers write it: 40 bits at a time in base 32, its digits renamed."""
    digest = F.sha1(value)
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, g * 10 + 1, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32) for g in range(4)]
    return F.concat(F.lit("sha1:"), *parts)


def uuid_urn(seed: Column) -> Column:
    """A record id that depends on the seed alone, so that a recomputed task names its records alike."""
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _point(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    fine = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def unescape(text: Column) -> Column:
    """Text with named, decimal and hexadecimal character references replaced; those without a semicolon or of an unknown name stay."""
    names = F.create_map(*(F.lit(x) for item in ENTITIES.items() for x in item))
    odd = F.create_map(*(F.lit(x) for item in CP1252.items() for x in item))

    def named(p: Column) -> Column:
        return F.struct(p.alias("p"), F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});", 1).alias("name"))

    def numbered(x: Column) -> Column:
        name = x["name"]
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        return F.struct(x["p"].alias("p"), name.alias("name"), F.when(F.startswith(name, F.lit("#")), digits.cast("int")).alias("number"))

    def piece(x: Column) -> Column:
        char = F.when(x["number"].isNotNull(), F.coalesce(F.try_element_at(odd, x["number"]), _point(x["number"]))).when(x["name"] != "", F.try_element_at(names, x["name"]))
        return F.coalesce(F.concat(char, F.substr(x["p"], F.length(x["name"]) + F.lit(2))), F.concat(F.lit("&"), x["p"]))

    # an array of one holds what is used several times, so that it is computed once
    def pieces(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.lit(1), F.lit(0)))
        return F.concat(parts[0], F.array_join(F.transform(F.transform(F.transform(rest, named), numbered), piece), ""))

    whole = lambda t: F.when(F.instr(t, "&") > 0, F.transform(F.array(F.split(t, "&")), pieces)[0]).otherwise(t)
    return F.transform(F.array(text), whole)[0]


def plain_text(html: Column) -> Column:
    """Visible text: script, style, title, template and comments go, blocks end lines, character references are decoded. Navigation,
    footers and what is shown without scripts stay. A tag ends at its first '>', in a quoted attribute too."""
    out = html
    for pattern, to in TEXT_STEPS:
        out = F.regexp_replace(out, pattern, to)
    out = unescape(out)
    for pattern, to in SPACE_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"^\n+|\n+$", ""))


def responses(pages: DataFrame) -> DataFrame:
    """Response records (record_id, target_uri, warc_date, http_header, payload) of a table (page_id, url, html)."""
    # ponytail: the pages table keeps no capture date or HTTP header; a fixed date and a minimal header stand in.
    length = F.octet_length("html").cast("string")
    return pages.select(
        uuid_urn(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.col("url"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF)).alias("http_header"),
        F.col("html").alias("payload"),
    )


def _line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", " ")


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for every response: 'metadata' (warc-fields) and 'conversion' (text/plain).

    Output: record_id, warc_type, refers_to (the response's record_id), target_uri, warc_date, content_type,
    source_header (the response's HTTP header, unchanged), source_digest (of its payload), block_digest,
    content_length (bytes of block), block. A null payload yields a metadata record alone, with null source_digest;
    an empty payload yields an empty conversion. Null target, date or header are kept as null and left out of the
    metadata block, whose values have line ends turned into spaces. Repeated responses yield repeated records. Other
    columns of records are ignored, whatever their names.
    """
    r = spread(records.select("record_id", "target_uri", "warc_date", "http_header", "payload")).withColumn("_digest", base32_sha1(F.col("payload")))
    title = F.trim(F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    lang = F.regexp_extract("payload", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    status = F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNull() | (value == ""), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), _line(value), F.lit(CRLF)))

    meta = F.concat(
        field("via", F.col("target_uri")), field("httpStatus", status), field("title", title), field("language", lang),
        field("sourceDigest", F.col("_digest")), field("sourceLength", F.octet_length("payload").cast("string")),
    )
    meta_row = F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block"))
    text_row = F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block"))
    both = r.select("*", F.explode(F.array(meta_row, text_row)).alias("_d")).where("_d.block is not null")
    return both.select(
        uuid_urn(F.concat_ws("|", F.col("_d.warc_type"), F.col("record_id"))).alias("record_id"),
        F.col("_d.warc_type").alias("warc_type"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("_d.content_type").alias("content_type"),
        F.col("http_header").alias("source_header"),
        F.col("_digest").alias("source_digest"),
        base32_sha1(F.col("_d.block")).alias("block_digest"),
        F.octet_length("_d.block").cast("bigint").alias("content_length"),
        F.col("_d.block").alias("block"),
    )


def to_warc_text(derived: DataFrame) -> DataFrame:
    """Column `record`: each derivative serialised as a WARC/1.1 record, ready for a text or binary sink.

    The source's digest and the lines of its header go along as WARC-Source-Digest and WARC-Source-Header; no value can
    begin a line of its own. Null fields are left out, a null block counts as empty.
    """
    h = lambda name, c: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), _line(c), F.lit(CRLF)))
    lines = F.filter(F.split(F.coalesce("source_header", F.lit("")), r"\r\n|\r|\n"), lambda x: x != "")
    source = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit(CRLF))), "")
    return derived.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"), h("WARC-Type", F.col("warc_type")), h("WARC-Record-ID", F.col("record_id")), h("WARC-Refers-To", F.col("refers_to")),
            h("WARC-Target-URI", F.col("target_uri")), h("WARC-Date", F.col("warc_date")), h("WARC-Block-Digest", F.col("block_digest")),
            h("WARC-Source-Digest", F.col("source_digest")), source,
            h("Content-Type", F.col("content_type")), F.lit("Content-Length: "), F.octet_length(F.coalesce("block", F.lit(""))).cast("string"), F.lit(CRLF * 2), F.coalesce("block", F.lit("")), F.lit(CRLF * 2),
        ).alias("record")
    )
