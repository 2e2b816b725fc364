"""URL filtering by hashed host-suffix and path-prefix expressions.

A URL is brought into a canonical form and expanded into every (host suffix, path prefix) expression. Expressions meet
the rules in an equi-join on the first bytes of their SHA-256 alone, the full digest then confirms, and the most specific
confirmed rule decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.runtime import fresh, spread

#: Hex digits of a digest that expressions and rules are joined on.
PREFIX_HEX = 8

#: (rule_id, pattern, action, priority); a pattern is host suffix + path prefix.
DEFAULT_RULES = [
    (1, "spam-farm.example.org/", "block", 0),
    (2, "cheap-pills.example.com/", "block", 0),
    (3, "cheap-pills.example.com/en/", "allow", 0),
    (4, "www.cheap-pills.example.com/en/", "block", 0),
    (5, "tionsh.example.net/de/", "block", 0),
    (6, "blog.tionsh.example.net/", "allow", 0),
    (7, "ththre.example.com/fr/825?page=2&ref=x", "block", 5),
    (8, "ththre.example.com/fr/825", "allow", 0),
    (9, "tionble.example.com/es/", "block", 1),
    (10, "tionble.example.com/es/", "allow", 1),
    (11, "m.ththth.example.net/en/25", "block", 0),
    (12, "example.invalid/", "block", 0),
]
RULE_SCHEMA = "rule_id bigint, pattern string, action string, priority int"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULE_SCHEMA)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _unreserved(text: Column) -> Column:
    """Escapes of letters, digits, '-', '.', '_' and '~' decoded once, those of other bytes in upper case."""

    def piece(p: Column) -> Column:
        def decoded(code: Column) -> Column:
            plain = code.rlike("^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)$")
            rest = F.substr(p, F.lit(3))
            return F.when(plain, F.concat(F.decode(F.unhex(code), "UTF-8"), rest)).when(code != "", F.concat(F.lit("%"), code, rest)).otherwise(F.concat(F.lit("%"), p))

        return _let(F.upper(F.regexp_extract(p, "^([0-9A-Fa-f]{2})", 1)), decoded)

    pieces = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.lit(1), F.lit(0))), piece), ""))
    return _let(text, lambda t: F.when(F.instr(t, "%") > 0, _let(F.split(t, "%"), pieces)).otherwise(t))


def _host(authority: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    return F.lower(F.regexp_replace(_unreserved(host), "^[.]+|[.]+$", ""))


def _path(raw: Column) -> Column:
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.lit("/"), x))
    flat = lambda s: F.concat(F.aggregate(F.split(s, "/"), F.lit(""), step), F.when(s.rlike(r"(^|/)\.{0,2}$"), F.lit("/")).otherwise(F.lit("")))
    return _let(_let(_unreserved(F.translate(raw, "\\", "/")), flat), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _parts(url: Column) -> Column:
    """host, path and query (with its '?') of a URL: no scheme, user, port, fragment or line ends; host in lower case without outer dots; escapes of
    unreserved characters decoded; the path with '/' for backslashes, no empty, '.' or '..' folders."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\r\n]", ""), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}", "")

    def split(b: Column) -> Column:
        def rest(authority: Column) -> Column:
            def named(tail: Column) -> Column:
                return _let(F.regexp_extract(tail, "^([^?]*)", 1), lambda raw: F.struct(_host(authority).alias("host"), _path(raw).alias("path"), _unreserved(F.substr(tail, F.length(raw) + F.lit(1))).alias("query")))

            return _let(F.substr(b, F.length(authority) + F.lit(1)), named)

        return _let(F.regexp_extract(b, r"^([^/\\?]*)", 1), rest)

    return _let(bare, split)


def expressions(url: Column) -> Column:
    """Array of all distinct expressions of a URL: every host suffix of two labels or more (an IPv4 host or a single
    label only whole) by every leading directory, the exact path, and the path with its query."""

    def suffixes(host: Column) -> Column:
        every = lambda labels: F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.when(host.rlike("^[0-9.]+$") | (F.instr(host, ".") == 0), F.array(host)).otherwise(_let(F.split(host, "[.]"), every))

    def prefixes(path: Column, query: Column) -> Column:
        folders = lambda pieces: F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.lit("/")))
        return F.array_distinct(F.concat(_let(F.split(path, "/"), folders), F.array(path), F.when(F.length(query) > 1, F.array(F.concat(path, query))).otherwise(F.array().cast("array<string>"))))

    def crossed(x: Column) -> Column:
        return _let(prefixes(x["path"], x["query"]), lambda paths: F.array_distinct(F.flatten(F.transform(suffixes(x["host"]), lambda h: F.transform(paths, lambda p: F.concat(h, p))))))

    return _let(_parts(url), crossed)


def url_filter(urls: DataFrame, rules: DataFrame, url_col: str = "url", prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """Decision for every distinct URL: (url, decision, rule_id, pattern).

    Precedence: longest host suffix, then longest path prefix, then higher priority, then allow before block, then
    the lower rule_id. A null or empty URL, and one that no rule covers, has decision 'none' with null rule columns.
    Rules with a null pattern or action never match; repeated rules decide once. Patterns are taken as they stand, in the
    form that canonical URLs have; host names beyond ASCII are compared as written. Other columns of urls are ignored, so
    their names cannot clash. URLs are expanded where they are read; only expressions whose hash prefix some rule has and
    one row a URL are moved. The rules are joined without a hint: Spark broadcasts them only below its own threshold.
    """
    u = urls.select(F.col(url_col).alias("url"))
    r = rules.where("pattern is not null and action is not null").select("rule_id", "pattern", "action", "priority").distinct()
    r = r.withColumn("_digest", F.unhex(F.sha2("pattern", 256))).withColumn("_short", F.substring(F.hex("_digest"), 1, prefix_hex))
    e = spread(u.where(F.col("url").isNotNull())).select("url", F.explode(expressions(F.col("url"))).alias("_e"))
    e = e.select("url", F.unhex(F.sha2("_e", 256)).alias("_full")).withColumn("_key", F.substring(F.hex("_full"), 1, prefix_hex))
    # a plain equality of digests would become part of the join's key and the prefix would be for nothing
    hit = e.join(r, F.col("_key") == F.col("_short")).where(F.startswith("_full", "_digest"))
    host_len = F.length(F.regexp_extract("pattern", "^([^/]*)", 1))
    rank = F.struct(host_len, F.length("pattern"), F.coalesce("priority", F.lit(0)), (F.col("action") == "allow").cast("int"), -F.col("rule_id"))
    hit = hit.select("url", F.struct("action", "rule_id", "pattern").alias("_rule"), rank.alias("_rank"))
    every = u.select("url", *(F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in ("_rule", "_rank")))
    best = every.union(hit).groupBy("url").agg(F.max_by("_rule", "_rank").alias("_b"))
    return best.select("url", F.coalesce("_b.action", F.lit("none")).alias("decision"), F.col("_b.rule_id").alias("rule_id"), F.col("_b.pattern").alias("pattern"))


def filter_pages(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows of pages whose URL is not blocked, all columns kept, whatever their names; null URLs stay, repeated rows stay repeated."""
    name = fresh("_blocked", pages)
    bad = url_filter(pages, rules, url_col).where("decision = 'block'").select(F.col("url").alias(name))
    return pages.join(bad, pages[url_col] == F.col(name), "left_anti")
