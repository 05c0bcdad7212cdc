"""URL filter: rules are indexed by their rarest literal token, and a URL tests only candidates.

A rule is a host with its subdomains and a path prefix (``example.com/en/``), or
any regular expression over ``host + path`` that names the literal tokens each
match must contain. The regular expression of a rule runs on a URL only if the
URL has the rule's token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
#: Most bytes of rule text that one broadcast block holds; larger rule sets go in blocks.
BLOCK_BYTES = 16 << 20
SCHEMA = "page_id long, host string, path string, rule string, weight int, verdict string, tested int"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def prefix_rule(host: str, path: str, action: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; longer rules weigh more."""
    inner = [t.group() for t in TOKEN.finditer(path) if path[t.end() : t.end() + 1] and path[t.start() - 1 : t.start()]]
    end = re.escape(path) if path else "(?:/|$)"
    return Rule(host + path, action, rf"(?:[^/?#]*\.)?{re.escape(host)}{end}", (*TOKEN.findall(host), *(t for t in inner if t == t.lower())), len(host) + len(path))


def pattern_rule(name: str, action: str, pattern: str, tokens: tuple[str, ...] = ()) -> Rule:
    """A rule of the method; ``tokens``: whole tokens that every match contains."""
    return Rule(name, action, pattern, tokens, -1)


#: The rules of the query, then the method's own blocks.
RULES = [
    prefix_rule("com", "/", "allow"),
    prefix_rule("example.com", "/en/", "block"),
    prefix_rule("www.example.com", "/en/", "allow"),
    prefix_rule("net", "/es/", "block"),
    prefix_rule("net", "/fr/", "block"),
]
METHOD = [
    pattern_rule("spam-farm", "block", r"(?:[^/?#]*[.-])?spam-farm[.-].*", ("spam", "farm")),
    pattern_rule("cheap-pills", "block", r"(?:[^/?#]*[.-])?cheap-pills[.-].*", ("cheap", "pills")),
    pattern_rule("casino", "block", r"(?:[^/?#]*[.-])?casino[.-].*", ("casino",)),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(pages: DataFrame, rules: list[Rule], *, url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token of a rule; the answer has at most one entry for each such token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    asked = pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    tokens = F.array_distinct(F.split(F.lower(F.concat(host_of(F.col(url_col)), path_of(F.col(url_col)))), r"[^0-9a-z\x{80}-\x{10ffff}]+"))
    met = pages.select(F.explode(tokens).alias("t"))
    small = sum(map(len, wanted)) <= BLOCK_BYTES
    return {r[0]: r[1] for r in met.join(F.broadcast(asked) if small else asked, "t").groupBy("t").count().collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token to rules, each under its rarest token; rules without a token are always candidates."""
    index: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def blocks_of(rules: list[Rule], most: int = BLOCK_BYTES) -> list[list[Rule]]:
    out, size = [[]], 0
    for r in rules:
        size += len(r.name) + len(r.pattern) + sum(map(len, r.tokens))
        if size > most and out[-1]:
            out.append([])
            size = 0
        out[-1].append(r)
    return out


def filter_urls(pages: DataFrame, *, rules: list[Rule] | None = None, method: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, tested (regular expressions run).

    The heaviest fitting rule of ``rules`` decides (ties: the smaller name);
    without one the method's patterns block or the page is allowed. Rules are
    broadcast in blocks of at most ``block_bytes``; each further block is one
    more pass over host and path, without a shuffle. Null URLs and those without ``://`` have empty host and path and
    are allowed; repeated rows are each judged; an empty table gives no rows; a
    null id stays null; other columns are not read.
    """
    rules, method = RULES if rules is None else rules, METHOD if method is None else method
    counts = token_counts(pages, rules + method, url_col=url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("weight"), F.lit("").alias("verdict"), F.lit(0).alias("tested"))
    for block in blocks_of(rules + method, block_bytes):
        index, always = index_rules(block, counts)
        shared = pages.sparkSession.sparkContext.broadcast((block, index, always))
        rows = rows.mapInArrow(_matcher(shared), SCHEMA)
    return rows.drop("weight").withColumn("verdict", F.when(F.col("verdict") == "", "allow").otherwise(F.col("verdict")))


def _matcher(shared):
    """``shared``: a broadcast of a block of rules, their index and those without a token. A rule found in a block before has its weight with it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, always = shared.value
        ready: dict[int, re.Pattern] = {}
        for batch in batches:
            _, hosts, paths, found, weights, verdicts, tested = (c.to_pylist() for c in batch.columns)
            for i, (host, path) in enumerate(zip(hosts, paths)):
                key = host + path
                tokens = set(TOKEN.findall(key.lower()))
                candidates = {r for t in tokens if t in index for r in index[t]}.union(always)
                best = (weights[i], found[i]) if found[i] is not None else None
                for r in candidates:
                    rule = block[r]
                    tested[i] += 1
                    if r not in ready:
                        ready[r] = re.compile(rule.pattern)
                    if not ready[r].match(key):
                        continue
                    if rule.weight < 0:
                        if best is None and verdicts[i] != "block":
                            verdicts[i] = rule.action
                    elif best is None or (-rule.weight, rule.name) < (-best[0], best[1]):
                        best = (rule.weight, rule.name)
                        found[i], weights[i], verdicts[i] = rule.name, rule.weight, rule.action
            own = [pa.array(found, pa.string()), pa.array(weights, pa.int32()), pa.array(verdicts, pa.string()), pa.array(tested, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own], names=["page_id", "host", "path", "rule", "weight", "verdict", "tested"])

    return task
