"""How much the sources of a language differ in their words, in whole numbers, and which words set a source apart.

One pass over the texts counts terms by language and source; tasks add up what they
hold before it is shuffled. The terms of a group (language and source) are then cells:
all terms with one count in the group and one in the language have one value, which is
computed once a cell. Cells are ranked by cumulative multiplicity, cells of equal value
stand together, and only those that reach the wanted ranks are expanded into terms.
Pairs of sources are compared slice by slice of the vocabulary: a task holds one slice's
counts of all sources, again as cells with multiplicities, and sends one sum a pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Least documents of a kept term, scale of the shares, ranks of the terms.
LEAST_DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Terms that a task holds before it sends them on; bytes of a text whose words are listed at once.
HELD, LISTED = 300_000, 1 << 20
#: Parts in which a group's values are ranked before what is left of them is ranked together.
SALTS = 8
#: Sources whose sums with all others one task holds; more are further blocks. Cells of a slice's table.
BLOCK, CELLS = 256, 1 << 19
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # in UTF-8: letters a to z and all that is not ASCII


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a language and source, added up over the rows of a task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for lo in range(0, len(terms), 50_000):
                cut = terms[lo : lo + 50_000]
                keys = [pa.array([k] * len(cut), pa.string()) for k in (lang, source)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(cut, pa.binary()).cast(pa.string()), pa.array([n[t] for t in cut], pa.int64()), pa.array([docs[t] for t in cut], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text.lower()  # of bytes: only A-Z
            own = Counter(_TERM.findall(text) if len(text) <= LISTED else (m[0] for m in _TERM.finditer(text)))
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            for t, k in own.items():
                n[t] += k
            docs.update(own.keys())
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from sent()
            held = {}
    yield from sent()


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def kept_terms(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, total, lead: occurrences of each kept term in a group and in its language; ``lead`` marks one row a term.

    A term is kept if ``least_docs`` rows of its language have it. Null texts, languages and
    sources are empty ones; repeated rows count each time.
    """
    found = _plain(docs, text_col, lang_col, source_col).mapInArrow(_counter, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    whole = counts.select("lang", "source", "term", "n", F.sum("n").over(of_lang).alias("total"), F.sum("docs").over(of_lang).alias("in_docs"), (F.col("source") == F.min("source").over(of_lang)).alias("lead"))
    return whole.filter(F.col("in_docs") >= least_docs).drop("in_docs")


def group_facts(docs: DataFrame, kept: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every occurring group: lang, source, own (occurrences of kept terms), whole (those of the language), terms (kept ones), sources (of the language)."""
    groups = _plain(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count_if("lead").alias("leads"))
    joined = groups.join(own, ["lang", "source"], "left").na.fill(0, ["own", "leads"])
    langs = joined.groupBy("lang").agg(F.sum("own").alias("whole"), F.sum("leads").alias("terms"), F.count("*").alias("sources"))
    return joined.drop("leads").join(langs, "lang")


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) of the named columns, exact at any counts."""
    return F.expr(f"1 + ({SCALE}BD * (CAST({count} AS DECIMAL(19, 0)) + 1)) div CAST(greatest({total} + terms, 1L) AS DECIMAL(19, 0))")


def _value(p: str, q: str) -> Column:
    """floor((p - q)^2 / q): shares are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def telling_terms(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank: the terms of each group whose share there is over that in the language, by value and then in UTF-8 order.

    A group's values are ranked in SALTS parts of which the best ``ranks`` are ranked together
    (others cannot come back), and only terms of their cells are looked up.
    """
    cells = kept.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("many"))
    shares = cells.join(groups, ["lang", "source"]).withColumns({"p": share("n", "own"), "q": share("total", "whole")})
    cells = written(shares.filter("p > q").select("lang", "source", "n", "total", "many", _value("p", "q").alias("value")), "cells")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    best = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many")).withColumn("salt", F.pmod(F.hash("value"), F.lit(SALTS)))
    for own in (Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value")), down):
        best = best.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= ranks)
        before = F.sum("many").over(own.rowsBetween(Window.unboundedPreceding, -1))
        best = best.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).filter(F.col("before") < ranks)
    best = written(best.select("lang", "source", "value", "before"), "values")
    chosen = written(cells.join(best, ["lang", "source", "value"]).select("lang", "source", "n", "total", "value", "before"), "chosen")
    terms = kept.join(chosen, ["lang", "source", "n", "total"]).select("lang", "source", F.col("term").alias("item"), "value", "before")
    within = Window.partitionBy("lang", "source", "value").orderBy("item")
    ranked = terms.withColumn("k", F.row_number().over(within)).filter(F.col("k") <= ranks).withColumn("rank", (F.col("before") + F.col("k")).cast("int"))
    return ranked.filter(F.col("rank") <= ranks).select("lang", "source", "item", "value", "rank")


class _Slice:
    """Sums of values over the slices of a language's vocabulary that a task has: of the sources of one block against all."""

    def __init__(self):
        self.names: list[str] = []
        self.bare: list[int] = []  # share of a term that the source lacks
        self.own: list[bool] = []
        self.sums: np.ndarray | None = None
        self.whole = False  # the sources are known

    def head(self, rows: pd.DataFrame) -> None:
        if self.whole:
            return
        self.names += rows["source"].tolist()
        self.bare += rows["p"].tolist()
        self.own += rows["own"].tolist()

    def add(self, term: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
        """Whole terms: the number of the term, the name of the source and its share, row by row."""
        if self.sums is None:
            self.at = pd.Index(self.names)
            self.rows = np.flatnonzero(self.own)
            self.base = np.array(self.bare, np.int64)
            self.sums = np.zeros((len(self.rows), len(self.names)), np.int64)
        step = max(1, CELLS // len(self.names))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        bounds = np.r_[first, len(term)]
        column = self.at.get_indexer(source)
        for lo in range(0, len(first), step):
            hi = min(len(first), lo + step)
            a, b = bounds[lo], bounds[hi]
            table = np.tile(self.base, (hi - lo, 1))
            table[np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])), column[a:b]] = p[a:b]
            table, many = np.unique(table, axis=0, return_counts=True)
            for i, k in enumerate(self.rows):
                gap = table[:, k, None] - table
                self.sums[i] += (gap * gap // table * many[:, None]).sum(axis=0)

    def batch(self, lang: str) -> Iterator[pa.RecordBatch]:
        rows = np.flatnonzero(self.own)
        for i, k in enumerate(rows):
            others = [j for j in range(len(self.names)) if j != k]
            values = [0] * len(others) if self.sums is None else self.sums[i][others].tolist()
            columns = [[lang] * len(others), [self.names[k]] * len(others), [self.names[j] for j in others], values]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each pair of sources; rows come by language, block and slice, a slice's sources first, then term by term."""
    key, now, rest, at = None, None, None, None

    def flush(last: bool) -> None:
        nonlocal rest
        if rest is None or not len(rest):
            return
        term = rest["term"].to_numpy()
        cut = len(rest) if last else int(np.flatnonzero(np.r_[True, term[1:] != term[:-1]])[-1])  # the last term may go on
        if cut:
            done = rest.iloc[:cut]
            now.add(pd.factorize(done["term"])[0], done["source"].to_numpy(), done["p"].to_numpy(np.int64))
        rest = rest.iloc[cut:]

    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        lang, block, part = (rows[c].to_numpy() for c in ("lang", "block", "part"))
        edges = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
        for a, b in zip(edges, np.r_[edges[1:], len(rows)]):
            if ((lang[a], block[a]), part[a]) != (key, at):
                if now is not None:
                    flush(True)
                    now.whole = True
                if (lang[a], block[a]) != key:
                    if now is not None:
                        yield from now.batch(key[0])
                    now = _Slice()
                key, at, rest = (lang[a], block[a]), part[a], None
            cut = rows.iloc[a:b]
            heads = cut[cut["term"].isna()]
            if len(heads):
                now.head(heads)
            terms = cut.iloc[len(heads) :]
            rest = terms if rest is None else pd.concat([rest, terms])
            flush(False)
    if now is not None:
        flush(True)
        yield from now.batch(key[0])


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: each source of a language against each other one, summed over all kept terms.

    The vocabulary of a language is dealt in as many slices as there are shuffle partitions;
    each gets a row of every source, and a task adds up the slices it has. Over BLOCK sources, a slice's rows go to a task for each
    block of sources.
    """
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("sources") / F.lit(BLOCK)).cast("int")
    each_block = F.explode(F.sequence(F.lit(0), blocks - 1))
    heads = groups.withColumns({"mine": F.pmod(F.hash("source"), blocks), "bare": F.lit(0).cast("long")}).withColumn("p", share("bare", "own"))
    heads = heads.withColumn("block", each_block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    heads = heads.select("lang", "part", "block", F.lit(None).cast("string").alias("term"), "source", "p", (F.col("mine") == F.col("block")).alias("own"))
    terms = kept.select("lang", "source", "term", "n").join(groups, ["lang", "source"]).withColumn("p", share("n", "own")).withColumn("block", each_block)
    terms = terms.select("lang", F.pmod(F.hash("term"), F.lit(parts)).alias("part"), "block", "term", "source", "p", F.lit(False).alias("own"))
    key = ["lang", "block", "part"]
    dealt = heads.unionByName(terms).repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first(), "source")
    sums = dealt.mapInArrow(_slices, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of every occurring group.

    ``pair``: every other source of the language by how far the group's shares are from its
    (0 if no term is kept). ``term``: kept terms whose share in the group is over the
    language's, the first ``ranks`` of them. Null text, language and source count as empty;
    repeated rows count each time; equal values stand in UTF-8 order of the item. An empty
    table gives no rows, and a language of one source no pairs. Other columns are not read.
    """
    names = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    kept = written(kept_terms(docs, least_docs=least_docs, **names), "terms")
    groups = written(group_facts(docs, kept, **names), "groups")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(source_pairs(kept, groups), "pair").unionByName(part(telling_terms(kept, groups, ranks), "term"))
