"""Quality rules as a short-circuit cascade; built-in functions only.

The base figures of a text are computed for every row. The other rules are
predicates with unlike costs: each is run many times on a bounded sample spread
over all rows, and the cascade asks first what rejects most per second of what is
left, so later rules see fewer rows. Their order never changes a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

SPACE = r"[\x20\x09-\x0D]+"
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Most rows, and longest text in bytes, of the sample on which costs and rejections are estimated; runs of a rule on each row.
SAMPLE_ROWS, SAMPLE_BYTES, REPEAT = 1000, 1 << 14, 20


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column) -> Column:
    """Words inside a window of three words that occurs twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes. Only where a hash repeats are the
    positions sorted by hash, equal neighbours kept and their cover summed up.
    """

    def cover(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def among(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: F.element_at(s, a)["h"] == F.element_at(s, b)["h"]
            twice = F.filter(F.sequence(F.lit(1), n), lambda j: F.when(j > 1, same(j, j - 1)).otherwise(False) | F.when(j < n, same(j, j + 1)).otherwise(False))
            return let(F.sort_array(F.transform(twice, lambda j: F.element_at(s, j)["i"])), covered)

        def covered(at: Column) -> Column:
            n = F.size(at)
            gap = lambda k: F.when(k == n, F.lit(3)).otherwise(F.least(F.lit(3), F.element_at(at, k + 1) - F.element_at(at, k)))
            return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, k: a + gap(k))).otherwise(0)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, among))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(F.size(words) >= 3, let(windows, cover)).otherwise(0)


def base_figures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a non-null text."""
    solid = without(text, " \t\n\x0b\x0c\r")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, " \t\x0b\x0c\r") != "")
    two = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    three = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return let(
        F.struct(two.alias("w"), three.alias("x")),
        lambda s: F.struct(
            s["w"]["n"].cast("long").alias("n_words"),
            F.length(solid).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            s["x"]["n"].cast("long").alias("n_lines"),
            s["x"]["d"].cast("long").alias("n_dup_lines"),
            s["w"]["r"].cast("long").alias("n_repeat_words"),
        ),
    )


def default_rules() -> dict[str, Column]:
    """What the method rejects beyond the base rule: name and predicate over text and ``b``, the base figures."""
    text, b = F.col("text"), F.col("b")
    return {
        "symbols": b["n_symbols"] * 5 > b["n_words"],
        "dup_lines": b["n_dup_lines"] * 10 > b["n_lines"] * 3,
        "word_length": (b["word_chars"] < b["n_words"] * 2) | (b["word_chars"] > b["n_words"] * 15),
        "shouting": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) * 2 > b["n_words"],
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) * 2 > b["word_chars"],
    }


def base_failed(b: Column) -> Column:
    return (b["n_words"] < 50) | (b["n_repeat_words"] * 100 > b["n_words"] * 50)


def _sample(rows: DataFrame, most: int) -> list:
    """At most ``most`` texts of at most SAMPLE_BYTES: those of the identifiers with the smallest hashes, so from all parts of the table.

    The identifiers alone are scanned first; the texts are then asked for by
    identifier, so that a reader can skip pages. Without identifiers the first rows stand in.
    """
    short = F.octet_length("text") <= SAMPLE_BYTES
    ids = [r[0] for r in rows.filter(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    picked = rows.filter(F.col("doc_id").isin(ids)) if ids else rows
    return picked.filter(short).select("text").limit(most).collect()


def order_rules(rows: DataFrame, rules: dict[str, Column], *, sample_rows: int = SAMPLE_ROWS, clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, float, float]]:
    """(name, share rejected of what the rules before it leave, seconds a row) by falling rejection per second.

    Measured on at most ``sample_rows`` rows that the base rule keeps, at most 16 MB at
    any input size. A rule's seconds are those of a job that runs it REPEAT times on each
    row, less those of the same job with a rule that does nothing.
    """
    some = _sample(rows, sample_rows)
    sample = rows.sparkSession.createDataFrame(some, "text string").withColumn("b", base_figures(F.col("text"))).filter(~base_failed(F.col("b"))).cache()
    try:
        verdicts = {n: F.coalesce(r, F.lit(False)).alias(n) for n, r in rules.items()}
        met = [(r["count"], {n for n in rules if r[n]}) for r in sample.groupBy(*verdicts.values()).count().collect()]  # no more rows than the sample has
        n = sum(k for k, _ in met)
        if not n:
            return [(name, 0.0, 0.0) for name in rules]

        def seconds(rule: Column) -> float:
            took = []
            for _ in range(2):
                began = clock()
                sample.select("text", "b", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))).alias("k")).agg(F.count_if(rule)).first()
                took.append(clock() - began)
            return min(took)

        idle = seconds(F.col("k") < 0)
        costs = {name: max(seconds(v) - idle, 1e-6) / (n * REPEAT) for name, v in verdicts.items()}
        out, left = [], dict(costs)
        while left:
            count = lambda name: sum(k for k, hit in met if name in hit)
            name = max(sorted(left), key=lambda x: count(x) / left[x])
            out.append((name, count(name) / max(1, sum(k for k, _ in met)), left.pop(name)))
            met = [(k, hit) for k, hit in met if name not in hit]
        return out
    finally:
        sample.unpersist()


def judge(docs: DataFrame, *, rules: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, base figures, base_failed, kept and the first rule that rejected (null: none).

    One pass, no shuffle. A null text has no words and fails the base rule; so
    does an empty one. Repeated rows are each judged; an empty table gives no
    rows; other columns are not read.
    """
    rules = rules or default_rules()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    figures = rows.withColumn("b", base_figures(F.col("text")))
    cascade = F.when(base_failed(F.col("b")), F.lit("base"))
    for name, _, _ in order_rules(rows, rules, sample_rows=sample_rows):
        cascade = cascade.when(rules[name], F.lit(name))
    judged = figures.withColumn("rejected_by", cascade)
    return judged.select("doc_id", "b.*", base_failed(F.col("b")).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")
