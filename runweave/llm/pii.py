"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Built-in functions only. Matches of a pattern are ``regexp_extract_all``; the
text between them is ``split`` by the same pattern; together they give the
code-point offsets of each match. A match of an address can only start where a run
of its characters starts or right after the match before it; the patterns say so, and
are possessive where that changes no match, so that the engine goes over a long run
once. Offsets are summed up in blocks of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

#: Kind, pattern, cheap test that each match implies, score without context, context words.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), 0.9, "mail|contact|write"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), 0.7, "ip|address|host|server|login"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"), 0.8, "card|visa|credit|payment|number"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), 0.7, "phone|tel|call|mobile|fax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), 0.8, "iban|account|bank|konto|compte|cuenta"),
    ("secret", r"(?<![A-Za-z0-9_-])(?:[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9_-])", lambda t: t.rlike(r"[0-9A-Fa-f]{32}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}"), 0.4, "token|secret|key|password|passwd|auth|credential|bearer"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), 0.3, "ssn|social security"),
]
BASE = ("email", "ip", "card", "phone")
RANK = {k[0]: i for i, k in enumerate(KINDS)}
#: Characters on either side, up to the next match of the kind, in which context words count; least score of other kinds; matches in a block; characters of a piece of text.
NEAR, THRESHOLD, BLOCK, PIECE = 40, 0.6, 64, 1024
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,match:string,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, spaces dropped, leaves 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(c.rlike("[0-9]"), (a * 10 + value - 48) % 97).otherwise((a * 100 + value - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _running(values: Column, zero: Column, join) -> Column:
    """``join`` of ``zero`` and the values up to each one: block by block, each begun with what all blocks before it come to."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    grown = lambda v, start: F.aggregate(v, F.array(start), lambda a, n: F.concat(a, F.array(join(F.element_at(a, -1), n))))

    def each(blocks: Column) -> Column:
        starts = grown(F.transform(blocks, lambda v: F.aggregate(v, zero, join)), zero)
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda v, start: F.slice(grown(v, start), F.lit(2), F.size(v))))

    return let(blocks, each)


def _spans(text: Column, kind: str, pattern: str, test, score: float, words: str) -> Column:
    """Confirmed matches of one kind with offsets (code points, end exclusive) and score."""
    none = F.array().cast(SPAN)

    def ends(matches: Column, gaps: Column) -> Column:
        """End of each match."""
        steps = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.length(g) + F.length(m))
        return _running(steps, F.lit(0), lambda a, n: a + n)

    def found(matches: Column, gaps: Column) -> Column:
        def span(m: Column, i: Column, end: Column) -> Column:
            near = F.lower(F.concat_ws(" ", F.right(F.element_at(gaps, i + 1), F.lit(NEAR)), F.left(F.element_at(gaps, i + 2), F.lit(NEAR))))
            bonus = F.when(near.rlike(rf"\b(?:{words})"), F.lit(0.4)).otherwise(F.lit(0.0))
            return F.struct((end - F.length(m)).cast("bigint").alias("start"), F.lit(RANK[kind]).alias("rank"), end.cast("bigint").alias("end"), F.lit(kind).alias("kind"), m.alias("match"), F.least(F.lit(1.0), F.lit(score) + bonus).alias("score"))

        at = let(ends(matches, gaps), lambda e: F.transform(matches, lambda m, i: F.when(_valid(kind, m), span(m, i, F.element_at(e, i + 1)))))
        return F.filter(at, lambda s: s.isNotNull())

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: found(m, g))).otherwise(none))
    return F.when(test(text), spans).otherwise(none)


def with_spans(docs: DataFrame, name: str, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows and a column ``name``: start, rank, end, kind, match, score of each span, by start and kind.

    Spans of the four base kinds stay whatever their score; spans of other kinds
    need ``threshold``. One pass, no shuffle. Null texts count as empty and have
    no spans; repeated rows are each searched; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = "__"
    while any(c.lower().startswith(own) for c in (*docs.columns, name)):  # so that no column of the table is overwritten
        own += "_"
    names = [f"{own}{k[0]}" for k in KINDS]
    rows = docs.withColumns({n: _spans(text, *k) for n, k in zip(names, KINDS)})
    kept = F.filter(F.concat(*names), lambda s: (s["rank"] < len(BASE)) | (s["score"] >= threshold))
    return rows.withColumn(name, F.sort_array(kept)).drop(*names)


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with its spans, of which there is one at least, replaced by their kinds.

    The text is cut once into pieces of PIECE characters, and what stands between two
    spans is taken from the pieces it lies in, so the work grows with the text and its spans.
    """
    def clean(pieces: Column, before: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """Characters from ``a`` to ``b``."""
            first = F.floor(a / PIECE).cast("int")
            last = F.floor(F.greatest(b - 1, a) / PIECE).cast("int")
            return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

        marked = F.zip_with(spans, before, lambda s, e: F.when(s["start"] >= e, F.struct(s["start"].alias("start"), e.alias("after"), s["kind"].alias("kind"))))
        parts = F.transform(F.filter(marked, lambda m: m.isNotNull()), lambda m: F.concat(between(m["after"], m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(F.element_at(before, -1), F.length(text).cast("bigint")))

    zero = F.lit(0).cast("bigint")
    reached = F.concat(F.array(zero), _running(F.transform(spans, lambda s: s["end"]), zero, lambda a, n: F.greatest(a, n)))  # end of all spans before each, and of all
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: let(reached, lambda e: clean(pieces, e)))


def redact(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, with each span of the text, overlapping ones as one, replaced by its first kind in brackets.

    Spans that only touch are replaced one by one. Null and empty texts and texts without
    spans stay as they are; repeated rows are each treated; an empty table gives no rows.
    """
    text, spans = F.col(text_col), "spans"
    while spans.lower() in map(str.lower, docs.columns):
        spans = f"_{spans}"
    found = with_spans(docs, spans, text_col=text_col, threshold=threshold)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, _replaced(text, F.col(spans))).otherwise(text)).drop(spans)


def spans_digest(found: DataFrame, spans: str = "spans") -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans as text."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
