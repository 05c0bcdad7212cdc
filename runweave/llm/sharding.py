"""Extendible hashing: shards of bounded bytes, found through a directory of hash-prefix bits.

A document's hash is the first 60 bits of the md5 of its identifier. A shard is
a prefix; only a prefix that holds too many bytes is split on one more bit. The
directory has one slot for each prefix of ``depth`` bits and names the slot's shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

BITS = 60
#: Bits that one round of splitting looks at; its node table has at most 2 ** (STEP + 1) rows for each shard split.
STEP = 12
#: Pages that one task chains of a hash that alone exceeds the limit.
GROUP = 64


def hash_of(key: Column) -> Column:
    """60 bits as a long; a null key counts as the text ``null``."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Shards of ``rows`` (h, bytes): depth, prefix, n_rows, n_bytes.

    Each round sums the bytes under every prefix of the next STEP bits of the
    prefixes still too large, with partial sums before the shuffle, and keeps as
    shards those within the limit whose parent is not. The rounds end when
    nothing is too large or the hash is used up; then rows of one hash stay
    together here and ``assign`` chains them.
    """
    open_ = rows.select(F.lit(0).alias("base"), F.lit(0).cast("long").alias("root"), "h", "bytes").groupBy("base", "root", F.shiftright("h", BITS - STEP).alias("cell")).agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"))
    out, base = None, 0
    while True:
        step = min(STEP, BITS - base)
        nodes = open_.select(F.explode(F.sequence(F.lit(0), F.lit(step))).alias("d"), "cell", "n_rows", "n_bytes")
        nodes = nodes.withColumn("prefix", F.expr(f"shiftright(cell, {step} - d)")).groupBy("d", "prefix").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        nodes = written(nodes.filter("d > 0") if base else nodes, "nodes")
        over = nodes.filter(F.col("n_bytes") > limit)
        parents = over.select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        first = nodes.filter("d = 0") if not base else nodes.filter("d = 1")
        below = nodes.filter(f"d > {0 if not base else 1}").join(parents, ["d", "prefix"], "left_semi").unionByName(first)
        last = base + step == BITS
        done = below.filter((F.col("n_bytes") <= limit) | F.lit(last) & (F.col("d") == step))
        done = done.select((F.col("d") + base).cast("int").alias("depth"), "prefix", "n_rows", "n_bytes")
        out = done if out is None else out.unionByName(done)
        more = below.filter((F.col("d") == step) & (F.col("n_bytes") > limit)).select(F.col("prefix").alias("root"))
        if last or not more.take(1):
            return written(out, "directory")
        base += step
        more = written(more, "split")
        deeper = rows.withColumn("root", F.shiftright("h", BITS - base)).join(more, "root", "left_semi")
        step = min(STEP, BITS - base)
        open_ = deeper.groupBy(F.shiftright("h", BITS - base - step).alias("cell")).agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"))


def assign(docs: DataFrame, *, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, h, n_bytes, depth, prefix, page, shard_bytes.

    A shard is (depth, prefix, page). ``page`` is 0 but where rows of one hash
    alone exceed the limit: these go to overflow pages, each within the limit
    unless a single row exceeds it. Null texts have no bytes; null identifiers
    share one hash; repeated rows are each placed; an empty table gives no rows
    and one empty shard; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), hash_of(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    rows = written(rows, "hashes")
    shards = directory(rows, limit)
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 61
    keyed = rows.withColumn("at", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(f"shiftright(h, {BITS - d})").alias("prefix")) for d in sorted(depths)])) if depths else F.explode(F.array().cast("array<struct<depth:int,prefix:bigint>>"))).select("doc_id", "h", "bytes", "at.*")
    placed = keyed.join(shards.select("depth", "prefix", F.col("n_bytes").alias("shard_bytes")), ["depth", "prefix"])
    paged = _paged(placed, limit)
    return paged.select("doc_id", "h", F.col("bytes").alias("n_bytes"), "depth", "prefix", "page", "shard_bytes")


def _paged(placed: DataFrame, limit: int) -> DataFrame:
    """Adds ``page``: rows of one hash that alone exceed the limit are chained over pages.

    Such rows are dealt into groups of about GROUP pages, which are paged each in a
    task of its own; then the pages of a hash are numbered on over its groups.
    """
    large = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
    groups = F.ceil(F.col("shard_bytes") / F.lit(GROUP * limit))
    rows = placed.filter(large).withColumn("__g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), groups))
    rows = written(rows, "chained")
    if not rows.take(1):
        return placed.withColumn("page", F.lit(0).cast("long"))
    over = Window.partitionBy("h", "__g").orderBy("bytes").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__p", F.floor((F.sum("bytes").over(over) - F.col("bytes")) / F.lit(limit)).cast("long"))
    pages = rows.groupBy("h", "__g").agg((F.max("__p") + 1).alias("n"))
    before = Window.partitionBy("h").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    first = pages.select("h", "__g", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__first"))  # a row for each group
    chained = rows.join(first, ["h", "__g"]).withColumn("page", F.col("__first") + F.col("__p"))
    return placed.filter(~large).withColumn("page", F.lit(0).cast("long")).unionByName(chained.select(*placed.columns, "page"))


def write_shards(docs: DataFrame, folder: str | None = None, *, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows, all columns as they are, to one Parquet folder per shard; returns the table read back with its ``shard``."""
    folder = folder or shared_dir(docs.sparkSession, "shards")
    placed = assign(docs, limit=limit, id_col=id_col, text_col=text_col)
    of_hash = placed.select("h", "depth", "prefix", "shard_bytes").distinct()
    rows = docs.select(hash_of(docs[id_col]).alias("h"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("bytes"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    paged = _paged(rows.join(of_hash, "h"), limit)
    out = paged.select("row.*", F.concat_ws("-", "depth", "prefix", "page").alias("shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
