"""Benchmark decontamination with an FM-index for each shard of training documents.

All words of a shard, which stand for themselves as 64-bit hashes, become symbols: a
number for each word of the benchmark; all others, which no phrase holds, share
CLASSES further symbols, so that runs of them still differ; one more symbol ends a
document. The whole shard
is suffix-sorted, and its Burrows-Wheeler transform is held in a wavelet matrix.
All phrases are searched backward at once, occurrences are located through
sampled suffix positions, and their word spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let
from .words import ALNUM, word_hashes

WINDOW = 10
#: Benchmark text bytes that one broadcast block of phrases may come from.
BLOCK_BYTES = 4 << 20
#: Text bytes of the documents that share one index, of which a row counts ROW more; rows that become symbols at once.
SHARD_BYTES, ROW = 8 << 20, 64
CUT = 100
SAMPLE = 8
#: The symbol after each document, and the symbols of words that are not in the benchmark.
END, CLASSES = 1, 1 << 12
HITS = [
    T.StructField("text", T.BinaryType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
]


class Phrases:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int = WINDOW):
        items = list(items)
        words = list(word_hashes([text for _, text in items], ALNUM))
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *words]))
        windows: dict[tuple[int, ...], set[int]] = {}
        for (item, _), own in zip(items, words):
            ids = (np.searchsorted(self.vocabulary, own) + 2 + CLASSES).tolist()
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.windows = list(windows)
        self.items = [sorted(windows[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        most = int(self.lengths.max()) if len(self.windows) else 0
        self.table = np.full((len(self.windows), most), -1, np.int64)
        for i, w in enumerate(self.windows):
            self.table[i, most - len(w) :] = w  # flush right, as the search starts there

    def symbols(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Each text as symbols: a word's own if it is in the benchmark, else that of its class."""
        out = []
        for own in word_hashes(texts, ALNUM):
            found = (own % np.uint64(CLASSES)).astype(np.int32) + 2
            if len(self.vocabulary):
                at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
                found = np.where(self.vocabulary[at] == own, at + 2 + CLASSES, found).astype(np.int32)
            out.append(found)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes of symbols from 1 up in order: sorted by their first few symbols, then by doubling; only groups still tied are sorted again."""
    n, bits = len(symbols), int(symbols.max(initial=1)).bit_length()
    step = max(1, 62 // bits)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while step < n:
        alone = fresh & np.r_[fresh[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new = np.r_[True, key[1:] != key[:-1]]
        fresh[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        step *= 2
    return order


class FMIndex:
    """Counts and locates sequences of symbols in a text of symbols from 1 to ``size``."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        symbols = np.r_[text.astype(np.int32), np.int32(0)]
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.bwt = symbols[order - 1]
        counts = np.bincount(symbols, minlength=size + 1)
        self.before = np.cumsum(counts) - counts
        self.marked = order % sample == 0
        self.rank_marked = np.cumsum(self.marked) - self.marked
        self.sampled = order[self.marked]
        # wavelet matrix: for each bit from the top, the ones before each place, and the zeros in all
        self.levels, row = [], self.bwt
        for b in reversed(range(max(1, int(size).bit_length()))):
            bit = (row >> b & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, self.n - int(ones[-1])))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` stands before row ``at``."""
        low, high = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            bit = (c >> b & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases stand flush right, -1 on their left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((low < high) & (phrases[:, k] >= 0))
            c = phrases[live, k]
            low[live], high[live] = self.before[c] + self.rank(c, low[live]), self.before[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled one."""
        out, steps, live, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.marked[at]
            out[live[hit]] = self.sampled[self.rank_marked[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


def search_shard(documents: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """Merged word spans and items found in each document, given as symbols, of one shard; equal documents are indexed once."""
    spans: list[list[tuple[int, int]]] = [[] for _ in documents]
    items: list[set[int]] = [set() for _ in documents]
    same: dict[bytes, int] = {}
    of = [same.setdefault(d.tobytes(), len(same)) for d in documents]
    first_of = {u: i for i, u in reversed(list(enumerate(of)))}
    whole = [documents[first_of[u]] for u in range(len(same))]
    sizes = np.array([len(d) + 1 for d in whole], np.int64)
    if not len(phrases.windows) or not sizes.sum() > len(sizes):
        return spans, items
    base = np.cumsum(sizes) - sizes
    symbols = np.full(int(sizes.sum()), END, np.int32)
    for d, at in zip(whole, base.tolist()):
        symbols[at : at + len(d)] = d
    index = FMIndex(symbols, len(phrases.vocabulary) + 2 + CLASSES)
    low, high = index.search(phrases.table)
    found = np.flatnonzero(low < high)
    if not len(found):
        return spans, items
    n = (high - low)[found]
    rows = np.repeat(low[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    which = np.repeat(found, n)
    at = index.locate(rows)
    doc = np.searchsorted(base, at, "right") - 1
    first, last = at - base[doc], at - base[doc] + phrases.lengths[which]
    by = np.lexsort((last, first, doc))
    own_spans: list[list[tuple[int, int]]] = [[] for _ in whole]
    own_items: list[set[int]] = [set() for _ in whole]
    for d, a, b in zip(doc[by].tolist(), first[by].tolist(), last[by].tolist()):
        own = own_spans[d]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]))
        else:
            own.append((a, b))
    for p in np.unique(doc * len(phrases.windows) + which).tolist():
        own_items[p // len(phrases.windows)].update(phrases.items[p % len(phrases.windows)])
    return [own_spans[u] for u in of], [own_items[u] for u in of]


def _merged(a: list, b: list) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted([(x["start"], x["end"]) for x in a] + list(b)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """The benchmark, the stated query set, in blocks of bounded size."""
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        size += len(text or b"")
        if size > most and block:
            yield block
            block, size = [], len(text or b"")
        block.append((item, bytes(text) if text is not None else None))
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: ``row`` (all columns as a struct), n_words, spans (merged word spans, end exclusive), items found there.

    A phrase is each run of ``window`` words of an item, or all words of a
    shorter one. No shuffle: tasks index their rows shard by shard, a shard
    holding at most ``shard_bytes`` of text or one longer text; the phrases are
    broadcast in blocks, and each further block of items is one more pass.
    Null and empty texts have no words; repeated rows are each searched, items
    with one item_id count as one; null item ids are left out; empty tables give no
    rows or no hits.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<bigint>").alias("items"))
    asked = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col("text").cast("binary"))
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), *HITS])
    blocks = _blocks(asked, block_bytes)
    block = next(blocks, [])
    while block is not None:  # the driver holds this block and the next
        after = next(blocks, None)
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        rows = rows.mapInArrow(_searcher(phrases, shard_bytes, after is None), schema)
        block = after
    return rows.drop("text")


def _searcher(shared, shard_bytes: int, last: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            spans, items = search_shard([w for _, ws in held for w in ws], phrases)
            at = 0
            for cut, ws in held:
                own = range(at, at + len(ws))
                at += len(ws)
                before, known = cut.column(3).to_pylist(), cut.column(4).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column(0),
                        pa.nulls(len(ws), pa.binary()) if last else cut.column(1),
                        pa.array([len(w) for w in ws], pa.int64()),
                        pa.array([_merged(b, spans[i]) for b, i in zip(before, own)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(items[i].union(k)) for k, i in zip(known, own)], pa.list_(pa.int64())),
                    ],
                    names=["row", "text", "n_words", "spans", "items"],
                )

        def add(cut: pa.RecordBatch) -> None:
            for lo in range(0, cut.num_rows, CUT):
                held.append((part := cut.slice(lo, CUT), phrases.symbols(part.column(1).to_pylist())))

        for batch in batches:
            loads, lo = (pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + ROW).tolist(), 0
            for i, load in enumerate(loads):
                if size and size + load > shard_bytes:
                    add(batch.slice(lo, i - lo))
                    yield from done()
                    held.clear()
                    lo, size = i, 0
                size += load
            add(batch.slice(lo))
        if held:
            yield from done()

    return task


def cut_words(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans, which are sorted and apart; what stands between words stays.

    The words between two spans are one slice, so the work grows with the text and its spans.
    """
    pattern = "[0-9A-Za-z\\x{80}-\\x{10ffff}]+"

    def left(words: Column) -> Column:
        after = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0).cast("long"))
        segment = lambda a, b: F.slice(words, (a + 1).cast("int"), (b - a).cast("int"))
        kept = F.transform(spans, lambda s, i: F.concat(segment(after(i), s["start"]), F.array_repeat(F.lit(""), (s["end"] - s["start"]).cast("int"))))
        kept = F.concat(F.flatten(kept), segment(after(F.size(spans)), F.size(words)))
        return F.array_join(F.zip_with(F.split(text, pattern, -1), kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), left)


def cut_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows, all columns as they are, with the words of every removal span cut out of the text.

    Null and empty texts and texts without hits stay as they are; repeated rows are
    each treated; an empty table gives no rows, an empty benchmark all as they are.
    """
    spans = "spans"
    while spans.lower() in map(str.lower, docs.columns):
        spans = f"_{spans}"
    found = find_leaks(docs, benchmark, text_col=text_col, **options).select("row.*", F.col("spans").alias(spans))
    text = F.col(text_col)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut_words(text, F.col(spans))).otherwise(text)).drop(spans)


def leaks_digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
