"""Exact n-gram Jaccard join with PartEnum signatures, and its connected components.

Sets are put in size bands such that only sets of one band or of neighbours can
be similar. Within bands t-1 and t, similar sets differ in at most k_t elements.
PartEnum cuts the domain of shingle hashes into first-level partitions, so many
that two similar sets differ in at most one element in more than ``slack`` of
them. Each is cut into PARTS second-level ones (two for large sets), and a set signs
every subset that leaves one of these out; where two sets differ in at most one element, they agree
on such a subset. A signature without elements says nothing and is weak. Only a
set with weak signatures in more than ``slack`` first-level partitions signs these
too, under marks of their own: if all that two similar sets share is weak, both
are such sets. So every similar pair shares a signature.

Nodes are distinct texts. What shares a signature is never listed in pairs:
(1) each group's members are compared with its smallest one; (2) all members of
one smallest node that are not yet in one component are compared by sketches,
block by block, and a spanning forest of what the sketches let pass makes
clusters; (3) each cluster's sets meet once, and only links that join two
components are emitted. Sketches never reject a similar pair, and sets decide.
Shingles, words and texts stand for themselves as 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written
from .words import WEIGHT, mix, word_hashes

_U = np.uint64
#: Members that one task compares with a pivot, and targets of one row of texts.
FAN, BUNDLE = 100, 200
#: Members, and bytes of sets, that meet in a block; larger groups are compared in pairs of blocks.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Second-level partitions, of which a signature leaves one out; from WIDE elements on two are enough. Signatures that are pre-aggregated at once.
PARTS, WIDE, CHUNK = 3, 256, 1 << 20
#: Links that one task of a step over links writes at least.
LINKS = 20_000
#: Most rows of identifiers that are broadcast to pick texts out of a scan; more are joined by a shuffle.
SENT = 1_000_000


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; of all its words if it has fewer."""
    out: list[np.ndarray] = []
    for words in word_hashes(texts):
        n = len(words)
        if n < size:
            out.append(mix((words * WEIGHT[:n]).sum(keepdims=True) + _U(n)) if n else np.empty(0, np.uint64))
            continue
        total = words[: n - size + 1] * WEIGHT[0]
        for k in range(1, size):
            total = total + words[k : n - size + 1 + k] * WEIGHT[k]
        out.append(np.unique(mix(total)))
    return out


class Scheme:
    """Bands, partitions and signatures for 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, np.int64)
        self.made: dict[int, tuple] = {}

    def differ(self, total: int) -> int:
        """Most elements by which similar sets of ``total`` elements together can differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def most(self, tag: int) -> int:
        return self.differ(2 * (int(self.low[tag + 1]) - 1))

    def parts(self, tag: int) -> tuple:
        """Bounds of a band pair's second-level partitions, seeds of its signatures, and the slack.

        Any slack is right; this one leaves few sets with more weak partitions.
        """
        if tag not in self.made:
            k, parts = self.most(tag), PARTS if self.low[tag] < WIDE else 2
            first, slack, n = k // 2 + 1, 0, math.sqrt(int(self.low[tag]) * int(self.low[max(tag - 1, 0)]))
            for _ in range(12):
                empty = min(1.0, parts * math.exp(-n * (parts - 1) / (parts * (first + slack))))
                weak = (first + slack) * empty
                slack = min(math.ceil(weak + 3 * math.sqrt(weak)) if weak > 0.01 else 0, first // 3 + 2)
            first = first + slack if k else 1
            cells = first * parts
            edges = np.array([min((i << 64) // cells, (1 << 64) - 1) for i in range(cells + 1)], np.uint64)
            seeds = mix(np.arange(cells, dtype=np.uint64) + (_U(tag + 1) << _U(40))).reshape(first, parts)
            self.made[tag] = edges, seeds, slack
        return self.made[tag]

    def signatures(self, elements: np.ndarray, tag: int) -> np.ndarray:
        edges, seeds, slack = self.parts(tag)
        sums = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix(elements + _U(0x5851F42D4C957F2D)), out=sums[1:])
        if not self.most(tag):  # similar sets are equal
            return mix(sums[-1:] ^ seeds[0, 0])
        at = np.searchsorted(elements, edges)
        at[-1] = len(elements)
        own, size = (sums[at[1:]] - sums[at[:-1]]).reshape(seeds.shape), np.diff(at).reshape(seeds.shape)
        each = mix((own.sum(axis=1, dtype=np.uint64)[:, None] - own) ^ seeds)  # all cells of a partition but one
        weak = size.sum(axis=1)[:, None] == size
        if np.count_nonzero(weak.any(axis=1)) <= slack:
            return each[~weak]
        return np.concatenate([each[~weak], mix(each[weak] + WEIGHT[5])])

    def sketch(self, elements: np.ndarray, tag: int, scale: int = 8) -> bytes:
        """Parity of the elements in each of ``scale`` k_t places: two sketches differ in no more places than the sets in elements."""
        return self.parity(elements, 64 * max(4, -(-scale * self.most(tag) // 64)))

    def parity(self, elements: np.ndarray, bits: int) -> bytes:
        odd = np.bincount((mix(elements ^ _U(0xD6E8FEB86659FD93)) % _U(bits)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()


@functools.lru_cache(maxsize=4)
def scheme(percent: int) -> Scheme:
    return Scheme(percent)


def _arrow(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SIGNED = "key long, node long, tag int, cnt int, extra long, sketch binary"


def _combined(sigs: np.ndarray, nodes: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (key, node, tag, cnt, extra) of a chunk: one for each signature, its smallest node and how many it has; and one with cnt 0, the signature as ``extra`` and a key of its own, for each further node."""
    by = np.lexsort((nodes, sigs))
    sigs, nodes, tags = sigs[by], nodes[by], tags[by]
    fresh = np.r_[True, sigs[1:] != sigs[:-1]]
    new = fresh | np.r_[True, nodes[1:] != nodes[:-1]]
    sigs, nodes, tags, fresh = sigs[new], nodes[new], tags[new], fresh[new]
    cnt = np.zeros(len(sigs), np.int32)
    first = np.flatnonzero(fresh)
    cnt[first] = np.diff(np.r_[first, len(sigs)])
    keys = sigs.copy()
    rest = ~fresh
    keys[rest] = mix(sigs[rest] ^ mix(nodes[rest].view(np.uint64)))
    by = np.argsort(nodes, kind="stable")  # rows of one node after each other compress well
    return tuple(x[by] for x in (keys.view(np.int64), nodes, tags, cnt, np.where(fresh, 0, sigs.view(np.int64))))


def _signer(size: int, percent: int):
    """Signatures of each text, pre-aggregated by chunk, and for each band pair of a set a row of cnt -1 with its size as ``extra`` and its sketch (tag -1: no words)."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("tag", pa.int32()), ("cnt", pa.int32()), ("extra", pa.int64()), ("sketch", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, load = scheme(percent), [], 0

        def combined() -> Iterator[pa.RecordBatch]:
            sigs = np.concatenate([s for s, _, _ in held])
            nodes, tags = (np.repeat(np.array([h[c] for h in held], t), [len(h[0]) for h in held]) for c, t in ((1, np.int64), (2, np.int32)))
            rows = _combined(sigs, nodes, tags)
            for lo in range(0, len(rows[0]), 100_000):
                cut = [x[lo : lo + 100_000] for x in rows]
                yield _arrow([*cut, pa.nulls(len(cut[0]), pa.binary())], schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cut, rows = batch.slice(lo, 500), []
                sets = shingle_sets(cut.column(1).to_pylist(), size)
                for node, s in zip(cut.column(0).to_pylist(), sets):
                    if not len(s):
                        rows.append((node, node, -1, -1, 0, None))
                        continue
                    t = own.band(len(s))
                    for k in (t, t + 1):
                        rows.append((int(mix(np.array([node, k], np.int64).view(np.uint64)).view(np.int64).sum()), node, k, -1, len(s), own.sketch(s, k)))
                        held.append((own.signatures(s, k), node, k))
                        load += len(held[-1][0])
                yield _arrow([[r[c] for r in rows] for c in range(6)], schema)
                if load >= CHUNK:
                    yield from combined()
                    held, load = [], 0
        if held:
            yield from combined()

    return task


def _memberships(reps: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(tag, pivot, node): each node that shares a signature with a smaller one and the smallest; and (tag, node, n, sketch).

    Tasks send one row for each signature of a chunk of texts, so a signature of
    many nodes has as many rows as there are chunks; further nodes get the pivot by a
    join, whose large keys are split at run time.
    """
    signed = reps.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(_signer(size, percent), _SIGNED)
    group = Window.partitionBy("key")
    met = signed.select("*", F.sum(F.greatest("cnt", F.lit(0))).over(group).alias("members"), F.min(F.when(F.col("cnt") > 0, F.col("node"))).over(group).alias("pivot"))
    met = written(met.filter("cnt < 1 or members > 1").drop("members"), "groups")
    leads = met.filter("cnt > 0")
    rest = met.filter("cnt = 0").select(F.col("extra").alias("key"), "node", "tag").join(leads.select("key", "pivot").distinct(), "key")
    pairs = leads.select("tag", "pivot", "node").unionByName(rest.select("tag", "pivot", "node")).filter("node <> pivot").distinct()
    return written(pairs, "pivots"), met.filter("cnt = -1").select("tag", "node", F.col("extra").alias("n"), "sketch")


def _small(df: DataFrame, most: int = SENT) -> DataFrame:
    """``df``, a table of a few numbers a row, marked for broadcast only where its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= most else df


def _shipper(size: int, fields: list[tuple[str, pa.DataType]]):
    """For each of a text's targets a row: the target's fields, the node and its set."""
    schema = pa.schema([*fields, ("node", pa.int64()), ("elements", pa.binary())])
    names = [f for f, _ in fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                cut, rows, load = batch.slice(lo, 200), [], 0
                for node, to, s in zip(cut.column(0).to_pylist(), cut.column(2).to_pylist(), shingle_sets(cut.column(1).to_pylist(), size)):
                    raw = s.tobytes()
                    for x in to:
                        rows.append((*(x[f] for f in names), node, raw))
                        load += len(raw)
                        if load > 8 << 20 or len(rows) >= 1000:
                            yield _arrow([[r[c] for r in rows] for c in range(len(schema))], schema)
                            rows, load = [], 0
                if rows:
                    yield _arrow([[r[c] for r in rows] for c in range(len(schema))], schema)

    return task


def _shipped(to: DataFrame, reps: DataFrame, size: int, fields: str) -> DataFrame:
    """The sets of the nodes of ``to`` (node, to: array of structs with ``fields``), one row for each target."""
    texts = reps.select("node", F.col("text").cast("binary").alias("text")).join(_small(to.select("node").distinct()), "node", "left_semi")
    kinds = {"long": pa.int64(), "int": pa.int32()}
    own = [(n, kinds[k]) for n, k in (x.split() for x in fields.split(", "))]
    return texts.join(to, "node").select("node", "text", "to").mapInArrow(_shipper(size, own), fields + ", node long, elements binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return _arrow([[x[0] for x in found], [x[1] for x in found]], _LINK)


def _checker(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for batch in batches:
            links = []
            for a, salt, role, node, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, salt) != key:
                    key, pivots = (a, salt), []
                own = np.frombuffer(raw, np.uint64)
                if not role:
                    pivots.append(own)
                elif any(_similar(own, p, percent) for p in pivots):
                    links.append((a, node))
            yield _links(links)

    return task


def verify(pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. Members of one ``a`` are spread over tasks, about FAN to each."""
    pairs = written(pairs, "pairs")
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(FAN)).cast("int").alias("fans"))
    target = lambda a, salt, role: F.struct(F.col(a).alias("a"), salt.alias("salt"), F.lit(role).alias("role"))
    members = pairs.join(fans, "a").withColumn("salt", F.pmod(F.hash("b"), "fans").cast("int")).select(F.col("b").alias("node"), F.pmod(F.hash("a"), F.lit(4)).alias("bundle"), target("a", F.col("salt"), 1).alias("to"))
    pivots = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt")).select(F.col("a").alias("node"), F.floor(F.col("salt") / F.lit(BUNDLE)).cast("int").alias("bundle"), target("a", F.col("salt"), 0).alias("to"))
    to = written(members.unionByName(pivots).groupBy("node", "bundle").agg(F.collect_list("to").alias("to")), "targets")
    shipped = _shipped(to, reps, size, "a long, salt int, role int")
    dealt = shipped.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    out = written(dealt.mapInArrow(_checker(percent), "a long, b long").distinct(), "links")
    discard(pairs, to)
    return out


def connected(links: DataFrame) -> DataFrame:
    """node, comp: each node of the links and the smallest node it reaches.

    Alternates large-star and small-star steps; minima are pre-aggregated and
    joined back, so a hub's links are split over tasks. Every step is a written table.
    """

    def star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = near.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        out = out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        after = written(out.coalesce(parts), "star")
        discard(edges)
        return after

    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges"), None
    while (now := mark(edges)) != before:
        before, parts = now, max(4, now[0] // LINKS)  # a step leaves no more links than it is given, so few of them need few files
        edges = star(star(edges, True, parts), False, parts)
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct().coalesce(parts))
    out = written(out, "components")
    discard(edges)
    return out


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which sketches differ, over the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _screener(percent: int):
    """The pairs (a, b) whose sketches do not rule them out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for a, b, na, nb, sa, sb in zip(*(c.to_pylist() for c in batch.columns)):
                if 100 * min(na, nb) >= percent * max(na, nb) and int(_far(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64))) <= (100 - percent) * (na + nb) // (100 + percent):
                    passed.append((a, b))
            yield _links(passed)

    return task


def _with_pivots(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs of a node and its pivot that the sketches let pass."""
    side = lambda c, name: sketches.select("tag", F.col("node").alias(name), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("b", "node"), ["tag", "node"]).join(side("a", "pivot"), ["tag", "pivot"])
    return both.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "na", "nb", "sa", "sb").mapInArrow(_screener(percent), "a long, b long").distinct()


class _Union:
    """Labels of 0 .. n-1 under merging."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)
        self.left = len(np.unique(self.label)) - 1

    def merge(self, x: int, y: int) -> bool:
        a, b = self.label[x], self.label[y]
        if a == b:
            return False
        self.label[self.label == max(a, b)] = min(a, b)
        self.left -= 1
        return True


def _passing(bits: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components, and of different blocks if there are two, that the sketches let pass."""
    two = block.min() != block.max()
    step = max(1, (2 << 20) // bits.size)
    for i in range(0, len(n), step):
        j = min(len(n), i + step)
        ok = (comp[i:j, None] != comp[None, :]) & (np.arange(i, j)[:, None] < np.arange(len(n))[None, :])
        ok &= 100 * np.minimum(n[i:j, None], n[None, :]) >= percent * np.maximum(n[i:j, None], n[None, :])
        if two:
            ok &= block[i:j, None] != block[None, :]
        if not ok.any():
            continue
        ok &= _far(bits[i:j, None, :], bits[None, :, :]) <= (100 - percent) * (n[i:j, None] + n[None, :]) // (100 + percent)
        x, y = np.nonzero(ok)
        yield x + i, y


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, without these."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def _forester(percent: int):
    """Of each block pair a spanning forest of the pairs that the sketches let pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 4):
            node, comp, n, block = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            if len(set(comp.tolist())) < 2:
                continue
            bits, trees, found = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1), _Union(np.arange(len(rows))), []
            for x, y in _passing(bits, n, comp, block, percent):
                while len(x):
                    if trees.merge(x[0], y[0]):
                        found.append((int(node[x[0]]), int(node[y[0]])))
                    live = trees.label[x] != trees.label[y]
                    x, y = x[live], y[live]
            yield _links(found)

    return task


def _linker(percent: int):
    """Of each block pair the links that join two components."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            comp, block, node = (np.array([r[c] for r in rows], np.int64) for c in range(3))
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            n, joint, found = np.array([len(s) for s in sets], np.int64), _Union(comp), []
            if not joint.left:
                continue
            own = scheme(percent)
            width = 64 * max(4, own.differ(2 * int(n.max())))  # wide enough that hardly any two elements share a place
            bits = np.frombuffer(b"".join(own.parity(s, width) for s in sets), np.uint64).reshape(len(rows), -1)
            for x, y in _passing(bits, n, comp, block, percent):
                for i, j in zip(x.tolist(), y.tolist()):
                    if joint.label[i] != joint.label[j] and _similar(sets[i], sets[j], percent) and joint.merge(i, j):
                        found.append((int(node[i]), int(node[j])))
                if not joint.left:
                    break
            yield _links(found)

    return task


def _placed(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    return nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(members: DataFrame, comps: DataFrame, key: list[str], *sums) -> DataFrame:
    """Members of the groups that lie in more than one component, with that component and the groups' sums."""
    placed = _placed(members, comps)
    split = placed.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *sums).filter("lo <> hi").drop("lo", "hi")
    split = written(split, "split")  # a table of its own, so that a large group's rows can be split in the join
    return placed.join(_small(split), key)


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Rows dealt into ``blocks`` blocks, once for each pair of blocks (p, q) they are in."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.hash("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other", "blocks")


def _blocks():
    """Blocks of a cluster of ``c`` members and ``b`` bytes of sets."""
    return F.greatest(F.ceil(F.col("c") / F.lit(BLOCK)), F.ceil(F.col("b") / F.lit(BLOCK_BYTES)))


def _clusters(pairs: DataFrame, sketches: DataFrame, comps: DataFrame, percent: int) -> DataFrame | None:
    """node, cl: any two nodes of one pivot and different components whose sketches may be similar are in one cluster."""
    key = ["tag", "pivot", "p", "q"]
    rows = _in_blocks(_open(pairs, comps, ["tag", "pivot"], F.count("*").alias("c")), F.ceil(F.col("c") / F.lit(BLOCK)))
    rows = rows.join(sketches, ["tag", "node"]).select(*key, "node", "comp", "n", "block", "sketch")
    edges = written(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_forester(percent), "a long, b long").distinct(), "passed")
    if not edges.take(1):
        return None
    found = connected(edges).withColumnRenamed("comp", "cl")
    discard(edges)
    return found


def _within(clusters: DataFrame, comps: DataFrame, sizes: DataFrame, reps: DataFrame, size: int, percent: int, crossing: bool) -> DataFrame:
    """Links that join components of a cluster: within its blocks, or else between two of them."""
    members = clusters.join(sizes, "node")
    rows = _open(members, comps, ["cl"], F.count("*").alias("c"), F.sum(F.col("n") * 8).alias("b"))
    rows = _in_blocks(rows, _blocks()).filter("p <> q" if crossing else "p = q")
    to = rows.select("node", F.pmod(F.hash("p", "q"), F.lit(4)).alias("bundle"), F.struct("cl", "p", "q", "comp", "block").alias("to"))
    to = written(to.groupBy("node", "bundle").agg(F.collect_list("to").alias("to")), "targets")
    key = ["cl", "p", "q"]
    dealt = _shipped(to, reps, size, "cl long, p int, q int, comp long, block int").repartition(*key).sortWithinPartitions(*key)
    out = written(dealt.mapInArrow(_linker(percent), "a long, b long"), "links")
    discard(to)
    return out


def _id(doc_id) -> object:
    """An identifier for joins; a null one has a number too."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)).cast("long"))


def _node() -> object:
    """A text's number: its smallest identifier, or where that has several texts, is negative or null, its hash with the sign bit."""
    return F.when((F.col("doc_id") >= 0) & F.col("several").isNull(), F.col("doc_id")).otherwise(F.col("th").bitwiseOR(F.lit(-(1 << 63)).cast("long")))


def text_hash(text) -> object:
    return F.xxhash64(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def linked(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, joint: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th) of every row, and of each distinct text: th, n (shingles), comp (smallest text number that it reaches), least (smallest doc_id there).

    ``joint``: texts of one identifier are linked.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("th"))
    keys = written(base.select("doc_id", "th"), "texts")
    several = keys.filter("doc_id is not null").groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo <> hi")
    several = written(several.select("doc_id", F.lit(True).alias("several")), "several")
    own = keys.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")).join(_small(several), "doc_id", "left")
    own = written(own.select("th", F.col("doc_id").alias("own"), _node().alias("node"), "rows"), "own")
    copies = keys.join(_small(written(own.filter("rows > 1").select("th", "own"), "same")), "th").filter(_id(F.col("doc_id")) != _id(F.col("own")))
    copies = written(copies.select(_id(F.col("doc_id")).alias("id"), "th").distinct(), "copies")
    reps = base.withColumn("id", _id(F.col("doc_id"))).join(_small(copies), ["id", "th"], "left_anti").join(_small(several), "doc_id", "left").select(_node().alias("node"), "text")
    pairs, sketches = _memberships(reps, size, percent)
    sizes = written(sketches.select("node", "n").distinct(), "sizes")
    links = verify(_with_pivots(pairs, sketches, percent), reps, size, percent)
    if joint:
        worded = keys.join(_small(several), "doc_id", "left_semi").distinct().join(own, "th").join(sizes.filter("n > 0"), "node").select("doc_id", "node")
        links = links.unionByName(written(worded.join(worded.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")), "joint"))
    comps = connected(links)
    clusters = _clusters(pairs, sketches, comps, percent)
    if clusters is not None:
        largest = clusters.join(sizes, "node").groupBy("cl").agg(F.count("*").alias("c"), F.sum(F.col("n") * 8).alias("b"))
        for crossing in (False, True) if largest.filter(_blocks() > 1).take(1) else (False,):
            found = _within(clusters, comps, sizes, reps, size, percent, crossing)
            if found.take(1):
                links = links.unionByName(found)
                comps = connected(links)
    at = sizes.join(own.drop("rows"), "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    at = written(at, "placed")
    least = at.groupBy("comp").agg(F.min("own").alias("least"), F.count("*").alias("texts")).filter("texts > 1").drop("texts")
    placed = at.join(least, "comp", "left").select("th", "n", "comp", F.coalesce("least", "own").alias("least"))
    discard(pairs)
    return keys, placed


def components(docs: DataFrame, *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest identifier reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets
    of ``size``-word shingles; no link between different texts is lost. Equal
    texts count as one text. Null and empty texts, and texts without words, have
    no shingles and no links. Rows of one identifier count as one document with
    several texts. A row without an identifier links by its text; its component
    is null where it reaches no identifier. An empty table gives no rows; other
    columns are not read.
    """
    keys, placed = linked(docs, size, percent, id_col, text_col)
    return keys.join(placed, "th").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, but only one row of each group of linked texts.

    The row of the smallest identifier stays, of the smallest text hash among equal
    ones; rows without an identifier come last, and of rows equal in both any one
    stays. Only texts decide: unlike texts of one identifier are no copies. Rows
    whose text has no words are no copies of each other and all stay.
    """
    keys, placed = linked(docs, size, percent, id_col, text_col, joint=False)
    rank = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    rows = written(keys.groupBy("doc_id", "th").agg(F.count("*").alias("rows")).join(placed.filter("n > 0"), "th").select("doc_id", "th", "rows", "comp"), "rows")
    first = rows.groupBy("comp").agg(F.min(rank()).alias("first"), F.count("*").alias("c"), F.max("rows").alias("r")).filter("c > 1 or r > 1").select("comp", "first")
    first = written(first, "first")  # a table of its own, so that a large group's rows can be split in the join
    out = rows.join(_small(first), "comp").select(_id(F.col("doc_id")).alias("__id"), F.col("th").alias("__th"), (rank() == F.col("first")).alias("__stays"), "rows")
    out = written(out.filter("not __stays or rows > 1").select("__id", "__th", "__stays"), "others")
    marked = docs.withColumns({"__id": _id(F.col(id_col).cast("long")), "__th": text_hash(F.col(text_col))})
    single = marked.join(_small(out.drop("__stays")), ["__id", "__th"], "left_anti").select(docs.columns)
    repeated = out.filter("__stays").drop("__stays")
    if not repeated.take(1):
        return single
    again = marked.join(_small(repeated), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return single.unionByName(again.select(docs.columns))
