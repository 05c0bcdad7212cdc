"""Best-fit packing of token sequences, refined by swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MEMO, tokenizer_file, word_encoder
from .shared import written

SCHEMA = "doc_id long, piece int, start long, length long, tokens binary, sequence_id long, offset long"
BINS = "sequence_id long, size long, keys array<long>, lengths array<int>"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of items by bin; a bin with least room that fits is taken."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in order:
        at = bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            insort(rooms, (room - lengths[i], b))
    return bins


def swap_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills by moves and exchanges until bins empty.

    A pass takes every underfull bin as donor once, always the emptiest that is
    left. Its documents are moved to bins with room, exchanged one for one, or
    two of them for one, so that a bin at least as full gets fuller; a donor that
    becomes empty goes, and so does a target that becomes full. Partners are
    looked up by room and by length over all bins left in the pass. Ends on a
    pass without change.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    done = [b for b, n in zip(bins, fill) if n == capacity]
    bins = [list(b) for b, n in zip(bins, fill) if 0 < n < capacity]
    changed = True
    while changed:
        changed = _pass(lengths, bins, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        done += [b for b, n in zip(bins, fill) if n == capacity]
        bins = [b for b, n in zip(bins, fill) if 0 < n < capacity]
    return done + bins


def _pass(lengths: list[int], bins: list[list[int]], capacity: int) -> bool:
    """One pass of ``swap_search`` in place; whether anything changed.

    ``held[b][v]`` are the documents of length v in bin b. ``heaps[v]`` has
    (-room, bin) of bins that hold a v; rooms only shrink during a pass, so its
    entries and ``most[v]``, the room of its first, are upper bounds, put right
    when they are used.
    """
    room = [capacity - sum(lengths[i] for i in b) for b in bins]
    held: list[dict[int, list[int]]] = []
    heaps: dict[int, list[tuple[int, int]]] = {}
    for b, members in enumerate(bins):
        held.append({})
        for i in members:
            held[b].setdefault(lengths[i], []).append(i)
        for v in held[b]:
            heaps.setdefault(v, []).append((-room[b], b))
    at, most = np.arange(capacity + 1), np.zeros(capacity + 1, np.int64)
    for v, heap in heaps.items():
        heapify(heap)
        most[v] = -heap[0][0]
    rooms = sorted((r, b) for b, r in enumerate(room))
    target = [True] * len(bins)

    def take(b: int, v: int) -> int:
        i = held[b][v].pop()
        if not held[b][v]:
            del held[b][v]
        return i

    def put(b: int, i: int) -> None:
        held[b].setdefault(lengths[i], []).append(i)

    def fuller(t: int, gain: int, new: tuple[int, ...]) -> None:
        del rooms[bisect_left(rooms, (room[t], t))]
        room[t] -= gain
        target[t] = room[t] > 0
        if target[t]:
            insort(rooms, (room[t], t))
            for v in new:
                heappush(heaps.setdefault(v, []), (-room[t], t))
                most[v] = max(most[v], room[t])

    def true_first(v: int) -> bool:
        """Whether the first entry for v holds; otherwise it is put right."""
        heap = heaps[v]
        r, b = heap[0]
        if target[b] and v in held[b]:
            if room[b] == -r:
                return True
            heapreplace(heap, (-room[b], b))
        else:
            heappop(heap)
        most[v] = -heap[0][0] if heap else 0
        return False

    changed = False
    while rooms:
        _, d = rooms.pop()
        target[d] = False
        own, pairs = held[d], None
        while own and rooms:
            widest = rooms[-1][0]
            v = max((v for v in own if v <= widest), default=0)
            if v:  # move
                t = rooms[bisect_left(rooms, (v, -1))][1]
                put(t, take(d, v))
                fuller(t, v, (v,))
                room[d] += v
                changed, pairs = True, None
                continue
            if pairs is None:  # what the donor can give: one document, or two together
                pairs = {v: (v,) for v in own}
                kinds = sorted(own)
                for n, v in enumerate(kinds):
                    for w in kinds[n if len(own[v]) > 1 else n + 1 :]:
                        if v + w > capacity:
                            break
                        pairs.setdefault(v + w, (v, w))
                sums = np.asarray(sorted(pairs))
            # the shortest length below each sum whose bin has room for the difference
            found = np.searchsorted(np.maximum.accumulate(at + most), sums)
            gain = np.where(found < sums, sums - found, 0)
            n = int(gain.argmax())
            if not gain[n]:
                break
            v, g = int(found[n]), int(gain[n])
            if not true_first(v):
                continue
            t, given = heaps[v][0][1], pairs[int(sums[n])]
            back = take(t, v)
            for w in given:
                put(t, take(d, w))
            put(d, back)
            fuller(t, g, given)
            room[d] += g
            changed, pairs = True, None
    bins[:] = [[i for v in sorted(h, reverse=True) for i in h[v]] for h in held]
    return changed


def _pack(held: list[tuple], capacity: int, first: int) -> tuple[list[tuple], int]:
    """Rows of the held short pieces, and the next free sequence number; pieces of underfull sequences keep ``open``."""
    lengths = [len(x[3]) // 4 for x in held]
    rows = []
    for b in swap_search(lengths, best_fit(lengths, capacity), capacity):
        at, short = 0, sum(lengths[i] for i in b) < capacity
        for i in b:
            doc, piece, start, tokens, key = held[i]
            rows.append((doc, piece, start, lengths[i], tokens, first, at, key if short else None))
            at += lengths[i]
        first += 1
    return rows, first


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 4000):
        part = rows[i : i + 4000]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], f.type) for c, f in enumerate(schema)], schema=schema)


def _repacked(bins: DataFrame, capacity: int) -> DataFrame:
    """Each partition's sequences packed anew together: the better of a search from them as they are and of one from best fit."""
    schema = pa.schema([("sequence_id", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, lengths, given = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for k, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                given.append(list(range(len(keys), len(keys) + len(k))))
                keys += k
                lengths += n
        found = min((swap_search(lengths, b, capacity) for b in (given, best_fit(lengths, capacity))), key=len)
        yield from _batches([(s, sum(lengths[i] for i in b), [keys[i] for i in b], [lengths[i] for i in b]) for s, b in zip(sorted(ids), found)], schema)

    return bins.mapInArrow(task, BINS)


def _placed(pieces: DataFrame, capacity: int, chunk: int) -> DataFrame:
    """Places (open, sequence_id, offset) of the pieces of underfull sequences after all of them have met.

    Each round deals the sequences that are still underfull over partitions of
    about ``chunk`` pieces and packs these anew, until a round empties none. Only
    keys and lengths move.
    """
    pair = F.sort_array(F.collect_list(F.struct("offset", "open", F.col("length").cast("int").alias("length"))))
    bins = pieces.filter("open is not null").groupBy("sequence_id").agg(F.sum("length").alias("size"), pair.alias("p"))
    bins = written(bins.select("sequence_id", "size", F.col("p.open").alias("keys"), F.col("p.length").alias("lengths")), "bins")
    settled, count = [], lambda b: b.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    n, parts = count(bins)
    while n > 1:
        split = -(-parts // chunk)
        after = written(_repacked(bins.repartition(split), capacity), "bins")
        all_, _ = count(after)
        settled.append(after.filter(F.col("size") == capacity))
        bins, emptied = after.filter(F.col("size") < capacity), n - all_
        n, parts = count(bins)
        if not emptied or split == 1:
            break
    for s in settled:
        bins = bins.unionByName(s)
    at = F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.struct(F.element_at("keys", i).alias("open"), F.aggregate(F.slice("lengths", 1, i - 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("offset")))
    return bins.select("sequence_id", F.explode(at).alias("a")).select("a.open", "sequence_id", "a.offset")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = 20_000, memo: int = MEMO) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces
    of ``capacity``. Returns per piece: doc_id, piece, start, length, tokens
    (little-endian unsigned 32-bit), sequence_id, offset.

    Each task encodes its rows and packs pieces ``chunk`` at a time, so memory does
    not depend on the data; this is written. Pieces of sequences that are then
    underfull, of whatever task, are packed again together (``_placed``) and joined
    to their new places, so the count does not follow the layout of the files. Null and empty texts give one
    piece that holds ``end_id``; repeated rows are packed once each; null ids
    stay null; an empty table gives no rows; other columns are not read.
    """
    path = tokenizer or tokenizer_file("word_bpe_49k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, wide = word_encoder(path, memo), capacity * 4
        number, held = TaskContext.get().partitionId() << 36, []
        key = number
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, rows = batch.slice(lo, 500), []
                for doc, raw in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    raw += end
                    whole = len(raw) // wide
                    for k in range(whole):
                        rows.append((doc, k, k * capacity, capacity, raw[k * wide : (k + 1) * wide], number, 0, None))
                        number += 1
                    if len(raw) > whole * wide:
                        held.append((doc, whole, whole * capacity, raw[whole * wide :], key))
                        key += 1
                yield from _batches(rows, schema)
                if len(held) >= chunk:
                    rows, number = _pack(held, capacity, number)
                    held = []
                    yield from _batches(rows, schema)
        if held:
            yield from _batches(_pack(held, capacity, number)[0], schema)

    own = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, SCHEMA + ", open long"), "pieces")
    moved = own.filter("open is not null").drop("sequence_id", "offset").join(_placed(own, capacity, chunk), "open")
    return own.filter("open is null").drop("open").unionByName(moved.drop("open"))


def pieces_digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with the crc32 of their ids in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")
