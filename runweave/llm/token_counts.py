"""Token counts by section: whole documents are encoded once, token spans are joined to section spans.

The tokenizer is a byte-level BPE whose pretokens are found by one public
pattern; the ids and offsets of a text are those of its pretokens in order, so
each distinct pretoken is encoded once per Python worker.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MEMO, tokenizer_file

RULES = ("start", "end", "majority", "split")


class SpanEncoder:
    """Character spans of a byte-level BPE's tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Start and end (code points, end exclusive) of each token of each text."""
        split = [self.find(t) for t in texts]
        memo = self.memo
        new = list({p for ps in split for p in ps if p not in memo})
        got = {}
        for p, e in zip(new, self.tok.encode_batch(new, add_special_tokens=False)):
            got[p] = tuple(x for s in e.offsets for x in s) if len(e.ids) > 1 else (0, len(p))
        if got and len(memo) + len(got) <= MEMO:
            memo.update(got)
            got = {}
        out = []
        for ps in split:
            sizes = np.fromiter(map(len, ps), np.int64, len(ps))
            base = np.cumsum(sizes) - sizes
            own = [memo.get(p) or got[p] for p in ps]
            n = np.fromiter((len(x) // 2 for x in own), np.int64, len(own))
            flat = np.array([v for x in own for v in x], np.int64).reshape(-1, 2) + np.repeat(base, n)[:, None]
            out.append((flat[:, 0], flat[:, 1]))
        return out


@functools.lru_cache(maxsize=4)
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def line_sections(text: str) -> np.ndarray:
    """Bounds of the sections of a text: each line with its line end; k sections have k + 1 bounds."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return np.array([0, *ends], np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and how many tokens cross a bound.

    A token inside one section counts there. One that crosses bounds goes to the
    section of its first character (``start``), of its last (``end``), to the
    one with most of its characters, the earliest of equals (``majority``), or
    to all of them in proportion (``split``).
    """
    n = len(bounds) - 1
    first = np.minimum(np.searchsorted(bounds, starts, "right") - 1, n - 1)
    last = np.minimum(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, n - 1)
    crossing = first != last
    to = last if rule == "end" else first.copy()
    counts = np.zeros(n)
    if rule in ("majority", "split"):
        for k in np.flatnonzero(crossing):
            parts = np.arange(first[k], last[k] + 1)
            own = np.minimum(bounds[parts + 1], ends[k]) - np.maximum(bounds[parts], starts[k])
            if rule == "majority":
                to[k] = parts[np.argmax(own)]
            else:
                counts[parts] += own / own.sum()
        if rule == "split":
            to = to[~crossing]
    counts += np.bincount(to, minlength=n)
    return counts, int(crossing.sum())


def count_tokens(docs: DataFrame, *, rule: str = "majority", sections=line_sections, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_sections, n_crossing, and tokens by section in order.

    One pass, no shuffle. ``sections`` maps a text to its ascending section
    bounds. Null and empty texts have one empty section; repeated rows are each
    counted; an empty table gives no rows; a null id stays null; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_file("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("tokens", pa.list_(pa.float64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                cut = batch.slice(lo, 200)
                texts = [t or "" for t in cut.column(1).to_pylist()]
                rows = []
                for t, (starts, ends) in zip(texts, encoder.spans(texts)):
                    counts, crossing = attribute(starts, ends, sections(t), rule)
                    rows.append((len(starts), len(counts), crossing, counts))
                yield pa.RecordBatch.from_arrays([cut.column(0), *[pa.array([r[c] for r in rows], schema.field(c + 1).type) for c in range(4)]], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, n_tokens long, n_sections long, n_crossing long, tokens array<double>")
