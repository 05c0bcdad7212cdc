"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the elementwise
product (binding) of its letters' vectors, rotated by 2, 1 and 0 places. A text
is the sum (bundle) of its trigrams, a language the bundle of its documents'
bundles; a text goes to the language of the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import forget

DIM = 512
#: Trigram vectors that a Python worker keeps; others are bound anew.
KEPT = 60_000
UNKNOWN = "und"
_BITS = 21


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is none."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Space:
    """Letter and trigram vectors, the same on every worker for one seed."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.kept = np.empty((1024, dim), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = (np.random.default_rng((self.seed, c)).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def bound(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 2 * _BITS, gram >> _BITS & (1 << _BITS) - 1, gram & (1 << _BITS) - 1
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A row for each trigram."""
        rows, asked = self.rows, grams.tolist()
        for g in asked:
            if g not in rows and len(rows) < KEPT:
                if len(rows) == len(self.kept):
                    self.kept = np.concatenate([self.kept, np.empty_like(self.kept)])
                self.kept[len(rows)] = self.bound(g)
                rows[g] = len(rows)
        at = [rows.get(g, -1) for g in asked]
        out = self.kept[at]
        for i in [i for i, r in enumerate(at) if r < 0]:
            out[i] = self.bound(asked[i])
        return out


@functools.lru_cache(maxsize=4)
def space(dim: int, seed: int) -> Space:
    return Space(dim, seed)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of letters and word gaps of the whole text, and their counts."""
    code = _letters()[np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")] if text else np.empty(0, np.int64)
    solid = code != 32
    if not solid.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = code[solid | np.r_[True, solid[:-1]]]  # one gap for each run
    code = np.r_[32, code, 32]
    grams = (code[:-2] << 2 * _BITS) | (code[1:-1] << _BITS) | code[2:]
    return np.unique(grams[code[1:-1] != 32] if len(grams) > 1 else grams, return_counts=True)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", dim: int = DIM, seed: int = 7) -> dict[str, list[float]]:
    """Prototype by label over all rows with a label and letters.

    Each partition bundles its own rows; the sums meet per label on the
    executors, so only one vector per label reaches the driver. Documents count
    by the square root of their trigram counts, so long ones do not outweigh the rest.
    """
    schema = pa.schema([("label", pa.string()), ("sums", pa.list_(pa.float64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: dict[str, dict[int, float]] = {}
        sums: dict[str, np.ndarray] = {}
        own = space(dim, seed)

        def bundle(label: str) -> None:
            c = counts.pop(label)
            grams, n = np.array(list(c), np.int64), np.array(list(c.values()))
            for i in range(0, len(grams), 4096):
                sums[label] = sums.get(label, np.zeros(dim)) + n[i : i + 4096] @ own.vectors(grams[i : i + 4096]).astype(np.float64)

        for batch in _slices(batches):
            met: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, n = trigrams(text)
                if len(grams):
                    met.setdefault(label, []).append((grams, n / np.sqrt(n.sum())))
            for label, pairs in met.items():
                grams, at = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
                c = counts.setdefault(label, {})
                for g, k in zip(grams.tolist(), np.bincount(at, np.concatenate([w for _, w in pairs])).tolist()):
                    c[g] = c.get(g, 0.0) + k
                if len(c) > 200_000:
                    bundle(label)
        for label in list(counts):
            bundle(label)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], schema=schema)

    parts = docs.filter(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).mapInArrow(task, "label string, sums array<double>")
    total = parts.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    out: dict[str, list[float]] = {}
    for r in total.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x")).collect():  # one row of ``dim`` numbers per label
        out[r.label] = [x.v for x in r.x]
    return out


def _predictor(prototypes: dict[str, list[float]], dim: int, seed: int):
    """Label and cosine of each text of a list."""
    labels = sorted(prototypes)
    unit = np.array([prototypes[x] for x in labels], np.float64).reshape(len(labels), dim)
    unit = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predicted(texts: list[str | None]) -> tuple[list[str], list[float]]:
        own, names, scores = space(dim, seed), [], []
        for text in texts:
            grams, n = trigrams(text)
            if not len(grams) or not labels:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            v = np.zeros(dim, np.float32)
            for i in range(0, len(grams), 1024):
                v += n[i : i + 1024].astype(np.float32) @ own.vectors(grams[i : i + 1024]).astype(np.float32)
            cos = unit @ (v / max(float(np.linalg.norm(v)), 1e-12))
            k = int(np.argmax(cos))
            names.append(labels[k])
            scores.append(min(1.0, max(0.0, float(cos[k]))))
        return names, scores

    return predicted


def predict(docs: DataFrame, prototypes: dict[str, list[float]], *, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, seed: int = 7) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the cosine, 0 to 1).

    ``und`` and 0 where the text is null or has no letter, or nothing was
    learned. Ties go to the smaller label. One pass, no shuffle; repeated rows
    are each predicted; an empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    predicted = _predictor(prototypes, dim, seed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, scores = predicted(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, lang_pred string, score double")


def cut_off(docs: DataFrame, prototypes: dict[str, list[float]], *, share: float = 0.002, text_col: str = "text", label_col: str = "lang", **options) -> float:
    """The cosine that all but ``share`` of the labelled rows with letters reach; 0 without such rows.

    ``docs`` should be rows that were not learned from. One pass; the quantile is within 0.0001 of its rank.
    """
    known = docs.filter(F.col(label_col).isNotNull()).select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scores = predict(known, prototypes, **options).filter(F.col("lang_pred") != UNKNOWN)
    return scores.agg(F.percentile_approx("score", F.lit(share), F.lit(10_000))).first()[0] or 0.0


def keep_known(docs: DataFrame, prototypes: dict[str, list[float]], *, text_col: str = "text", min_score: float = 0.1, dim: int = DIM, seed: int = 7) -> DataFrame:
    """The rows, all columns as they are, whose text has letters and a cosine of ``min_score`` or more."""
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("known", T.BooleanType())])
    task = _predictor(prototypes, dim, seed)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in _slices(batches):
            names, scores = task(batch.column(1).to_pylist())
            known = [n != UNKNOWN and s >= min_score for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.bool_())], names=["row", "known"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judged, schema).filter("known").select("row.*")


def languages(docs: DataFrame, **options) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row: doc_id, held_out, lang_pred, score."""
    prototypes = learn(docs.filter(~is_held_out(F.col("doc_id"))), **options)
    return predict(docs, prototypes, **options).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
