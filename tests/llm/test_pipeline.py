"""The whole pipeline, and language profiles, against plain versions."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from runweave.llm import encoding, langid

from test_brute import CARD, EMAIL, IP, PHONE, SF, components, luhn

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?:[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9_-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def bundle(text, dim=langid.DIM, seed=7):
    """Sum of the bound vectors of all trigrams, one at a time."""
    letters = lambda c: np.random.default_rng((seed, ord(c))).integers(0, 2, dim, np.int8) * 2 - 1
    plain = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    plain = re.sub(" +", " ", plain).strip()
    out = np.zeros(dim)
    if not plain:
        return out, 0
    padded = f" {plain} "
    memo = {}
    for i in range(1, len(padded) - 1):
        if padded[i] != " ":
            gram = padded[i - 1 : i + 2]
            if gram not in memo:
                memo[gram] = np.roll(letters(gram[0]), 2) * np.roll(letters(gram[1]), 1) * letters(gram[2])
            out += memo[gram]
    return out, sum(c != " " for c in padded)


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def predicted(rows):
    """Language and cosine of each document by profiles of the documents that are not held out."""
    made = {k: bundle(r.text) for k, r in rows.items()}
    sums = collections.defaultdict(lambda: np.zeros(langid.DIM))
    for k, (v, n) in made.items():
        if zlib.crc32(str(k).encode()) % 5 and rows[k].lang is not None and n:
            sums[rows[k].lang] += v / np.sqrt(n)
    names = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    out = {}
    for k, (v, n) in made.items():
        cos = unit @ v / np.linalg.norm(v) if n else None
        out[k] = (names[int(np.argmax(cos))], float(np.clip(cos.max(), 0, 1))) if n else ("und", 0.0)
    return out


def test_language_profiles_against_trigrams_one_by_one(spark, predicted):
    got = {r.doc_id: r for r in langid.languages(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got.keys() == predicted.keys()
    for k, (name, score) in predicted.items():
        assert got[k].lang_pred == name and got[k].score == pytest.approx(score, abs=1e-4)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_equal_languages_go_to_the_smaller_label(spark):
    d = spark.createDataFrame([(i, "same letters here", x) for i, x in ((1, "b"), (2, "a"), (3, "b"), (4, "a"), (6, "a"), (7, "b"))], "doc_id long, text string, lang string")
    profile = langid.learn(d.filter("lang = 'a'"))["a"]
    assert {r.lang_pred for r in langid.predict(d, {"b": profile, "a": profile}).collect()} == {"a"}


def ascii_words(text):
    return [m.group().translate({c: c + 32 for c in range(65, 91)}) for m in WORD.finditer(text or "")]


def leaks_cut(text, items):
    words = ascii_words(text)
    hit = set()
    for own in items:
        for i in range(max(1, len(own) - 9) if own else 0):
            window = own[i : i + 10]
            hit.update(k for j in range(len(words) - len(window) + 1) if words[j : j + len(window)] == window for k in range(j, j + len(window)))
    places = iter(range(len(words)))
    return WORD.sub(lambda m: "" if next(places) in hit else m.group(), text) if hit else text


def redacted(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m, "EMAIL", 0) for m in EMAIL.finditer(text)]
    found += [(m, "IP", 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m, "CARD", 2) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(m.group())]
    found += [(m, "PHONE", 3) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    spans = [(m.start(), r, m.end(), k) for m, k, r in found]
    for pattern, kind, rank, score, words in ((IBAN, "IBAN", 4, 0.8, "iban|account|bank|konto|compte|cuenta"), (SECRET, "SECRET", 5, 0.4, "token|secret|key|password|passwd|auth|credential|bearer"), (SSN, "SSN", 6, 0.3, "ssn|social security")):
        every = list(pattern.finditer(text))
        for i, m in enumerate(every):
            if kind == "IBAN":
                c = m.group().replace(" ", "")
                if int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 != 1:
                    continue
            before = text[every[i - 1].end() if i else 0 : m.start()][-40:]
            after = text[m.end() : every[i + 1].start() if i + 1 < len(every) else None][:40]
            near = re.search(rf"\b(?:{words})", f"{before} {after}".lower(), re.ASCII)
            if score + (0.4 if near else 0.0) >= 0.6:
                spans.append((m.start(), rank, m.end(), kind))
    out, at = [], 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_against_plain_versions(spark, rows, predicted):
    least = min(s for k, (x, s) in predicted.items() if x != "und" and zlib.crc32(str(k).encode()) % 5 == 0 and rows[k].lang is not None)
    kept = [k for k in sorted(rows) if predicted[k][0] != "und" and predicted[k][1] >= least - 1e-9]
    comps = components([(k, rows[k].text) for k in kept], 5, 80)
    kept = [k for k in kept if not comps[k][0] or comps[k][1] == k]
    items = [ascii_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {k: redacted(leaks_cut(rows[k].text, items)) for k in kept}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.tokenizer_file("word_bpe_49k.json"))
    want = set()
    for k, text in texts.items():
        ids = np.asarray([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want |= {(k, i // 2048, i, min(2048, len(ids) - i), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
