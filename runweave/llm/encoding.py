"""Whole-text encoding with a public tokenizer, memoised by white-space chunk.

Both tokenizers used here never join characters across the places where a text
is cut below, so the ids of a text are the ids of its chunks in order. Each
distinct chunk is encoded once per Python worker. The memo holds at most
``MEMO`` chunks, or as many as are asked for; beyond that, chunks are still encoded, but not kept.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np

MEMO = 400_000
#: Distinct runs of symbols that are kept.
TAILS = 50_000
#: Words to a text when many are encoded at once, and the first letter that the plainer tokenizer is not given.
WORDS, BEYOND = 200, "\u0530"
#: Characters that Python and the tokenizer treat differently when splitting or lower-casing.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ")
#: ASCII characters that are no letter, number or space; without the apostrophe, which may begin a piece with letters.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Chunks that are kept; those of the present call that find no room stand in ``rest``."""

    rest: dict[str, bytes] = {}

    def __missing__(self, w: str) -> bytes:
        return self.rest[w]


class WordEncoder:
    """Ids of a lower-casing word BPE (each word ends in a piece with ``</w>``)."""

    def __init__(self, path: str, most: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.special = sorted(t for t in (x.content for x in self.tok.get_added_tokens_decoder().values()))
        self.plain = self._plainer()
        self.memo = Memo()
        self.tails: dict[str, bytes] = {}
        self.most = most

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plainer(self):
        """The same model behind a split at spaces, for lower-case words of letters that are one piece each; None where it may differ."""
        from tokenizers import Tokenizer, pre_tokenizers

        kind = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        match kind.get("pretokenizers"):
            case [{"type": "Split", "pattern": {"Regex": pattern}, "invert": True, "behavior": "Removed"}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}] if "|[\\p{L}]+|" in pattern:
                plain = Tokenizer(self.tok.model)
                plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
                return plain

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, many to a text; cut after each piece that ends a word."""
        out: list[bytes] = []
        parts = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
        for k in range(0, len(parts), 50):
            texts = [" ".join(part) for part in parts[k : k + 50]]
            plain = self.plain and all(t.isascii() or max(t) < BEYOND for t in texts)
            for part, e in zip(parts[k : k + 50], (self.plain if plain else self.tok).encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.asarray(e.ids, "<u4")
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) != len(part):
                    out += self._direct(part)
                    continue
                raw, at = ids.tobytes(), [0, *(cut * 4).tolist()]
                out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Encodes the chunks not met before; a chunk of letters and then only stops and symbols is put together from the two, which the tokenizer cuts apart."""
        memo, tails = self.memo, self.tails
        plain, joined, other = set(), [], []
        for w in missing:
            core = w.rstrip(_TAIL)
            if not core.isalpha():
                other.append(w)
            elif core == w:
                plain.add(w)
            else:
                joined.append((w, core, w[len(core) :]))
                if core not in memo:
                    plain.add(core)
        words = list(plain)
        got = dict(zip(words, self._letters(words)))
        got.update(zip(other, self._direct(other)))
        if len(tails) > TAILS:
            tails.clear()
        new = list({tail for _, _, tail in joined} - tails.keys())
        tails.update(zip(new, self._direct(new)))
        for w, core, tail in joined:
            ids = got.get(core)
            got[w] = (memo[core] if ids is None else ids) + tails[tail]
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        memo, split, odd = self.memo, [], {}
        missing: set[str] = set()
        for i, t in enumerate(texts):
            t = t or ""
            if any(c in t for c in _ODD) or any(s in t for s in self.special):
                odd[i] = t
                split.append([])
                continue
            if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            words = t.lower().split()
            split.append(words)
            missing.update(w for w in set(words) if w not in memo)
        got = self._learn(missing) if missing else {}
        room = max(0, self.most - len(memo))
        if room < len(got):
            memo.update(list(got.items())[:room])
            memo.rest = got
        else:
            memo.update(got)
        of = memo.__getitem__
        out = [b"".join(map(of, ws)) for ws in split]
        memo.rest = {}
        if odd:
            for i, raw in zip(odd, self._direct(list(odd.values()))):
                out[i] = raw
        return out


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, most: int = MEMO) -> WordEncoder:
    """One encoder per Python worker, file and size of memo."""
    return WordEncoder(path, most)


def forget() -> None:
    """Frees the encoders that earlier tasks left in this Python worker."""
    word_encoder.cache_clear()
