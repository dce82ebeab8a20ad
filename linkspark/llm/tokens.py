"""Token ids of whole texts by a public tokenizer file, at the cost of its new words.

A byte-level BPE first cuts a text into pieces (words with the blank before them, digits, signs, white
space) and merges inside each piece only. So the ids of a text are those of its pieces, and a piece met
before needs no merging: pieces are cut and looked up by 64-bit fingerprints for a batch of texts at once,
and the library's model is asked for new pieces alone. Texts that the fast cut doesn't surely cut as the
library does (letters beyond Latin-1, apostrophes, control characters, special tokens) go through the
library whole. The store of pieces has a bound; beyond it new pieces are merged again each time.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
TOKENIZER = "byte_bpe_50k.json"
CHUNK_BYTES = 1 << 20
KNOWN_PIECES = 3_000_000

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_LETTER, _DIGIT, _SIGN, _BLANK, _SPACE = range(5)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    kind = np.full(256, _SIGN, np.int8)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[32] = _BLANK
    kind[9:14] = _SPACE
    return kind


def _strange() -> np.ndarray:
    """Bytes that send a text to the library: controls, the apostrophe, and leads of all but U+00C0-U+00FF."""
    odd = np.zeros(256, bool)
    odd[[*range(9), *range(14, 32), 39, 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True
    return odd


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stay, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_KIND, _ODD, _MIX = _classes(), _strange(), np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64)
_AS_LETTER = dict(enumerate(_byte_letters()))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Encoder:
    def __init__(self, path: str, most: int = KNOWN_PIECES):
        self.most = most  # pieces to keep
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                           and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
                           and not spec["model"].get("ignore_merges"))
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self._keys = np.empty(0, np.uint64)  # sorted fingerprints, and where their ids lie in _flat
        self._at = self._count = np.empty(0, np.int64)
        self._flat, self._powers, self._inverses = array("I"), _powers(_P, CHUNK_BYTES), _powers(_P_INVERSE, CHUNK_BYTES)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of each text; a null text has none."""
        texts = texts.cast(pa.large_string())
        if len(texts) == 0:
            return []
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out: list[np.ndarray] = []
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            last = min(last, len(texts))
            out += self._chunk(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            first = last
        return out

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n, sizes = len(data), np.diff(offsets)
        whole = np.full(len(sizes), not self.byte_level)
        if n and self.byte_level:
            odd = _ODD[data]
            odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among the letters
            before = np.concatenate([[0], np.cumsum(odd)])
            whole |= before[offsets[1:]] > before[offsets[:-1]]
            raw = data.tobytes()
            for special in self.specials:
                if special in raw:
                    whole |= np.array([special in raw[a:b] for a, b in zip(offsets, offsets[1:])])
        out: list = [np.empty(0, np.uint32)] * len(sizes)
        odd_ones = [i for i in np.flatnonzero(whole).tolist() if sizes[i]]
        if odd_ones:
            texts = [data[offsets[i]:offsets[i + 1]].tobytes().decode() for i in odd_ones]
            for i, e in zip(odd_ones, self.library.encode_batch(texts, add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        plain = np.flatnonzero(~whole & (sizes > 0))
        if len(plain) < len(sizes):
            if not len(plain):
                return out
            data = np.concatenate([data[offsets[i]:offsets[i + 1]] for i in plain])
            offsets = np.concatenate([[0], np.cumsum(sizes[plain])])
        ids, ends = self._pieces(data, offsets)
        for i, a, b in zip(plain.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[i] = ids[a:b]
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and where each text's ids begin."""
        n = len(data)
        kind = _KIND[data]
        white = kind >= _BLANK
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True
        opens, after = opens[:-1], opens[1:]
        white_before = np.concatenate([[False], white[:-1]]) & ~opens
        white_after = np.concatenate([white[1:], [True]]) | after
        blank_before = np.concatenate([[False], data[:-1] == 32]) & ~opens
        other_before = np.concatenate([[True], kind[1:] != kind[:-1]])
        # white space: a run is one piece, but before a word its last character stands alone or goes with the word
        start = np.where(white, ~white_before | ~white_after, (opens | other_before) & ~blank_before)
        starts = np.flatnonzero(start)
        if n > len(self._powers):
            self._powers, self._inverses = _powers(_P, n), _powers(_P_INVERSE, n)
        keys = np.add.reduceat(_MIX[data] * self._powers[:n], starts) * self._inverses[starts]
        codes, distinct = pd.factorize(keys)
        at, count, flat = self._lookup(distinct, codes, starts, data)
        counts = count[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(at[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offsets)]

    def _lookup(self, distinct, codes, starts, data):
        found = np.searchsorted(self._keys, distinct)
        held = found < len(self._keys)
        held[held] = self._keys[found[held]] == distinct[held]
        at, count = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        at[held], count[held] = self._at[found[held]], self._count[found[held]]
        new = np.flatnonzero(~held)
        known = len(self._flat)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            stops = np.append(starts[1:], len(data))
            raw, tokenize, flat, lengths = data.tobytes().decode("latin-1"), self.library.model.tokenize, self._flat, []
            where = first[new]
            for a, b in zip(starts[where].tolist(), stops[where].tolist()):
                ids = [t.id for t in tokenize(raw[a:b].translate(_AS_LETTER))]
                flat.extend(ids)
                lengths.append(len(ids))
            count[new] = lengths
            at[new] = known + np.cumsum(lengths) - lengths
        flat = np.array(self._flat, np.uint32)
        if len(new):
            if len(self._keys) + len(new) <= self.most:
                order = new[np.argsort(distinct[new])]
                place = np.searchsorted(self._keys, distinct[order])
                self._at = np.insert(self._at, place, at[order])
                self._count = np.insert(self._count, place, count[order])
                self._keys = np.insert(self._keys, place, distinct[order])
            else:
                del self._flat[known:]
        return at, count, flat


@lru_cache(maxsize=2)
def encoder(path: str, most: int = KNOWN_PIECES) -> Encoder:
    """One per worker process; workers outlive tasks, and so do the pieces they know."""
    return Encoder(path, most)
