"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword of bits. One binary classifier per bit tells the languages whose codeword has
a 1 there from the others: the log odds of hashed character n-grams under both sides (one counting pass over
the labelled rows; every language weighs the same). A text's margins are decoded by loss: the language whose
codeword loses least, each bit weighted by how well it parts the languages, wins; a near tie is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import wordhash as W

BUCKETS = 1 << 14
NGRAMS = (1, 2, 3)
SMOOTHING = 0.5
AMBIGUOUS = 0.02  # least lead, as a share of the largest possible loss, that is no near tie
UNDETERMINED = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_CHUNK = 1 << 18  # bytes of text that are looked at together


def codewords(n: int) -> np.ndarray:
    """n different rows of +-1 bits: all ways to part up to 7 languages in two, else rows of a seeded random
    code of 15 * log2(n) bits whose rows and columns all differ and whose columns part the languages."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 7:
        half = np.arange(1, 1 << (n - 1))
        return np.vstack([-np.ones(len(half), np.int8),
                          *[np.where(half >> i & 1, 1, -1).astype(np.int8) for i in range(n - 1)]])
    bits, rng = int(15 * np.ceil(np.log2(n))), np.random.default_rng(n)
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if len(np.unique(code, axis=0)) == n and (abs(code.sum(axis=0)) < n).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # NGRAMS * BUCKETS x bits, float32
    weights: np.ndarray  # of the bits


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[*range(0, 33), *range(48, 58)]] = 32  # white space, controls and digits are word ends alike
    return table


_LOWER = _lower()


def _features(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the feature of the n bytes that end at each byte; before each text's start lie spaces."""
    b = _LOWER[data].astype(np.uint32)
    out, code = [b], b
    for n in (1, 2):
        earlier = np.concatenate([np.full(n, 32, np.uint32), b[:-n]]) if len(b) > n else np.full(len(b), 32, np.uint32)
        for k in range(n):  # the k-th byte of a text, or one of a text that follows as closely
            earlier[starts[starts + k < len(b)] + k] = 32
        code = code | earlier << np.uint32(8 * n)
        out.append((code * _MIX[n]) >> np.uint32(32 - 14))
    return out


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK bytes each, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1))
        yield first, last
        first = last


def _stretches(data: np.ndarray, starts: np.ndarray) -> Iterator[list[np.ndarray]]:
    """``_features`` of a chunk; those of a text longer than a chunk stretch by stretch."""
    if len(starts) > 1 or len(data) <= _CHUNK:
        yield _features(data, starts)
        return
    for at in range(0, len(data), _CHUNK):
        before = min(at, 2)  # the n-grams of a stretch's first bytes begin in the stretch before
        own = _features(data[at - before:at + _CHUNK], starts)
        yield [x[before:] for x in own]


def train(rows: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Fit on all given rows with a label: n-gram counts per language, added up over the partitions.

    What comes to the driver is the model's size: languages x (at most 3 * 2**14 counts). Rows with a null
    label or text are left out; without any labelled row the model knows no language.
    """
    names = [r[0] for r in rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).groupBy(label).count().select(label).collect()]
    languages = sorted(names)
    place = {name: i for i, name in enumerate(languages)}
    width = len(NGRAMS) * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), width), np.int64)
        for batch in batches:
            data, offsets = W.buffers(batch.column(0))
            labels = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in _chunks(data, offsets):
                part = data[offsets[a]:offsets[b]]
                which = np.repeat(labels[a:b], np.diff(offsets[a:b + 1]))
                seen = 0
                for features in _stretches(part, offsets[a:b] - offsets[a]):
                    own = which[seen:seen + len(features[0])]
                    seen += len(own)
                    for n, feature in enumerate(features):
                        found = np.bincount(own * BUCKETS + feature, minlength=len(languages) * BUCKETS)
                        totals[:, n * BUCKETS:(n + 1) * BUCKETS] += found.reshape(len(languages), BUCKETS)
        language, feature = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(feature, pa.int32()),
                                          pa.array(totals[language, feature], pa.int64())], ["language", "feature", "n"])

    used = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(text, label)
    counts = (used.mapInArrow(count, "language int, feature int, n bigint")
              .groupBy("language", "feature").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((len(languages), width))
    table[counts["language"].to_numpy(), counts["feature"].to_numpy()] = counts["n"].to_numpy()
    return fit(languages, table)


def fit(languages: list[str], counts: np.ndarray) -> Model:
    if not languages:
        return Model([], np.ones((0, 1), np.int8), np.zeros((counts.shape[1] if counts.ndim == 2 else 1, 1), np.float32), np.ones(1))
    code = codewords(len(languages))
    shares = np.empty_like(counts)
    for n in range(len(NGRAMS)):
        own = counts[:, n * BUCKETS:(n + 1) * BUCKETS] + SMOOTHING
        shares[:, n * BUCKETS:(n + 1) * BUCKETS] = own / own.sum(axis=1, keepdims=True)
    odds, weights = [], []
    for bit in code.T:
        if (bit > 0).all() or (bit < 0).all():  # a single language: nothing to tell apart
            odds.append(np.ones(counts.shape[1]))
            weights.append(1.0)
            continue
        one, other = shares[bit > 0].mean(axis=0), shares[bit < 0].mean(axis=0)
        odds.append(np.log(one / other))
        weights.append(float(((one - other) * odds[-1]).sum()))  # how far the two sides lie apart
    weights = np.array(weights)
    return Model(languages, code, np.stack(odds, axis=1).astype(np.float32), weights / weights.sum())


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) for rows of margins: means of the log odds over a text's n-grams."""
    push = np.tanh(2 * margins)[:, None, :] * model.code  # 1: the bit surely agrees with the codeword
    loss = ((1 - push) / 2 * model.weights).sum(axis=2)
    best = loss.argmin(axis=1)
    order = np.sort(loss, axis=1)
    lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.ones(len(loss))
    likely = np.exp(-20 * (loss - order[:, :1]))
    return best, 1 / likely.sum(axis=1), lead < AMBIGUOUS


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; the whole text counts, nothing else.

    A text that is null or has no letter is ``und`` with score 0, and so is any text if no language is known.
    Columns of these names are replaced.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")
    at, names = kept.columns.index(text), kept.columns

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            data, offsets = W.buffers(texts)
            margins = np.zeros((len(texts), model.odds.shape[1]))
            for a, b in _chunks(data, offsets):
                part, starts = data[offsets[a]:offsets[b]], offsets[a:b] - offsets[a]
                full = np.flatnonzero(np.diff(offsets[a:b + 1]) > 0)
                if not len(full):
                    continue
                sums = 0
                for features in _stretches(part, starts):
                    for n, feature in enumerate(features):
                        sums = sums + np.add.reduceat(model.odds[n * BUCKETS + feature], starts[full], axis=0)
                margins[a + full] = sums / (len(NGRAMS) * np.diff(offsets[a:b + 1])[full, None])
            told = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)
            told &= bool(model.languages)
            if model.languages:
                best, score, near = decide(model, margins)
            else:
                best, score, near = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            chosen = [model.languages[k] if t else UNDETERMINED for k, t in zip(best, told)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chosen, pa.string()), pa.array(np.where(told, score, 0.0)), pa.array(near & told)],
                [*names, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(tell, f"{fields}, lang_pred string, score double, ambiguous boolean")
