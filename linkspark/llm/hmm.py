"""A hidden Markov language model: Baum-Welch over the training documents, exact likelihoods of all.

The latent states emit classes of words: each of the OWN most frequent words is a class, all other words fall
into TAIL classes by their fingerprint, and the end of a text is a class. Within a class a word has its
share of the class's smoothed counts, and each class keeps the share of one unseen word, so the probabilities
of a class sum to one and the model is bounded however many words there are. Word counts are aggregated over
the cluster; the HOT most frequent words travel with the tasks, all others are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import wordhash as W
from linkspark.session import cut

STATES, ROUNDS = 8, 5
OWN, TAIL, HOT = 4_096, 1_024, 200_000
CLASSES = OWN + TAIL + 1
END = CLASSES - 1
BATCH_TOKENS = 1_000_000
PRIOR = 200.0  # tokens' worth of the class frequencies added to every state
_HELD = 2_000_000


# --- vocabulary --------------------------------------------------------------------------------------

@dataclass
class Vocabulary:
    words: DataFrame  # (word, n), stored
    tokens: int  # in the training documents, ends included
    distinct: int  # the end included
    ends: int
    hot: np.ndarray  # fingerprints of the HOT most frequent words, sorted
    hot_n: np.ndarray
    hot_class: np.ndarray
    class_n: np.ndarray  # training tokens by class
    mass: np.ndarray  # smoothed probability of each class, that of one unseen word included in the tail's

    def log_base(self, n):
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts, combined before they leave it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def combined():
        keys = np.concatenate([k for k, _ in held])
        codes, distinct = pd.factorize(keys)
        return distinct, np.bincount(codes, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def out(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for _, _, data, offsets in W.chunks(batch.column(0)):
            prints = W.words(data, offsets, lower=True)[2]
            codes, distinct = pd.factorize(prints)
            held.append((distinct, np.bincount(codes, minlength=len(distinct)).astype(np.int64)))
            size += len(distinct)
            if size > _HELD:
                held = [combined()]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*combined())


def count_words(train: DataFrame, text: str = "text") -> Vocabulary:
    words = cut(train.select(text).mapInArrow(_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    ends = train.count()
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (total.n or 0) + ends, total.v + (ends > 0)
    top = words.orderBy(F.desc("n"), "word").limit(HOT).toPandas()  # HOT rows at most
    hot, hot_n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    hot_class = OWN + hot % TAIL
    hot_class[:OWN] = np.arange(min(OWN, len(hot)))
    by_bucket = words.groupBy(F.pmod("word", F.lit(TAIL)).alias("bucket")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # TAIL rows
    class_n, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[OWN + by_bucket["bucket"].to_numpy(np.int64)] = by_bucket["n"].to_numpy()
    kinds[OWN + by_bucket["bucket"].to_numpy(np.int64)] = by_bucket["v"].to_numpy()
    own = hot[:OWN]
    np.subtract.at(class_n, OWN + own % TAIL, hot_n[:OWN])
    np.subtract.at(kinds, OWN + own % TAIL, 1)
    class_n[:len(own)], class_n[END] = hot_n[:OWN], ends
    kinds[:len(own)] = kinds[END] = 1
    kinds[OWN:END] += 1  # the unseen word
    mass = (class_n + 0.5 * kinds) / (tokens + 0.5 * (distinct + 1))
    order = np.argsort(hot)
    return Vocabulary(words, tokens, distinct, ends, hot[order], hot_n[order], hot_class[order], class_n, mass)


# --- texts as classes --------------------------------------------------------------------------------

_ENCODED = pa.schema([("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("base", pa.float64()),
                      ("inner", pa.float64()), ("classes", pa.binary()), ("cold", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def encode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` (``row``, ``text``) as ``row``, the classes of the text's tokens, the sums that hot words settle,
    and the other words with their counts.

    ``base`` sums the base logs of hot words and the end, ``inner`` the logs of words within tail classes; to
    both the logs of the cold words are still to be added.
    """
    hot, hot_class, ends = vocabulary.hot, vocabulary.hot_class, vocabulary.ends
    hot_log, end_log = vocabulary.log_base(vocabulary.hot_n), float(vocabulary.log_base(vocabulary.ends))
    log_mass = np.log10(np.maximum(vocabulary.mass, 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.chunks(batch.column(1)):
                _, _, prints, counts = W.words(data, offsets, lower=True)
                words = prints.view(np.int64)
                codes, distinct = pd.factorize(words)
                found = np.searchsorted(hot, distinct)
                found[found == len(hot)] = 0
                is_hot = (hot[found] == distinct) if len(hot) else np.zeros(len(distinct), bool)
                kind = OWN + distinct % TAIL
                log = np.zeros(len(distinct))
                if len(hot):
                    kind[is_hot], log[is_hot] = hot_class[found[is_hot]], hot_log[found[is_hot]]
                classes, logs, known = kind[codes], log[codes], is_hot[codes]
                n = b - a
                doc = np.repeat(np.arange(n), np.diff(counts))
                tail = classes >= OWN
                base = np.bincount(doc, weights=logs, minlength=n) + end_log
                inner = np.bincount(doc[tail], weights=(logs - log_mass[classes])[tail], minlength=n)
                n_hot = np.bincount(doc[known], minlength=n) + (ends > 0)
                ids = np.insert(classes, counts[1:], END).astype("<u2")  # an end after each text
                edges = counts + np.arange(n + 1)
                cold = pd.DataFrame({"doc": doc[~known], "code": codes[~known]})
                pairs = cold.value_counts(sort=False).reset_index()
                cuts = np.searchsorted(pairs["doc"].to_numpy(), np.arange(n + 1))
                own, times = distinct[pairs["code"].to_numpy(np.int64)], pairs["count"].to_numpy(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], pa.array(np.diff(edges)), pa.array(n_hot.astype(np.int64)), pa.array(base, pa.float64()), pa.array(inner, pa.float64()),
                    pa.array([ids[x:y].tobytes() for x, y in zip(edges.tolist(), edges[1:].tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times, pa.int32()))], ["row", *_ENCODED.names])

    return rows.select("row", "text").mapInArrow(
        run, f"row {rows.schema['row'].dataType.simpleString()}, n_tokens bigint, n_hot bigint, base double, inner double, classes binary, cold array<bigint>, times array<int>")


# --- the chain ---------------------------------------------------------------------------------------

@dataclass
class Chain:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # classes x states


class _Packed:
    """Sequences of different lengths laid out step by step, the longest first: one numpy call per step."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than each step
        self.edges = np.concatenate([[0], np.cumsum(alive)])
        self.alive = alive
        flat = np.concatenate([sequences[i] for i in self.order]).astype(np.int64)
        within = np.concatenate([np.arange(n) for n in lengths])
        self.tokens = np.empty(len(flat), np.int64)
        self.tokens[self.edges[within] + np.repeat(np.arange(len(lengths)), lengths)] = flat
        self.lengths = lengths


def forward(chain: Chain, packed: _Packed) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and scales of every position; the product of a sequence's scales is its likelihood."""
    alpha = np.empty((len(packed.tokens), len(chain.start)))
    scale = np.empty(len(packed.tokens))
    edges, previous = packed.edges.tolist(), None
    for a, b in zip(edges, edges[1:]):
        now = chain.start if previous is None else previous[:b - a] @ chain.step
        now = now * chain.emit[packed.tokens[a:b]]
        scale[a:b] = now.sum(axis=1)
        now /= scale[a:b, None]
        alpha[a:b] = previous = now
    return alpha, scale


def log_likelihoods(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    packed = _Packed(sequences)
    logs = np.log10(forward(chain, packed)[1])
    row = np.concatenate([np.arange(n) for n in packed.alive])
    out = np.empty(len(sequences))
    out[packed.order] = np.bincount(row, weights=logs, minlength=len(sequences))
    return out


def expected(chain: Chain, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, steps and emissions (forward-backward)."""
    packed = _Packed(sequences)
    alpha, scale = forward(chain, packed)
    steps, edges = np.zeros_like(chain.step), packed.edges.tolist()
    beta = np.ones((0, len(chain.start)))
    for t in range(len(edges) - 2, -1, -1):
        a, b = edges[t], edges[t + 1]
        own = np.ones((b - a, len(chain.start)))
        own[:len(beta)] = beta  # sequences that end here have beta one
        if t:
            weighed = own * chain.emit[packed.tokens[a:b]] / scale[a:b, None]
            before = edges[t - 1]
            steps += alpha[before:before + b - a].T @ weighed
            beta = weighed @ chain.step.T
        alpha[a:b] *= own
    emit = np.stack([np.bincount(packed.tokens, weights=alpha[:, s], minlength=CLASSES) for s in range(alpha.shape[1])], axis=1)
    return alpha[:edges[1]].sum(axis=0), steps * chain.step, emit


def initial(vocabulary: Vocabulary, states: int = STATES, seed: int = 5) -> Chain:
    """States that stay, and that favour different words by chance."""
    rng = np.random.default_rng(seed)
    share = vocabulary.class_n + 0.5
    emit = share[:, None] * np.exp(rng.normal(0, 1, (CLASSES, states)))
    return Chain(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list]]:
    """(classes, ids) of about BATCH_TOKENS tokens; a sequence is never cut."""
    sequences, ids, held = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        for own in batch.column(1):
            sequences.append(np.frombuffer(own.as_buffer(), "<u2"))
            held += len(sequences[-1])
            if held >= BATCH_TOKENS:
                done = len(sequences)
                yield sequences, ids[:done]
                sequences, ids, held = [], ids[done:], 0
    if sequences:
        yield sequences, ids


def baum_welch(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Fit on all rows of ``encoded``: a round adds up the tasks' expected counts by class and re-estimates."""
    chain = initial(vocabulary, states)
    share = (vocabulary.class_n + 0.5) / (vocabulary.class_n + 0.5).sum()
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], chain=chain) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + states + CLASSES, states))
            for sequences, _ in _batches(batches):
                first, steps, emit = expected(chain, sequences)
                total += np.concatenate([first[None], steps, emit])
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(total[rows, i]) for i in range(states)]], ["row", *names])

        summed = (encoded.select(F.col("row._rid"), "classes").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names))
                  .groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas())  # the model's size
        total = np.zeros((1 + states + CLASSES, states))
        total[summed["row"].to_numpy()] = summed[names].to_numpy()
        first, steps, emit = total[0] + 0.1, total[1:1 + states] + 0.1, total[1 + states:] + PRIOR * share[:, None]
        chain = Chain(first / first.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return chain


def score(docs: DataFrame, learn, text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (without ``text``) plus ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``learn`` is a condition that marks the training rows. Tokens are the text's words (A-Z in lower case, cut
    at ASCII white space) and one end; a null or empty text is the end alone. Scores are log10 probabilities.
    Without training rows every word is unseen and the states are the initial ones. Repeated rows are scored
    each; other columns ride along, columns of the result's names are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    rows = docs.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    vocabulary = count_words(rows.filter("_learn").select(text), text)
    # the id is stored together with what is made from the row, so it is drawn once
    own = F.struct(F.monotonically_increasing_id().alias("_rid"), *rest, "_learn")
    encoded = cut(encode(rows.select(own.alias("row"), F.col(text).alias("text")), vocabulary))
    chain = baum_welch(encoded.filter("row._learn"), vocabulary, states, rounds)

    total = vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)
    cold = encoded.select(F.col("row._rid").alias("_rid"), F.inline(F.arrays_zip("cold", "times")))
    looked = cold.join(vocabulary.words.withColumnRenamed("word", "cold"), "cold", "left")
    sums = looked.groupBy("_rid").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / total)).alias("cold_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("cold_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequences, ids in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(log_likelihoods(chain, sequences))],
                                             ["_rid", "chain_log"])

    chains = encoded.select(F.col("row._rid").alias("_rid"), "classes").mapInArrow(run, "_rid bigint, chain_log double")
    plain = encoded.select("row", F.col("row._rid").alias("_rid"), "n_tokens", "n_hot", "base", "inner")
    joined = plain.join(chains, "_rid").join(sums, "_rid", "left")
    cold_log = F.coalesce("cold_log", F.lit(0.0))
    return joined.select(
        *[F.col(f"row.`{c}`") for c in rest], "n_tokens", (F.col("n_hot") + F.coalesce("cold_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + cold_log).alias("base_score"),
        (F.col("chain_log") + F.col("inner") + cold_log).alias("score"))
