"""Near-duplicates, repeats, decontamination, language model, neighbours, packing: brute force and hard rows."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkspark.llm import decontam, hmm, minhash, packing, substring, vptree
from linkspark.llm.tokens import Encoder, tokenizer_path

EXTRA = "doc_id long, text string, lang string, spans string, _id int, _row int, kept string, score string"


def table(spark, rows, parts=4):
    """(id, text) rows with further columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "k", "x") for i, t in rows], EXTRA).repartition(parts)


def vocabulary(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(n)]


HARD = [(None, None), (None, "one two"), (1, ""), (2, " \n "), (3, None), (4, "One  two"), (5, "one two"), (5, "one two"), (6, "é中 ünï"), (6, "other")]


# --- near-duplicates ----------------------------------------------------------------------------------------

def _set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    """Smallest id reachable over links between all pairs of rows."""
    sets, up = [_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            up[root(a)] = root(b)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k if k is not None else -1, len(s), low.get(root(i), -1)) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def _near_groups(seed, groups=12, chain=25):
    """Groups around a text, with more and more words changed, and a chain that only hangs together link by link."""
    rnd, words = random.Random(seed), vocabulary(400, seed)
    rows = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 8, 60, 150]))]
        for k in range(rnd.randrange(1, 14)):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + k // 2)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append(" ".join(own))
    link = [rnd.choice(words) for _ in range(200)]
    for _ in range(chain):
        link = link[12:] + [rnd.choice(words) for _ in range(12)]
        rows.append(" ".join(link))
    rnd.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_near_duplicates_against_all_pairs(spark):
    rows = _near_groups(5)
    got = minhash.near_duplicates(table(spark, rows)).collect()
    want = _components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert max(Counter(c for _, _, c in want).values()) >= 20  # the chain


def test_near_duplicates_of_hard_rows(spark):
    got = minhash.near_duplicates(table(spark, HARD)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == _components(HARD)
    assert minhash.near_duplicates(table(spark, HARD).limit(0)).count() == 0
    stay = minhash.one_of_each(table(spark, HARD))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in stay.collect()))) == sorted(map(repr, [
        (None, None), (1, ""), (2, " \n "), (3, None), (4, "One  two"), (6, "é中 ünï"), (6, "other")]))
    assert stay.columns == table(spark, HARD).columns


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(7, 100), (500, 501), (5, 5)]
    random.Random(1).shuffle(pairs)
    comp = {r.node: r.comp for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {comp[i] for i in [*range(100, 161), *range(200, 400), 7]} == {7} and comp[501] == comp[500] == 500


def test_components_take_as_many_tasks_as_their_edges_are_worth(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(200, 300)] + [(5, 5)]
    edges, files, cut = spark.createDataFrame(pairs, "a long, b long"), [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df: files.append(len((out := cut(df)).inputFiles())) or out)
    default = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = minhash.components(edges)
        assert {(r.node, r.comp) for r in found.collect()} == {(i, 100) for i in range(100, 131)} | {(i, 7) for i in [7, *range(200, 300)]}
        assert max(files) <= spark.sparkContext.defaultParallelism
        files.clear()
        again = minhash.components(found.toDF("a", "b"))  # stars already: nothing is gone through twice
        assert sorted(again.collect()) == sorted(found.collect()) and len(files) == 2
        files.clear()
        monkeypatch.setattr(minhash, "PER_TASK", 1)  # many edges for a task: all partitions
        assert sorted(minhash.components(edges).collect()) == sorted(found.collect())
        assert max(files) > spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", default)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- repeated passages ---------------------------------------------------------------------------------------

def _repeats(rows, size):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (k, _), w in zip(rows, words):
        gone = {p for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for p in range(i, i + size)}
        left = b" ".join(x for p, x in enumerate(w) if p not in gone).decode()
        out.append((k if k is not None else -1, len(w), len(gone), left))
    return sorted(out)


@pytest.mark.parametrize("size,flush", [(5, None), (35, 60)])
def test_repeats_against_counting(spark, monkeypatch, size, flush):
    if flush:  # many partial sketches and many occurrences of a passage in other tasks
        monkeypatch.setattr(substring, "FLUSH", flush)
    rnd, words = random.Random(size), vocabulary(3000)
    passages = [[rnd.choice(words) for _ in range(rnd.randrange(size, 3 * size))] for _ in range(4)]
    rows = []
    for i in range(150):
        body = [rnd.choice(words) for _ in range(rnd.randrange(0, 4 * size))]
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(body) + 1)
            body[at:at] = passages[min(3, int(rnd.expovariate(1)))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(body)))
    rows += [(900, " ".join(["loop"] * (size + 3))), (901, rows[3][1]), (902, rows[3][1].upper()), (903, " ".join(words) + " " + " ".join(words))]
    got = substring.remove_repeats(table(spark, rows), size).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == _repeats(rows, size)
    assert {r.spans for r in got} == {"s"}


def test_repeats_of_hard_rows(spark):
    long = " ".join(vocabulary(40))
    rows = [*HARD, (None, long), (7, long), (8, long), (8, long), (9, None), (10, "é " * 40)]
    got = substring.remove_repeats(table(spark, rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in got) == _repeats(rows, 35)
    assert substring.remove_repeats(table(spark, rows).limit(0)).count() == 0


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With far too few cells every window is estimated to repeat; the exact pass decides alike."""
    monkeypatch.setattr(substring, "MOST_CELLS", 20)
    rnd, words = random.Random(3), vocabulary(50)
    rows = [(i, " ".join(rnd.choice(words) for _ in range(400))) for i in range(20)]
    got = substring.remove_repeats(table(spark, rows), 2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == _repeats(rows, 2)


@pytest.mark.parametrize("tasks", [1, 6])
def test_windows_with_equal_first_fingerprints_stay_apart(monkeypatch, tasks):
    """All windows share their first fingerprint; in one task or several, the second still tells them apart."""
    monkeypatch.setattr(substring.W, "windows", lambda prints, size: np.zeros(max(0, len(prints) - size + 1), np.uint64))
    monkeypatch.setattr(substring, "_unfolded", lambda sketch, cells: [])
    rnd, words = random.Random(4), vocabulary(500)
    passage = [rnd.choice(words) for _ in range(12)]
    texts = [[rnd.choice(words) for _ in range(30)] for _ in range(6)]
    for i in (1, 4):
        texts[i][3 * i:3 * i] = passage
    seen = Counter(tuple(t[i:i + 5]) for t in texts for i in range(len(t) - 4))
    want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 4) if seen[tuple(t[i:i + 5])] > 1}
    rows = [pa.RecordBatch.from_arrays([pa.array([" ".join(t) for t in texts[a::tasks]]), pa.array(range(a, 6, tasks), pa.int64()),
                                        pa.array([0] * len(texts[a::tasks]), pa.int32())], ["text", "id", "print"]) for a in range(tasks)]
    passed = pa.Table.from_batches([b for batch in rows for b in substring._occurrences(None, 20, 5)(iter([batch]))])
    laid = passed.sort_by([("h1", "ascending"), ("x", "ascending")]).combine_chunks().to_batches()
    got = pa.Table.from_batches(list(substring._exact(iter(laid))), substring._FOUND).to_pylist()
    assert len(want) >= 16 and {(r["id"], (r["span"] >> 32) + i) for r in got for i in range(r["span"] & 0xFFFFFFFF)} == want


# --- decontamination -----------------------------------------------------------------------------------------

def _norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _contamination(rows, items):
    out = []
    for k, t in rows:
        w, hit, met = _norm(t), set(), set()
        for item, body in items:
            b = _norm(body)
            n = min(10, len(b))
            grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    met.add(str(item)) if item is not None else None
        out.append((k if k is not None else -1, len(w), len(hit), sorted(met)))
    return sorted(out, key=repr)


def test_contamination_against_scanning(spark, monkeypatch):
    rnd, words = random.Random(8), vocabulary(200)
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 9, 10, 11, 14, 30, 60)]
    items = [*enumerate(texts), (None, texts[-1]), (77, None), (78, "--"), (79, texts[8]), (79, texts[8]), (80, "Zürich, 中文!")]
    rows = []
    for i in range(80):
        body = [rnd.choice(words[:150]) for _ in range(rnd.randrange(0, 50))]
        if rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            a = rnd.randrange(len(w))
            body[3:3] = w[a:a + rnd.randrange(1, 40)]
        rows.append((i, rnd.choice([" ", ", ", "\n--\n"]).join(x.upper() if rnd.random() < 0.3 else x for x in body)))
    rows += [*HARD, (200, "in ZüRICH 中文"), (201, " ".join(texts) * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _contamination(rows, items)
    for most in (10**6, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(decontam, "MOST_GRAMS", most)
        got = decontam.contamination(table(spark, rows), bench).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want
        assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    left = decontam.decontaminate(table(spark, rows), bench)
    assert left.count() == sum(x[2] == 0 for x in want) and left.columns == [c for c in table(spark, rows).columns if c != "spans"]
    cleaned = decontam.decontaminate(table(spark, [(1, "Keep. " + texts[-1].upper() + " And this")]), bench.filter("item_id = 9"), "spans")
    assert cleaned.first().text == "keep and this"
    assert decontam.contamination(table(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(table(spark, rows).limit(0), bench).count() == 0


def test_decontamination_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = decontam.contamination(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- language model ------------------------------------------------------------------------------------------

def test_forward_sums_all_paths():
    rng = np.random.default_rng(1)
    chain = hmm.Chain(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(hmm.CLASSES), 3).T)
    runs = [rng.integers(0, hmm.CLASSES, n) for n in (1, 4, 2, 4)]
    got = hmm.log_likelihoods(chain, runs)
    for run, log in zip(runs, got):
        paths = np.stack(np.meshgrid(*[range(3)] * len(run), indexing="ij"), -1).reshape(-1, len(run))
        p = chain.start[paths[:, 0]] * chain.emit[run[0], paths[:, 0]]
        for t in range(1, len(run)):
            p = p * chain.step[paths[:, t - 1], paths[:, t]] * chain.emit[run[t], paths[:, t]]
        assert log == pytest.approx(math.log10(p.sum()))
    first, steps, emit = hmm.expected(chain, runs)
    assert first.sum() == pytest.approx(4) and steps.sum() == pytest.approx(7) and emit.sum() == pytest.approx(11)
    better = hmm.Chain(first / first.sum(), steps / steps.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    assert hmm.log_likelihoods(better, runs).sum() >= got.sum()  # what expectation-maximisation promises


def _base(rows, learns):
    words = [[w.lower() for w in (t or "").encode().split()] + [None] for _, t in rows]
    c = Counter(w for own, learn in zip(words, learns) if learn for w in own)
    n, v = sum(c.values()), len(c)
    return n, sorted((len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for w in words)


@pytest.mark.parametrize("hot", [200_000, 30])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(hmm, "HOT", hot)  # with few hot words most go through the join
    rnd, words = random.Random(2), vocabulary(800)
    rows = [(i, " ".join(rnd.choice(words[:400] if i % 2 else words[400:]) for _ in range(rnd.randrange(0, 120)))) for i in range(200)]
    rows += [*HARD, (7, "Unseen Words here " * 50)]
    learns = [(i or 0) % 5 != 1 for i, _ in rows]
    got = hmm.score(table(spark, rows), F.coalesce(F.col("doc_id") % 5, F.lit(0)) != 1)
    assert got.columns == ["doc_id", "lang", "spans", "_id", "_row", "kept", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = got.collect()
    n, want = _base(rows, learns)
    assert {r.train_tokens for r in out} == {n} and {r.kept for r in out} == {"k"}
    flat = lambda rows: [x for row in rows for x in row]
    assert flat(sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out)) == pytest.approx(flat(want))
    held = [r for r in out if (r.doc_id or 0) % 5 == 1 and r.n_tokens == r.n_known]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # two topics are told apart


def test_scores_without_training(spark):
    out = hmm.score(table(spark, HARD), F.lit(False)).collect()
    assert len(out) == len(HARD) and all(math.isfinite(r.score) and r.n_known == 0 and r.base_score == 0 for r in out)
    assert hmm.score(table(spark, HARD).limit(0), F.lit(True)).count() == 0


def test_classes_have_probabilities_that_sum_to_one(spark):
    rows = [(i, " ".join(vocabulary(300, i))) for i in range(30)]
    known = hmm.count_words(table(spark, rows))
    share = (known.words.toPandas()["n"] + 0.5).sum() + 0.5 * hmm.TAIL + known.ends + 0.5
    assert known.mass.sum() * (known.tokens + 0.5 * (known.distinct + 1)) == pytest.approx(share, abs=0.6)


# --- neighbours ----------------------------------------------------------------------------------------------

def _nearest(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v
            and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-round(float(v @ w), 9), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out.setdefault(q, []).append([i for _, i in near])
    return out


def test_neighbours_exact_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAST_SHARD", 200)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1, 5])).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a hot vector
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [float("nan")] + [1.0] * 5), (2060, [float("inf")] * 6), (2080, [None] + [1.0] * 5),
             (None, [1.0] * 6), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (2120, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    want = _nearest(rows, 20)
    got: dict = {}
    for r in vptree.neighbours(df, F.col("vec_id") % 20 == 0, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: x[0] for q, x in want.items() if x[0]}
    assert vptree.neighbours(df.limit(0), F.lit(True)).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = _nearest(rows, 20)
    got = vptree.neighbours(df, F.col("vec_id") % 20 == 0).collect()
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    assert sum(r.vec_id in want[r.query_id][0] for r in got) >= 0.98 * 20 * len(want)
    assert all(r.score == pytest.approx(vectors[r.query_id] @ vectors[r.vec_id], abs=1e-12) for r in got)


@pytest.mark.parametrize("kind", ["few dimensions", "groups", "unlike norms"])
def test_recall_on_vectors_with_structure(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    if kind == "groups":
        x += 3 * rng.normal(size=(30, 6))[rng.integers(0, 30, 2000)]
    x = x @ rng.normal(size=(6, 64))
    x = x * np.exp(rng.normal(size=(2000, 1)) * 0.5) if kind == "unlike norms" else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = _nearest(rows, 20)
    got = vptree.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 20 * len(want) and sum(r.vec_id in want[r.query_id][0] for r in got) >= 0.999 * len(got)


@pytest.mark.parametrize("kind", ["same score", "signs", "small numbers"])
def test_ties_between_different_vectors(kind):
    """Thousands of different vectors of one score: the smallest ids come first, whatever tree they are in."""
    rng = np.random.default_rng(8)
    if kind == "same score":
        vectors = np.concatenate([np.ones((3000, 1)), rng.choice([-1.0, 1.0], (3000, 15))], axis=1)
        queries = np.zeros((3, 16))
        queries[:, 0] = 1
    else:
        vectors = rng.choice([-1.0, 1.0], (3000, 12)) if kind == "signs" else rng.integers(-2, 3, (3000, 6)) / 10
        queries = vectors[:40]
    ids = rng.permutation(3000) * 7
    largest = float(np.sqrt((vectors ** 2).sum(axis=1).max()))
    q, i, s = vptree.nearest(vptree.build(ids, vectors, largest * (1 + 1e-12), 64), ids[:len(queries)], queries, 20, 1.0)
    for n, own in enumerate(ids[:len(queries)].tolist()):
        exact = (vectors * queries[n]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -exact)).tolist() if ids[j] != own][:20]
        assert i[20 * n:20 * n + 20] == ids[order].tolist()
        assert s[20 * n:20 * n + 20] == exact[order].tolist()


# --- packing -------------------------------------------------------------------------------------------------

def _check_packing(rows, capacity):
    by = {}
    for pid, length, at, seq in rows:
        by.setdefault(seq, []).append((at, length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return len(by)


@pytest.mark.parametrize("name,most", [("mixed", 1.03), ("tiny", 1.01), ("equal", 1.0), ("none", 1.0), ("one", 1.0)])
def test_packing(spark, name, most):
    rng = np.random.default_rng(3)
    lengths = {"mixed": rng.integers(1, 2049, 3000), "tiny": rng.integers(1, 40, 8000), "equal": np.full(1000, 1024),
               "none": np.zeros(0, int), "one": np.array([5])}[name]
    df = spark.createDataFrame([(10 * i, int(n)) for i, n in enumerate(lengths)], "pid long, length long").repartition(3)
    sizes = {r.pid: r.length for r in df.collect()}
    out = [(r.pid, sizes[r.pid], r["at"], r["bin"]) for r in packing.pack(df).collect()]
    assert sorted(p for p, *_ in out) == sorted(sizes)
    assert _check_packing(out, 2048) <= max(1, math.ceil(lengths.sum() / 2048)) * most if len(lengths) else not out


def test_matching_across_ranges():
    # ranges from large to small: (range, pieces without a gap, gaps left); a piece takes the last gap still free
    assert packing.across([(0, 2, 3), (1, 1, 2), (2, 4, 0)]) == [(1, 0, 0, 2, 1, 0), (2, 0, 1, 1, 2, 1), (2, 2, 0, 1, 2, 3)]
    assert packing.across([(0, 5, 0), (1, 0, 1)]) == []


def test_a_round_reads_what_was_swept_once_for_each_input(spark, monkeypatch):
    pieces = [(i, 40 + i % 200) for i in range(300)]
    gaps = spark.createDataFrame([(1000 + i, 60 + i) for i in range(150)], "bin long, size long")
    plans, cut = [], packing.cut
    monkeypatch.setattr(packing, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    state = packing._round(spark.createDataFrame(pieces, "pid long, size long"), gaps, 100, 1000, 2).collect()
    assert plans[-1].count("parquet") <= 4  # matched ones, two sides of what ranges leave over, and the rest
    size, gap = dict(pieces), {r.bin: r.size for r in gaps.collect()}
    placed = [r for r in state if r.kind == packing._MATCH]
    assert sorted([r.pid for r in placed] + [r.pid for r in state if r.kind == packing._PIECE]) == sorted(size)
    assert placed and all(r.size == size[r.pid] for r in state if r.kind == packing._PIECE)
    left = {r.bin: r.size for r in state if r.kind == packing._GAP}
    for own, free in gap.items():
        at = 1000 - free
        for r in sorted((r for r in placed if r.bin == own), key=lambda r: r.at):
            assert r.at == at
            at += size[r.pid]
        assert left.get(own, 0) == 1000 - at


def test_packed_documents(spark):
    library = Encoder(tokenizer_path()).library
    rows = [*HARD, (50, "alpha beta " * 3000), (51, "x"), (52, "word " * 2047)]
    out = packing.pack_documents(table(spark, rows)).collect()
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048
        edges = [*([0] if first else []), *range(first, len(ids), 2048), len(ids)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    _check_packing([(None, r.length, r.offset, r.sequence_id) for r in out], 2048)
    assert packing.pack_documents(table(spark, rows).limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage against a plain version on its own input; hard rows and planted cases go through all of them."""
    rnd, words = random.Random(6), vocabulary(2500)
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, item, near = some(60), " ".join(some(30)), some(90)
    rows = [(i, " ".join(some(rnd.randrange(20, 120)))) for i in range(60)]
    rows += [(100 + i, " ".join(some(30) + passage + some(30))) for i in range(4)]
    rows += [(200, "start " + item + " end"), (201, " ".join(near)), (202, " ".join(near[:-2])), (203, None), (204, "123 --"), (205, " ".join(near))]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "src", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "pack":
            assert now.columns == docs.columns
            seen[name] = before, {r.doc_id: r.text for r in now.collect()}
    before, after = seen["language_id"]
    assert after == {i: t for i, t in before.items() if i not in (203, 204)}
    before, after = seen["near_dedup"]
    alone = {c for _, _, c in _components(list(before.items()))}
    assert after == {i: t for i, t in before.items() if i in alone} and 201 in after and 202 not in after
    before, after = seen["substring_dedup"]
    left = {i: (t, n, gone) for i, n, gone, t in _repeats(list(before.items()), 35)}
    assert after == {i: before[i] if gone == 0 else t for i, (t, n, gone) in left.items() if gone < n or not n}
    assert all(len(after[100 + i].split()) == 60 for i in range(4))
    before, after = seen["decontaminate"]
    assert set(before) - set(after) == {200}
    packed = now.collect()
    assert {r.doc_id for r in packed} == set(after)
    _check_packing([(None, r.length, r.offset, r.sequence_id) for r in packed], 2048)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in final) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_digests_of_the_queries(spark, sf):
    """The registered queries derive their digests from the operators' outputs."""
    import __spark_entry__ as entry
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {k: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for k, n, gone, t in _repeats(list(texts.items()), 35)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in entry.queries()["op6_substring_dedup"](spark, sf).collect()}
    assert got == want
