"""Analysis, fuzzy expansion and ranking against brute force."""
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkspark.functions import text as T
from linkspark.operators import search as S

# word pairs from the published description of the stemming algorithm
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "über": "über", "it": "it", "x1ing": "x1ing"}


def test_stems():
    assert {w: T.stem(w) for w in STEMS} == STEMS


def test_stems_of_a_vocabulary(spark, sf):
    """The columns say what the letter-by-letter form says, for the published pairs and for whatever is in the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rnd = random.Random(3)
    ends = [*T._STEP2, *T._STEP3, *T._STEP4, "ed", "ing", "eed", "s", "sses", "ies", "y", "e", "ll", "yy", ""]
    made = {"".join(rnd.choice("aeioubcdstylyz") for _ in range(rnd.randrange(1, 6))) + rnd.choice(ends) for _ in range(3000)}
    words = spark.createDataFrame([(w,) for w in [*STEMS, *made, "", "a", "été", "x1ing", "don't"]], "word string")
    words = words.unionByName(docs.select(F.explode(T.tokens(F.col("text"), "standard")).alias("word")))
    got = {r.word: r.stem for r in T.stems(words).collect()}
    assert len(got) > 4000 and all(got[w] == s for w, s in STEMS.items())
    assert {w: s for w, s in got.items() if T.stem(w) != s} == {}
    plan = T.stems(words)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_analyzers(spark):
    df = spark.createDataFrame([(1, "The Cat's running, cats ran: don't e.g. stop_it 3.5 été")], "doc_id int, t string")
    english = S.analyze(df, ["t"], "doc_id").first().tokens
    assert english == ["cat", "run", "cat", "ran", "don't", "e.g", "stop_it", "3.5", "été"]
    standard = S.analyze(df, ["t"], "doc_id", "standard").first().tokens
    assert standard[:4] == ["the", "cat's", "running", "cats"]


def test_very_long_words_and_texts(spark):
    df = spark.createDataFrame([(1, "a." * 200_000 + "z " + "w " * 100_000)], "doc_id int, t string")
    tokens = S.analyze(df, ["t"], "doc_id", "standard").first().tokens
    assert len(tokens) == 100_001


def swap_distance(a, b):
    """Edit distance with swaps of neighbours, by the table of the textbook."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_swap_distance(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 8))) for _ in range(120)]
    pairs = [(a, b) for a in words for b in rnd.sample(words, 60)] + [
        ("ca", "ac"), ("ca", "abc"), ("abcd", "acbd"), ("", "ab"), ("kitten", "sitting"), ("abcdef", "badcfe"), ("thntin", "thinn")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("d", F.expr(T.edit_distance("a", "b"))).collect():
        assert r.d == min(swap_distance(r.a, r.b), 3), (r.a, r.b)


def test_expansion_matches_comparing_every_pair(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(700)})
    vocab = spark.createDataFrame([("content", w, i % 7 + 1) for i, w in enumerate(words)], "field string, term string, df int")
    wanted = rnd.sample(words, 25) + ["zzz", "abcabcabc", "a"]
    out = S.expand_terms(spark.createDataFrame([(w,) for w in wanted], "qterm string"), vocab).collect()
    got = {(r.qterm, r.term): (r.edits, round(r.weight, 9)) for r in out}
    want = {}
    for q in wanted:
        most = 0 if len(q) <= 2 else 1 if len(q) <= 5 else 2
        for w in words:
            d = swap_distance(q, w)
            weight = 1 - d / min(len(q), len(w))
            if d <= most and weight > 0:
                want[q, w] = (d, round(weight, 9))
    assert got == want
    best = S.expand_terms(spark.createDataFrame([(wanted[0],)], "qterm string"), vocab, limit=3)
    assert best.count() <= 3


def test_long_words_by_parts(spark):
    """Every word within two edits of a long one is found, and nothing grows with the square of its length."""
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcde") for _ in range(n)) for n in (14, 15, 16, 17, 18, 25, 60)]

    def edited(w):
        i = rnd.randrange(len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:], w[:i] + w[i + 1] + w[i] + w[i + 2:]])
    words = sorted({w for b in base for _ in range(25) for w in (b, edited(b), edited(edited(b)), edited(edited(edited(b))))})
    vocab = spark.createDataFrame([("content", w, 1) for w in [*words, "z" * 5000, "z" * 4998]], "field string, term string, df int")
    asked = spark.createDataFrame([(b,) for b in [*base, "z" * 4999]], "qterm string")
    got = {(r.qterm, r.term) for r in S.expand_terms(asked, vocab).collect() if len(r.term) < 100}
    assert got == {(b, w) for b in base for w in words if swap_distance(b, w) <= 2}
    assert S.expand_terms(asked, vocab).filter("length(term) > 100").count() == 2


DOCS = [(1, "apple pie", "an apple pie with apples and cream", "j1"), (2, "banana", "bananas are not apples, they are bananas", "j1"),
        (3, "cream", "cream cream cream", "j2"), (4, "nothing", "", "j2"), (5, "aple", "misspelt aple", "j2")]


def _docs(spark):
    return spark.createDataFrame([(d, t, c, j, f"http://x/{d}", 0, 200, None) for d, t, c, j in DOCS],
                                 "doc_id int, title string, content string, job_id string, url string, depth int, "
                                 "status_code int, crawled_at timestamp")


def _brute(query, analyzer="standard"):
    """Unfuzzy BM25 by the book, best boosted field."""
    def words(text):
        return re.findall(r"[\w']+", text.lower())
    scores = {}
    for field, boost, at in (("title", 3, 1), ("content", 1, 2)):
        docs = {d[0]: words(d[at]) for d in DOCS if words(d[at])}
        mean = sum(map(len, docs.values())) / len(docs)
        for doc, ws in docs.items():
            total, tf = 0.0, Counter(ws)
            for q, n in Counter(words(query)).items():
                df = sum(q in w for w in map(set, docs.values()))
                if tf[q]:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    total += n * idf * tf[q] / (tf[q] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if total:
                scores[doc] = max(scores.get(doc, 0), boost * total)
    return {d: round(s, 6) for d, s in scores.items()}


@pytest.mark.parametrize("query", ["apple cream", "cream cream pie", "bananas are", "zebra"])
def test_ranking(spark, query):
    docs = _docs(spark)
    index = S.build_index(docs, ["title", "content"], analyzer="standard")
    out = S.search(index, docs, query, fuzzy=False, highlights=False).collect()
    assert {r.doc_id: r.score for r in out} == pytest.approx(_brute(query), abs=2e-6)
    assert [r.score for r in out] == sorted((r.score for r in out), reverse=True)
    assert "content" not in docs.columns or "content" not in out[0].__fields__ if out else True


def test_search_options(spark, tmp_path):
    docs = _docs(spark)
    S.build_index(docs, ["title", "content"]).save(str(tmp_path / "index"))
    index = S.Index.load(spark, str(tmp_path / "index"))
    out = S.search(index, docs, "aple").collect()
    assert out[0].doc_id == 5 and {r.doc_id for r in out} == {1, 2, 5}
    assert {r.doc_id for r in S.search(index, docs, "aple", fuzzy=False).collect()} == {5}
    assert {r.doc_id for r in S.search(index, docs, "apples", job_id="j1").collect()} == {1, 2}
    assert S.search(index, docs, "cream", size=1).count() == 1
    marks = {r.doc_id: r.highlights for r in S.search(index, docs, "apples creams").collect()}
    assert marks[1] == {"title": ["<em>apple</em> pie"], "content": ["an <em>apple</em> pie with <em>apples</em> and <em>cream</em>"]}
    for bad in ({"query": ""}, {"query": "x", "size": 0}, {"query": "x", "size": 101}):
        with pytest.raises(ValueError):
            S.search(index, docs, **bad)
    queries = spark.createDataFrame([(1, "apple cream"), (2, "banana"), (3, "zzzzzzzz")], "query_id int, query string")
    many = S.search_many(index, queries, 2).collect()
    assert {(r.query_id, r.rank) for r in many} == {(1, 1), (1, 2), (2, 1), (2, 2)} or {r.query_id for r in many} == {1, 2}
    only = S.search_many(index, queries, 5, docs=docs.filter("job_id = 'j2'"))
    assert {r.doc_id for r in only.collect()} <= {3, 4, 5}


def _zipf_docs(spark, n, seed=3):
    """Documents of common and rare words, some alike, so that scores tie."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 4))), " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 60)))) for i in range(n)]
    rows += [(n + i, *rows[i][1:]) for i in range(n // 10)]
    queries = [(q, " ".join(rnd.choices(words, weights, k=rnd.randrange(1, 12)))) for q in range(30)] + [(30, "w0"), (31, "w0 w1 w2"), (32, "none")]
    return (spark.createDataFrame(rows, "doc_id long, title string, content string"),
            spark.createDataFrame(queries, "query_id int, query string"))


def _ranked(found, k):
    per = {}
    for q, d, s in found:
        per.setdefault(q, []).append((-s, d))
    return {(q, i + 1, d, -s) for q, own in per.items() for i, (s, d) in enumerate(sorted(own)[:k])}


@pytest.mark.parametrize("k,early,fuzzy", [(1, 2000, False), (5, 50, False), (10, 0, True), (400, 50, False)])
def test_bounds_change_nothing(spark, tmp_path, monkeypatch, k, early, fuzzy):
    monkeypatch.setattr(S, "EARLY", early)
    docs, queries = _zipf_docs(spark, 400)
    index = S.build_index(docs, ["title", "content"], analyzer="standard")
    index.save(str(tmp_path / "index"), row_group=4096)
    saved = S.Index.load(spark, str(tmp_path / "index"), analyzer="standard")
    want = _ranked([tuple(r) for r in S.score(index, queries, fuzzy).collect()], k)
    some = docs.filter("doc_id % 3 = 0")
    want_some = _ranked([tuple(r) for r in S.score(index, queries, fuzzy).filter("doc_id % 3 = 0").collect()], k)
    for own in (index, saved):
        assert {tuple(r) for r in S.search_many(own, queries, k, fuzzy).collect()} == want
        assert {tuple(r) for r in S.search_many(own, queries, k, fuzzy, docs=some).collect()} == want_some


def test_few_of_the_documents_that_share_a_word_are_scored(spark):
    docs, queries = _zipf_docs(spark, 3000)
    index = S.build_index(docs.select("doc_id", "content"), ["content"], analyzer="standard")
    queries = queries.filter("query_id < 30")
    passing, _ = S.candidates(index, S.weighted_terms(index, queries, fuzzy=False), 5)
    assert passing.count() < 0.2 * S.score(index, queries, fuzzy=False).count()


def test_a_search_reads_the_pages_of_its_terms(spark, tmp_path):
    docs, _ = _zipf_docs(spark, 3000)
    path = str(tmp_path / "index")
    S.build_index(docs, ["title", "content"], analyzer="standard").save(path, row_group=4096)
    saved = S.Index.load(spark, path, analyzer="standard")
    assert saved.blocks.agg(F.max(F.size("ids"))).first()[0] == S.BLOCK
    every = saved.blocks.count()
    asked = spark.createDataFrame([(f, t) for f in ("title", "content") for t in ("w5", "w512")], "field string, term string")
    own = saved.of_terms(asked).blocks
    assert own.count() > 3
    rows = own.select("field", "term", "ids")
    rows.collect()
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert read < every / 2 and own.count() <= read
    assert {r.term for r in rows.collect()} == {"w5", "w512"}


def test_blocks_of_other_ids(spark, tmp_path):
    docs = _docs(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    S.build_index(docs, ["title", "content"], analyzer="standard").save(str(tmp_path / "index"))
    saved = S.Index.load(spark, str(tmp_path / "index"), analyzer="standard")
    assert {r.doc_id for r in S.search(saved, docs, "cream", fuzzy=False, highlights=False).collect()} == {"d1", "d3"}
    assert saved.of_terms(spark.createDataFrame([], "field string, term string")).postings.count() == 0


def test_positions(spark):
    index = S.build_index(_docs(spark), ["content"], analyzer="standard", positions=True)
    row = index.postings.filter("term = 'cream' and doc_id = 3").first()
    assert (row.tf, row.positions) == (3, [0, 1, 2])


def test_fragments():
    text = "x " * 300 + "alpha beta " + "y " * 300 + "alpha " + "z " * 300
    marked = T.mark(text, {"alpha", "beta"}, "standard", 2, 200)
    assert len(marked) == 2 and "<em>alpha</em> <em>beta</em>" in marked[0] and "<em>alpha</em>" in marked[1]
    assert all(len(re.sub("</?em>", "", m)) <= 200 for m in marked)
    assert T.mark("nothing here", {"alpha"}, "standard", 2, 200) == []


def _broadcasts(df):
    """The plans of what is broadcast in a join, one text each."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Z]", x).start() if re.search(r"[A-Z]", x) else 0 for x in lines]
    return ["\n".join([x, *itertools.takewhile(lambda y: depth[lines.index(y)] > depth[i], lines[i + 1:])])
            for i, x in enumerate(lines) if "BroadcastExchange" in x]


def test_vocabulary_is_not_broadcast(spark, monkeypatch):
    """Unfolded words are many times what the planner takes them for; a driver can't hold those of a large index."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abcd", k=rnd.randrange(2, 20))) for _ in range(120)})
    near = [w[1:] for w in words if len(w) > 2] + words
    vocabulary = spark.createDataFrame([("content", w, i + 1, 0.5) for i, w in enumerate(words[:40])], "field string, term string, df long, most double")
    asked = spark.createDataFrame([(w,) for w in near], "qterm string")
    found = []
    for most in (50_000, 0):
        monkeypatch.setattr(S, "SPREAD", most, raising=False)
        pairs = S._near_pairs(asked, vocabulary)
        held = _broadcasts(pairs)
        assert len(held) == (2 if most else 0)
        assert not any("Generate" in x for x in held)
        found.append(sorted(map(tuple, S.expand_terms(asked, vocabulary).collect())))
    assert found[0] == found[1] and len(found[0]) > 40


def test_term_frequencies_write_the_vocabulary_only(spark, monkeypatch):
    """What is written is as large as the vocabulary, not as the texts' words."""
    words = ["running", "ran", "The", "dog's", "dogs", "DOG", "it's", "über", "x1", "and", "ponies"]
    rnd = random.Random(6)
    rows = [(i % 150, " ".join(rnd.choices(words, k=30)), rnd.choice([None, "", "Dogs and ponies"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string")
    columns, written = {"content": "text", "title": "title"}, []

    def cut(df, keep=S.cut):
        written.append((out := keep(df)).count())
        return out
    for name in ("cut", "lookup_table"):
        monkeypatch.setattr(S, name, cut)
    for analyzer in ("english", "standard"):
        want = Counter()
        for _, text, title in rows:
            for field, own in (("content", text), ("title", title or "")):
                for w in own.lower().split():
                    w = re.sub("'s$", "", w) if analyzer == "english" else w
                    if analyzer == "standard" or w not in T.STOP_WORDS:
                        want[field, T.stem(w) if analyzer == "english" else w] += 1
        got = S.term_frequencies(docs, columns, analyzer=analyzer)
        assert {(r.field, r.term): r.tf for r in got.collect()} == want
        assert got.count() == len(want) and max(written) <= len(words) + 3


def test_only_postings_of_missing_terms_are_shuffled(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "content", d) for d in range(30)], "query_id int, field string, doc_id long")
    terms = spark.createDataFrame([(1, "content", "b", 2.0, 3.0), (1, "content", "c", 1.0, 3.0)],
                                  "query_id int, field string, term string, weight double, mean_length double")
    postings = spark.createDataFrame([("content", t, d, 3, 1 + d % 2) for t in "abc" for d in range(0, 40, 2)],
                                     "field string, term string, doc_id long, length int, tf long")
    found = []
    for most in (50_000, 0):
        monkeypatch.setattr(S, "SPREAD", most, raising=False)
        df = S._missing(asked, terms, postings)
        assert ("LeftSemi" in df._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        found.append(sorted(map(tuple, df.collect())))
    assert found[0] == found[1] and len(found[0]) == 30
