"""Sharding, token files, language codes, archives: brute force, round trips and hard rows."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.llm import arc, langid, sharding, tokenfile
from linkspark.llm.tokens import Encoder, tokenizer_path

DOC = "doc_id long, text string, lang string, slot string, row string, score int, kept string"


def docs(spark, rows, parts=3):
    """Rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", "r", 1, "k") for i, t, lang in rows], DOC).repartition(parts)


HARD = [(None, None, None), (1, "", "en"), (2, "the cat " * 4000, "en"), (3, "same text", "fr"), (4, "same text", "fr"),
        (4, "same text", "fr"), (5, " \n\t ", None), (6, "Übermäßig 中文 naïve", "de")]


# --- sharding --------------------------------------------------------------------------------------------

def one_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_moves_into_the_new_shard_only():
    keys = np.array([0, 1, 2, 40, 2**63, 2**64 - 1, *range(1000, 4000)], np.uint64)
    for n in (1, 2, 39, 40):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert before.tolist() == [one_jump(int(k), n) for k in keys]
        assert ((before == after) | (after == n)).all()
        assert abs((before != after).mean() - 1 / (n + 1)) < 0.03


def test_shards_of_hard_rows(spark):
    rows = sharding.shard_rows(docs(spark, HARD), "doc_id", 4).collect()
    assert len(rows) == len(HARD) and {r.kept for r in rows} == {"k"}
    for r in rows:
        assert r.shard == one_jump(r.doc_id or 0, 4) and r.grown_shard == one_jump(r.doc_id or 0, 5)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_rows(docs(spark, HARD).limit(0), "doc_id").count() == 0


def test_slots_of_one_hot_shard(spark):
    rows = sharding.shard_rows(spark.range(5000).select((F.col("id") % 7).alias("k"), "id"), "k", 1).collect()
    assert sorted(r.slot for r in rows) == list(range(5000))
    assert [r.k for r in sorted(rows, key=lambda r: r.slot)] == sorted(r.k for r in rows)


# --- tokens and their files ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encode():
    e = Encoder(tokenizer_path())
    whole = lambda t: e.library.encode(t or "", add_special_tokens=False).ids
    return e.encode, whole


def test_pieces_give_the_ids_of_whole_texts(encode):
    bits = ["a", "the", " ", "  ", "\n", "\t", "12", ".", ",", "'s", "'", " 'll", "é", "×", "÷", "ß", "中", "<|endoftext|>",
            "_", "\x1c", "\x85", " ", "Ā", "--", "\r\n", "²", "ñ"]
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(3000)] + [None, "", " ", "a ", "x" * 5000]
    own, whole = encode
    for _ in range(2):  # new pieces, then known ones
        assert [x.tolist() for x in own(pa.array(texts))] == [whole(t) for t in texts]
    assert [x.tolist() for x in own(pa.array(texts)[5:9])] == [whole(t) for t in texts[5:9]]
    assert own(pa.array([], pa.string())) == []


@pytest.mark.parametrize("top", [1, 2, 300, 32_767, 32_768, 50_257, 2**20, 2**32])
def test_packed_ids_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 239, 241, 5000, 40_000):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ids[rng.random(n) < 0.01] = 2**32 - 1  # escapes
        assert np.array_equal(tokenfile.unpack(tokenfile.pack(ids)), ids)
    zeros = tokenfile.pack(np.zeros(48_000, np.uint32))
    assert len(zeros) < 48_000 * 8 / 200 + 200  # 240 to a word


def test_token_files(spark, encode):
    rows = {(r.doc_id, r.start): r for r in tokenfile.through_files(docs(spark, HARD)).collect()}
    assert len(rows) == len(HARD)
    at = 0
    for i, text, _ in sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode[1](text) + [2]
        got = rows[(i, at)]
        assert got.n_tokens == len(ids) and got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenfile.through_files(docs(spark, HARD).limit(0)).count() == 0


# --- language codes --------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 4, 7, 20])
def test_codewords_differ_and_columns_part(n):
    code = langid.codewords(n)
    assert len(np.unique(code, axis=0)) == n
    if n > 1:
        assert (abs(code.sum(axis=0)) < n).all()
        gaps = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
        assert gaps.min() >= {2: 1, 4: 4, 7: 32, 20: 20}[n]


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.train(table.filter(~out))
    assert model.languages == ["de", "en", "es", "fr"]
    told = langid.predict(table.filter(out), model).toPandas()
    assert (told.lang == told.lang_pred).mean() > 0.98 and told.score.between(0, 1).all()


def test_language_of_hard_rows(spark):
    model = langid.train(docs(spark, [(1, "the cat and the dog sat there", "en"), (2, "le chat et le chien sont là", "fr"),
                                      (3, None, "en"), (4, "no label", None)]))
    told = langid.predict(docs(spark, HARD), model).collect()
    assert len(told) == len(HARD) and {r.kept for r in told} == {"k"}
    for r in told:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("en", "fr") and 0 < r.score <= 1
    none = langid.train(docs(spark, HARD).filter("false"))
    assert {r.lang_pred for r in langid.predict(docs(spark, HARD), none).collect()} == {"und"}
    assert langid.predict(docs(spark, HARD).limit(0), model).count() == 0


def test_a_text_is_judged_alike_alone_and_in_a_batch(spark):
    learn = [(1, "the cat and the dog sat there", "en"), (2, "le chat et le chien sont là", "fr"), (3, "o", "en"), (4, "à", "fr")]
    short = [(i, t, None) for i, t in enumerate(["le", "t", "", "h", None, "et", "o", "the", "x", "é", "at", "sont là", "a", "a"])]
    told = []
    for most in ("10000", "1"):  # all texts of a table in one batch, and every text in a batch of its own
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            model = langid.train(docs(spark, learn, 1))
            rows = langid.predict(docs(spark, short, 1), model).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        told.append((model, {r.doc_id: (r.lang_pred, round(r.score, 6), r.ambiguous) for r in rows}))
    assert (told[0][0].odds == told[1][0].odds).all() and told[0][1] == told[1][1]
    assert told[0][1][12] == told[0][1][13]


def test_a_near_tie_is_flagged():
    counts = np.zeros((2, 3 * langid.BUCKETS))
    counts[0, 100], counts[1, 101] = 50, 50
    model = langid.fit(["a", "b"], counts)
    best, score, near = langid.decide(model, np.array([[0.0], [3.0], [-3.0]]))
    assert near.tolist() == [True, False, False] and best[1] != best[2] and score[0] == pytest.approx(0.5)


# --- archives --------------------------------------------------------------------------------------------

def test_arc_versions_and_lengths():
    head = "HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 3\r\n\r\n"
    body = head + "a\nb"
    one = arc.version_block(1) + "\n" + f"http://x/ 1.2.3.4 20240102030405 text/html {len(body)}\n{body}\n"
    two = arc.version_block(2) + "\n" + f"http://y/ 1.2.3.4 20240102030405 text/html 200 - - 0 - {len(body)}\n{body}\n"
    found = list(arc.parse_arc((one + two).encode()))
    assert [r["URL"] for r in found] == ["http://x/", "http://y/"] and found[1]["Result-code"] == "200"
    assert all(r["block"] == body.encode() for r in found)
    with pytest.raises(ValueError):
        list(arc.parse_arc(one.encode()[:-8]))
    with pytest.raises(ValueError):  # a version 2 line under version 1
        list(arc.parse_arc((one + two.split("\n\n")[-1]).encode() + b""[:0] + two.split("text/plain")[1].encode()))


def test_pages_through_archives(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny\nhttp://z 1 2 3 4\n"
    rows = [(3, "http://a/", "same"), (2, "http://a b/", "same"), (9, None, "same"), (4, "", tricky), (5, "u", None), (6, "u", ""),
            (7, "http://é/", "é中"), (None, "n", "same"), (8, "d", "twice"), (8, "d", "twice"), (10, "long", "z" * 300_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    out = arc.pages_through_archives(table).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in out) == sorted(
        (p or -1, len((h or "").encode()), arc.payload_digest((h or "").encode())) for p, _, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert {(2, "response", None), (3, "revisit", 2), (9, "revisit", 2), (None, "revisit", 2), (5, "response", None),
            (6, "revisit", 5), (8, "response", None), (8, "revisit", 8), (4, "response", None)} <= kinds
    assert arc.pages_through_archives(table.limit(0)).count() == 0
    assert {r.record_type for r in arc.pages_through_archives(table.filter("page_id in (5, 6)"), min_bytes=1).collect()} == {"response"}


def one_language(model, text):
    """Margins, losses and the choice for one text, number by number."""
    low = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 32 or 48 <= c <= 57 else c for c in text.encode())
    bits = model.odds.shape[1]
    sums = [0.0] * bits
    for i in range(len(low)):
        code = low[i]
        for n in range(3):
            if n:
                code |= (low[i - n] if i >= n else 32) << (8 * n)
            feature = (code * int(langid._MIX[n]) & 0xFFFFFFFF) >> 18 if n else code
            for b in range(bits):
                sums[b] += float(model.odds[n * langid.BUCKETS + feature, b])
    margins = [s / (3 * len(low)) for s in sums]
    losses = [sum((1 - np.tanh(2 * m) * int(c)) / 2 * w for m, c, w in zip(margins, row, model.weights)) for row in model.code]
    best = min(losses)
    ordered = sorted(losses)
    return model.languages[losses.index(best)], 1 / sum(np.exp(-20 * (x - best)) for x in losses), ordered[1] - ordered[0] < langid.AMBIGUOUS


def test_languages_number_by_number(spark, sf):
    learn = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    model = langid.train(learn)
    assert len(model.languages) == 4 and model.odds.shape == (3 * langid.BUCKETS, 7)
    texts = ["a", "le", "und der die das", "½ ² ①", "½ x", "1 2 3", "", None, "ñandú 中文", "the " * 90, "Ünï\tx\n9z", "A"]
    rows = langid.predict(docs(spark, [(i, t, None) for i, t in enumerate(texts)], 2), model).collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
            continue
        lang, score, near = one_language(model, r.text)
        assert r.lang_pred == lang and r.ambiguous == near and abs(r.score - score) < 1e-4


def test_a_long_text_in_stretches(monkeypatch):
    data = np.frombuffer("the quick brown fox 1 ".encode() * 40, np.uint8)
    whole = next(langid._stretches(data, np.zeros(1, np.int64)))
    monkeypatch.setattr(langid, "_CHUNK", 37)
    parts = list(langid._stretches(data, np.zeros(1, np.int64)))
    assert len(parts) > 20
    for n in range(3):
        assert np.array_equal(np.concatenate([p[n] for p in parts]), whole[n])
