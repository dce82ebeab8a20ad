"""Phrase collocations: brute force, tries, filters that let everything pass, hard rows."""
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from linkspark.llm import colloc, doublearray
from linkspark.llm import wordhash as W

DOC = "doc_id long, text string, lang string, phrase string, a int, segment int, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    out = [[]]
    word = ""
    for c in (text or "").translate(LOWER) + "\n":
        if c in " \t.,;:!?\n\x0b\x0c\r":
            if word:
                out[-1].append(word)
            word = ""
            if c not in " \t":
                out.append([])
        else:
            word += c
    return out


def wanted(rows, least=30, top=2000, longest=4):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found, longer = defaultdict(list), Counter()
    several = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, w), a in several.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i:i + size]] = max(longer[lang, w[i:i + size]], a)
    for (lang, w), a in several.items():
        if (lang, w) in longer and 100 * longer[lang, w] >= 80 * a:
            continue
        score, k, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "r") for i, (lang, t) in enumerate(rows)], DOC).repartition(parts)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=1500):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "中文", "a", "b", "x<y", "city", "rare" + str(seed)]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(0, 40)))
        rows.append((rnd.choice(["en", "en", "fr", None, "und", ""]), text + rnd.choice(["", "the city of new york", "a b a b a b a b"])))
    return rows


HARD = [(None, None), ("en", ""), ("en", None), (None, " \t. "), ("fr", "..."), ("de", "one"), ("de", "one two"), ("é", "ünï " * 70),
        ("long", "w0 w1 w2 w3 " * 3000), ("same", "it is so. " * 15), ("same", "it is so. " * 15), ("same", "\x00 \x01 " * 31)]


@pytest.mark.parametrize("seed,most", [(1, colloc.MOST), (2, 40)])
def test_against_brute_force(spark, seed, most):
    rows = corpus(seed) + HARD
    want = wanted(rows)
    assert len(want) > 60 and len({r[0] for r in want}) >= 5
    assert got(colloc.collocations(table(spark, rows), most=most)) == want


def test_top_and_ties(spark):
    rows = [("en", "p q. r s. t u. ")] * 40 + [("en", "p q r")] * 31
    want = wanted(rows, top=2)
    assert len(want) == 2
    assert got(colloc.collocations(table(spark, rows), top=2)) == want


def test_filters_decide_nothing(spark, monkeypatch):
    rows = corpus(3, 120)
    want = got(colloc.collocations(table(spark, rows)))
    monkeypatch.setattr(colloc, "level_filter", lambda texts, cells, held, size: tuple(b"\xff" * x.nbytes for x in cells.empty()))
    named = colloc.candidates(colloc_texts(spark, rows))
    found = colloc.scored(colloc.phrase_counts(colloc_texts(spark, rows), named))
    assert {tuple(r) for r in found.collect()} == {(x[0], *x[2:]) for x in want}


def colloc_texts(spark, rows):
    return spark.createDataFrame([(t or "", lang if lang is not None else "und") for lang, t in rows], "text string, lang string").repartition(3)


def test_no_candidates(spark):
    assert got(colloc.collocations(table(spark, HARD).limit(0))) == []
    assert got(colloc.collocations(table(spark, [("en", "nothing here is frequent")]))) == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(colloc, "CHUNK", 16)
    texts = ["short.", "a b c d e f g h i j k l m n o p q r s t u v. then, more: of it! and so on? yes", "", "no mark " * 9, "é,中文。" * 9]
    data, offsets = W.buffers(pa.array(texts))
    cuts, of = colloc._sections(data, offsets)
    assert set(offsets) <= set(cuts.tolist()) and len(of) == len(cuts) - 1
    for a, b, t in zip(cuts[:-1], cuts[1:], of):
        assert offsets[t] <= a <= b <= offsets[t + 1]
        assert b in offsets or colloc._BREAK[data[b - 1]]
    assert len(cuts) > len(offsets) + 3


def test_tries_hold_all_phrases_and_no_other():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    phrases = {(rnd.choice("pqr"), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))) for _ in range(3000)}
    phrases |= {("p", f"w{i} w{j}") for i in range(3) for j in range(400)} | {("q", "")}
    phrases = sorted(phrases)
    trie, states = doublearray.build(pa.array([g for g, _ in phrases]), pa.array([p for _, p in phrases]))
    trie = doublearray.Trie.from_bytes(trie.to_bytes())
    assert len(set(states.tolist())) == len(phrases)

    def walk(group, phrase):
        data, offsets = W.buffers(pa.array([phrase]))
        state = np.array([trie.roots[group]])
        for code in trie.codes(W.words(data, offsets)[2]).tolist():
            if state[0] < 0:
                return -1
            state = trie.step(state, np.array([code], np.int32))
        return int(state[0])
    assert [walk(g, p) for g, p in phrases] == states.tolist()
    prefixes = {(g, " ".join(p.split()[:k])) for g, p in phrases for k in range(5)}
    for _ in range(2000):
        own = rnd.choice("pqr"), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        assert (walk(*own) >= 0) == (own in prefixes)
    assert walk("p", "unknown") == -1 and walk("p", "w1 unknown") == -1
