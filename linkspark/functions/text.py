"""Text analysis: tokens, stop words, stems, edit distance, highlighting."""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.sql import lam, let, struct

# A word: letters, marks, digits; single dots and apostrophes inside it belong to it.
# The possessive group keeps matching iterative, so a very long word cannot exhaust the stack.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[.'’][\p{L}\p{M}\p{N}_]+)*+"

# Fixed value: the search server's default English stop words.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with").split()


def tokens(text: Column, analyzer: str = "english") -> Column:
    """Index terms of a text in order; position i of the array is token i of the text.

    ``standard`` lower-cases. ``english`` also drops possessives and stop words; its terms are the stems of what is
    left, see :func:`stems`.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if analyzer == "standard":
        return words
    return F.filter(F.transform(words, lambda w: kept(w, analyzer)), lambda w: w.isNotNull())


def kept(word: Column, analyzer: str = "english") -> Column:
    """What an analyzer keeps of a word, null of a stop word."""
    if analyzer != "english":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    bare = F.regexp_replace(word, "['’]s$", "")
    return F.when(~bare.isin(*STOP_WORDS), bare)


# --- Porter's suffix stripping (An algorithm for suffix stripping, 1980) -----------------

_VOWEL = "aeiou"

# The suffix tables of steps 2, 3 and 4 of the published algorithm.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize").split()


def _shape(word: str) -> str:
    """'v' and 'c' per letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in _VOWEL or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and len(word) >= 3 and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _shape_of(word: Column) -> Column:
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(""), lambda out, c: F.concat(out, F.when(
        c.isin(*_VOWEL) | ((c == "y") & out.endswith("c")), "v").otherwise("c")))


def stems(words: DataFrame, column: str = "word") -> DataFrame:
    """(column, stem) for every distinct word, worked out once per word of the vocabulary; texts are joined with it."""
    return stemmed(words.select(column).distinct(), column)


def stemmed(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` plus ``stem``: the published steps, one column after another.

    Words with other than ASCII letters, and those of up to two, are their own stems.
    """
    w, shape = F.col("_w"), F.col("_s")

    def head(n) -> Column:  # all but n letters
        return F.left(w, F.length(w) - n)

    def measure(n) -> Column:
        return F.regexp_count(F.left(shape, F.length(shape) - n), F.lit("vc"))

    def voiced(n) -> Column:
        return F.left(shape, F.length(shape) - n).contains("v")

    def ends_cvc(word: Column, own: Column) -> Column:
        return own.endswith("cvc") & ~F.right(word, F.lit(1)).isin("w", "x", "y")

    def step(df: DataFrame, value: Column) -> DataFrame:
        return df.withColumn("_w", value).withColumn("_s", _shape_of(F.col("_w")))

    def longest(suffixes, then) -> Column:
        out = F.when(F.lit(False), w)
        for suffix in sorted(suffixes, key=len, reverse=True):
            out = out.when(w.endswith(suffix), then(suffix))
        return out.otherwise(w)
    plain = F.col(column).rlike("^[a-z]{3,}$")
    df = words.filter(plain).withColumn("_w", F.col(column))
    df = step(df, F.when(w.endswith("sses") | w.endswith("ies"), head(2)).when(w.endswith("s") & ~w.endswith("ss"), head(1)).otherwise(w))
    # past and progressive forms: what is left of them is mended
    size = F.when(w.endswith("eed"), None).when(w.endswith("ed") & voiced(2), 2).when(w.endswith("ing") & voiced(3), 3)
    df = df.withColumn("_eed", F.when(w.endswith("eed") & (measure(3) > 0), head(1))).withColumn("_cut", size)
    df = df.withColumn("_c", F.left(w, F.length(w) - F.col("_cut"))).withColumn("_cs", F.left(shape, F.length(shape) - F.col("_cut")))
    c, cs = F.col("_c"), F.col("_cs")
    last = F.right(c, F.lit(1))
    double = (F.length(c) > 1) & (last == F.substring(c, -2, 1)) & cs.endswith("c") & ~last.isin("l", "s", "z")
    mended = (F.when(c.endswith("at") | c.endswith("bl") | c.endswith("iz"), F.concat(c, F.lit("e")))
              .when(double, F.left(c, F.length(c) - 1))
              .when((F.regexp_count(cs, F.lit("vc")) == 1) & ends_cvc(c, cs), F.concat(c, F.lit("e"))).otherwise(c))
    df = step(df, F.when(c.isNotNull(), mended).otherwise(F.coalesce("_eed", w))).drop("_eed", "_cut", "_c", "_cs")
    df = step(df, F.when(w.endswith("y") & voiced(1), F.concat(head(1), F.lit("i"))).otherwise(w))
    for table in (_STEP2, _STEP3):
        df = step(df, longest(table, lambda s, t=table: F.when(
            measure(len(s)) > 0, F.concat(head(len(s)), F.lit(t[s]))).otherwise(w)))
    enough = lambda s: (measure(len(s)) > 1) & (
        head(3).endswith("s") | head(3).endswith("t") if s == "ion" else F.lit(True))
    df = step(df, longest(_STEP4, lambda s: F.when(enough(s), head(len(s))).otherwise(w)))
    short = ends_cvc(head(1), F.left(shape, F.length(shape) - 1))
    df = step(df, F.when(w.endswith("e") & ((measure(1) > 1) | ((measure(1) == 1) & ~short)), head(1)).otherwise(w))
    df = step(df, F.when(w.endswith("ll") & (measure(1) > 1), head(1)).otherwise(w))
    return df.select(*words.columns, w.alias("stem")).unionByName(words.filter(~plain).withColumn("stem", F.col(column)))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    # plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive forms
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[:-len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[:-len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[:-len(s)]) > 0:
            w = w[:-len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s:
        head = w[:-len(s)]
        if _measure(head) > 1 and (s != "ion" or head.endswith(("s", "t"))):
            w = head
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# --- edit distance, as SQL expressions ----------------------------------------------------

def edits_allowed(term: str) -> str:
    """0 for up to two characters, 1 for three to five, 2 beyond."""
    return f"CASE WHEN length({term}) <= 2 THEN 0 WHEN length({term}) <= 5 THEN 1 ELSE 2 END"


def deletions(term: str, most: str) -> str:
    """``term`` and all strings left after removing up to ``most`` (0..2) characters.

    Two words within k edits, swaps of neighbours included, share a string left after removing
    up to k characters from each, so an equality join on these finds every fuzzy match.
    """
    none = "CAST(array() AS array<string>)"
    size = f"length({term})"
    one = lam(lambda i: f"concat(left({term}, {i} - 1), substr({term}, {i} + 1))")

    def second(i: str) -> str:
        cut = lam(lambda j: f"concat(left({term}, {i} - 1), substr({term}, {i} + 1, {j} - {i} - 1), substr({term}, {j} + 1))")
        return f"transform(sequence({i} + 1, {size}), {cut})"

    return f"""array_distinct(concat(array({term}),
      IF({most} >= 1 AND {size} >= 1, transform(sequence(1, {size}), {one}), {none}),
      IF({most} >= 2 AND {size} >= 2, flatten(transform(sequence(1, {size} - 1), {lam(second)})), {none})))"""


PARTS = 5  # of a long word: two edits touch four of them at most, if both are swaps across a cut


def _part(size: str, i: str) -> tuple[str, str]:
    """Start (from 0) and length of the i-th part of a word of ``size`` letters."""
    start = f"CAST(floor({i} * {size} / {PARTS}) AS int)"
    return start, f"(CAST(floor(({i} + 1) * {size} / {PARTS}) AS int) - {start})"


def parts(term: str) -> str:
    """array<struct<size, part, piece>>: the parts of a word, with its length."""
    start, width = _part(f"length({term})", "i")
    return f"transform(sequence(0, {PARTS - 1}), i -> struct(length({term}) AS size, i AS part, substr({term}, {start} + 1, {width}) AS piece))"


def near_parts(term: str) -> str:
    """What :func:`parts` gives for some word within two edits is among these.

    Such a word is at most two letters longer or shorter, one of its parts is untouched, and that part
    stands at most two places further or earlier here. The strings add up to a fixed multiple of the word.
    """
    start, width = _part("n", "i")
    return f"""array_distinct(flatten(flatten(transform(sequence(length({term}) - 2, length({term}) + 2), n ->
      transform(sequence(0, {PARTS - 1}), i -> transform(filter(sequence(-2, 2), d -> {start} + d >= 0 AND {start} + d + {width} <= length({term})),
        d -> struct(n AS size, i AS part, substr({term}, {start} + d + 1, {width}) AS piece)))))))"""


def _one_swap(a: str, b: str) -> str:
    """The words differ by swapping two neighbours."""
    swapped = lam(lambda i: f"{b} = concat(left({a}, {i} - 1), substr({a}, {i} + 1, 1), substr({a}, {i}, 1), substr({a}, {i} + 2))")
    return f"(length({a}) > 1 AND length({a}) = length({b}) AND exists(sequence(1, greatest(length({a}) - 1, 1)), {swapped}))"


def edit_distance(a: str, b: str) -> str:
    """Edit distance in which swapping two neighbours counts one; 3 stands for three and more.

    The built-in distance does not know swaps. It equals ours up to 1; at 2 a single swap makes
    the difference. At 3 or 4 the distance is 2 only if there is a swap with at most one more
    edit, which then lies wholly before or wholly after it.
    """
    def single(x: str, y: str) -> str:
        return f"(levenshtein({x}, {y}, 1) = 1 OR {_one_swap(x, y)})"

    def at(i: str, shift: str) -> str:
        halves = struct(la=f"left({a}, {i} - 1)", lb=f"left({b}, {i} + {shift} - 1)",
                        ra=f"substr({a}, {i} + 2)", rb=f"substr({b}, {i} + {shift} + 2)")
        rest = let(halves, lambda h: f"(({h}.la = {h}.lb AND {single(f'{h}.ra', f'{h}.rb')}) OR "
                                     f"({h}.ra = {h}.rb AND {single(f'{h}.la', f'{h}.lb')}))")
        return (f"({i} + {shift} >= 1 AND substr({b}, {i} + {shift}, 2) = reverse(substr({a}, {i}, 2)) "
                f"AND length(substr({b}, {i} + {shift}, 2)) = 2 AND {rest})")

    anywhere = lam(lambda i: " OR ".join(at(i, d) for d in ("-1", "0", "1")))
    swap_and_edit = f"exists(sequence(1, greatest(length({a}) - 1, 1)), {anywhere})"
    return let(f"levenshtein({a}, {b}, 4)", lambda d: f"""CASE WHEN {d} BETWEEN 0 AND 1 THEN {d}
      WHEN {d} = 2 THEN IF({_one_swap(a, b)}, 1, 2)
      WHEN {d} IN (3, 4) AND {swap_and_edit} THEN 2 ELSE 3 END""")


# --- highlighting -------------------------------------------------------------------------

FRAGMENTS, FRAGMENT_SIZE = 2, 200
_WORD = regex.compile(TOKEN)


def _index_term(word: str, analyzer: str) -> str:
    word = word.lower()
    if analyzer == "standard":
        return word
    return stem(word[:-2] if word.endswith(("'s", "’s")) else word)


def mark(text: str, terms: set[str], analyzer: str, fragments: int, size: int) -> list[str]:
    """Fragments of ``text`` with matching words in <em>; ``size`` 0 keeps the text whole."""
    hits = [m.span() for m in _WORD.finditer(text) if _index_term(m.group(), analyzer) in terms]
    if not hits:
        return []
    if not size:
        chosen = [(0, len(text))]
    else:
        windows, at = [], 0
        while at < len(hits):  # greedy windows of about ``size`` characters, in text order
            start = hits[at][0]
            inside = at
            while inside + 1 < len(hits) and hits[inside + 1][1] - start <= size:
                inside += 1
            slack = max(size - (hits[inside][1] - start), 0) // 2
            low = max(start - slack, windows[-1][1][1] if windows else 0)
            windows.append((inside - at + 1, (low, min(hits[inside][1] + slack, len(text)))))
            at = inside + 1
            while at < len(hits) and hits[at][0] < windows[-1][1][1]:
                at += 1
        windows.sort(key=lambda w: (-w[0], w[1]))
        chosen = sorted(w[1] for w in windows[:fragments])
    out = []
    for low, high in chosen:
        piece, at = "", low
        for a, b in hits:
            if a >= low and b <= high:
                piece += text[at:a] + "<em>" + text[a:b] + "</em>"
                at = b
        out.append((piece + text[at:high]).strip())
    return out
