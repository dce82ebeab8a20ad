"""Fill-in-middle: brute force, exact way back, frames that are moved unread, hard rows."""
import hashlib
import random

import numpy as np
import pytest

from linkspark.llm import fim

DOC = "doc_id long, text string, n string, frames int, _row string, form string, h int, kept string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(key, text):
    text, n = text or "", len(text or "")
    x = sha(f"1:{'' if key is None else key}")
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "n", 1, "r", "f", 2, "k") for i, t in rows], DOC).repartition(parts)


def random_text(rnd, n):
    return "".join(rnd.choice("ab \n<P>SM é中😀") for _ in range(n))


HARD = [(None, None), (None, "null id"), (1, ""), (2, None), (3, "x"), (3, "x"), (4, "<P"), (5, "has <M> inside"), (6, "<" * 40), (7, "é中😀" * 9),
        (8, "long " * 60_000), (9, "<S" * 50), (10, ">P<" * 20), (-11, "negative id")]


@pytest.mark.parametrize("frame", [1, 24, fim.FRAME])
def test_against_brute_force(spark, frame):
    rnd = random.Random(frame)
    long = HARD if frame > 1 else [r for r in HARD if len(r[1] or "") < 1000]
    rows = long + [(100 + i, random_text(rnd, rnd.randrange(0, 120))) for i in range(150)]
    found = fim.fill_in_middle(table(spark, rows), frame=frame).collect()
    assert {r.kept for r in found} == {"k"} and found[0]["_row"] == "r" and found[0].h == 2
    got = sorted((repr(r.doc_id), r.n, r.form, repr(r.prefix_chars), repr(r.middle_chars), r.output_sha256, r.restored_sha256) for r in found)
    want = []
    for key, text in rows:
        n, form, a, m, out = wanted(key, text)
        want.append((repr(key), n, form, repr(a), repr(m), sha(out), sha(text or "")))
    assert got == sorted(want)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_outputs_are_texts(spark):
    rows = [(i, f"text {i} of é中 " * (i % 7)) for i in range(60)]
    found = {r.doc_id: (r.form, r.text) for r in fim.output_texts(table(spark, rows), frame=32).collect()}
    assert found == {k: (wanted(k, t)[1], wanted(k, t)[4]) for k, t in rows}


def test_empty_table(spark):
    assert fim.fill_in_middle(table(spark, HARD).limit(0)).count() == 0


def test_only_cut_frames_are_read():
    unpack, opened = fim._zstd().ZstdDecompressor().decompress, []

    def counting(frame):
        opened.append(frame)
        return unpack(frame)
    text = "".join(f"word{i} é " for i in range(40_000))
    writer = fim.Frames(4096)
    for piece in fim.cut_up(np.frombuffer(text.encode(), np.uint8), 4096):
        writer.add(piece)
        writer.flush()
    frames, ends = writer.done()
    assert ends[-1] == len(text) and len(frames) > 80
    out, out_ends = fim.arranged(frames, ends, "psm", 100_001, 250_003, writer, counting)
    # the frame of each cut is read once on either side of it, and no other
    assert len(opened) == 4 and len(set(opened)) == 2
    assert out_ends[-1] == len(text) + 9
    assert b"".join(map(unpack, out)).decode() == f"<P>{text[:100_001]}<S>{text[250_003:]}<M>{text[100_001:250_003]}"
    assert fim.digests(out, "psm", unpack)[1] == sha(text)


def test_an_output_without_its_mark_is_refused():
    frame = fim._zstd().ZstdCompressor().compress(b"<P>ab<S>c")
    with pytest.raises(ValueError):
        fim.digests([frame], "psm", fim._zstd().ZstdDecompressor().decompress)
