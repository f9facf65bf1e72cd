import random
import re

import numpy as np
import pyarrow as pa

from siltstone.llm import kernels as K

PARTS = ["Ab", "c9", " ", ".", "é", "ñ", "中", "\n", "-", "Z", "", "😀", "\t"]


def _texts(seed, n=200):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def _words(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return re.findall(rb"[a-z0-9\x80-\xff]+", raw)


def test_words_and_grams_equal_python():
    texts = _texts(1)
    buf, off = K.text_buffers(pa.array(texts))
    h, s, e, woff = K.words(buf, off)
    seen, back = {}, {}
    for d, t in enumerate(texts):
        ws = _words(t)
        assert len(ws) == woff[d + 1] - woff[d]
        for w, x in zip(ws, h[woff[d] : woff[d + 1]].tolist()):
            assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w
    for k in (1, 2, 3, 5):
        g, goff = K.grams(h, woff, k)
        seen, back = {}, {}
        for d, t in enumerate(texts):
            ws = _words(t)
            want = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([tuple(ws)] if ws else [])
            assert len(want) == goff[d + 1] - goff[d]
            for w, x in zip(want, g[goff[d] : goff[d + 1]].tolist()):
                assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_sliced_and_null_arrays():
    a = pa.array(["xx", None, "abc", "", "d"])
    buf, off = K.text_buffers(a.slice(1, 3))
    assert np.diff(off).tolist() == [0, 3, 0] and buf[off[1] : off[2]].tobytes() == b"abc"
    assert K.text_buffers(pa.array([], pa.string()))[1].tolist() == [0]
    ids, there = K.ids_of(pa.array([5, None], pa.int64()))
    assert ids.tolist() == [5, 0] and there.tolist() == [True, False]


def test_blocks_hold_whole_documents():
    texts = ["a" * n for n in (5, 0, 300, 7, 7)]
    buf, off = K.text_buffers(pa.array(texts))
    got = list(K.blocks(buf, off, 16))
    assert [x for lo, hi, *_ in got for x in range(lo, hi)] == list(range(5))
    for lo, hi, b, o in got:
        assert np.diff(o).tolist() == [len(t) for t in texts[lo:hi]] and len(b) == o[-1]
