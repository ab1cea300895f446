from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sitemetrics.llm import texts
from sitemetrics.llm.bitpack import bits_for, pack, unpack
from sitemetrics.llm.fingerprint import WINDOW, _GAIN, _MOST, CLASSES, entropy_classes, likeness
from sitemetrics.llm.labelled import shapes
from sitemetrics.llm.pitman_yor import seat

LOWER = {i: i + 32 for i in range(65, 91)}
RULES = [(texts.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), (texts.NOT_SPACE, re.compile(r"[^\x20\x09-\x0D]+"))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAB09.-éß😀", max_size=30)), max_size=8), st.integers(1, 12))
def test_words_equal_the_regular_expressions(found, segment):
    old, texts.SEGMENT_BYTES = texts.SEGMENT_BYTES, segment
    try:
        for letters, rule in RULES:
            w = texts.words(pa.array(found, pa.string()), letters)
            want = [rule.findall((t or "").translate(LOWER)) for t in found]
            assert np.diff(w.first).tolist() == [len(x) for x in want]
            assert [w.word(i) for i in range(len(w.hash))] == [x for y in want for x in y]
            flat = [x for y in want for x in y]
            assert len(set(w.hash.tolist())) == len(set(flat))
    finally:
        texts.SEGMENT_BYTES = old


def test_words_of_a_sliced_column_and_of_none():
    column = pa.array(["skip me", None, "Keep THIS", ""])
    w = texts.words(column.slice(1), texts.ALNUM)
    assert [w.word(i) for i in range(len(w.hash))] == ["keep", "this"] and w.first.tolist() == [0, 0, 2, 2]
    assert texts.words(pa.array([], pa.string()), texts.ALNUM).first.tolist() == [0]


def test_shingles_stay_inside_a_text():
    w = texts.words(pa.array(["a b c", "d", "a b"]), texts.NOT_SPACE)
    hashes, at = texts.shingles(w, 2)
    assert at.tolist() == [0, 1, 4] and hashes[0] == hashes[2]


def test_shapes_follow_the_tokens():
    column = pa.array(["Word NO!! a1", "", "  x\n"])
    s = shapes(column)
    assert [s.word(i) for i in range(len(s.hash))] == ["Aa", "A!", "a0", "a"]
    assert s.first.tolist() == texts.words(column, texts.NOT_SPACE).first.tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 1 << 20), st.data())
def test_bit_packing_round_trip(vocabulary, data):
    bits = bits_for(vocabulary)
    ids = np.array(data.draw(st.lists(st.integers(0, vocabulary - 1), max_size=50)), np.uint32)
    packed = pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8) and unpack(packed, bits, len(ids)).tolist() == ids.tolist()


def test_entropy_classes_equal_counting():
    data = np.random.default_rng(3).integers(97, 110, 700).astype(np.uint8)
    data[100:300] = 65
    for i, kind in enumerate(entropy_classes(data)):
        total = _GAIN[np.bincount(data[i : i + WINDOW], minlength=256)].sum()
        assert kind == min((_MOST - total) * CLASSES // _MOST, CLASSES - 1)
    assert len(entropy_classes(data[:63])) == 0


def test_likeness_bounds():
    some = np.packbits(np.random.default_rng(1).random((2, 2048)) < 0.3, axis=1)
    none = np.zeros((0, 256), np.uint8)
    assert likeness(some, some) == 1 and likeness(none, none) == 1 and likeness(some, none) == 0
    other = np.packbits(np.random.default_rng(2).random((3, 2048)) < 0.3, axis=1)
    assert 0 <= likeness(some, other) < 0.2 and likeness(some, some[:1]) == 1


def test_seating_follows_the_restaurant_process():
    """Mean tables of n customers with strength a and discount 0: the sum of a / (a + i)."""
    rng = np.random.default_rng(0)
    tables = seat(np.full(4000, 50), np.full(4000, 2.0), 0.0, rng)
    assert abs(tables.mean() - sum(2 / (2 + i) for i in range(1, 50)) - 1) < 0.1
    c = rng.integers(0, 5000, 300)
    tables = seat(c, np.full(300, 3.0), 0.5, rng)
    assert (tables <= c).all() and (tables[c > 0] >= 1).all() and (tables[c == 0] == 0).all()
