"""Every transform of a block against its inverse, and against what it means, on edge blocks and random ones."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.operators import kernels as K
from bytequarry.operators.codecs import STAGES

EDGES = [b"", b"a", b"aa", b"ab", *(b"a" * n for n in (254, 255, 256, 510, 511)), bytes(range(256)), b"abab" * 20, b"\0\xff" * 9, b"\0", b"\xff", "äöü漢字😀".encode() * 5, bytes(random.Random(1).choices(range(256), k=700)), bytes(random.Random(2).choices(b"ab", k=513)), b"banana", b"x" * 512 + b"y"]


@pytest.mark.parametrize("name", list(STAGES))
def test_round_trip(name):
    forth, back = STAGES[name]
    for block in EDGES:
        assert back(forth(block)) == block


@pytest.mark.parametrize("name", list(STAGES))
@settings(max_examples=60, deadline=None)
@given(block=st.one_of(st.binary(max_size=120), st.text("ab\n", max_size=200).map(str.encode)))
def test_round_trip_any(name, block):
    forth, back = STAGES[name]
    assert back(forth(block)) == block


@pytest.mark.parametrize("block", EDGES)
def test_suffix_array(block):
    assert K.suffix_array(block).tolist() == sorted(range(len(block)), key=lambda i: block[i:])


@pytest.mark.parametrize("block", [b for b in EDGES if b])
def test_bwt_by_definition(block):
    n = len(block)
    order = sorted(range(n + 1), key=lambda i: block[i:])
    assert K.bwt(block) == bytes(block[max(i - 1, 0)] for i in order) + order.index(0).to_bytes(4, "little")
    order = sorted(range(n), key=lambda i: (block + block)[i:])
    assert K.bwt_cyclic(block) == bytes(block[i - 1] for i in order) + order.index(0).to_bytes(4, "little")


@pytest.mark.parametrize("block", [b for b in EDGES if b])
def test_mtf_closed_form(block):
    """Distinct symbols since the last use; at first use those so far and the smaller ones still to come."""
    want = []
    for i, b in enumerate(block):
        last = block.rfind(b, 0, i)
        seen = set(block[:i])
        want.append(len(set(block[last + 1 : i])) if last >= 0 else len(seen) + len([c for c in set(block) - seen if c < b]))
    coded = K.mtf(block)
    assert list(coded[:-32]) == want
    assert coded[-32:] == bytes(sum(1 << (7 - k) for k in range(8) if 8 * j + k in block) for j in range(32))


@pytest.mark.parametrize(("n", "lengths"), [(254, [254]), (255, [255]), (256, [255, 1]), (510, [255, 255]), (511, [255, 255, 1])])
def test_run_cap(n, lengths):
    symbols, found = K.runs(b"q" * n)
    assert found.tolist() == lengths and set(symbols.tolist()) == {ord("q")}


def test_rle_flag():
    assert K.rle(b"abc") == b"\0abc"
    assert K.rle(b"a" * 9) == b"\xff\x09a"
    assert K.rle(b"aaab") == b"\0aaab"  # 5 bytes of 4
    assert K.rle(b"a" * 8 + b"b") == b"\xff\x08\x01ab"  # 5 of 9
    assert K.rle_interleaved(b"a" * 8 + b"b") == b"\xffa\x08b\x01"


@pytest.mark.parametrize("block", EDGES)
def test_models(block):
    freq = K.order0(block)
    assert freq.sum() == (K.WHOLE if block else 0)
    assert (freq > 0).tolist() == (K.histogram(block) > 0).tolist()
    rows = K.order1(block).sum(1)
    assert set(rows.tolist()) <= {0, K.WHOLE}
    assert set(np.flatnonzero(rows).tolist()) == set(block[:-1])


def test_order1_compensation_by_ones():
    rng = np.random.default_rng(3)
    for _ in range(50):
        block = rng.integers(0, rng.integers(2, 250), 2000).astype(np.uint8).tobytes()
        counts, model = K.pair_counts(block), K.order1(block)
        totals = counts.sum(1, keepdims=True)
        near = np.where(totals > 0, (2 * counts * K.WHOLE + totals) // np.maximum(2 * totals, 1), 0)
        assert np.abs(model - near).max() <= 1


def test_scaled_gives_the_rest_to_the_first_largest():
    assert K.scaled(np.array([1, 1, 1]), 10).tolist() == [4, 3, 3]
    assert K.scaled(np.array([2, 3, 5]), 10).tolist() == [2, 3, 5]


def test_bits():
    assert K.pack_bits([1, 0, 1]) == b"\x05"
    assert K.pack_bits([1] * 8 + [0, 1]) == b"\xff\x01"
    for n in range(20):
        bits = random.Random(n).choices([0, 1], k=n)
        assert K.unpack_bits(K.pack_bits(bits), n) == bits


def test_coder_headers():
    coded = K.ac(b"hello")
    assert int.from_bytes(coded[4:8], "little") == 5 and len(coded) > 1032
    coded = K.ac2(b"hello")
    assert coded[8 + 262_144 : 8 + 262_145] == b"h"
