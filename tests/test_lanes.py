"""Coders of many blocks side by side: the same bytes as a plain coder makes, block by block, and in a fraction of its time."""

import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from bytequarry.operators import codecs, kernels, lanes
from bytequarry.plans.queries import QUERIES

WHOLE, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


def plain(symbols):
    """Bits of (lower, upper) bounds, bit by bit."""
    low, high, held, bits = 0, WHOLE, 0, []
    for lower, upper in symbols:
        width = high - low
        low, high = low + (2 * lower * width + WHOLE) // (2 * WHOLE), low + (2 * upper * width + WHOLE) // (2 * WHOLE)
        while high < HALF or low >= HALF:
            bit = int(low >= HALF)
            bits += [bit] + [1 - bit] * held
            held, low, high = 0, 2 * (low - HALF * bit), 2 * (high - HALF * bit)
        while low >= QUARTER and high < 3 * QUARTER:
            held, low, high = held + 1, 2 * (low - QUARTER), 2 * (high - QUARTER)
    bit = int(low > QUARTER)
    bits += [bit] + [1 - bit] * (held + 1)
    full = len(bits) // 8 * 8
    tail = [int("".join(map(str, bits[full:])), 2)] if len(bits) % 8 else []
    return len(bits), np.packbits(np.array(bits[:full], np.uint8)).tobytes() + bytes(tail)


def plain_ac(block):
    freq = kernels.order0(block)
    upper = np.cumsum(freq).tolist()
    n, bits = plain((upper[b] - int(freq[b]), upper[b]) for b in block)
    return struct.pack("<II", n, len(block)) + freq.astype("<u4").tobytes() + bits


def plain_ac2(block):
    freq = kernels.order1(block)
    upper = np.cumsum(freq, axis=1).tolist()
    n, bits = plain((upper[a][b] - int(freq[a, b]), upper[a][b]) for a, b in zip(block, block[1:], strict=False))
    return struct.pack("<II", n, len(block)) + freq.astype("<u4").tobytes() + block[:1] + bits


def texts(n, size, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(400)]
    return [" ".join(r.choices(words, k=r.randint(1, 2 * size // 6))).encode() for _ in range(n)]


@pytest.fixture(scope="module")
def blocks():
    r = np.random.default_rng(5)
    odd = [b"", b"a", b"aa", b"ab", bytes(range(256)), b"a" * 700, b"\0\xff" * 33, bytes(999) + b"\1", b""]
    noise = [r.integers(0, 256, 900 + i, dtype=np.uint8).tobytes() for i in range(4)]
    rare = [(r.random(2000) < 0.003).astype(np.uint8).tobytes() for _ in range(4)]  # intervals that straddle the middle for long
    return texts(30, 600, 1) + odd + noise + rare + ["žluťoučký kůň\n".encode() * 40]


@pytest.mark.parametrize("few", [1, 20, 10**6])
@pytest.mark.parametrize("name", ["AC", "AC2"])
def test_side_by_side_makes_the_plain_coders_bytes(blocks, name, few, monkeypatch):
    """With all lanes taken side by side, with the long ones finished alone, and with each alone; in several chunks."""
    monkeypatch.setattr(lanes, "FEW", few)
    monkeypatch.setattr(lanes, "CHUNK_BYTES", 20_000)
    forth, back = codecs.STAGES[name]
    want = [{"AC": plain_ac, "AC2": plain_ac2}[name](b) if b else b"" for b in blocks]
    coded = list(kernels.MANY[forth](iter(blocks)))
    assert coded == want
    assert list(kernels.MANY[back](iter(coded))) == blocks
    assert forth(blocks[0]) == want[0] and back(want[0]) == blocks[0]


@pytest.mark.parametrize("name", ["AC", "AC2"])
def test_coding_many_blocks_takes_a_fraction_of_the_plain_coders_time(name):
    """700 texts of 1 KB, in CPU time beside a plain loop over 20 of them (a Python step for each byte, at least as much before)."""
    many = texts(700, 1000, 2)
    forth, back = codecs.STAGES[name]
    began = time.process_time()
    for b in many[:20]:
        {"AC": plain_ac, "AC2": plain_ac2}[name](b)
    alone = (time.process_time() - began) / sum(map(len, many[:20]))
    began = time.process_time()
    assert list(kernels.through([forth, back], many)) == many
    assert (time.process_time() - began) / sum(map(len, many)) < alone / 2


@pytest.mark.parametrize("query", ["ac_order0_roundtrip", "ac_order1_roundtrip"])
def test_round_trips_hold_no_coded_blocks_between_python_steps(query, spark, sf_dir):
    """One pass over a few blocks at a time; a column of coded blocks held 256 KiB for each row of a batch."""
    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("few", [1, 20, 10**6])
@pytest.mark.parametrize("spec", ["BWT", "BWT2", "MTF", "BWT+MTF+RLE+AC", "BWT+MTF+RLE+AC2", "BWT2+MTF+RLE+AC"])
def test_pipelines_side_by_side(blocks, spec, few, monkeypatch):
    """Many blocks give what each gives alone, and undoing gives the blocks back."""
    stages = [codecs.STAGES[s] for s in codecs.stages_of(spec)]
    alone = list(blocks)
    for forth, _ in stages:
        alone = [forth(x) for x in alone]
    monkeypatch.setattr(lanes, "FEW", few)
    monkeypatch.setattr(lanes, "CHUNK_BYTES", 20_000)
    assert list(kernels.through([f for f, _ in stages], blocks)) == alone
    assert list(kernels.through([g for _, g in reversed(stages)], alone)) == blocks


def test_front_lists_and_walks_are_taken_side_by_side():
    assert {kernels.mtf, kernels.unmtf, kernels.unbwt, kernels.unbwt_cyclic} <= set(kernels.MANY)


@pytest.mark.parametrize("few", [1, 10**6])
@pytest.mark.parametrize("name", ["AC", "AC2"])
def test_more_bits_held_than_a_word_has(name, few, monkeypatch):
    """40 times the middle one of three symbols of equal frequency: the interval straddles the middle for 63 bits."""
    block = {"AC": b"\1" * 40 + b"\0\2" * 40, "AC2": b"\1" * 41 + b"\1\0" * 40 + b"\1\2" * 40}[name]
    monkeypatch.setattr(lanes, "FEW", few)
    forth, back = codecs.STAGES[name]
    many = [block[: i + 50] for i in range(60)] + [block] * 9 + [block + b"\2\1" * i for i in range(9)]
    coded = list(kernels.MANY[forth](many))
    assert coded == [{"AC": plain_ac, "AC2": plain_ac2}[name](b) for b in many]
    assert list(kernels.MANY[back](coded)) == many


@pytest.mark.parametrize("shares", [1, 7, 4096])
@pytest.mark.parametrize("name", ["AC", "AC2"])
def test_symbols_that_shares_miss_are_searched(blocks, name, shares, monkeypatch):
    """Too few shares for the symbols, and blocks with more symbols after a byte than there are shares."""
    monkeypatch.setattr(lanes, "SHARES", shares)
    r = np.random.default_rng(3)
    many = [*blocks, *(np.minimum(r.geometric(0.2, 20_000 + i), 200).astype(np.uint8).tobytes() for i in range(25))]
    forth, back = codecs.STAGES[name]
    assert list(kernels.through([forth, back], many)) == many


def test_shares_find_nearly_all_symbols():
    """A decoder that searches all lanes' models for each byte takes most of its time for that."""
    for text in [*texts(20, 3000, 4), b"ab" * 3 + b"ac" * 7, bytes(range(256)) * 3]:
        pairs, freq, _ = kernels.pair_model(text)
        lower, upper, row = kernels._bounds(pairs, freq)
        begin = np.searchsorted(row, np.arange(row.max() + 1))
        parts, first, found = lanes._shares(begin, lower, upper)
        right = tried = 0
        for m, n in enumerate(parts.tolist()):
            value = np.linspace(0, WHOLE - 1, 999).astype(np.int64)
            share = (value * n + (1 << 32) - (1 << 32) // lanes.LATE >> 32) + first[m]
            got = found[share]
            assert (row[got] == m).all() and (lower[got] <= value).all()
            right, tried = right + int((value < upper[got]).sum()), tried + len(value)
        assert right > 0.97 * tried


def test_blocks_of_many_batches_are_worked_on_together():
    """Long blocks are few in a batch, so batches are read on; results come batch by batch, in order."""
    batches = [pa.RecordBatch.from_pydict({"block": pa.array([f"{i} {j}".encode() for j in range(i)], pa.binary())}) for i in (3, 0, 2, 5)]
    taken = []

    def run(blocks):
        taken.extend(blocks)
        yield from (b.upper() for b in taken)

    made = codecs._in_turn(iter(batches), run)
    first = next(made)
    assert len(taken) == 10
    assert [(b.num_rows, x) for b, x in [first, *made]] == [(b.num_rows, b.column("block").to_pylist()) for b in batches if b.num_rows]


def test_order_1_takes_a_small_part_of_the_plain_coders_time():
    """3,000 texts, forth and back, in CPU time beside a plain loop that codes 30 of them."""
    many = texts(3000, 2000, 6)
    began = time.process_time()
    for b in many[:30]:
        plain_ac2(b)
    alone = (time.process_time() - began) / sum(map(len, many[:30]))
    began = time.process_time()
    assert list(kernels.through([kernels.ac2, kernels.unac2], many)) == many
    took = (time.process_time() - began) / sum(map(len, many))
    assert took < alone / 6
