"""Transforms of one block of bytes, each with its inverse, and the frequency models that coding needs.

A block goes through a kernel whole. What can be said of all its bytes at once is NumPy; what goes byte by byte in the
nature of the matter (move-to-front, arithmetic coding) is a plain loop. Empty blocks stay empty throughout.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from . import lanes
from .lanes import WHOLE

RUN_CAP = 255


def as_array(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.uint8)


# Suffix order.
def suffix_array(block: bytes) -> np.ndarray:
    """Starts of the suffixes in byte order, a prefix before what it begins; by their first 8 bytes, then doubling."""
    n = len(block)
    if not n:
        return np.empty(0, np.int64)
    return _refined(_eights(np.concatenate([as_array(block), np.zeros(7, np.uint8)]), n), 8, False)


def _eights(t: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places on, as numbers."""
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= t[j : n + j].astype(np.uint64) << np.uint64(8 * (7 - j))
    return out


def _refined(first: np.ndarray, k: int, cyclic: bool) -> np.ndarray:
    """Places by what stands from each on, given numbers for its first k bytes; doubling, of what is still equal. A suffix
    that ends goes before what it begins; equal rotations go by falling place."""
    n = len(first)
    order = np.argsort(first)
    inside = first[order]
    new = np.concatenate([[True], inside[1:] != inside[:-1]])
    begin = np.flatnonzero(new)
    group = np.repeat(begin, np.diff(np.append(begin, n)))  # of each rank: where its equals begin
    rank = np.empty(n, np.int64)
    rank[order] = group
    left = np.flatnonzero(~(new & np.append(new[1:], True)))  # ranks that share their group
    while len(left):
        own = order[left]
        if cyclic:
            after = np.zeros(len(own), np.int64) if k >= n else rank[(own + k) % n] + 1
            last = k >= n
        else:
            # what ends within the first k bytes has only zeros left: the shorter first
            after = np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + n + 1, n - own)
            last = False
        if last:
            order[left] = own[np.lexsort((-own, group[left]))]
            break
        at = np.lexsort((after, group[left]))
        own, after, groups = own[at], after[at], group[left]
        order[left] = own
        new = np.concatenate([[True], (groups[1:] != groups[:-1]) | (after[1:] != after[:-1])])
        begin = np.flatnonzero(new)
        group[left] = np.repeat(left[begin], np.diff(np.append(begin, len(left))))
        rank[own] = group[left]
        left = left[~(new & np.append(new[1:], True))]
        k *= 2
    return order


# Burrows-Wheeler transform, with a sentinel or of the cyclic text.
def bwt(block: bytes) -> bytes:
    """Last column of the n+1 sorted suffixes (the empty one first), then the row of the whole text as u32. The whole
    text's row, which has no byte before it, holds the first byte as a filler."""
    if not block:
        return b""
    t, order = as_array(block), np.concatenate([[len(block)], suffix_array(block)])
    return t[np.where(order == 0, 0, order - 1)].tobytes() + struct.pack("<I", int(np.flatnonzero(order == 0)[0]))


def _unbwt(coded: Iterable[bytes]) -> Iterator[bytes]:
    lasts, steps, sizes = [], [], []
    for c in coded:
        last, row = as_array(c[:-4]).astype(np.int16) + np.int16(1), struct.unpack("<I", c[-4:])[0]
        last[row] = 0
        lasts.append((last - np.int16(1)).astype(np.uint8))
        steps.append(last_to_first(last))
        sizes.append(len(last) - 1)
    yield from lanes.walked(lasts, steps, [0] * len(lasts), sizes)


def unbwt(coded: bytes) -> bytes:
    return next(unbwt_many([coded]))


def rotations(block: bytes) -> np.ndarray:
    """Starts of the rotations in byte order; of equal ones (a text that repeats itself) the later start first, as the
    suffixes of the text written twice have it. Ranks of rotations' first k bytes are doubled cyclically; beyond k = n
    nothing can change."""
    n = len(block)
    return _refined(_eights(np.resize(as_array(block), n + 7), n), 8, True)


def bwt_cyclic(block: bytes) -> bytes:
    """Last column of the n rotations, ordered as suffixes of the text written twice, then the text's own row as u32."""
    if not block:
        return b""
    order = rotations(block)
    return as_array(block)[order - 1].tobytes() + struct.pack("<I", int(np.flatnonzero(order == 0)[0]))


def _unbwt_cyclic(coded: Iterable[bytes]) -> Iterator[bytes]:
    coded = list(coded)
    lasts = [as_array(c[:-4]) for c in coded]
    yield from lanes.walked(lasts, [last_to_first(x) for x in lasts], [struct.unpack("<I", c[-4:])[0] for c in coded], [len(x) for x in lasts])


def unbwt_cyclic(coded: bytes) -> bytes:
    return next(unbwt_cyclic_many([coded]))


unbwt_many, unbwt_cyclic_many = lanes.in_chunks(_unbwt), lanes.in_chunks(_unbwt_cyclic)


def last_to_first(last: np.ndarray) -> np.ndarray:
    """Row whose first byte is the last byte of each row."""
    step = np.empty(len(last), np.int64)
    step[np.argsort(last, kind="stable")] = np.arange(len(last))
    return step


# Move-to-front.
def present(block: bytes) -> bytes:
    """Which byte values occur: 256 bits, the highest bit of each byte first."""
    seen = np.zeros(256, bool)
    seen[as_array(block)] = True
    return np.packbits(seen).tobytes()


def _mtf(blocks: Iterable[bytes]) -> Iterator[bytes]:
    blocks = list(blocks)
    for b, x in zip(blocks, lanes.places_in_front([as_array(b) for b in blocks]), strict=True):
        yield x + present(b)


def _unmtf(coded: Iterable[bytes]) -> Iterator[bytes]:
    coded = list(coded)
    yield from lanes.values_in_front([np.flatnonzero(np.unpackbits(as_array(c[-32:]))).tolist() for c in coded], [as_array(c[:-32]) for c in coded])


mtf_many, unmtf_many = lanes.in_chunks(_mtf), lanes.in_chunks(_unmtf)


def mtf(block: bytes) -> bytes:
    """Places in a list of the block's byte values, ascending at first, each moved to the front when used; then the bitmap."""
    return next(mtf_many([block]))


def unmtf(coded: bytes) -> bytes:
    return next(unmtf_many([coded]))


# Run lengths.
def runs(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte, length) of the runs, none longer than 255."""
    t = as_array(block)
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(t)))
    pieces = -(-lengths // RUN_CAP)
    out = np.full(int(pieces.sum()), RUN_CAP, np.int64)
    if len(out):
        out[np.cumsum(pieces) - 1] = lengths - RUN_CAP * (pieces - 1)
    return np.repeat(t[starts], pieces), out.astype(np.uint8)


def _packed(block: bytes, body: bytes) -> bytes:
    """The body under flag FF if it saves a third or more, flag included; else the block under flag 00."""
    return b"\0" + block if (1 + len(body)) * 3 > len(block) * 2 else b"\xff" + body


def rle(block: bytes) -> bytes:
    """Lengths of all runs, then their bytes."""
    if not block:
        return b""
    symbols, lengths = runs(block)
    return _packed(block, lengths.tobytes() + symbols.tobytes())


def unrle(coded: bytes) -> bytes:
    if not coded or coded[0] == 0:
        return coded[1:]
    n = (len(coded) - 1) // 2
    return np.repeat(as_array(coded[1 + n :]), as_array(coded[1 : 1 + n])).tobytes()


def rle_interleaved(block: bytes) -> bytes:
    """Byte and length of each run in turn."""
    if not block:
        return b""
    return _packed(block, np.stack(runs(block), axis=1).tobytes())


def unrle_interleaved(coded: bytes) -> bytes:
    if not coded or coded[0] == 0:
        return coded[1:]
    pairs = as_array(coded[1:]).reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1]).tobytes()


# Frequency models.
def histogram(block: bytes) -> np.ndarray:
    return np.bincount(as_array(block), minlength=256)


def scaled(counts: np.ndarray, limit: int) -> np.ndarray:
    """Counts brought to a sum of limit: floors, and what is missing on the first of the largest."""
    total = int(counts.sum())
    if total in (0, limit):
        return counts.astype(np.int64)
    out = counts.astype(np.int64) * limit // total
    out[int(out.argmax())] += limit - int(out.sum())
    return out


def order0(block: bytes) -> np.ndarray:
    return scaled(histogram(block), WHOLE)


def pair_counts(block: bytes) -> np.ndarray:
    """How often each byte follows each: a row for the byte before."""
    t = as_array(block).astype(np.int64)
    return np.bincount(t[:-1] << 8 | t[1:], minlength=1 << 16).reshape(256, 256) if len(t) > 1 else np.zeros((256, 256), np.int64)


def order1(block: bytes) -> np.ndarray:
    """Pair counts with every row that has any brought to a sum of 2**32-1: rounded, and the difference, by ones, taken
    from the first symbols or given to the last."""
    counts = pair_counts(block)
    totals = counts.sum(1, keepdims=True)
    out = np.where(totals > 0, (2 * counts * WHOLE + totals) // np.maximum(2 * totals, 1), 0)
    for row in np.flatnonzero(totals[:, 0]):
        gap, some = WHOLE - int(out[row].sum()), np.flatnonzero(out[row])
        if gap < 0:
            out[row, some[:-gap]] -= 1
        elif gap:
            out[row, some[-gap:]] += 1
    return out


# Arithmetic coding over integers of 32 bits, of many blocks side by side. Bits go the highest first; the last byte holds
# its bits at its low end.
def pack_bits(bits: np.ndarray | list[int]) -> bytes:
    bits = np.asarray(bits, np.uint8)
    full = len(bits) // 8 * 8
    tail = bits[full:]
    return np.packbits(bits[:full]).tobytes() + (bytes([int(np.packbits(tail)[0]) >> 8 - len(tail)]) if len(tail) else b"")


def unpack_bits(data: bytes, n: int) -> list[int]:
    full = n // 8
    out = np.unpackbits(as_array(data[:full])).tolist()
    return out + [data[full] >> i & 1 for i in range(n % 8 - 1, -1, -1)] if n % 8 else out


def _ac(blocks: Iterable[bytes]) -> Iterator[bytes]:
    blocks = list(blocks)
    freqs = [order0(b) for b in blocks]
    uppers = [np.cumsum(f) for f in freqs]
    coded = lanes.encoded([as_array(b) for b in blocks], [_joined(u - f, u) for f, u in zip(freqs, uppers, strict=True)])
    for b, f, (n_bits, bits) in zip(blocks, freqs, coded, strict=True):
        yield struct.pack("<II", n_bits, len(b)) + f.astype("<u4").tobytes() + bits


def _joined(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Bounds as the coder takes them."""
    return lower.astype(np.uint64) << np.uint64(32) | upper.astype(np.uint64)


def _unac(coded: Iterable[bytes]) -> Iterator[bytes]:
    models, firsts, streams, bits, sizes = lanes.Models(), [], [], [], []
    for c in coded:
        n_bits, n = struct.unpack_from("<II", c)
        freq = np.frombuffer(c, "<u4", 256, 8).astype(np.int64)
        symbols = np.flatnonzero(freq)
        upper, none = np.cumsum(freq[symbols]), np.zeros(len(symbols), np.int64)
        firsts.append(models.add(upper - freq[symbols], upper, symbols, none, none, 1))
        streams.append(c[8 + 1024 :])
        bits.append(n_bits)
        sizes.append(n)
    yield from lanes.decoded(models, firsts, streams, bits, sizes)


def pair_model(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs that occur, byte before << 8 | byte, ascending; their frequencies as in order1; number of each place's pair)."""
    t = as_array(block).astype(np.uint16)
    places = t[:-1] << np.uint16(8) | t[1:]
    inside = np.sort(places)  # numpy's unique takes longer
    begin = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]])) if len(inside) else np.empty(0, np.int64)
    pairs, counts = inside[begin], np.diff(np.append(begin, len(inside)))
    number = np.empty(1 << 16, np.uint16)
    number[pairs] = np.arange(len(pairs))
    if not len(pairs):
        return pairs, counts, places
    begin, row = _rows(pairs)
    totals = np.add.reduceat(counts, begin)[row]
    freq = (2 * counts * WHOLE + totals) // (2 * totals)
    gap = (WHOLE - np.add.reduceat(freq, begin))[row]
    place = np.arange(len(pairs)) - begin[row]
    size = np.diff(np.append(begin, len(pairs)))[row]
    freq += (gap > 0) & (place >= size - gap)
    freq -= (gap < 0) & (place < -gap)
    return pairs, freq, number[places]


def _rows(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs of each byte before begin, and the number of each pair's byte before."""
    new = np.concatenate([[True], pairs[1:] >> 8 != pairs[:-1] >> 8])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _bounds(pairs: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, number of the byte before) of each pair: bounds among those of its byte before."""
    if not len(pairs):
        return freq, freq, freq
    begin, row = _rows(pairs)
    upper = np.cumsum(freq)
    upper -= (upper - freq)[begin][row]
    return upper - freq, upper, row


def _ac2(blocks: Iterable[bytes]) -> Iterator[bytes]:
    begins, held, numbers, bounds = [], [], [], []
    for b in blocks:
        pairs, freq, number = pair_model(b)
        begins.append((b[:1], len(b)))
        held.append((pairs, freq.astype("<u4")))
        numbers.append(number)
        bounds.append(_joined(*_bounds(pairs, freq)[:2]))
    coded = lanes.encoded(numbers, bounds)
    del numbers, bounds
    table = np.zeros(1 << 16, "<u4")
    for (begin, n), (pairs, freq), (n_bits, bits) in zip(begins, held, coded, strict=True):
        table[pairs] = freq
        yield b"".join([struct.pack("<II", n_bits, n), table.data, begin, bits])
        table[pairs] = 0


def _unac2(coded: Iterable[bytes]) -> Iterator[bytes]:
    models, firsts, streams, bits, sizes, begins = lanes.Models(), [], [], [], [], []
    at = 8 + (1 << 18)
    for c in coded:
        n_bits, n = struct.unpack_from("<II", c)
        freq = np.frombuffer(c, "<u4", 1 << 16, 8).reshape(256, 256)
        before = np.flatnonzero(freq.max(axis=1))  # most rows are empty, and quickly passed over so
        own = freq[before].reshape(-1)
        places = np.flatnonzero(own)
        pairs = before[places >> 8] << 8 | places & 255
        lower, upper, row = _bounds(pairs, own[places].astype(np.int64))
        number = np.zeros(256, np.int64)
        number[before] = np.arange(len(before))
        firsts.append(models.add(lower, upper, pairs & 255, row, number[pairs & 255], len(before)) + int(number[c[at]]))
        streams.append(c[at + 1 :])
        bits.append(n_bits)
        sizes.append(n - 1)
        begins.append(c[at : at + 1])
    for b, x in zip(begins, lanes.decoded(models, firsts, streams, bits, sizes), strict=True):
        yield b + x


def coded_size(coded: bytes) -> int:
    """Bytes of the block that one of the coders made this of."""
    return struct.unpack_from("<I", coded, 4)[0] if coded else 0


ac_many, ac2_many = (lanes.in_chunks(f, times=lanes.CODED) for f in (_ac, _ac2))
unac_many, unac2_many = (lanes.in_chunks(f, coded_size, lanes.CODED) for f in (_unac, _unac2))


def ac(block: bytes) -> bytes:
    """u32 bits, u32 bytes, 256 x u32 frequencies, bits: coded by the block's own byte frequencies."""
    return next(ac_many([block]))


def unac(coded: bytes) -> bytes:
    return next(unac_many([coded]))


def ac2(block: bytes) -> bytes:
    """u32 bits, u32 bytes, 256 x 256 x u32 frequencies, first byte, bits: each byte coded by the byte before it."""
    return next(ac2_many([block]))


def unac2(coded: bytes) -> bytes:
    return next(unac2_many([coded]))


#: Kernels that work on many blocks side by side.
MANY: dict[Callable[[bytes], bytes], Callable[[Iterable[bytes]], Iterator[bytes]]] = {unbwt: unbwt_many, unbwt_cyclic: unbwt_cyclic_many, mtf: mtf_many, unmtf: unmtf_many, ac: ac_many, unac: unac_many, ac2: ac2_many, unac2: unac2_many}


def through(chain: Iterable[Callable[[bytes], bytes]], blocks: Iterable[bytes]) -> Iterator[bytes]:
    """Blocks through kernels, in order; what is made on the way is held a chunk at a time."""
    for f in chain:
        blocks = MANY[f](blocks) if f in MANY else map(f, blocks)
    return iter(blocks)
