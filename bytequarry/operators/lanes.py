"""Byte-by-byte work on many blocks side by side.

Coding a byte rests on all bytes before it, but blocks don't rest on each other. So blocks stand in lanes, longest first,
and NumPy takes one byte of every lane at a time. Lanes that have ended are at the end, so those that run are always the
first so many. When fewer than FEW run, NumPy's calls cost more than plain loops, which take each lane from where it stands.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np

#: Range of the arithmetic coder and of its models.
WHOLE = (1 << 32) - 1
HALF, QUARTER = 1 << 31, 1 << 30
#: Bytes of blocks, and blocks, that are worked on side by side.
CHUNK_BYTES, CHUNK_BLOCKS = 8 << 20, 8192
#: Times as many bytes for the coders: long blocks are few, so a step of theirs has more lanes.
CODED = 3
#: Lanes from which on they are worked on side by side.
FEW = 20
#: Values that are turned at once from steps to lanes.
GROUP = 1 << 16
#: Most shares of a model's range by which symbols are looked up, and how much of a share each begins late, as bounds are
#: rounded up and down.
SHARES, LATE = 4096, 1 << 10
#: Shares of the rarest symbol where no few shares fit all.
FINER = 16

U = np.uint64
_MASK, _LOW31, _TOP, _ROUND, _ONE = (np.array(x, U) for x in (WHOLE, HALF - 1, HALF, HALF - 1, 1))
_5, _31, _32, _52 = (np.array(x, U) for x in (5, 31, 32, 52))
#: The bias of a float's exponent, and 31 or 30 places.
_SHARED, _HELD, _SOME = np.array(1023 + 31, U), np.array(1023 + 30, U), np.array(0.5)


def in_chunks(run: Callable[[Iterable[bytes]], Iterator[bytes]], size: Callable[[bytes], int] = len, times: int = 1) -> Callable[[Iterable[bytes]], Iterator[bytes]]:
    """A function of some blocks, which reads them all before it gives the first result, as one of any number of blocks, in
    order, a chunk (so many times CHUNK_BYTES) at a time. Empty blocks stay."""

    def many(blocks: Iterable[bytes]) -> Iterator[bytes]:
        source = iter(blocks)

        def chunk(filled: list[bool]) -> Iterator[bytes]:
            n = 0
            for x in source:
                filled.append(bool(x))
                if x:
                    n += size(x)
                    yield x
                if n >= times * CHUNK_BYTES or len(filled) >= CHUNK_BLOCKS:
                    return

        while True:
            filled: list[bool] = []
            made = run(chunk(filled))
            first = list(islice(made, 1))
            if not filled:
                return
            made = chain(first, made)
            for full in filled:
                yield next(made) if full else b""

    return many


class Lanes:
    """Lengths of lanes, longest first, and where each step's values stand that are written one step after another."""

    def __init__(self, lengths: Sequence[int]):
        n = np.asarray(lengths, np.int64)
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        steps = int(self.n[FEW - 1]) if len(n) >= FEW else 0  # while FEW or more run
        ends = np.searchsorted(-self.n, -np.arange(steps), side="left")  # lanes longer than each step
        self.steps, self.running = steps, ends.tolist()
        self.base = np.cumsum(ends) - ends
        self.total = int(ends.sum())

    def own(self, values: np.ndarray, lane: int) -> np.ndarray:
        """A lane's values of the steps that were taken side by side."""
        return values[self.base[: min(int(self.n[lane]), self.steps)] + lane]

    def groups(self, begin: int = 0) -> Iterator[tuple[int, int]]:
        """Lanes from `begin` on, some at a time, as rows of a table that fits a core's cache."""
        while begin < len(self.n):
            end = min(len(self.n), begin + max(1, GROUP // max(1, min(int(self.n[begin]), self.steps))))
            yield begin, end
            begin = end

    def _where(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the lanes from i to j at each step, and which of them there are."""
        t = min(int(self.n[i]), self.steps)
        return self.base[:t, None] + np.arange(i, j), np.arange(t)[:, None] < self.n[i:j]

    def laid(self, values: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Lanes' numbers, each lane's raised by its `first`, one step after another."""
        out = np.empty(self.total, np.uint32)
        for i, j in self.groups():
            where, some = self._where(i, j)
            own = np.zeros((j - i, len(where)), np.uint32)
            for row, x in zip(own, values[i:j], strict=True):
                row[: len(x)] = x[: len(row)]
            own += first[i:j, None].astype(np.uint32)
            out[where[some]] = own.T[some]
        return out

    def taken(self, values: Sequence[np.ndarray], i: int, j: int) -> list[np.ndarray]:
        """Rows of the lanes from i to j; zero where a lane has ended."""
        where, some = self._where(i, j)
        if not some.all():
            where[~some] = 0
        return [np.ascontiguousarray(np.where(some, x[where], 0).astype(x.dtype, copy=False).T) if len(x) else np.zeros((j - i, len(where)), x.dtype) for x in values]

    def restored(self, made: list) -> list:
        """What was made for each lane, in the order in which the lengths came."""
        out = [None] * len(made)
        for i, x in zip(self.order.tolist(), made, strict=True):
            out[i] = x
        return out


class _Steps:
    """Ends of the running lanes' intervals, (2, lanes), and what they go through at each step, in place: at a hundred lanes
    and fewer, a new array costs as much as the work on it."""

    def __init__(self, lanes: int):
        self._all = np.zeros((7, lanes), U)
        self._all[1] = WHOLE
        self.cut(lanes)

    def cut(self, k: int) -> None:
        """From now on the first k run."""
        own = self._all[:, :k]
        self.ends, self.low, self.high, self.next, self.width, self.spare = own[:2], own[0], own[1], own[2:4], own[4], own[4].view(np.int64)
        self.lower, self.upper, self.shared, self.held = own[2], own[3], own[5], own[6]
        self.real = own[5].view(np.float64), own[6].view(np.float64)

    def narrow(self, bounds: np.ndarray) -> None:
        """To the part of a symbol: its bounds, as lower << 32 | upper. Afterwards `next` has the ends."""
        np.right_shift(bounds, _32, out=self.lower)
        np.bitwise_and(bounds, _MASK, out=self.upper)
        np.subtract(self.high, self.low, out=self.width)
        new = self.next
        new *= self.width
        new += _ROUND
        new //= _MASK
        new += self.low

    def shift(self) -> None:
        """The leading bits that the ends share go out (`shared` of them), and then those by which they straddle the middle
        (`held`). A float's exponent is the place of the highest bit."""
        ends, low, high, found, shared, held = self.ends, self.low, self.high, self.spare, self.shared, self.held
        np.bitwise_xor(self.lower, self.upper, out=self.width)
        self.real[0][...] = found
        shared >>= _52
        np.subtract(_SHARED, shared, out=shared)
        np.left_shift(self.next, shared, out=ends)
        ends &= _MASK
        np.bitwise_xor(low, _LOW31, out=self.width)
        np.bitwise_or(self.width, high, out=self.width)
        np.bitwise_and(self.width, _LOW31, out=self.width)
        real = self.real[1]
        real[...] = found
        real += _SOME  # where none is left
        held >>= _52
        np.subtract(_HELD, held, out=held)
        ends <<= held
        ends &= _LOW31
        high |= _TOP


def encoded(numbers: list[np.ndarray], bounds: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(bits, their bytes, the last byte's at its low end) of the arithmetic code of each sequence of numbers of symbols in
    a table of bounds out of WHOLE, as lower << 32 | upper."""
    lanes = Lanes([len(x) for x in numbers])
    order = lanes.order.tolist()
    sizes = np.array([len(bounds[i]) for i in order], np.int64)
    first = np.cumsum(sizes) - sizes
    table = np.concatenate([bounds[i] for i in order]) if order else np.empty(0, U)
    every = lanes.laid([numbers[i] for i in order], first)
    state, last = _Steps(len(order)), len(order)
    out, shared, held = np.empty(lanes.total, np.uint32), np.empty(lanes.total, np.uint8), np.empty(lanes.total, np.uint8)
    at, low = 0, np.zeros(len(order), U)
    got = np.empty(last, U)
    for k in lanes.running:
        if k != last:
            low[k:last] = state.low[k:]  # those that end here
            state.cut(k)
            got, last = got[:k], k
        to = at + k
        table.take(every[at:to], out=got, mode="clip")
        state.narrow(got)
        out[at:to] = state.lower
        state.shift()
        shared[at:to], held[at:to] = state.shared, state.held
        at = to
    low[:last] = state.low
    ended, high, made = low.tolist(), state.high.tolist(), []
    alone = int(np.searchsorted(-lanes.n, -lanes.steps, side="left"))  # lanes longer than the steps
    for i in range(alone):
        own = numbers[order[i]][lanes.steps :]
        pair = bounds[order[i]][own]
        *rest, ended[i] = _encoded_alone((pair >> _32).astype(np.uint32), pair.astype(np.uint32), ended[i], high[i])
        parts = [np.concatenate([lanes.own(x, i), y]) for x, y in zip((out, shared, held), rest, strict=True)]
        made += _packed(*(x[None] for x in parts), [ended[i]]) if len(parts[0]) <= 1 << 20 else [_bits(*parts, ended[i])]
    for i, j in lanes.groups(alone):
        made += _packed(*lanes.taken((out, shared, held), i, j), ended[i:j])
    return lanes.restored(made)


def _encoded_alone(lower, upper, low, high):
    """The rest of one lane: (ends of intervals, shared bits, held bits, last low)."""
    n = len(lower)
    out, shared, held = np.empty(n, np.uint32), bytearray(n), bytearray(n)
    ends = memoryview(out)
    for j, (a, b) in enumerate(zip(memoryview(lower), memoryview(upper), strict=True)):
        width = high - low
        high = low + (b * width + 0x7FFFFFFF) // 0xFFFFFFFF
        low += (a * width + 0x7FFFFFFF) // 0xFFFFFFFF
        ends[j] = low
        s = 32 - (low ^ high).bit_length()
        if s:
            shared[j] = s
            low, high = low << s & 0xFFFFFFFF, high << s & 0xFFFFFFFF
        if low & 0x40000000 and not high & 0x40000000:
            held[j] = h = 32 - (~((low & ~high) << 1) & 0xFFFFFFFF).bit_length()
            low, high = low << h & 0x7FFFFFFF, high << h & 0x7FFFFFFF | 0x80000000
    return out, np.frombuffer(shared, np.uint8), np.frombuffer(held, np.uint8), low


def _packed(ends: np.ndarray, shared: np.ndarray, held: np.ndarray, low: list[int]) -> list[tuple[int, bytes]]:
    """(bits, their bytes) of some lanes, a row each: at each step the shared bits in order, the first followed by as many
    opposite ones as were held since the last that went out. Rows are filled with steps at which none goes out."""
    lanes, width = shared.shape
    straddled = np.cumsum(held, axis=1, dtype=np.int32)
    steps = np.flatnonzero(shared)
    per = np.count_nonzero(shared, axis=1)
    stop = np.cumsum(per)
    begin = stop - per
    some = np.flatnonzero(per)
    before = (straddled - held).reshape(-1)[steps]
    waiting = np.diff(before, prepend=np.int32(0))
    waiting[begin[some]] = before[begin[some]]
    left = straddled[:, -1].astype(np.int64) if width else np.zeros(lanes, np.int64)
    left[some] -= before[stop[some] - 1]
    many = shared.reshape(-1)[steps].astype(np.int32)
    size = many + waiting
    top = ends.reshape(-1)[steps]
    value = ((top.astype(U) << _32) >> (64 - many).astype(U))  # the bits that go out
    first = top >> np.uint32(31)
    rest = (many - 1).astype(U)
    value &= (_ONE << rest) - _ONE
    word = (_ONE << np.minimum(waiting, 32).astype(U)) - _ONE + first
    word <<= rest
    word |= value
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    bits = total[stop] - total[begin]
    long = np.zeros(lanes, bool)
    if len(size) and int(size.max()) > 32:
        long[np.searchsorted(stop, np.flatnonzero(size > 32), side="right")] = True
    long |= left > 30
    words = (bits + np.where(long, 0, left + 2) >> 5) + 2
    at = np.cumsum(words) - words  # each lane's first word of 32 bits
    place = total[:-1] + np.repeat(32 * at - total[begin], per)
    made = np.zeros(int(words.sum()) + 2, U)

    def put(place, word, size):
        where = place >> 5
        word = word << (np.maximum(64 - size - (place & 31), 0)).astype(U)
        new = np.flatnonzero(np.diff(where, prepend=-1))
        if len(new):
            made[where[new]] += np.add.reduceat(word >> _32, new)
            made[where[new] + 1] += np.add.reduceat(word & _MASK, new)

    put(place, word, size)
    low = np.array(low, np.int64)
    one = low > QUARTER
    tail = np.minimum(left + 1, 31)
    put(32 * at + bits, np.where(one, 1 << tail, (1 << tail) - 1).astype(U), np.minimum(left + 2, 32))
    raw = made.astype(">u4").tobytes()
    out = []
    for i, (n, begin_at, slow) in enumerate(zip((bits + left + 2).tolist(), (4 * at).tolist(), long.tolist(), strict=True)):
        if slow:
            out.append(_bits(ends[i], shared[i], held[i], int(low[i])))
            continue
        data = raw[begin_at : begin_at + (n + 7) // 8]
        out.append((n, data[:-1] + bytes([data[-1] >> 8 - n % 8]) if n % 8 else data))
    return out


def _bits(ends: np.ndarray, shared: np.ndarray, held: np.ndarray, low: int) -> tuple[int, bytes]:
    """The same of one lane, however many bits are held."""
    straddled = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
    steps = np.flatnonzero(shared)
    waiting = np.diff(straddled[steps], prepend=0)
    pieces, size = [], 1 << 16
    for i in range(0, len(steps), size):
        own = steps[i : i + size]
        many = shared[own].astype(np.int64)
        bits = np.unpackbits(ends[own].astype(">u4").view(np.uint8)).reshape(-1, 32)[np.arange(32) < many[:, None]]
        times = np.ones(len(bits), np.int64)
        times[np.cumsum(many) - many] += waiting[i : i + size]
        first = np.cumsum(times) - times
        copies = np.ones(int(times.sum()), np.uint8)
        copies[first] = 0
        pieces.append(np.repeat(bits, times) ^ copies)
    left = int(straddled[-1] - (straddled[steps[-1]] if len(steps) else 0))
    bit = int(low > QUARTER)
    made = np.concatenate([*pieces, np.array([bit] + [1 - bit] * (left + 1), np.uint8)])
    full = len(made) // 8 * 8
    tail = made[full:]
    return len(made), np.packbits(made[:full]).tobytes() + (bytes([int(np.packbits(tail)[0]) >> 8 - len(tail)]) if len(tail) else b"")


class Models:
    """Frequency models one after another, in one table: bounds and symbols of those that occur, and the model that is
    next after each symbol (order 1), counted from the lane's first."""

    def __init__(self):
        self.lower, self.upper, self.symbol, self.next, self.of, self.count = [], [], [], [], [], 0

    def add(self, lower: np.ndarray, upper: np.ndarray, symbol: np.ndarray, of: np.ndarray, after: np.ndarray, models: int) -> int:
        """Adds a lane's models; of: each entry's model, after: the next one. Number of the first."""
        first = self.count
        for own, x in zip((self.lower, self.upper, self.symbol, self.next, self.of), (lower.astype(np.uint32), upper.astype(np.uint32), symbol.astype(np.uint8), (after + first).astype(np.int32), (of + first).astype(np.int32)), strict=True):
            own.append(x)
        self.count += models
        return first


def _shares(begin: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shares of each model, its first, number of the last symbol that begins before each share does).

    Where frequencies are so many n-ths of the whole, a model gets n shares, and the symbol is the right one but for values
    just behind a bound. With other frequencies it is the right one mostly; the decoder looks.
    """
    of = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(lower)))
    parts = np.zeros(len(begin))
    if len(begin):
        share = (upper - lower).astype(np.float64)
        share /= np.minimum.reduceat(share, begin)[of]
        least = np.add.reduceat(share, begin)
        for times in range(1, 5):  # the rarest symbol has so many n-ths
            now = share * times
            whole = np.maximum.reduceat(np.abs(now - np.rint(now)), begin) < 0.01
            parts = np.where((parts == 0) & whole, least * times, parts)
        parts = np.where(parts == 0, least * FINER, parts)
    parts = np.clip(np.rint(parts), 1, SHARES).astype(np.int64)
    first = np.cumsum(parts + 1) - parts - 1
    late = (WHOLE + 1) // LATE
    starts = np.where(lower > 0, ((lower - 1) * parts[of] - late >> 32) + 2, 0) + first[of]
    return parts, first, np.repeat(np.arange(len(lower), dtype=np.uint32), np.diff(starts, append=int((parts + 1).sum())))


def decoded(models: Models, first: list[int], streams: list[bytes], bits: list[int], lengths: list[int]) -> list[bytes]:
    """Symbols of each lane: `lengths` of them, from its stream of so many bits (the last byte's at its low end), by its models,
    beginning with number `first`."""
    lanes = Lanes(lengths)
    order = lanes.order.tolist()
    lower, upper, symbol, after, of = (np.concatenate(x) if x else np.empty(0, np.uint8) for x in (models.lower, models.upper, models.symbol, models.next, models.of))
    begins = np.searchsorted(of, np.arange(models.count))
    parts, at_share, shares = _shares(begins, lower.astype(np.int64), upper)
    bounds = lower.astype(U) << _32 | upper
    keys = of.astype(U) << _32 | lower
    model = np.zeros((models.count + 1, 2))  # of each: number of shares, where they begin; the last is none
    model[:-1, 0], model[:-1, 1] = parts, at_share + (1 - 1 / LATE)
    after = np.minimum(after, models.count)
    follow = model[after]
    padded = []
    for i in order:
        x, n = streams[i], bits[i]
        if n % 8:
            full = n // 8
            x = x[:full] + bytes([x[full] << (8 - n % 8) & 255])
        padded.append(x + b"\0" * (12 - len(x) % 4))
    sizes = np.array([len(x) for x in padded], np.int64)
    begin = (np.cumsum(sizes) - sizes) * 8
    words = np.frombuffer(b"".join(padded), ">u4").astype(U)
    del padded
    window = np.zeros(max(0, len(words) - 1), U)  # two words from each on, backwards, so that a place counted from the end is both index and shift
    ahead = window[::-1]
    ahead |= words[:-1] << _32
    ahead |= words[1:]
    ahead >>= _ONE  # the 31 bits after any bit of the first word
    state, last = _Steps(len(order)), len(order)
    start = words[begin >> 5] if len(order) else np.zeros(0, U)
    end = 32 * len(window) - 1
    every, real_all = np.empty((4, last), U), np.empty((2, last))
    every[0], every[1] = start, (end - begin).astype(U)
    now_all = model[np.minimum(np.array(first, np.int64)[order], models.count)] if order else model[:0]
    wrong_all, found_all = np.empty(last, bool), np.empty(last, np.uint32)
    (at, place, value, got), (ratio, width), now, wrong, found = every, real_all, now_all, wrong_all, found_all
    out, done = np.empty(lanes.total, np.uint8), 0
    for k in lanes.running:
        if k != last:
            state.cut(k)
            (at, place, value, got), (ratio, width), now, wrong, found = every[:, :k], real_all[:, :k], now_all[:k], wrong_all[:k], found_all[:k]
            last = k
        to = done + k
        np.subtract(at, state.low, out=value)
        ratio[...] = value.view(np.int64)
        np.subtract(state.high, state.low, out=value)
        width[...] = value.view(np.int64)
        ratio /= width
        ratio *= now[:, 0]
        ratio += now[:, 1]
        shares.take(ratio.astype(np.int64), out=found, mode="clip")
        bounds.take(found, out=got, mode="clip")
        state.narrow(got)
        np.subtract(at, state.lower, out=value)
        np.subtract(state.upper, state.lower, out=got)
        np.greater_equal(value, got, out=wrong)
        if np.count_nonzero(wrong):
            some = np.flatnonzero(wrong)
            wide = state.high[some] - state.low[some]
            exact = ((at[some] - state.low[some]) * _MASK + _ROUND) // wide
            own = np.searchsorted(keys, keys[found[some]] & ~_MASK | exact, side="right") - 1
            found[some] = own
            state.lower[some] = state.low[some] + (lower[own].astype(U) * wide + _ROUND) // _MASK
            state.upper[some] = state.low[some] + (upper[own].astype(U) * wide + _ROUND) // _MASK
        follow.take(found, axis=0, out=now, mode="clip")
        symbol.take(found, out=out[done:to], mode="clip")
        done = to
        state.shift()
        place -= state.shared
        place -= state.held
        at <<= state.shared
        at &= _TOP
        np.right_shift(place, _5, out=value)
        window.take(value.view(np.int64), out=got, mode="clip")
        np.bitwise_and(place, _31, out=value)
        got >>= value
        got &= _LOW31
        at |= got
    made = []
    alone = int(np.searchsorted(-lanes.n, -lanes.steps, side="left"))  # lanes longer than the steps
    if alone:
        rest = [x[:alone].tolist() for x in (state.low, state.high, at, place)]
        number = np.searchsorted(at_share, now[:alone, 1].astype(np.int64)).tolist()
        cuts, views, tables = np.append(begins, len(of)).tolist(), window.data, {}

    def table(m):
        if m not in tables:
            own = slice(cuts[m], cuts[m + 1])
            tables[m] = lower[own].tolist(), upper[own].tolist(), symbol[own].tolist(), after[own].tolist()
        return tables[m]

    for i in range(alone):
        tables.clear()
        made.append(lanes.own(out, i).tobytes() + _decoded_alone(table, views, int(lanes.n[i]) - lanes.steps, number[i], *(x[i] for x in rest)))
    for i, j in lanes.groups(alone):
        made += [row[:n].tobytes() for row, n in zip(lanes.taken([out], i, j)[0], lanes.n[i:j].tolist(), strict=True)]
    return lanes.restored(made)


def _decoded_alone(table, window, n, model, low, high, at, place) -> bytes:
    """The rest of one lane."""
    out = bytearray(n)
    for j in range(n):
        lower, upper, symbol, after = table(model)
        width = high - low
        k = bisect_right(lower, ((at - low) * 0xFFFFFFFF + 0x7FFFFFFF) // width) - 1
        out[j], model = symbol[k], after[k]
        high = low + (upper[k] * width + 0x7FFFFFFF) // 0xFFFFFFFF
        low += (lower[k] * width + 0x7FFFFFFF) // 0xFFFFFFFF
        s = 32 - (low ^ high).bit_length()
        if s:
            low, high, at = low << s & 0xFFFFFFFF, high << s & 0xFFFFFFFF, at << s & 0x80000000
        else:
            at &= 0x80000000
        if low & 0x40000000 and not high & 0x40000000:
            h = 32 - (~((low & ~high) << 1) & 0xFFFFFFFF).bit_length()
            low, high = low << h & 0x7FFFFFFF, high << h & 0x7FFFFFFF | 0x80000000
            s += h
        place -= s
        at |= window[place >> 5] >> (place & 31) & 0x7FFFFFFF
    return bytes(out)


def places_in_front(texts: list[np.ndarray]) -> list[bytes]:
    """Move-to-front of each sequence of bytes: places in a list of its values, ascending at first."""
    lanes = Lanes([len(x) for x in texts])
    order = lanes.order.tolist()
    every = np.concatenate([texts[i] for i in order]) if order else np.empty(0, np.uint8)
    starts = np.cumsum(lanes.n) - lanes.n
    seen = np.zeros((256, len(order)), bool)
    for j, i in enumerate(order):
        seen[texts[i], j] = True
    place = np.where(seen, np.cumsum(seen, axis=0) - 1, 255).astype(np.uint8)[seen.any(1)]  # where a value is in the list
    code = (np.cumsum(seen.any(1)) - 1).astype(np.uint8)
    value, lane = np.flatnonzero(seen.any(1)), np.arange(len(order))
    out, done = np.empty(lanes.total, np.uint8), 0
    for t, k in enumerate(lanes.running):
        own, b = place[:, :k], code[every[starts[:k] + t]]
        i = own[b, lane[:k]]
        own += own < i
        own[b, lane[:k]] = 0
        out[done : done + k] = i
        done += k
    made = []
    for j, n in enumerate(lanes.n.tolist()):
        text = bytearray(lanes.own(out, j))
        if n > lanes.steps:
            front = value[np.argsort(place[:, j], kind="stable")].tolist()
            for b in every[int(starts[j]) + lanes.steps : int(starts[j]) + n].tolist():
                i = front.index(b)
                text.append(i)
                if i:
                    del front[i]
                    front.insert(0, b)
        made.append(bytes(text))
    return lanes.restored(made)


def values_in_front(fronts: list[list[int]], places: list[np.ndarray]) -> list[bytes]:
    """The inverse, of the values of each list and the places."""
    lanes = Lanes([len(x) for x in places])
    order = lanes.order.tolist()
    every = np.concatenate([places[i] for i in order]) if order else np.empty(0, np.uint8)
    starts, lane = np.cumsum(lanes.n) - lanes.n, np.arange(len(order))
    front = np.zeros((max(map(len, fronts), default=0), len(order)), np.uint8)
    for j, i in enumerate(order):
        front[: len(fronts[i]), j] = fronts[i]
    row = np.arange(len(front), dtype=np.uint8)[:, None]
    out, done = np.empty(lanes.total, np.uint8), 0
    for t, k in enumerate(lanes.running):
        i = every[starts[:k] + t]
        own = front[: int(i.max()) + 1, :k]
        b = own[i, lane[:k]]
        own[1:] = np.where(row[1 : len(own)] <= i, own[:-1], own[1:])
        own[0] = b
        out[done : done + k] = b
        done += k
    made = []
    for j, n in enumerate(lanes.n.tolist()):
        text = bytearray(lanes.own(out, j))
        if n > lanes.steps:
            own = front[: len(fronts[order[j]]), j].tolist()
            for i in every[int(starts[j]) + lanes.steps : int(starts[j]) + n].tolist():
                b = own[i]
                text.append(b)
                if i:
                    del own[i]
                    own.insert(0, b)
        made.append(bytes(text))
    return lanes.restored(made)


def walked(lasts: list[np.ndarray], steps: list[np.ndarray], rows: list[int], lengths: list[int]) -> list[bytes]:
    """The bytes met on so many steps from a row of each table, backwards."""
    lanes = Lanes(lengths)
    order = lanes.order.tolist()
    sizes = np.array([len(lasts[i]) for i in order], np.int64)
    begin = np.cumsum(sizes) - sizes
    last = np.concatenate([lasts[i] for i in order]).astype(np.uint8) if order else np.empty(0, np.uint8)
    step = np.concatenate([steps[i] + o for i, o in zip(order, begin.tolist(), strict=True)]) if order else np.empty(0, np.int64)
    now = np.array([rows[i] for i in order], np.int64) + begin
    out, done = np.empty(lanes.total, np.uint8), 0
    for k in lanes.running:
        now = now[:k]
        out[done : done + k] = last[now]
        now = step[now]
        done += k
    made = []
    for j, n in enumerate(lanes.n.tolist()):
        text = bytearray(lanes.own(out, j))
        if n > lanes.steps:
            symbols, after, row = lasts[order[j]].tolist(), steps[order[j]].tolist(), int(now[j] - begin[j])
            for _ in range(n - lanes.steps):
                text.append(symbols[row])
                row = after[row]
        text.reverse()
        made.append(bytes(text))
    return lanes.restored(made)
