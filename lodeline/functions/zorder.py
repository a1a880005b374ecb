"""Z-order keys of 2 to 16 dimensions as fixed-width hex, in built-in expressions: they sort as the curve runs."""

from __future__ import annotations

import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a coordinate by number of dimensions.
BITS = {1: 64, 2: 32, 3: 32, 4: 32, 8: 8, 16: 8}


#: Bits of each coordinate in one long of a key, by number of dimensions.
_PER_WORD = {1: 64, 2: 32, 3: 16, 4: 16, 8: 8, 16: 4}


def _mask(dims: int, bits: int, group: int) -> Column:
    """``bits`` ones in groups of ``group``, a group beginning every dims * group bits, as a signed long."""
    ones = sum(((1 << group) - 1) << (dims * group * i) for i in range(bits // group)) & (1 << 64) - 1
    return F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("bigint")


def _spread(x: Column, dims: int, bits: int) -> Column:
    """The low ``bits`` bits of x, each dims places from the next."""
    x = x.bitwiseAND(_mask(dims, bits, bits))
    group = bits // 2
    while dims > 1 and group:
        # From three dimensions on, what is moved meets nothing, so a product writes x once; no product reaches 2**63.
        moved = x.bitwiseOR(F.shiftleft(x, group)) if dims == 2 else x * F.lit(1 + (1 << group * (dims - 1))).cast("bigint")
        x = moved.bitwiseAND(_mask(dims, bits, group))
        group //= 2
    return x


def _gather(x: Column, dims: int, bits: int) -> Column:
    """The inverse: every dims-th bit of x, side by side."""
    x = x.bitwiseAND(_mask(dims, bits, 1))
    group = 1
    while dims > 1 and group < bits:
        x = x.bitwiseOR(F.shiftrightunsigned(x, group * (dims - 1))).bitwiseAND(_mask(dims, bits, 2 * group))
        group *= 2
    return x


def encode(*coords: Column) -> Column:
    """Bit-interleaved key: from the highest bit on, one bit of each coordinate, the last coordinate first.

    A key is one or two longs; coordinates are spread over them by shifts and masks, half as far each time.
    """
    n = len(coords)
    per = _PER_WORD[n]
    words = []
    for w in reversed(range(BITS[n] // per)):
        word = None
        for i, c in enumerate(coords):
            part = _spread(F.shiftrightunsigned(c.cast("bigint"), w * per) if w else c.cast("bigint"), n, per)
            part = F.shiftleft(part, i) if i else part
            word = part if word is None else word.bitwiseOR(part)
        words.append(F.lower(F.lpad(F.hex(word), n * per // 4, "0")))
    return F.concat(*words)


def longs(key: Column, dims: int) -> list[Column]:
    """The one or two longs of a key, the highest first."""
    size = dims * _PER_WORD[dims] // 4
    return [F.conv(F.substring(key, 1 + size * w, size), 16, -10).cast("bigint") for w in range(BITS[dims] // _PER_WORD[dims])]


def decode(key: Column, dims: int) -> Column:
    """array<long> of the coordinates of a key."""
    per = _PER_WORD[dims]
    coords = []
    for d in range(dims):
        value = F.lit(0).cast("bigint")
        for word in longs(key, dims):
            part = _gather(F.shiftrightunsigned(word, d) if d else word, dims, per)
            value = part if per == BITS[dims] else F.shiftleft(value, per).bitwiseOR(part)
        coords.append(value)
    return F.array(*coords)


def key_of(coords: list[int]) -> int:
    """The curve's key of a point, as an integer."""
    out = 0
    for b in range(BITS[len(coords)] - 1, -1, -1):
        for c in reversed(coords):
            out = out << 1 | c >> b & 1
    return out


def as_hex(key: int, dims: int) -> str:
    return f"{key:0{-(-dims * BITS[dims] // 4)}x}"


def ranges(low: list[int], high: list[int], most: int = 32) -> list[tuple[str, str]]:
    """At most ``most`` ranges of keys, both ends inclusive, that hold every point of a box.

    A box is cut where its least and greatest key first differ; between the last key of the lower half and the first of
    the upper one the curve runs outside. The widest such gaps are cut out.
    """
    n = len(low)

    def cut(lo: list[int], hi: list[int]):
        """(minus the gap, the two halves) of a box, or None for a single point."""
        differ = key_of(lo) ^ key_of(hi)
        if not differ:
            return None
        place = differ.bit_length() - 1
        d, b = place % n, place // n
        middle = hi[d] >> b << b
        left, right = [*hi[:d], middle - 1, *hi[d + 1 :]], [*lo[:d], middle, *lo[d + 1 :]]
        return key_of(left) - key_of(right) + 1, (lo, left), (right, hi)

    if any(a > b for a, b in zip(low, high, strict=True)):
        return []
    done, todo = [], []

    def push(lo: list[int], hi: list[int]):
        found = cut(lo, hi)
        if found is None:
            done.append((lo, hi))
        else:
            heapq.heappush(todo, (found[0], key_of(lo), lo, hi, found[1:]))

    push(low, high)
    while todo and len(done) + len(todo) < most:
        *_, halves = heapq.heappop(todo)
        for lo, hi in halves:
            push(lo, hi)
    spans = sorted((key_of(lo), key_of(hi)) for lo, hi in done + [(lo, hi) for _, _, lo, hi, _ in todo])
    out = [spans[0]]
    for a, b in spans[1:]:
        if a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(as_hex(a, n), as_hex(b, n)) for a, b in out]
