"""All pairs of fingerprints within a Hamming distance, by parts.

The bits form a ring of parts. A part has a radius, and the radii and one for each part add up to more than the distance, so by
the pigeonring principle a pair within the distance has a part from which on every chain of parts stays below the sum of its own
radii and ones: the first part differs by its radius at most. Each part is a table of its own: rows are found by the part's
bits at every place within the radius, and the parts behind it are compared before the pair is passed on. No pair is left out,
whatever the rows are.

Rows have labels; only pairs of different labels are wanted. Rows of one part value and label are one unit, so a large group
that is known to belong together costs as little as one row where units meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from attrweave.llm.common import ranges

#: Units that are looked up at a time, pairs compared at a time, and units of one value that are met one after the other.
_UNITS, _PAIRS, _LAYERS = 1 << 14, 1 << 20, 8


@dataclass
class Part:
    """One part of the ring, and the whole parts behind it that fit 64 bits, then another 64."""

    start: int
    width: int
    radius: int
    behind: tuple[int, int]  # bits compared
    below: tuple[int, int]  # bits in which chains up to there may differ


def parts(bits: int, most: int, radius: int) -> list[Part]:
    """Parts of `radius` or one less, of which the latter are three bits narrower; all are about as rare to meet."""
    count = -(-(most + 1) // (radius + 1))
    less = count * (radius + 1) - most - 1
    radii = np.array([radius] * (count - less) + [radius - 1] * less)
    ends = np.round(np.cumsum((bits + 3 * less) / count - 3 * (radii < radius))).astype(int)
    widths = np.diff(ends, prepend=0)
    out = []
    for k in range(count):
        behind, below, step = [], [], 1
        total = int(radii[k]) + 1
        for _ in range(2):
            wide = 0
            while step < count and wide + widths[(k + step) % count] <= 64:
                wide += int(widths[(k + step) % count])
                total += int(radii[(k + step) % count]) + 1
                step += 1
            behind.append(wide)
            below.append(total - 1)
        out.append(Part(int(ends[k] - widths[k]), int(widths[k]), int(radii[k]), tuple(behind), tuple(below)))
    return out


def keyed(bits: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part's value of each row of bits, and the two stretches behind it."""
    columns = np.zeros((len(bits), 192), dtype=np.uint8)
    at = part.start
    for k, wide in enumerate((part.width, *part.behind)):
        columns[:, 64 * k : 64 * k + wide] = bits[:, np.arange(at, at + wide) % bits.shape[1]]
        at += wide
    words = np.packbits(columns, axis=1, bitorder="little").view(np.uint64)
    return words[:, 0].astype(np.uint32), np.ascontiguousarray(words[:, 1]), np.ascontiguousarray(words[:, 2])


def masks(width: int, radius: int) -> list[int]:
    """The numbers of so many bits with one to `radius` of them set."""
    return sorted(sum(1 << b for b in c) for k in range(1, radius + 1) for c in combinations(range(width), k))


def tiles(part: Part, top: int) -> list[tuple[int, int]]:
    """Which tiles, by the part's `top` highest bits, have to meet: pairs (u, v), u <= v."""
    return [(u, v) for u in range(1 << top) for v in range(u, 1 << top) if (u ^ v).bit_count() <= part.radius]


def search(part: Part, key: np.ndarray, one: np.ndarray, two: np.ndarray, label: np.ndarray, across: int = 0, top: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different labels that keep the budgets of the chains from this part on.

    across: of a part value, the `top` highest bits in which the two rows differ.
    """
    order = np.lexsort((label, key))
    key, one, two, label = key[order], one[order], two[order], label[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])])[: len(key)])
    size = np.diff(np.append(first, len(key)))
    value, own = key[first].astype(np.int64), one[first]
    count = np.bincount(value, minlength=1 << part.width).astype(np.int32)
    begin, some = np.cumsum(count, dtype=np.int32) - count, count > 0
    single = bool((size == 1).all())

    def close(a: np.ndarray, b: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows, those within the budgets and of different labels."""
        near = np.flatnonzero(np.bitwise_count(one[a] ^ one[b]) <= part.below[0] - apart)
        a, b = a[near], b[near]
        near = (np.bitwise_count(one[a] ^ one[b]).astype(np.int32) + np.bitwise_count(two[a] ^ two[b]) <= part.below[1] - apart) & (label[a] != label[b])
        return order[a[near]], order[b[near]]

    def crossed(u: np.ndarray, v: np.ndarray, times: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All rows of units u with all rows of units v."""
        total, at = np.cumsum(times), 0
        while at < len(u):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
            if times[at] <= _PAIRS:
                pair = np.repeat(np.arange(at, upto), times[at:upto])
                step = ranges(np.zeros(upto - at, dtype=np.int64), times[at:upto])
                yield close(first[u[pair]] + step // size[v[pair]], first[v[pair]] + step % size[v[pair]], apart)
            else:  # one pair of large units
                rows = first[u[at]] + np.arange(size[u[at]])
                for row in range(first[v[at]], first[v[at]] + size[v[at]]):
                    yield close(rows, np.full(len(rows), row), apart)
            at = upto

    def units_met(u: np.ndarray, v: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of units."""
        if not single:
            times = size[u] * size[v]
            plain = times == 1
            if not plain.all():
                large = np.flatnonzero(~plain & (label[first[u]] != label[first[v]]))
                yield from crossed(u[large], v[large], times[large], apart)
                u, v = u[plain], v[plain]
        near = np.flatnonzero(np.bitwise_count(own[u] ^ own[v]) <= part.below[0] - apart)
        if len(near):
            yield close(first[u[near]], first[v[near]], apart)

    def met(a: np.ndarray, start: np.ndarray, many: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each unit a with `many` units, one at least, from start on."""
        deep = np.flatnonzero(many > _LAYERS)
        if len(deep):
            total, at = np.cumsum(many[deep], dtype=np.int64), 0
            while at < len(deep):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
                part_of = deep[at:upto]
                yield from units_met(np.repeat(a[part_of], many[part_of]), ranges(start[part_of], many[part_of]), apart)
                at = upto
            flat = np.flatnonzero(many <= _LAYERS)
            a, start, many = a[flat], start[flat], many[flat]
        while len(a):
            yield from units_met(a, start, apart)
            more = np.flatnonzero(many > 1)
            a, start, many = a[more], start[more] + 1, many[more] - 1

    if across == 0:
        units = np.arange(len(first))
        left = (begin + count)[value] - units - 1
        crowded = np.flatnonzero(left)
        for at in range(0, len(crowded), _UNITS):
            a = crowded[at : at + _UNITS]
            yield from met(a, a + 1, left[a], 0)
    by_top: dict[int, list[int]] = {}
    for mask in masks(part.width, part.radius):
        if mask >> (part.width - top) == across:
            by_top.setdefault(mask.bit_length() - 1, []).append(mask)
    for bit, those in by_top.items():
        lower = np.flatnonzero((value >> bit) & 1 == 0)
        for at in range(0, len(lower), _UNITS):
            units = lower[at : at + _UNITS]
            mine = value[units]
            for mask in those:
                other = mine ^ mask
                hit = np.flatnonzero(some[other])
                if len(hit):
                    other = other[hit]
                    yield from met(units[hit], begin[other], count[other], mask.bit_count())
