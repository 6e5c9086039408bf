"""A vector for every token on both sides of the network of ``lm_scoring``.

Ids lie in the order of their counts, where a class is a run of them. A class is cut in two by the sum of its counts, and
each part again, until one id is left: the network gives the probability of either side of a cut from what it sees, so an
id's probability is that of its class times those of the sides it lies on, and all ids together come to one. Tables hold
a vector for each counted id as the network's input and one for each cut as its output, both zero at first: then an id has
its share of its class by counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

# Rows of a table that tasks send as one.
BLOCK = 512
# Runs of up to so many rows are added up side by side.
SHORT = 8


@dataclass
class Tree:
    """The cuts of all classes.

    ``places``: where each id lies; ``known``: how many ids have a count, which come first; ``rest``: the others of each class,
    which are not told apart. A cut is named by the first place after it. ``sides``: the cuts of the parts before and after each
    cut in turn, 0 for one that is cut no further; ``odds``: the logarithm of the counts after it over those before; ``roots``:
    the first cut of each class; ``depths``: how many cuts lead to each place.
    """

    places: np.ndarray
    known: int
    rest: np.ndarray
    roots: np.ndarray
    sides: np.ndarray
    odds: np.ndarray
    depths: np.ndarray

    @property
    def lower(self) -> np.ndarray:
        return self.sides[0::2]

    @property
    def upper(self) -> np.ndarray:
        return self.sides[1::2]

    def rows(self, places: np.ndarray) -> np.ndarray:
        """The row of a table for each place; ids without a count and what lies beyond a document share the last one."""
        return np.minimum(places, self.known + 1)

    def first(self, classes: np.ndarray) -> np.ndarray:
        """The first cut of each class."""
        return self.roots.take(classes).astype(np.intp)

    def next(self, cut: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The cut that follows each one on the side ``after`` it or not, 0 for none."""
        return self.sides.take(2 * cut + after).astype(np.intp)


def tree(counts: np.ndarray, order: np.ndarray, classes: np.ndarray, number: int) -> Tree:
    """The tree of ids with ``counts``; ``order`` sorts them by descending count, and ``classes`` are runs of that order."""
    total = len(counts)
    places = np.empty(total, dtype=np.int32)
    places[order] = np.arange(total, dtype=np.int32)
    known = int(np.count_nonzero(counts))
    mass = np.concatenate(([0.0], np.cumsum(counts[order] + 0.5)))

    def cut(low: np.ndarray, high: np.ndarray) -> np.ndarray:  # ids without a count first, as one part
        middle = np.searchsorted(mass, (mass[low] + mass[high]) / 2)
        middle = np.where((low < known) & (known < high), known, np.clip(middle, low + 1, high - 1))
        return np.where((high - low > 1) & (low < known), middle, 0)

    sides = np.zeros(2 * (known + 1), dtype=np.int32)
    odds = np.zeros(known + 1, dtype=np.float32)
    turns = np.zeros(total + 1, dtype=np.int32)
    starts = np.searchsorted(classes[order], np.arange(number + 1))
    rest = np.diff(np.maximum(starts, known))
    low, high = starts[:-1], starts[1:]
    at = roots = cut(low, high)
    while len(at):
        live = at > 0
        low, high, at = low[live], high[live], at[live]
        odds[at] = np.log((mass[high] - mass[at]) / (mass[at] - mass[low]))
        np.add.at(turns, low, 1)
        np.add.at(turns, high, -1)
        sides[2 * at], sides[2 * at + 1] = cut(low, at), cut(at, high)
        low, high, at = np.concatenate((low, at)), np.concatenate((at, high)), np.concatenate((sides[2 * at], sides[2 * at + 1]))
    return Tree(places, known, rest, roots.astype(np.int32), sides, odds, np.cumsum(turns[:-1]).astype(np.uint8))


def run_sums(values: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sums of ``values`` from each of ``starts`` to the next, ``times`` further on."""
    if 4 * len(starts) < len(values):
        return np.add.reduceat(values, starts, axis=0)
    # mostly short runs: the first rows of all of them, the second ones, and so on
    order = np.argsort(-times)
    first, counts = starts.take(order), np.bincount(np.minimum(times, SHORT + 1), minlength=SHORT + 2)
    live = len(starts) - np.cumsum(counts)
    made = values.take(starts, axis=0)
    if live[1]:
        rest = values.take(first[: live[1]] + 1, axis=0)
        for size in range(2, SHORT):
            if not live[size]:
                break
            rest[: live[size]] += values.take(first[: live[size]] + size, axis=0)
        rest += made.take(order[: live[1]], axis=0)
        if long := live[SHORT]:
            own = times.take(order[:long])
            ends = np.cumsum(own)
            rows = np.arange(ends[-1]) + (first[:long] - ends + own).repeat(own)
            rest[:long] = np.add.reduceat(values.take(rows, axis=0), ends - own, axis=0)
        _whole(made)[order[: live[1]]] = _whole(rest)
    return made


class Table:
    """Vectors whose steps shorten as they are learnt from, ``visits`` times so far. The last row stays."""

    def __init__(self, values: np.ndarray, rate: float):
        self.values, self.rate = values.astype(np.float32, order="C"), np.float32(rate)
        self.visits = np.zeros(len(values), dtype=np.int32)
        self._rows = _whole(self.values)

    def learn(self, keys: np.ndarray, vectors: np.ndarray, starts: np.ndarray, slopes: np.ndarray) -> None:
        """Move the rows ``keys``, now ``vectors``, along the sums of ``slopes`` from each of ``starts`` to the next."""
        times = _times(starts, len(slopes))
        visits = self.visits.take(keys)
        visits += times
        sums = run_sums(slopes, starts, times)
        steps = visits.astype(np.float32)
        steps /= 8
        steps += 1
        np.sqrt(steps, out=steps)
        np.divide(self.rate, steps, out=steps)
        sums *= steps[:, None]
        if keys[-1] == len(self.values) - 1:
            keys, vectors, sums, visits = keys[:-1], vectors[:-1], sums[:-1], visits[:-1]
        self.visits[keys] = visits
        self._rows[keys] = _whole(np.subtract(vectors, sums, out=sums))

    def blocks(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(block, rows within it, visits, values) of the rows that have learnt."""
        met = np.flatnonzero(self.visits)
        ends = np.searchsorted(met, np.arange(0, len(self.values) + BLOCK, BLOCK))
        for block in np.flatnonzero(np.diff(ends)):
            rows = met[ends[block] : ends[block + 1]]
            values = np.clip(self.values[rows], -60_000, 60_000).astype(np.float16)
            yield int(block), (rows - block * BLOCK).astype(np.uint16).tobytes(), self.visits[rows].tobytes(), values.tobytes()


def mean_rows(parts: Iterable[tuple[bytes, bytes, bytes]], width: int) -> tuple[bytes, bytes]:
    """(rows, values) of one block from its (rows, visits, values) in several tasks: means of a row's vectors by their visits."""
    totals, times = np.zeros((BLOCK, width)), np.zeros(BLOCK)
    for rows, visits, values in parts:
        at, weight = np.frombuffer(rows, dtype=np.uint16), np.frombuffer(visits, dtype=np.int32)
        totals[at] += np.frombuffer(values, dtype=np.float16).reshape(-1, width).astype(np.float64) * weight[:, None]
        times[at] += weight
    met = np.flatnonzero(times)
    return met.astype(np.uint16).tobytes(), (totals[met] / times[met, None]).astype(np.float16).tobytes()


class Tokens:
    """The vectors of tokens beside a place (``near``) and of ``cuts``, on ``tree``, for a network that sees the places ``offsets``.

    Cuts go by as many of the first units of the hidden layer as their vectors are long.
    """

    def __init__(self, tree: Tree, near: np.ndarray, cuts: np.ndarray, offsets: tuple[int, ...], rate: float = 0.1):
        self.tree, self.near, self.cuts, self.offsets = tree, Table(near, rate), Table(cuts, rate), offsets
        width = near.shape[1]
        # by its place a token's vector has other signs, so that what is seen depends on the order
        signs = [[(-1) ** (unit & (2 * k + 1)).bit_count() for unit in range(width)] for k in range(len(offsets))]
        self.signs = np.array(signs, dtype=np.float32)

    def around(self, places: np.ndarray, first: int, end: int) -> np.ndarray:
        """The rows of the tokens from ``first`` to ``end`` and of those within reach of them."""
        reach = max(self.offsets)
        low, high = max(0, first - reach), min(len(places), end + reach)
        beyond = self.tree.known + 1
        return np.pad(self.tree.rows(places[low:high]), (low - first + reach, end + reach - high), constant_values=beyond)

    def added(self, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        """What the tokens beside each place add to the hidden layer; ``held``: whether a place of the window is in the document."""
        reach = max(self.offsets)
        total = len(rows) - 2 * reach
        vectors = self.near.values.take(rows, axis=0)
        made, part = np.zeros((total, vectors.shape[1]), dtype=np.float32), np.empty((total, vectors.shape[1]), dtype=np.float32)
        for k, offset in enumerate(self.offsets):
            np.multiply(vectors[reach + offset : reach + offset + total], self.signs[k], out=part)
            part[~held[k]] = 0
            made += part
        return made

    def learn_near(self, rows: np.ndarray, held: np.ndarray, back: np.ndarray) -> None:
        reach = max(self.offsets)
        slopes, part = np.zeros((len(rows), back.shape[1]), dtype=np.float32), np.empty_like(back)
        for k, offset in enumerate(self.offsets):
            np.multiply(back, self.signs[k], out=part)
            part[~held[k]] = 0
            slopes[reach + offset : reach + offset + len(back)] += part
        order = np.argsort(rows)
        rows = rows[order]
        starts = _starts(rows)
        keys = rows[starts].astype(np.intp)
        self.near.learn(keys, self.near.values.take(keys, axis=0), starts, slopes.take(order, axis=0))

    def learn_cuts(self, hidden: np.ndarray, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Learn which sides ``places`` lie on; the slope of the hidden layer."""
        order, width = np.argsort(places), self.cuts.values.shape[1]
        made = np.zeros_like(hidden)
        cut, places = self.tree.first(classes.take(order)), places.take(order)
        own = hidden[:, :width].take(order, axis=0)
        back = np.zeros_like(own)
        # in the order of places, the tokens that share a cut lie side by side
        while len(cut):
            live = np.flatnonzero(cut)
            if 4 * len(live) < 3 * len(cut):
                made[order, :width] = back
                order, cut, places, own, back = order.take(live), cut.take(live), places.take(live), own.take(live, axis=0), back.take(live, axis=0)
                continue
            starts = _starts(cut)
            keys = cut.take(starts)
            held, times = self.cuts.values.take(keys, axis=0), _times(starts, len(cut))
            vectors = held.repeat(times, axis=0)
            after = places >= cut
            off = np.einsum("nh,nh->n", own, vectors)
            off += self.tree.odds.take(keys).repeat(times)
            np.negative(off, out=off)
            np.exp(off, out=off)
            off += 1
            np.reciprocal(off, out=off)
            off -= after
            vectors *= off[:, None]
            back += vectors
            self.cuts.learn(keys, held, starts, np.multiply(own, off[:, None], out=vectors))
            # tokens that are cut no further learn from a row that stays zero
            self.cuts.values[0] = self.cuts.visits[0] = 0
            cut = self.tree.next(cut, after)
        return made

    def within(self, hidden: np.ndarray, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The log-probability of each token in its class."""
        depths = self.tree.depths.take(places)
        # the deepest first: at each level the tokens that have a cut are the first ones
        order = np.argsort(places - (depths.astype(np.int64) << 32))
        most = int(depths.max(initial=0))
        made = np.zeros(len(places))
        hidden = hidden[:, : self.cuts.values.shape[1]].take(order, axis=0)
        cut, sorted_places = self.tree.first(classes.take(order)), places.take(order)
        for live in np.cumsum(np.bincount(depths, minlength=most + 1)[:0:-1])[::-1].tolist():
            cut = cut[:live]
            after = sorted_places[:live] >= cut
            odds = np.einsum("nh,nh->n", hidden[:live], self.cuts.values.take(cut, axis=0))
            odds += self.tree.odds.take(cut)
            odds *= np.float32(1) - 2 * after.astype(np.float32)
            off = np.abs(odds)
            np.negative(off, out=off)
            np.exp(off, out=off)
            off += 1
            np.log(off, out=off)
            off += np.maximum(odds, 0, out=odds)
            made[:live] -= off
            cut = self.tree.next(cut, after)
        logs = np.empty(len(places))
        logs[order] = made
        unknown = places >= self.tree.known
        logs[unknown] -= np.log(self.tree.rest[classes[unknown]])
        return logs


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal ``rows`` begin."""
    return np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))


def _times(starts: np.ndarray, total: int) -> np.ndarray:
    """How far it is from each of ``starts`` to the next, from the last to ``total``."""
    times = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=times[:-1])
    times[-1:] = total - starts[-1:]
    return times


def _whole(vectors: np.ndarray) -> np.ndarray:
    """Each vector as one value: numpy puts these into their places at a quarter of the cost of numbers."""
    return vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").reshape(-1)
