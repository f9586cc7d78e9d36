"""Motif discovery: best-first search over motifs that grow around the modified base, in Spark rounds.

Spark prepares what a search needs: levels, seed fits and responsibilities are joins and aggregations.
A contig longer than ``CHUNK`` positions is cut into chunks; a chunk is one row with its bases (and those that
windows reach beyond its ends) and its records, packed once and written, so that no window is ever
shuffled. What is open in a group is one small row: its queue of motifs and what was found so far.

A round joins the open groups with their chunks. Every chunk tallies the motifs that its group wants to
look at next: sums of the weights per offset and base over the windows that match. The tallies of a
group of many chunks are added up by a grouped sum with a bounded fan-in, and then move its queue, so
a contig of any length is spread over the cluster, and the best ``AHEAD`` motifs of the queue are
tallied at a time, so that few rounds are needed. A group of one chunk needs nobody else's tallies and
takes up to ``STEPS`` steps a round where it is; most groups are small, so the groups of a task step
side by side and share the calls that tally and score. Rounds go on while a group is open.

Choices where upstream behaviour is undefined or aborts: equal priorities are expanded in order of
insertion, among equal scores the motif inserted last is the best; a motif that explains every
methylated window ends the search of its modification; a motif that removes no window ends it too.
Counts within the search are of all records of the contig that lie on the motif, windows cut by an
end of the contig included; every record tests itself, so matches may overlap. The counts of the
results come from ``occurrences``, without overlap.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methyloom.functions.iupac import MASK, _CODE
from methyloom.functions.measures import COUNT_LEVELS, MIXTURE_LEVELS, Levels, beta_log_pdf, frac64, log_sum_exp
from methyloom.functions.measures import level as level_of
from methyloom.functions.modcodes import MOD_BASE
from methyloom.functions.motif import subsets
from methyloom.operators import mixture
from methyloom.operators.occurrences import MOTIF, level_counts, occurrences
from methyloom.session import checkpointed, parallelism, written

GROUP = ["contig_id", "mod_type"]
CHUNK = 1 << 21  # positions of a chunk: below that, the steps of a search take less time than its rounds
STEPS = 5_000
AHEAD = 32
_FAN_IN = 32
_BLOCK = 1 << 21  # cells taken apart at a time
_ABREAST = 1 << 17  # windows of the groups that step side by side
_LARGE = 1 << 13  # from so many windows on a group is tallied by itself
_SORTED = 1 << 13  # and their order matters to the time of a tally
_ENTRIES = 20_000  # models a task, to which records are joined without a sort
_ROWS = 256  # rows of packed chunks a task, once every core has some

_ANY = 31  # A, C, G, T and every other character
_BITS = {**{c: _ANY if m == 15 else m for c, m in MASK.items()}}
_SUBSETS = np.array([[float(mask >> i & 1) for i in range(4)] for mask in range(16)])
_BASES = np.full(256, 4, np.uint8)
for _i, _base in enumerate("ACGT"):
    _BASES[ord(_base)] = _i
_ONE = np.array([1, 2, 4, 8, 16], np.uint8)
_BYTE_BITS = np.zeros(256, np.uint8)
for _code, _mask in _BITS.items():
    _BYTE_BITS[ord(_code)] = _mask
_INDEX = np.zeros(32, np.intp)
_INDEX[_ONE] = range(5)
_PLACE = np.full(32, 5, np.intp)  # the same, with a place for what is beyond the contig
_PLACE[_ONE] = range(5)
_OWN = np.where(_BYTE_BITS[:, None] > 0, (_BYTE_BITS[:, None] & _ONE) > 0, True).astype(float)  # the bases of a code; dots leave all
_SUBSETS_ANY = np.column_stack([_SUBSETS, np.arange(16) == 15])  # N takes any character
_WITHIN_OF = [[sum(some) for some in subsets(1 << b for b in range(4) if mask >> b & 1)] for mask in range(16)]
_N_WITHIN = np.array([len(sets) for sets in _WITHIN_OF])
_WITHIN = np.array([sets + [0] * (15 - len(sets)) for sets in _WITHIN_OF])
_DOT, _N = ord("."), ord("N")
_SETS = np.array([*range(15), _ANY], np.uint8)  # sets of bases by their last four bits: N takes any character


@dataclass(frozen=True)
class CountOptions:
    flank: int = 10
    levels: Levels = COUNT_LEVELS
    min_kl: float = 0.05
    min_score: float = 0.2
    min_base_freq: float = 0.25
    max_rounds: int = 15
    both_strands: bool = False  # False: as the reference counts, the plus strand only

    @property
    def width(self) -> int:
        return 2 * self.flank + 1

    @property
    def reach(self) -> int:
        """Offsets within which a motif grows further."""
        return self.width


@dataclass(frozen=True)
class MixtureOptions:
    flank: int = 4
    levels: Levels = MIXTURE_LEVELS
    min_score: float = 0.1
    max_rounds: int = 100
    max_low_score: int = 10
    penalty: float = 3.0
    min_records: int = 50
    min_motif_records: int = 10

    @property
    def width(self) -> int:
        """All offsets that the rounds can open, from the left edge of the window on."""
        return 2 * (self.max_rounds + 1) + 1

    @property
    def reach(self) -> int:
        """Offsets within which a motif grows further."""
        return min(2 * self.flank + 1, self.width)


# ---------------------------------------------------------------- within a chunk


class Windows:
    """Windows around positions of a chunk as bases per offset, and their weights (window, kind).

    A motif is a text as wide as a window: codes from its first to its last base, dots around them.
    """

    def __init__(self, bases: np.ndarray, at: np.ndarray, minus: np.ndarray, left: int, right: int, weights: np.ndarray):
        """``at`` are places in ``bases``, which end where the contig ends; windows of the minus strand read its complement."""
        margin = max(left, right)
        padded = np.concatenate([np.full(margin, 5, np.uint8), bases, np.full(margin, 5, np.uint8)])
        turned = np.array([3, 2, 1, 0, 4, 5], np.uint8)[padded] if minus.any() else padded
        bits = np.array([1, 2, 4, 8, 16, 0], np.uint8)
        padded, turned = bits[padded], bits[turned]
        around = np.lib.stride_tricks.sliding_window_view(padded, left + right + 1)[at + (margin - left)]
        if minus.any():
            around[minus] = np.lib.stride_tricks.sliding_window_view(turned, left + right + 1)[at[minus] + (margin - right)][:, ::-1]
        self.bits = np.ascontiguousarray(around.T)
        self.weights = weights
        self.n_bases = 5 if (self.bits == _ONE[4]).any() else 4

    def missed(self, motif: str) -> tuple[np.ndarray, np.ndarray]:
        """The offsets of a motif, and for each which windows have another base there."""
        codes = _read(motif)
        at = (codes != _DOT).nonzero()[0]
        return at, (self.bits[at] & _BYTE_BITS[codes[at]][:, None]) == 0

    def without(self, motif: str, kinds: slice) -> None:
        """The windows that match a motif weigh nothing any more; those of no weight at all are let go."""
        hit = ~self.missed(motif)[1].any(axis=0)
        self.weights[hit, kinds] = 0
        left = self.weights.any(axis=1)
        if np.count_nonzero(left) < 0.8 * len(left):
            self.bits, self.weights = self.bits[:, left], self.weights[left]

    def _sums(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the weights of some windows per (offset, base, kind)."""
        kinds, bases = self.weights.shape[1], self.n_bases
        sums = np.zeros((n, 5, kinds))
        step = max(1, _BLOCK // (bases * n))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            is_base = self.bits[:n].take(some, axis=1) == _ONE[:bases, None, None]
            own = is_base.reshape(bases * n, -1).astype(float) @ self.weights.take(some, axis=0)
            sums[:, :bases] += own.reshape(bases, n, kinds).swapaxes(0, 1)
        return sums

    def tally(self, motif: str, n_offsets: int) -> np.ndarray:
        """Sums of the weights per (offset, A C G T other, kind) of the windows that match.

        At an offset of the motif its own base is not looked at, so that other bases are counted too.
        """
        at, missed = self.missed(motif)
        misses = missed.sum(axis=0, dtype=np.uint8 if len(at) < 256 else np.int32)
        sums = self._sums((misses == 0).nonzero()[0], n_offsets)
        near = (misses == 1).nonzero()[0]
        place = at[missed.take(near, axis=1).argmax(axis=0)]
        base = self.bits[place, near]
        counted = (base > 0) & (place < n_offsets) & (_read(motif)[place] != _N)
        near, cell = near[counted], place[counted] * 5 + _INDEX[base[counted]]
        if len(near):
            flat, own = sums.reshape(-1, sums.shape[2]), self.weights.take(near, axis=0)
            most = int(cell.max()) + 1
            for kind in range(sums.shape[2]):
                flat[:most, kind] += np.bincount(cell, own[:, kind], most)
        return sums


class Flock(Windows):
    """Windows of several groups side by side, so that the same calls tally a motif of each.

    Which windows miss a set of bases at an offset is kept as bits, 64 windows a word, for the first ``reach`` offsets:
    no motif that is tallied stands behind them. A group begins with a word; what fills its last word is beyond
    every contig and weighs nothing.
    """

    def __init__(self, windows: list[Windows], reach: int):
        self.size = np.array([len(w.weights) for w in windows])
        self.n_words = -(-self.size // 64)
        self.word = np.cumsum(self.n_words) - self.n_words
        total = 64 * int(self.n_words.sum())
        self.bits = np.zeros((len(windows[0].bits), total), np.uint8)
        self.weights = np.zeros((total, windows[0].weights.shape[1]))
        for w, first, n in zip(windows, (64 * self.word).tolist(), self.size.tolist(), strict=True):
            alike = np.lexsort(w.bits[:reach][::-1]) if n >= _SORTED else slice(None)  # what a motif matches stands together
            self.bits[:, first : first + n], self.weights[first : first + n] = w.bits[:, alike], w.weights[alike]
        self.n_bases, self.reach = max(w.n_bases for w in windows), reach
        self.flags = bool(((self.weights == 0) | (self.weights == 1)).all())  # then sums are numbers of bits
        self.kinds = np.zeros((self.weights.shape[1], total // 64), "<u8")
        self.misses = np.empty((reach, 16, total // 64), "<u8")
        self._keep(0, total // 64)

    def _keep(self, a: int, b: int) -> None:
        """The bits of some words."""
        step = max(1, _BLOCK // (16 * 64 * max(1, b - a)))
        for first in range(0, self.reach, step):
            some = self.bits[first : min(first + step, self.reach), None, 64 * a : 64 * b]
            self.misses[first : first + step, :, a:b] = np.packbits((some & _SETS[:, None]) == 0, axis=2, bitorder="little").view("<u8")
        self.misses[:, 0, a:b] = 0  # the empty set: nothing is asked
        self._keep_kinds(a, b)

    def _keep_kinds(self, a: int, b: int) -> None:
        if self.flags:
            self.kinds[:, a:b] = np.packbits(np.ascontiguousarray(self.weights[64 * a : 64 * b].T != 0), axis=1, bitorder="little").view("<u8")

    def without_of(self, group: int, motif: str, kinds: slice) -> None:
        """As ``without``, for the windows of one group."""
        a, n = 64 * self.word[group], self.size[group]
        codes = _read(motif)
        at = (codes != _DOT).nonzero()[0]
        hit = ((self.bits[at, a : a + n] & _BYTE_BITS[codes[at]][:, None]) != 0).all(axis=0)
        weights = self.weights[a : a + n]
        weights[hit, kinds] = 0
        left = weights.any(axis=1).nonzero()[0]
        if len(left) < 0.8 * n:
            self.bits[:, a : a + len(left)] = self.bits[:, a + left]
            self.bits[: self.reach, a + len(left) : a + n] = 0
            self.weights[a : a + len(left)] = weights[left]
            self.weights[a + len(left) : a + n] = 0
            self.size[group], self.n_words[group] = len(left), -(-len(left) // 64)
            self._keep(self.word[group], self.word[group] + self.n_words[group])
        else:
            self._keep_kinds(self.word[group], self.word[group] + self.n_words[group])

    @staticmethod
    def _set(words: np.ndarray) -> np.ndarray:
        """The places of the bits that are set."""
        some = words.nonzero()[0]
        places = np.unpackbits(words[some].view(np.uint8), bitorder="little").view(bool).nonzero()[0]
        return 64 * some[places >> 6] + (places & 63)

    def tallies(self, groups: list[int], motifs: list[str], n_offsets: list[int]) -> list[np.ndarray]:
        """The tally of a motif of each group."""
        codes = _read("".join(motifs)).reshape(len(motifs), -1)[:, : self.reach]
        some = codes != _DOT
        # an N between needs no look: only what is beyond the contig misses it, and so it misses an end of the motif
        ends = some & ~((np.cumsum(some, axis=1) > 1) & (np.cumsum(some[:, ::-1], axis=1)[:, ::-1] > 1))
        of, at = (some & (ends | (codes != _N))).nonzero()
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        places = np.zeros((int(rank.max()) + 1, len(motifs)), np.intp)
        sets = np.zeros(places.shape, np.intp)  # 0: this motif has no further offset
        places[rank, of], sets[rank, of] = at, _BYTE_BITS[codes[of, at]] & 15
        n_words = self.n_words[groups]
        ends = np.cumsum(n_words)
        of = np.repeat(np.arange(len(groups)), n_words)
        words = np.arange(len(of)) + (self.word[groups] - ends + n_words)[of]
        flat, total = self.misses.reshape(-1), self.misses.shape[2]
        starts = (places * 16 + sets) * total
        missed = [flat.take(start[of] + words) for start in starts]
        once, again = np.zeros((2, len(of)), "<u8")
        for miss in missed:
            again |= once & miss
            once |= miss
        looked = (codes[np.arange(len(motifs)), places] != _N) & (places < np.array(n_offsets))
        if self.flags and max(n_offsets) <= self.reach:
            alone = [np.where(wanted[of], miss & once & ~again, 0) for miss, wanted in zip(missed, looked, strict=True)]
            return [own[:n] for own, n in zip(self._numbers(~once, alone, places, of, words, ends - n_words), n_offsets, strict=True)]
        hit = self._set(~once)
        bounds = [0, *np.searchsorted(hit, 64 * ends).tolist()]
        hit = 64 * words[hit >> 6] + (hit & 63)
        sums = [self._sums(hit[a:b], n) for a, b, n in zip(bounds, bounds[1:], n_offsets, strict=False)]
        once &= ~again
        more = np.zeros((len(motifs), self.reach, 5, self.weights.shape[1]))
        for miss, offset, wanted in zip(missed, places, looked, strict=True):  # the windows that miss this offset alone
            near = self._set(np.where(wanted[of], miss & once, 0))
            if len(near):
                if len(motifs) == 1:
                    near += 64 * words[0]
                    base = self.bits[offset[0]].take(near)
                else:
                    group, near = of[near >> 6], 64 * words[near >> 6] + (near & 63)
                    base = self.bits.reshape(-1).take(offset[group] * self.bits.shape[1] + near)
                own = self.weights.take(near, axis=0)
                if len(motifs) == 1:
                    more[0, offset[0]] += (base == _ONE[:, None]).astype(float) @ own
                    continue
                cell = group * 6 + _PLACE[base]
                kinds = [np.bincount(cell, own[:, kind], 6 * len(motifs)) for kind in range(own.shape[1])]
                more[np.arange(len(motifs)), offset] += np.stack(kinds, axis=1).reshape(len(motifs), 6, -1)[:, :5]
        for own, near in zip(sums, more, strict=True):
            own[: self.reach] += near[: len(own)]
        return sums

    def _numbers(self, hit: np.ndarray, alone: list[np.ndarray], places: np.ndarray, of: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tallies where every weight is 0 or 1, of the windows that match and of those that miss one of the places alone."""
        sums = np.zeros((len(starts), self.reach, 5, len(self.kinds)))
        held = np.unique(of)  # groups that have a window
        if not len(held):
            return sums
        flat, total, kinds = self.misses.reshape(-1), self.misses.shape[2], self.kinds[:, words]

        def count(some: np.ndarray, at: np.ndarray | int) -> np.ndarray:
            missed = [flat.take(at * (16 * total) + base * total + words) for base in (1, 2, 4, 8)]
            bases = [~miss for miss in missed]
            if self.n_bases == 5:
                bases.append(~flat.take(at * (16 * total) + 15 * total + words) & reduce(np.bitwise_and, missed))
            cells = np.bitwise_count(np.stack(bases)[:, None] & (kinds & some))
            return np.add.reduceat(cells, starts[held], axis=2, dtype=np.int64).transpose(2, 0, 1)

        for offset in range(self.reach):
            sums[held, offset, : self.n_bases] = count(hit, offset)
        for some, offset in zip(alone, places, strict=True):
            if some.any():
                sums[held, offset[held], : self.n_bases] += count(some, offset[of])
        return sums


class BitFlock:
    """Small groups of the mixture search side by side: for every offset, which windows have a base there is kept as bits.

    What a motif would match once it has grown is counted by bits, and weights are summed only for what matches
    records enough. A group has as many words of 64 windows as the largest; what fills them is beyond every contig.
    """

    def __init__(self, windows: list[Windows], reach: int):
        n_words = max(1, *(-(-len(w.weights) // 64) for w in windows))
        n, kinds = 64 * n_words, windows[0].weights.shape[1]
        self.bits = np.zeros((len(windows), len(windows[0].bits), n), np.uint8)
        self.weights = np.zeros((len(windows), n, kinds - 3))
        flags = np.zeros((len(windows), 3, n), bool)
        for g, w in enumerate(windows):
            self.bits[g, :, : len(w.weights)] = w.bits
            self.weights[g, : len(w.weights)] = w.weights[:, 3:]
            flags[g, :, : len(w.weights)] = w.weights[:, :3].T != 0
        self.methylated, self.live, self.valid = self._words(flags).swapaxes(0, 1).copy()
        bases = np.stack([self._words((b & _ONE[:4, None, None]) != 0) for b in self.bits])  # group, base, offset, word
        self.bases = bases.transpose(0, 2, 3, 1).reshape(-1, 4 * n_words)  # a row for each offset of a group: its words of four bases
        sets = np.stack([self._words((b[:reach] & _SETS[:, None, None]) != 0) for b in self.bits])
        sets[:, 0] = ~np.uint64(0)  # the empty set: nothing is asked
        self.sets = sets.swapaxes(1, 2).reshape(-1, n_words)  # a row for each offset and set of bases of a group
        self.reach, self.n_offsets, self.n_words = reach, self.bits.shape[1], n_words

    @staticmethod
    def _words(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=-1, bitorder="little").view("<u8")

    def without_of(self, group: int, motif: str, kinds: slice) -> None:
        """As ``without``, for the records of one group: the methylated windows stay."""
        codes = _read(motif)
        at = (codes != _DOT).nonzero()[0]
        self.live[group] &= ~self._words(((self.bits[group, at] & _BYTE_BITS[codes[at]][:, None]) != 0).all(axis=0))

    def matched(self, groups: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(methylated windows, records) that match a motif of each group; the records that match it but for an offset (motif, offset, word)."""
        here = np.where(codes == _DOT, 0, _BYTE_BITS[codes] & 15)
        hit = self.sets.take((groups[:, None] * self.reach + np.arange(self.reach)) * 16 + here, axis=0)
        but = np.full((len(groups), self.reach, hit.shape[2]), ~np.uint64(0))
        but[:, 1:] = np.bitwise_and.accumulate(hit, axis=1)[:, :-1]
        but[:, :-1] &= np.bitwise_and.accumulate(hit[:, ::-1], axis=1)[:, -2::-1]
        match = but[:, 0] & hit[:, 0]
        live = self.live[groups]
        count = lambda words: np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        return count(match & self.methylated[groups]), count(match & live), but & live[:, None]

    def grown(self, groups: np.ndarray, codes: np.ndarray, but: np.ndarray, n_now: np.ndarray, opened: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """(motif, offset, set of bases, sums of the kinds but the first) where a base more leaves ``least`` records, in this order."""
        here = np.where(codes == _DOT, 0, _BYTE_BITS[codes] & 15)
        masks = here[:, :, None] | _ONE[:4]
        near = self.sets.take(((groups[:, None] * self.reach + np.arange(self.reach)) * 16)[:, :, None] + masks, axis=0) & but[:, :, None]
        n = reduce(np.add, np.moveaxis(np.bitwise_count(near), 3, 0).astype(np.int32))
        enough = (n >= least) & (masks != here[:, :, None]) & (np.arange(self.reach)[:, None] < opened[:, None, None])
        of, at, b = enough.nonzero()
        words, masks, n = near[of, at, b], masks[of, at, b], n[of, at, b]
        further = np.where(n_now >= least, np.maximum(opened - self.reach, 0), 0)
        if further.any():  # offsets that no motif which grows holds
            far_of = np.repeat(np.arange(len(groups)), further)
            far_at = np.arange(len(far_of)) - (np.cumsum(further) - further)[far_of] + self.reach
            whole = np.repeat(np.bitwise_and.reduce(but, axis=1), 4, axis=1)
            far = self.bases.take(groups[far_of] * self.n_offsets + far_at, axis=0)
            far &= whole.take(far_of, axis=0)
            far_n = np.bitwise_count(far)
            far_n = reduce(np.add, [far_n[:, i : i + 4].astype(np.int32) for i in range(0, 4 * self.n_words, 4)])
            i, far_b = np.divmod((far_n.ravel() >= least).nonzero()[0], 4)
            far = far.reshape(len(far), self.n_words, 4)
            of, at = np.concatenate([of, far_of[i]]), np.concatenate([at, far_at[i]])
            words, masks, n = np.concatenate([words, far[i, :, far_b]]), np.concatenate([masks, _ONE[far_b]]), np.concatenate([n, far_n[i, far_b]])
            order = np.argsort(of, kind="stable")
            of, at, words, masks, n = of[order], at[order], words[order], masks[order], n[order]
        sums = np.empty((len(of), 2 + self.weights.shape[2]))
        sums[:, 0], sums[:, 1] = n, np.bitwise_count(words & self.valid[groups[of]]).sum(axis=1)
        flags = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(float)
        bounds = np.searchsorted(of, np.arange(len(groups) + 1)).tolist()
        for g, first, last in zip(groups.tolist(), bounds, bounds[1:], strict=False):
            if first < last:
                np.matmul(flags[first:last], self.weights[g], out=sums[first:last, 2:])
        return of, at, masks, sums


class Chunk:
    """A row of packed chunks: the bases around a stretch of a contig, and the records on it."""

    def __init__(self, rows: pa.RecordBatch, i: int, kinds: tuple[str, ...]):
        get = lambda name: rows[name][i].as_py()
        self.bases = _BASES[np.frombuffer(rows["text"][i].as_buffer(), np.uint8)]
        self.begin, self.length = get("begin"), get("length")
        self.first, self.last = get("first") - self.begin, get("last") - self.begin
        items = rows["records"][i].values
        column = lambda name: items.field(name).to_numpy(zero_copy_only=False)
        empty = items is None
        self.at = np.empty(0, np.int64) if empty else column("position") - self.begin
        self.minus = np.empty(0, bool) if empty else column("minus")
        self.records = {k: np.empty(0) if empty else column(k).astype(float) for k in kinds}

    def whole(self, at: np.ndarray, flank: int) -> np.ndarray:
        """Which windows no end of the contig cuts."""
        position = at + self.begin
        return (position >= flank) & (position + flank < self.length)


def _read(motif: str) -> np.ndarray:
    return np.frombuffer(motif.encode(), np.uint8)


def _around(motif: str, at: int, left: int, right: int) -> tuple[str, str]:
    """What stands before and behind an offset when a motif from ``left`` to ``right`` grows there; the gap fills with N."""
    if at < left:
        return "." * at, "N" * (left - at - 1) + motif[left:]
    if at < right:
        return motif[:at], motif[at + 1 :]
    return motif[:right] + "N" * (at - right), motif[at + 1 :]


def _ends(motif: str) -> tuple[int, int]:
    return len(motif) - len(motif.lstrip(".")), len(motif.rstrip("."))


def _grown(motif: str, at: int, mask: int) -> str:
    """A motif with a set of bases at an offset."""
    before, behind = _around(motif, at, *_ends(motif))
    return before + _CODE[mask] + behind


# ---------------------------------------------------------------- the queue of a group


@dataclass
class Search:
    """What is open in a group: a queue of motifs by priority, the best so far, what was found."""

    mod_type: str
    options: object
    n_left: int
    open: bool = True
    found: list = field(default_factory=list)
    removed: list = field(default_factory=list)
    low: int = 0
    ready: dict = field(default_factory=dict)  # tallies of motifs that the queue has not come to

    def __post_init__(self):
        self.seed = "." * self.options.flank + MOD_BASE[self.mod_type] + "." * (self.options.width - self.options.flank - 1)
        self.begin()

    def begin(self) -> None:
        self.queue, self.order, self.since, self.best = [(0.0, 0, self.seed)], 0, 0, (0.0, 0, self.seed, None)
        self.known, self.ready = {self.seed: (0.0, 0)}, {}

    def wanted(self, limit: int) -> list[str]:
        """The motifs to be tallied next; the first of the queue is among them."""
        return [m for _, _, m in heapq.nsmallest(limit, self.queue) if m not in self.ready]

    def feed(self, tallies: dict[str, np.ndarray]) -> None:
        """Go on with the queue as far as its tallies are there."""
        self.ready |= tallies
        while (motif := self.due()) is not None:
            sums = self.ready.pop(motif, None)
            if sums is None or len(sums) < self.n_offsets(1):
                return
            self.pop()
            self.expand_all([self], [motif], [sums])

    def due(self) -> str | None:
        """The motif whose tally comes next; what needs none is done before. None at the end."""
        while self.open:
            if not self.queue or self.since > self.options.max_rounds:
                self.finish()
            elif self.expandable(motif := self.queue[0][2]):
                return motif
            else:
                self.pop()
        return None

    def pop(self) -> None:
        heapq.heappop(self.queue)
        self.since += 1

    def close(self) -> None:
        self.open, self.queue, self.known, self.further, self.ready = False, [], {}, {}, {}

    def remove(self, motif: str) -> None:
        self.removed.append(motif)
        self.begin()


class CountSearch(Search):
    """Scores by the counts of high and low records; grows where methylated and background windows differ.

    Kinds of weights: background, methylated, high, low.
    """

    KINDS = ("background", "methylated", "high", "low")
    RECORD = ("high", "low")  # what a record of a chunk says
    REMOVABLE = slice(0, 2)
    counted = False
    seed_odds = None

    @classmethod
    def windows(cls, o: CountOptions, mod_type: str, chunk: Chunk) -> Windows:
        """Background windows around every base that can carry the modification, and windows of the records."""
        base = _BASES[ord(MOD_BASE[mod_type])]
        own = chunk.bases[chunk.first : chunk.last]
        around = [np.flatnonzero(own == b) + chunk.first for b in (base, 3 - base)]
        around = [a[chunk.whole(a, o.flank)] for a in around]
        high, low = chunk.records["high"], chunk.records["low"]
        n, at = [len(a) for a in around], chunk.at
        weights = np.zeros((sum(n) + len(at), 4))
        weights[: sum(n), 0] = 1
        weights[sum(n) :, 1:] = np.stack([high * chunk.whole(at, o.flank), high, low], axis=1)
        minus = np.concatenate([np.zeros(n[0], bool), np.ones(n[1], bool), chunk.minus])
        return Windows(chunk.bases, np.concatenate([*around, at]), minus, o.flank, o.flank, weights)

    def n_offsets(self, ahead: int) -> int:
        return self.options.width

    def expandable(self, motif: str) -> bool:
        return True

    @staticmethod
    def shape(high, low):
        """Mean and standard deviation of a Beta of the counts, each raised by one."""
        a, b = high + 1.0, low + 1.0
        return a / (a + b), np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))

    @classmethod
    def expand_all(cls, searches: list[CountSearch], motifs: list[str], tallies: list[np.ndarray]) -> None:
        """Each search grows the motif that it has come to."""
        o, sums = searches[0].options, np.stack(tallies)
        codes = _read("".join(motifs)).reshape(len(motifs), -1)
        totals = (sums[:, o.flank] * _OWN[codes[:, o.flank], :, None]).sum(axis=1)
        n_background, n_methylated, n_high, n_low = totals.T
        for search, odds in zip(searches, ((n_high + 1) / (n_low + 1)).tolist(), strict=True):
            if search.seed_odds is None:
                search.seed_odds = odds
        grows = ((n_background > 0) & (n_methylated > 0)).nonzero()[0]
        if not len(grows):
            return
        own = sums[grows, :, :4, :2] * _OWN[codes[grows], :4, None]
        p, q = own[..., 1] / n_methylated[grows, None, None], own[..., 0] / n_background[grows, None, None]
        divergence = ((p + 1e-6) * np.log((p + 1e-6) / (q + 1e-6))).sum(axis=2)
        of, wide = (divergence > o.min_kl).nonzero()
        frequent = (p[of, wide] > o.min_base_freq) @ _ONE[:4]
        of = grows[of]
        here = np.where(codes == _DOT, 0, _BYTE_BITS[codes])[of, wide]
        n_sets = np.where(here == _ANY, 0, _N_WITHIN[frequent])  # joining bases to N leaves the motif as it is
        cell = np.repeat(np.arange(len(of)), n_sets)
        masks = _WITHIN[frequent[cell], np.arange(len(cell)) - (np.cumsum(n_sets) - n_sets)[cell]] | here[cell]
        cell, masks = cell[changes := masks != here[cell]], masks[changes]
        of, wide = of[cell], wide[cell]
        mean, sd = (x[of] for x in cls.shape(n_high, n_low))
        joined = (_SUBSETS_ANY[masks][:, None] @ sums[of, wide])[:, 0]
        high, low = joined[:, 2], joined[:, 3]
        means, sds = cls.shape(high, low)
        scores = (means * -np.log10((sds + sd) / 2) * (means - mean)).round(12).tolist()
        odds = np.array([search.seed_odds for search in searches])
        priorities = ((1 - (high + 1) / (low + 1)) / odds[of]).tolist()
        bounds = np.searchsorted(of, np.arange(len(searches) + 1)).tolist()
        wide, masks = wide.tolist(), masks.tolist()
        for i, (search, motif) in enumerate(zip(searches, motifs, strict=True)):
            (left, right), known, queue = _ends(motif), search.known, search.queue
            last = before = behind = None
            for j in range(bounds[i], bounds[i + 1]):
                if wide[j] != last:
                    last = wide[j]
                    before, behind = _around(motif, last, left, right)
                new, score = before + _CODE[masks[j]] + behind, scores[j]
                if score > search.best[0]:
                    search.since = 0
                if (old := known.get(new)) is None:
                    search.order += 1
                    heapq.heappush(queue, (priorities[j], search.order, new))
                    now = known[new] = (score, search.order)
                elif score > old[0]:  # a better score from another parent
                    now = known[new] = (score, old[1])
                else:
                    now = old
                if now > search.best[:2]:
                    search.best = (*now, new, joined[j].tolist())

    def finish(self) -> None:
        score, _, motif, sums = self.best
        if score <= self.options.min_score or not sums[1]:
            self.close()
            return
        self.found.append((motif, score, sums[2], sums[3], None, None, None))
        self.remove(motif)


class MixtureSearch(Search):
    """Scores by the mixture fitted to the records of a motif; grows by single bases at offsets that open two per round.

    Kinds of weights: methylated windows, records, records with a responsibility r, and the sums of
    r, r x and r x x. The gate counts every record that no motif has removed.
    """

    KINDS = ("methylated", "n", "valid", "w", "wx", "wxx")
    RECORD = ("high", "x", "r")
    REMOVABLE = slice(1, 6)
    counted = True  # records are flags, so what a motif matches can be counted before weights are summed

    @classmethod
    def windows(cls, o: MixtureOptions, mod_type: str, chunk: Chunk) -> Windows:
        """Windows of the records, all of them on the forward reading of the contig."""
        high, x, r = (chunk.records[k] for k in cls.RECORD)
        valid = ~(np.isnan(x) | np.isnan(r))
        mantissa, exponent = np.frexp(np.where(valid, r, 0.0))
        r, x = np.ldexp(np.round(np.ldexp(mantissa, 36)), exponent - 36), np.where(valid, x, 0.0)  # the last bits differ from run to run
        weights = np.stack([high * chunk.whole(chunk.at, o.flank), np.ones(len(r)), valid, r, r * x, r * x * x], axis=1)
        return Windows(chunk.bases, chunk.at, np.zeros(len(r), bool), o.flank, o.width - o.flank - 1, weights)

    def n_offsets(self, ahead: int) -> int:
        """Offsets open by then, and at least up to the modified base, which counts all that match."""
        return max(min(2 * (self.since + ahead) + 1, self.options.width), self.options.flank + 1)

    def begin(self) -> None:
        super().begin()
        self.best, self.known, self.further = (0.0, 0, self.seed, None), {self.seed}, {}
        self.n_seed = 0.0
        if self.n_left < self.options.min_records or self.low > self.options.max_low_score:
            self.close()

    def wanted(self, limit: int) -> list[str]:
        return [m for _, _, m in heapq.nsmallest(limit, (e for e in self.queue if self.expandable(e[2]))) if m not in self.ready]

    def expandable(self, motif: str | list) -> bool:
        """As upstream, what is longer than the windows grows no further."""
        return type(motif) is str

    def queue_run(self, run: list[tuple[float, int]]) -> None:
        """Motifs that grow no further join the queue without their text, the first of them at the end: one at a time stands for all."""
        heapq.heappush(self.queue, (*run.pop(), run))

    def pop(self) -> None:
        run = self.queue[0][2]
        if type(run) is list and run:
            heapq.heapreplace(self.queue, (*run.pop(), run))
        else:
            heapq.heappop(self.queue)
        self.since += 1

    @staticmethod
    def fit(sums: np.ndarray, o: MixtureOptions):
        """(score, pi, alpha, beta) for each row of sums of the kinds but the first; no score where there is no fit."""
        n, valid, w, wx, wxx = sums.T
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, pi = wx / w, w / valid
            variance = wxx / w - mean * mean
            common = np.where(variance >= 1e-12, mean * (1 - mean) / variance - 1, 0.0)
            good = (n >= o.min_motif_records) & (w > 0) & (common > 0)
            return np.where(good, np.round(pi * mean, 9), -np.inf), pi, mean * common, (1 - mean) * common

    @classmethod
    def expand_all(cls, searches: list[MixtureSearch], motifs: list[str], tallies: list[np.ndarray]) -> None:
        """Each search grows the motif that it has come to."""
        o = searches[0].options
        codes = _read("".join(motifs)).reshape(len(motifs), -1)
        totals = (np.stack([sums[o.flank, :, :2] for sums in tallies]) * _OWN[codes[:, o.flank], :, None]).sum(axis=1).tolist()
        grows = []
        for i, (search, (methylated, n)) in enumerate(zip(searches, totals, strict=True)):
            if motifs[i] == search.seed:
                search.n_seed = n
            if methylated:  # else its windows are background windows too, and neither set is ever reduced
                grows.append(i)
        if not grows:
            return
        opened = [min(2 * searches[i].since + 1, o.width) for i in grows]
        sums = np.concatenate([tallies[i][:n] for i, n in zip(grows, opened, strict=True)])
        codes = np.concatenate([codes[i, :n] for i, n in zip(grows, opened, strict=True)])
        joined = sums[:, :4].copy()
        masks = np.tile(_ONE[:4], (len(sums), 1))
        inside = (codes != _DOT).nonzero()[0]
        here = (_BYTE_BITS[codes[inside]] & 15)[:, None]
        masks[inside] |= here
        joined[inside] = _SUBSETS[masks[inside]] @ sums[inside, :4]
        i, b = np.nonzero(masks[inside] == 15)
        joined[inside[i], b] = sums[inside[i]].sum(axis=1)  # N takes any character
        enough = joined[:, :, 1] >= o.min_motif_records
        enough[inside] &= masks[inside] != here  # else the motif as it is
        at, b = np.nonzero(enough)
        joined = joined[at, b]
        ends = np.cumsum(opened)
        of = np.searchsorted(ends, at, side="right")
        cls.grow_all([searches[i] for i in grows], [motifs[i] for i in grows], of, at - (ends - opened)[of], masks[at, b], joined[:, 1:])

    @classmethod
    def grow_all(cls, searches: list[MixtureSearch], motifs: list[str], of: np.ndarray, at: np.ndarray, masks: np.ndarray, sums: np.ndarray) -> None:
        """The motifs that grow at an offset by a set of bases, in order of motif and offset, join the queues if they fit."""
        o = searches[0].options
        score, *model = cls.fit(sums, o)
        fits = (score > -np.inf).nonzero()[0]
        n, *model = (x[fits] for x in (sums[:, 0], *model))
        of, at, masks, score = of[fits], at[fits], masks[fits], score[fits]
        bounds = np.searchsorted(of, np.arange(len(searches) + 1))
        further = bounds[1:] - np.bincount(of[at >= o.reach], minlength=len(searches))  # where those begin that grow no more
        cells = (at * 16 + masks).tolist()
        bounds, further, at, masks, score = bounds.tolist(), further.tolist(), at.tolist(), masks.tolist(), score.tolist()
        push = heapq.heappush
        for k, (search, motif) in enumerate(zip(searches, motifs, strict=True)):
            first, mid, end = bounds[k], further[k], bounds[k + 1]
            if first == end:
                continue
            (left, right), known, queue, order, best, better = _ends(motif), search.known, search.queue, search.order, search.best[0], None
            last = before = behind = None
            for j in range(first, mid):
                if at[j] != last:
                    last = at[j]
                    before, behind = _around(motif, last, left, right)
                new = before + _CODE[masks[j]] + behind
                if new in known:
                    continue
                order += 1
                s = score[j]
                push(queue, (-s, order, new))
                known.add(new)
                if s > best:
                    best, better = s, (j, order)
            if mid < end:
                fresh = range(mid, end)
                grown = search.further.setdefault(motif[:right].rstrip("N"), set())  # the gap is filled with N anyway
                if grown:
                    fresh = [j for j in fresh if cells[j] not in grown]
                grown.update(cells[mid:end])
                run = sorted([(-score[j], order + 1 + j - mid, j) for j in fresh], reverse=True)
                order += end - mid + 1
                if run:
                    s, place, j = run[-1]
                    if -s > best:
                        best, better = -s, (j, place)
                    search.queue_run([(s, place) for s, place, _ in run])
            search.order = order
            if better:
                j, place = better
                search.since = 0
                search.best = (best, place, _grown(motif, at[j], masks[j]), (float(n[j]), *(float(x[j]) for x in model)))

    @classmethod
    def expand_counted(cls, flock: BitFlock, groups: list[int], searches: list[MixtureSearch], motifs: list[str]) -> None:
        """As ``expand_all``, of groups side by side."""
        o, places = searches[0].options, np.array(groups)
        codes = _read("".join(motifs)).reshape(len(motifs), -1)[:, : flock.reach]
        methylated, n, but = flock.matched(places, codes)
        for search, motif, own in zip(searches, motifs, n.tolist(), strict=True):
            if motif == search.seed:
                search.n_seed = float(own)
        grows = methylated.nonzero()[0]
        if len(grows):
            some = [searches[i] for i in grows]
            opened = np.array([min(2 * search.since + 1, o.width) for search in some])
            cls.grow_all(some, [motifs[i] for i in grows], *flock.grown(places[grows], codes[grows], but[grows], n[grows], opened, o.min_motif_records))

    def finish(self) -> None:
        score, _, motif, model = self.best
        n_removed = model[0] if model else self.n_seed
        if score <= self.options.min_score and not n_removed:
            self.close()  # nothing changes, so every further search would end alike
            return
        if score > self.options.min_score:
            self.found.append((motif, score, None, None, *model[1:]))
            self.low = 0
        else:
            self.low += 1
        self.n_left -= n_removed
        self.remove(motif)


# ---------------------------------------------------------------- rounds over all groups

_STATE = "contig_id string, mod_type string, n_chunks int, n_records double, open boolean, state binary"
_FOUND = "array<struct<motif:string,score:double,high:double,low:double,pi:double,alpha:double,beta:double>>"
_ROUND = pa.schema([("contig_id", pa.string()), ("mod_type", pa.string()), ("n_chunks", pa.int32()), ("n_records", pa.float64()), ("open", pa.bool_()), ("state", pa.binary())])


def chunks_of(records: DataFrame, sequences: DataFrame, groups: DataFrame, kind: type[Search], margin: int, chunk: int) -> DataFrame:
    """(group, n_chunks, chunk, length, first, last, begin, text, records): each chunk of the contig of each group.

    ``records`` has (group, position, strand, what the kind of search wants of a record).
    """
    first = F.col("chunk") * chunk
    last = F.least(first + chunk, F.col("length"))
    begin = F.greatest(first - margin, F.lit(0))
    text = F.substr(F.col("seq"), (begin + 1).cast("int"), (last + margin - begin).cast("int"))
    pieces = (
        sequences.where("seq is not null and seq <> ''")
        .select("contig_id", F.regexp_replace("seq", "[^ACGT]", "N").alias("seq"), F.length("seq").cast("long").alias("length"))
        .join(groups.groupBy("contig_id").agg(F.collect_set("mod_type").alias("mods")), "contig_id")  # one row per contig
        .withColumn("n_chunks", F.ceil(F.col("length") / chunk).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - F.lit(1).cast("long"))))
        .select("contig_id", "mods", "n_chunks", "chunk", "length", first.alias("first"), last.alias("last"), begin.alias("begin"), text.alias("text"))
        .select("*", F.explode("mods").alias("mod_type"))
        .drop("mods")
    )
    # at most two records a position; in a fixed order, so that sums are the same in every run
    own = F.sort_array(F.collect_list(F.struct("position", (F.col("strand") == "-").alias("minus"), *kind.RECORD))).alias("records")
    packed = records.where("position >= 0").groupBy(*GROUP, F.floor(F.col("position") / chunk).alias("chunk")).agg(own)
    inside = F.filter("records", lambda r: r["position"] < F.col("length"))
    return pieces.join(packed, [*GROUP, "chunk"], "left").withColumn("records", inside)


def _search_of(rows: pa.RecordBatch, i: int, kind: type[Search], options) -> Search:
    state = rows["state"][i].as_py()
    return pickle.loads(state) if state is not None else kind(rows["mod_type"][i].as_py(), options, rows["n_records"][i].as_py())


def stepped(searches: list[Search], windows: list[Windows], steps: int) -> None:
    """Searches of one kind, each on windows of its own, take their steps side by side."""
    reach = searches[0].options.reach
    small = [i for i, w in enumerate(windows) if len(w.weights) < _LARGE]
    flocks = [small] * bool(small) + [[i] for i, w in enumerate(windows) if len(w.weights) >= _LARGE]
    if searches[0].counted:  # those of about the same size step side by side
        sizes = {i: max(0, len(windows[i].weights) - 1).bit_length() for i in small}
        flocks = [[i for i in small if max(sizes[i], 7) == size] for size in sorted({max(size, 7) for size in sizes.values()})] + flocks[bool(small) :]
    place, flocks_of = {i: k for flock in flocks for k, i in enumerate(flock)}, {}
    for some in flocks:
        flock = (BitFlock if searches[0].counted and len(windows[some[0]].weights) < _LARGE else Flock)([windows[i] for i in some], reach)
        for i in some:
            flocks_of[i], windows[i] = flock, None
    gone, going = [0] * len(searches), range(len(searches))
    for _ in range(steps):
        due = [(i, searches[i].due()) for i in going]
        motifs = {i: motif for i, motif in due if motif is not None}
        if not motifs:
            return
        going, tallies = list(motifs), {}
        for i in going:
            search = searches[i]
            for motif in search.removed[gone[i] :]:
                flocks_of[i].without_of(place[i], motif, search.REMOVABLE)
            gone[i] = len(search.removed)
            search.pop()
        for some in flocks:
            if not (some := [i for i in some if i in motifs]):
                continue
            if isinstance(flocks_of[some[0]], BitFlock):
                searches[0].expand_counted(flocks_of[some[0]], [place[i] for i in some], [searches[i] for i in some], [motifs[i] for i in some])
            else:
                own = flocks_of[some[0]].tallies([place[i] for i in some], [motifs[i] for i in some], [searches[i].n_offsets(0) for i in some])
                tallies |= zip(some, own, strict=True)
        if tallies:
            searches[0].expand_all([searches[i] for i in tallies], [motifs[i] for i in tallies], list(tallies.values()))
    for i in going:
        searches[i].due()  # the last of them may be at its end


def _alone(kind: type[Search], options, steps: int):
    """Groups of one chunk: they move on where they are."""

    def run(batches):
        for rows in batches:
            states = [_search_of(rows, i, kind, options) for i in range(rows.num_rows)]
            some, windows, n = [], [], 0
            for i, search in enumerate(states):
                some.append(search)
                windows.append(kind.windows(options, search.mod_type, Chunk(rows, i, kind.RECORD)))
                n += len(windows[-1].weights)
                if n >= _ABREAST or i == len(states) - 1:
                    stepped(some, windows, steps)
                    some, windows, n = [], [], 0
            yield _state_rows(rows, states)

    return run


def _state_rows(rows: pa.RecordBatch, states: list[Search]) -> pa.RecordBatch:
    kept = [rows[n] for n in ("contig_id", "mod_type", "n_chunks", "n_records")]
    opened, pickled = pa.array([s.open for s in states], pa.bool_()), pa.array([pickle.dumps(s) for s in states], pa.binary())
    return pa.RecordBatch.from_arrays([*kept, opened, pickled], schema=_ROUND)


def _parts(kind: type[Search], options, ahead: int):
    """Chunks of groups that have several: the tallies of what their group wants, one after the other."""

    def run(batches):
        for rows in batches:
            sums = []
            for i in range(rows.num_rows):
                search = _search_of(rows, i, kind, options)
                windows = kind.windows(options, search.mod_type, Chunk(rows, i, kind.RECORD))
                for motif in search.removed:
                    windows.without(motif, kind.REMOVABLE)
                n = search.n_offsets(ahead)
                sums.append(np.concatenate([windows.tally(m, n).ravel() for m in search.wanted(ahead)]) if search.open else np.empty(0))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sums)]), pa.int32()), pa.array(np.concatenate(sums)))
            yield pa.RecordBatch.from_arrays([rows["contig_id"], rows["mod_type"], rows["chunk"], lists], names=[*GROUP, "chunk", "sums"])

    return run


def _moved(kind: type[Search], options, ahead: int):
    """Groups of several chunks: their queues move on by the summed tallies."""

    def run(batches):
        for rows in batches:
            states = []
            for i in range(rows.num_rows):
                search = _search_of(rows, i, kind, options)
                wanted = search.wanted(ahead) if search.open else []
                sums = rows["sums"][i].values.to_numpy().reshape(len(wanted), -1, 5, len(kind.KINDS)) if wanted else []
                search.feed(dict(zip(wanted, sums, strict=True)))
                states.append(search)
            yield _state_rows(rows, states)

    return run


def added_up(parts: DataFrame, n_chunks: int) -> DataFrame:
    """(group, sums): arrays of equal length added up, in rounds of at most ``_FAN_IN`` arrays a row."""
    levels = max(1, math.ceil(math.log(max(n_chunks, 2), _FAN_IN)))
    add = "aggregate(slice(a, 2, size(a)), a[0], (x, y) -> zip_with(x, y, (p, q) -> p + q))"
    for left in reversed(range(levels)):
        keys = [*GROUP, F.floor(F.col("chunk") / _FAN_IN).alias("chunk")] if left else GROUP
        gathered = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "sums"))), lambda x: x["sums"]).alias("a")
        parts = parts.groupBy(*keys).agg(gathered).withColumn("sums", F.expr(add)).drop("a")
    return parts


def _found_of(kind: type[Search]):
    def run(batches):
        for rows in batches:
            names = ("motif", "score", "high", "low", "pi", "alpha", "beta")
            found = [[dict(zip(names, f, strict=True)) for f in pickle.loads(s.as_py()).found] for s in rows["state"]]
            kinds = pa.list_(pa.struct([(n, pa.string() if n == "motif" else pa.float64()) for n in names]))
            yield pa.RecordBatch.from_arrays([rows["contig_id"], rows["mod_type"], pa.array(found, kinds)], names=[*GROUP, "found"])

    return run


def _tasks(rows: DataFrame, n: int) -> int:
    """Tasks for ``n`` rows of packed chunks: some for each core, more where there are many rows."""
    spark = rows.sparkSession
    return max(1, min(n, 4 * parallelism(spark), max(8 * spark.sparkContext.defaultParallelism, n // _ROWS)))


def search_rounds(records: DataFrame, sequences: DataFrame, groups: DataFrame, kind: type[Search], options, chunk: int = CHUNK, steps: int = STEPS, ahead: int = AHEAD) -> DataFrame:
    """(group, motif_seq, mod_position, what is known of it) of all groups, one row per motif.

    ``records`` has (group, position, strand, what the kind of search wants); ``groups`` has (group, n_records).
    """
    packed = written(chunks_of(records, sequences, groups, kind, options.width - options.flank, chunk), "packed")
    sizes = packed.groupBy(*GROUP).agg(F.first("n_chunks").alias("n_chunks"))
    states = groups.join(sizes, GROUP).select(*GROUP, "n_chunks", F.col("n_records").cast("double").alias("n_records"), F.lit(True).alias("open"), F.lit(None).cast("binary").alias("state"))
    n_one, n_parts, most = packed.agg(F.count_if(F.col("n_chunks") == 1), F.count_if(F.col("n_chunks") > 1), F.max("n_chunks")).first()
    one, many = packed.where("n_chunks = 1"), packed.where("n_chunks > 1").drop("n_chunks")
    if n_one and n_parts:
        many = checkpointed(many)  # read in every round
    settled = []
    while n_one or n_parts:
        moved = None
        if n_one:
            moved = states.where("n_chunks = 1").join(one.drop("n_chunks"), GROUP).repartition(_tasks(records, n_one), *GROUP).mapInArrow(_alone(kind, options, steps), _STATE)
        if n_parts:
            apart = states.where("n_chunks > 1")
            tasks = min(n_parts, 4 * parallelism(records.sparkSession))  # each is much work
            parts = apart.select(*GROUP, "n_records", "state").join(many, GROUP).repartition(tasks, *GROUP, "chunk").mapInArrow(_parts(kind, options, ahead), "contig_id string, mod_type string, chunk long, sums array<double>")
            summed = apart.join(added_up(parts, most), GROUP).mapInArrow(_moved(kind, options, ahead), _STATE)
            moved = summed if moved is None else moved.unionByName(summed)
        states = checkpointed(moved)
        is_open = F.col("open")
        n_closed, n_one, n_parts = states.agg(
            F.count_if(~is_open), F.count_if(is_open & (F.col("n_chunks") == 1)), F.coalesce(F.sum(F.when(is_open & (F.col("n_chunks") > 1), F.col("n_chunks"))), F.lit(0))
        ).first()
        if n_closed:
            settled.append(states.where("not open"))  # what is done stays where it was written
            if len(settled) > _FAN_IN:
                settled = [checkpointed(reduce(DataFrame.unionByName, settled))]
            states = states.where("open")
    states = reduce(DataFrame.unionByName, settled) if settled else states
    found = states.mapInArrow(_found_of(kind), f"contig_id string, mod_type string, found {_FOUND}")
    rows = found.select(*GROUP, F.explode("found").alias("f")).select(*GROUP, "f.*")
    at = F.lit(options.flank) - (F.length("motif") - F.length(F.ltrim(F.col("motif"), F.lit("."))))
    return rows.select(*GROUP, F.trim(F.col("motif"), F.lit(".")).alias("motif_seq"), at.cast("int").alias("mod_position"), "score", "high", "low", "pi", "alpha", "beta")


# ---------------------------------------------------------------- the two discoveries


def _named(*columns) -> list[Column]:
    return [
        F.col("contig_id"),
        F.concat_ws("-", "motif_seq", "mod_type", F.col("mod_position").cast("string")).alias("motif"),
        F.col("motif_seq"),
        F.col("mod_type").alias("motif_mod_type"),
        F.col("mod_position").alias("motif_mod_position"),
        *columns,
    ]


def with_whole_window(records: DataFrame, sequences: DataFrame, high: Column, flank: int, *sums: Column) -> DataFrame:
    """(group, sums) of the groups that have a high record whose window no end of its contig cuts.

    The first such position from the left tells, so records need not meet the length of their contig.
    """
    first = F.min(F.when(high & (F.col("position") >= flank), F.col("position"))).alias("first")
    lengths = sequences.where("seq is not null").select("contig_id", F.length("seq").alias("length"))
    return records.groupBy(*GROUP).agg(first, *sums).join(lengths, "contig_id").where(F.col("first") + flank < F.col("length")).drop("first", "length")


def discover_by_counts(records: DataFrame, sequences: DataFrame, options: CountOptions = CountOptions(), **rounds) -> DataFrame:
    """The motifs of each contig with the counts of their levels and their score."""
    level = level_of(F.col("n_mod"), F.col("n_valid_cov"), options.levels).alias("level")
    leveled = written(records.select(*GROUP, "position", "strand", level), "leveled")  # what gives the records may be costly
    found = checkpointed(found_by_counts(leveled, sequences, options, **rounds))  # read twice below
    at = occurrences(sequences, found)
    counted = level_counts(leveled, at if options.both_strands else at.where("strand = '+'"))
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("low_count", "middle_count", "high_count"))
    return found.join(counted, ["contig_id", *MOTIF], "left").select(*_named(*counts, "score"))


def found_by_counts(leveled: DataFrame, sequences: DataFrame, options: CountOptions, **rounds) -> DataFrame:
    """The motifs of each contig with the high and low records that gave their score."""
    observed = leveled.where("level in ('High', 'Low')" if options.both_strands else "level in ('High', 'Low') and strand = '+'")
    is_level = lambda name: (F.col("level") == name).alias(name.lower())
    records = written(observed.select(*GROUP, "position", "strand", is_level("High"), is_level("Low")), "observed")
    groups = checkpointed(with_whole_window(records, sequences, F.col("high"), options.flank).withColumn("n_records", F.lit(0.0)))
    return search_rounds(records, sequences, groups, CountSearch, options, **rounds).drop("pi", "alpha", "beta")


def weighed_records(records: DataFrame, seeds: DataFrame, options: MixtureOptions) -> DataFrame:
    """Records with their level, fraction ``x`` and responsibility ``r``.

    The seed fit fixes both components, so the responsibility of a record is the same for every
    candidate: it is computed once, and a candidate's step is a sum over its windows. As upstream, a
    motif has the records of both strands at its forward positions.
    """
    hashed = seeds.count() <= _ENTRIES * parallelism(seeds.sparkSession)  # the weighed records stay sorted: so they are written smaller
    fitted = mixture.em_step(records, seeds, GROUP, penalty=1.0, hashed=hashed).where("alpha is not null and pi > 0 and pi < 1")
    models = fitted.select(*GROUP, "pi", F.col("alpha").alias("ta"), F.col("beta").alias("tb")).join(seeds.select(*GROUP, "fa", "fb", "n"), GROUP)
    x, logged = F.col("x"), mixture.with_log_beta(models)
    lt = F.log("pi") + beta_log_pdf(x, F.col("ta"), F.col("tb"), F.col("lbt"))
    lf = F.log(1 - F.col("pi")) + beta_log_pdf(x, F.col("fa"), F.col("fb"), F.col("lbf")) + F.log(F.lit(options.penalty))
    high = F.coalesce((level_of(F.col("n_mod"), F.col("n_valid_cov"), options.levels) == "High") & (F.col("strand") == "+"), F.lit(False))
    clamped = F.least(F.greatest(frac64(F.col("n_mod"), F.col("n_valid_cov")), F.lit(mixture.CLAMP)), F.lit(1 - mixture.CLAMP))
    with_x = records.select(*GROUP, "position", "strand", high.alias("high"), F.when(F.col("n_valid_cov") > 0, clamped).alias("x"))
    weighed = mixture.with_models(with_x, logged, GROUP).withColumn("r", F.exp(lt - log_sum_exp(lt, lf)))
    return weighed.select(*GROUP, "position", "strand", "high", "x", "r")


def discover_by_mixture(records: DataFrame, sequences: DataFrame, options: MixtureOptions = MixtureOptions(), **rounds) -> DataFrame:
    """The motifs of each contig with the mixture fitted to their records."""
    # what gives the records may be costly, and they are read for the seeds, their fit and the weights
    return found_by_mixture(written(records.select(*GROUP, "position", "strand", "n_mod", "n_valid_cov"), "records"), sequences, options, **rounds)


def found_by_mixture(records: DataFrame, sequences: DataFrame, options: MixtureOptions, **rounds) -> DataFrame:
    """As ``discover_by_mixture``, of records that are written and so may be read several times."""
    seeds = checkpointed(mixture.seed_models(records, GROUP))
    weighed = written(weighed_records(records, seeds, options), "weighed")
    count = F.count("*").cast("double").alias("n_records")
    groups = checkpointed(with_whole_window(weighed, sequences, F.col("high"), options.flank, count).where(F.col("n_records") >= options.min_records))
    found = search_rounds(weighed, sequences, groups, MixtureSearch, options, **rounds)
    false = seeds.select(*GROUP, F.col("fa").alias("false_alpha"), F.col("fb").alias("false_beta"))
    models = (F.col("alpha").alias("true_alpha"), F.col("beta").alias("true_beta"), "false_alpha", "false_beta")
    return found.join(false, GROUP).select(*_named("pi", *models, "score"))
