"""Motifs: an IUPAC sequence, the modification and the position it sits at."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from methyloom.functions import iupac
from methyloom.functions.modcodes import MOD_BASE, MOD_NAMES, mod_base


@dataclass(frozen=True)
class Motif:
    """Validated: known codes, a known modification, a position inside that holds the modified base."""

    sequence: str
    mod_type: str
    position: int

    def __post_init__(self):
        object.__setattr__(self, "mod_type", MOD_NAMES.get(self.mod_type, self.mod_type))
        if not self.sequence or any(c not in iupac.BASES for c in self.sequence):
            raise ValueError(f"no IUPAC sequence: {self.sequence!r}")
        if self.mod_type not in MOD_BASE:
            raise ValueError(f"unknown modification: {self.mod_type!r}")
        if not 0 <= self.position < len(self.sequence):
            raise ValueError("the modified position lies outside the motif")
        if self.sequence[self.position] != MOD_BASE[self.mod_type]:
            raise ValueError("the base at the modified position does not carry the modification")

    @property
    def pretty(self) -> str:
        return self.sequence[: self.position] + self.mod_type + self.sequence[self.position + 1 :]

    @property
    def underscored(self) -> str:
        return f"{self.sequence}_{self.mod_type}_{self.position}"

    @property
    def dashed(self) -> str:
        return f"{self.sequence}-{self.mod_type}-{self.position}"

    @property
    def regex(self) -> str:
        return iupac.regex(self.sequence)

    def complement(self) -> ComplementMotif:
        return ComplementMotif(iupac.complement(self.sequence)[::-1], self.mod_type, len(self.sequence) - 1 - self.position)

    def grown(self, at: int, bases: Iterable[str]) -> tuple[str, int]:
        """(sequence, position) grown by a set of bases at an index, which may lie outside."""
        return grow(self.sequence, self.position, at, bases)


@dataclass(frozen=True)
class ComplementMotif:
    """A motif as it reads on the other strand: its position holds the complement of the modified base."""

    sequence: str
    mod_type: str
    position: int

    def __post_init__(self):
        if not 0 <= self.position < len(self.sequence):
            raise ValueError("the modified position lies outside the motif")
        if iupac.complement(self.sequence[self.position]) != MOD_BASE[self.mod_type]:
            raise ValueError("the base at the modified position is not the complement of the modified one")


@dataclass(frozen=True)
class MotifPair:
    """A motif and its reverse partner, which must have equal length and be its reverse complement."""

    forward: Motif
    reverse: Motif

    def __post_init__(self):
        if len(self.forward.sequence) != len(self.reverse.sequence):
            raise ValueError("the motifs of a pair have equal length")
        if self.forward.complement().sequence != self.reverse.sequence:
            raise ValueError("the motifs of a pair are reverse complements")

    @property
    def palindrome(self) -> bool:
        return self.forward == self.reverse


def grow(sequence: str, position: int, at: int, bases: Iterable[str]) -> tuple[str, int]:
    """Before or behind the motif the gap fills with N; inside, the set joins what is there."""
    code = iupac.from_bases(bases)
    if at < 0:
        return code + "N" * (-at - 1) + sequence, position - at
    if at >= len(sequence):
        return sequence + "N" * (at - len(sequence)) + code, position
    return sequence[:at] + iupac.join(sequence[at], code) + sequence[at + 1 :], position


def subsets(bases: Iterable[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets, small ones first, each in the given order."""
    items = tuple(bases)
    return [c for n in range(1, len(items) + 1) for c in combinations(items, n)]


def overlaps_itself(sequence: str) -> bool:
    """Whether two matches of the sequence can overlap."""
    masks = [iupac.MASK[c] for c in sequence]
    return any(all(a & b for a, b in zip(masks[s:], masks, strict=False)) for s in range(1, len(masks)))


# ---- the same on columns ----


def overlaps_itself_col(sequence: Column) -> Column:
    """What ``overlaps_itself`` tells: whether some shift of the sequence is compatible with it at every base."""
    mask = F.create_map(*[F.lit(x) for pair in iupac.MASK.items() for x in pair])
    masks = F.transform(F.split(sequence, "(?!$)"), lambda c: mask[c])
    shifts = F.sequence(F.lit(1), F.greatest(F.length(sequence) - 1, F.lit(1)))

    def fits(by: Column) -> Column:
        moved = F.slice(masks, by + 1, F.greatest(F.length(sequence) - by, F.lit(0)))
        return F.forall(F.arrays_zip(moved.alias("a"), F.slice(masks, F.lit(1), F.length(sequence) - by).alias("b")), lambda z: z["a"].bitwiseAND(z["b"]) != 0)

    return (F.length(sequence) > 1) & F.exists(shifts, fits)


def is_valid_col(sequence: Column, mod_type: Column, position: Column) -> Column:
    """What ``Motif`` checks; false for nulls."""
    inside = (position >= 0) & (position < F.length(sequence))
    base = F.substr(sequence, position + 1, F.lit(1)) == mod_base(mod_type)
    return F.coalesce(iupac.is_iupac_col(sequence) & inside & base, F.lit(False))


def pretty_col(sequence: Column, mod_type: Column, position: Column) -> Column:
    return F.concat(F.substr(sequence, F.lit(1), position), mod_type, F.substr(sequence, position + 2, F.length(sequence)))


def complement_position_col(sequence: Column, position: Column) -> Column:
    return F.length(sequence) - 1 - position
