"""IUPAC base codes as sets of A, C, G and T, and column expressions over sequences of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes and the bases each stands for; the complement of each code.
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN"

MASK = {code: sum(1 << "ACGT".index(b) for b in bases) for code, bases in BASES.items()}
_CODE = {mask: code for code, mask in MASK.items()}


def from_bases(bases) -> str:
    """The code of a non-empty set of codes, each standing for its bases."""
    mask = 0
    for b in bases:
        if b not in MASK:
            raise ValueError(f"no IUPAC base: {b!r}")
        mask |= MASK[b]
    if not mask:
        raise ValueError("an empty set of bases has no code")
    return _CODE[mask]


def join(a: str, b: str) -> str:
    """The code of the union."""
    return from_bases((a, b))


def contains(code: str, base: str) -> bool:
    """Whether a code contains a concrete base (N contains every code; no other ambiguous code is contained)."""
    return code == "N" or (base in "ACGT" and bool(MASK[code] & MASK[base]))


def one_hot(code: str) -> list[float]:
    """Weights of A, C, G and T: equal shares of the bases that the code stands for."""
    return [1.0 / len(BASES[code]) if b in BASES[code] else 0.0 for b in "ACGT"]


def regex(sequence: str) -> str:
    """A pattern of a sequence: one character class per ambiguous code, any character for N."""
    return "".join("." if c == "N" else c if len(BASES[c]) == 1 else f"[{BASES[c]}]" for c in sequence)


def complement(sequence: str) -> str:
    return sequence.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))


# ---- the same on columns ----


def complement_col(sequence: Column) -> Column:
    return F.translate(sequence, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement_col(sequence: Column) -> Column:
    """Reversed complement; characters that are no upper-case code stay as they are."""
    return F.reverse(complement_col(sequence))


def is_iupac_col(sequence: Column) -> Column:
    return sequence.rlike(r"\A[ACGTRYSWKMBDHVN]+\z")


def regex_col(sequence: Column) -> Column:
    """Pattern of each sequence of a column (null where it is not made of codes)."""
    out = F.regexp_replace(sequence, "N", ".")
    for code, bases in BASES.items():
        if 1 < len(bases) < 4:
            # a class holds only A, C, G and T, so codes still to come are never inside one
            out = F.regexp_replace(out, code, f"[{bases}]")
    return F.when(is_iupac_col(sequence), out)
