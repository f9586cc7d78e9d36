"""Modification codes, spellings and their bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pileup codes and the names of the three modifications.
MOD_NAMES = {"a": "6mA", "m": "5mC", "21839": "4mC"}
MOD_SPELLINGS = ("a", "m", "21839", "6mA", "5mC", "4mC")
MOD_BASE = {"6mA": "A", "5mC": "C", "4mC": "C"}
MOD_TYPES = ("6mA", "5mC", "4mC")


def _literal_case(value: Column, pairs: dict[str, str], otherwise: Column | None = None) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(otherwise) if otherwise is not None else out


def canonical_mod_type(value: Column) -> Column:
    """Code or name to the name; anything else (null included) is null."""
    return F.when(value.isin(*MOD_TYPES), value).otherwise(_literal_case(value, MOD_NAMES))


def mod_code(value: Column) -> Column:
    """Name to the pileup code; anything else is null."""
    return _literal_case(value, {v: k for k, v in MOD_NAMES.items()})


def mod_base(value: Column) -> Column:
    """The base a modification sits on; anything else is null."""
    return _literal_case(value, MOD_BASE)
