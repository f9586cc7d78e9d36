"""Joining rows with one row per key, where a key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000
ROWS_PER_SALT = 1_000_000


def with_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], count: str, hot_share: int = HOT_SHARE, per_salt: int = ROWS_PER_SALT, hashed: bool = False) -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has one row per key and in ``count`` how many rows the key has.

    Keys of at least 1/``hot_share`` of all rows are at most ``hot_share``, so their entries are
    broadcast. The rows of other keys meet their entry by (key, salt), with as many salts as keep the
    rows of one key and salt at about ``per_salt``. Rows without an entry are left out. ``hashed``: the entries
    of a task fit into its memory, so the rows need no sort.
    """
    total = lookup.agg(F.sum(count)).scalar()
    hot = lookup.where(F.col(count) * hot_share >= total)
    few = F.broadcast(hot.drop(count))
    salts = F.greatest(F.ceil(total / (hot_share * per_salt)).cast("int"), F.lit(1))
    copies = lookup.where(F.col(count) * hot_share < total).drop(count).withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    copies = copies.hint("shuffle_hash") if hashed else copies
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*(f"`{c}`" for c in rows.columns)), salts).cast("int"))
    return rows.join(few, list(keys)).unionByName(salted.join(copies, [*keys, "__salt"]).drop("__salt"))
