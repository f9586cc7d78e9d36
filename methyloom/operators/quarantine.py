"""Rows that fail to parse: valid rows load, the others come out with their reasons.

The parsed cells of each line are exploded into (row, column, value), joined with a small rule
table, validated, and the errors aggregated per row; the clean rows are what an anti-join with the
errors leaves. Everything stays in JVM expressions; only failing cells are shuffled.

Defined results
  * a null line is a case (``missing_line``); an empty line has one field, hence a wrong count;
  * fields are counted only where the quoting is sound, and cell rules apply only to lines with the
    right number of fields, because columns shift otherwise;
  * a line is judged by its text: rows that share a key (a null key included) are judged one by one,
    so a failing row never takes a sound one with it; copies of a failing row are reported once per key;
  * other columns of the input are kept whatever they are called (internal names are reserved by
    the prefix ``__q_``); an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.functions.modcodes import MOD_SPELLINGS, canonical_mod_type

FIELD_COUNT = -1
QUOTING = -2


@dataclass(frozen=True)
class Rule:
    """One validation of one column: ``kind`` is ``in`` (allowed values) or ``uint`` (digits, bounded)."""

    column: int
    reason: str
    kind: str
    allowed: tuple[str, ...] = ()
    maximum: int | None = None


PILEUP_FIELDS = 18
INT_MAX = 2147483647
PILEUP_RULES = (
    Rule(1, "invalid_position", "uint", maximum=INT_MAX),
    Rule(3, "invalid_mod_type", "in", allowed=tuple(MOD_SPELLINGS)),
    Rule(5, "invalid_strand", "in", allowed=("+", "-")),
    Rule(11, "invalid_n_mod", "uint", maximum=INT_MAX),
)


def rule_table(spark: SparkSession, rules: Sequence[Rule], n_fields: int) -> DataFrame:
    """The rules as a table, with the two rules on the shape of a line added."""
    shape = (
        Rule(FIELD_COUNT, "wrong_field_count", "in", allowed=(str(n_fields),)),
        Rule(QUOTING, "broken_quoting", "in", allowed=("ok", "missing")),
        Rule(QUOTING, "missing_line", "in", allowed=("ok", "broken")),
    )
    rows = [(r.column, r.reason, r.kind, list(r.allowed), r.maximum) for r in (*shape, *rules)]
    return spark.createDataFrame(
        rows, "`__q_column` int, reason string, kind string, allowed array<string>, maximum long"
    )


# Pieces between tabs are gathered into fields: a field that begins with a quote runs to the piece
# at which the number of quotes seen in it becomes even. Spans keep the first ``n_fields`` fields,
# ``sound`` tells of all of them.
_SPANS = """
aggregate(__q_pieces,
  named_struct('n', 0, 'i', 0, 'first', 0, 'quotes', 0, 'sound', true, 'spans', cast(array() as array<struct<a:int,b:int>>)),
  (s, p) -> named_struct(
    'n', s.n + if({closed}, 1, 0),
    'i', s.i + 1,
    'first', if({closed}, s.i + 1, s.first),
    'quotes', if({closed}, 0, {quotes}),
    'sound', s.sound and if({closed} and (s.quotes > 0 or startswith(p, '"')), {sound}, true),
    'spans', if({closed} and s.n < {n_fields},
                concat(s.spans, array(named_struct('a', s.first, 'b', s.i))), s.spans)))
"""
_QUOTES = "if(s.quotes > 0 or startswith(p, '\"'), s.quotes + length(p) - length(replace(p, '\"', '')), 0)"


def parsed(lines: DataFrame, line: str, n_fields: int) -> DataFrame:
    """``lines`` with ``__q_fields`` (the first fields, unquoted), ``__q_n`` (their number) and ``__q_quoting``.

    A line without a quote is split at tabs. Otherwise fields that begin with a quote are put
    together again; such a field is sound if it ends in a quote and holds only doubled ones inside.
    """
    closed = f"({_QUOTES}) % 2 = 0"
    inner = "replace(substring({f}, 2, length({f}) - 2), '\"\"', '{to}')"
    whole = "array_join(slice(__q_pieces, s.first + 1, s.i - s.first + 1), '\t')"
    sound = f"(length({whole}) >= 2 and endswith({whole}, '\"') and not contains({inner.format(f=whole, to='')}, '\"'))"
    spans = _SPANS.format(closed=closed, quotes=_QUOTES, sound=sound, n_fields=n_fields)
    split = lines.withColumn("__q_pieces", F.split(F.col(line), "\t", -1))
    quoted = F.contains(F.col(line), F.lit('"'))
    scanned = split.withColumn("__q_scan", F.when(quoted, F.expr(spans)))
    raw = "transform(__q_scan.spans, s -> array_join(slice(__q_pieces, s.a + 1, s.b - s.a + 1), '\t'))"
    with_raw = scanned.withColumn("__q_raw", F.expr(raw))
    return with_raw.select(
        *(F.col(f"`{c}`") for c in lines.columns),
        F.coalesce(F.col("__q_scan.n"), F.size("__q_pieces")).alias("__q_n"),
        F.when(F.col(line).isNull(), "missing")
        .when(~quoted, "ok")
        .when(
            (F.col("__q_scan.quotes") == 0) & F.col("__q_scan.sound"),
            "ok",
        )
        .otherwise("broken")
        .alias("__q_quoting"),
        F.when(
            quoted,
            F.expr(f"transform(__q_raw, f -> if(startswith(f, '\"'), {inner.format(f='f', to=chr(34))}, f))"),
        )
        .otherwise(F.col("__q_pieces"))
        .alias("__q_fields"),
    )


def cells(lines: DataFrame, key: str, line: str, rules: Sequence[Rule], n_fields: int) -> DataFrame:
    """(row, column, value): of a sound line the cells that rules name, of another the cell that tells why not."""
    columns = sorted({r.column for r in rules})
    cell = lambda c, v: F.struct(F.lit(c).alias("c"), v.alias("v"))
    ruled = F.array(*[cell(c, F.get("__q_fields", F.lit(c))) for c in columns])
    shown = (
        F.when(F.col("__q_quoting") != "ok", F.array(cell(QUOTING, F.col("__q_quoting"))))
        .when(F.col("__q_n") != n_fields, F.array(cell(FIELD_COUNT, F.col("__q_n").cast("string"))))
        .otherwise(ruled)
    )
    return (
        parsed(lines.select(key, line), line, n_fields)
        .select(key, F.col(f"`{line}`").alias("__q_line"), F.explode(shown).alias("__q_cell"))
        .select(key, "__q_line", F.col("__q_cell.c").alias("__q_column"), F.col("__q_cell.v").alias("__q_value"))
    )


def cell_errors(lines: DataFrame, key: str, line: str, rules: Sequence[Rule] = PILEUP_RULES, n_fields: int = PILEUP_FIELDS) -> DataFrame:
    """(key, column, value, reason) of each cell that breaks a rule."""
    value = F.col("__q_value")
    in_range = F.expr("try_cast(__q_value as bigint)") <= F.col("maximum")
    sound = F.when(F.col("kind") == "in", F.array_contains("allowed", value)).otherwise(
        value.rlike(r"\A[0-9]+\z") & in_range
    )
    small = F.broadcast(rule_table(lines.sparkSession, rules, n_fields))  # a fixed handful of rules
    return (
        cells(lines, key, line, rules, n_fields)
        .join(small, "__q_column")
        .where(~F.coalesce(sound, F.lit(False)))
        .select(key, "__q_line", F.col("__q_column").alias("column"), F.col("__q_value").alias("value"), "reason")
    )


def row_errors(lines: DataFrame, key: str, line: str, rules: Sequence[Rule] = PILEUP_RULES, n_fields: int = PILEUP_FIELDS) -> DataFrame:
    """One row per failing line: its key and its sorted, distinct reasons."""
    return _errors_with_line(lines, key, line, rules, n_fields).drop("__q_line")


def _errors_with_line(lines: DataFrame, key: str, line: str, rules: Sequence[Rule] = PILEUP_RULES, n_fields: int = PILEUP_FIELDS) -> DataFrame:
    reasons = F.sort_array(F.collect_set("reason")).alias("reasons")
    return cell_errors(lines, key, line, rules, n_fields).groupBy(key, "__q_line").agg(reasons)


def clean_rows(lines: DataFrame, errors: DataFrame, key: str, line: str) -> DataFrame:
    """The rows that no error names (an anti-join on key and text; nulls match nulls)."""
    bad = errors.select(F.col(key).alias("__q_key"), "__q_line")
    return lines.join(bad, lines[key].eqNullSafe(bad["__q_key"]) & lines[line].eqNullSafe(bad["__q_line"]), "left_anti")


def pileup_records(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """Typed pileup records of sound lines; free numeric fields that are not integers become null."""
    get = lambda i: F.get("__q_fields", F.lit(i))
    free = lambda i: F.expr(f"try_cast(get(__q_fields, {i}) as int)")
    kept = [c for c in lines.columns if c != line and c not in _RECORD]
    return parsed(lines, line, PILEUP_FIELDS).select(
        *(F.col(f"`{c}`") for c in kept),
        get(0).alias("contig_id"),
        free(1).alias("position"),
        get(5).alias("strand"),
        canonical_mod_type(get(3)).alias("mod_type"),
        free(11).alias("n_mod"),
        free(9).alias("n_valid_cov"),
        free(12).alias("n_canonical"),
        free(16).alias("n_diff"),
    )


_RECORD = {"contig_id", "position", "strand", "mod_type", "n_mod", "n_valid_cov", "n_canonical", "n_diff"}


def load_pileup(lines: DataFrame, key: str = "line_id", line: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(typed records of the sound lines, key and reasons of the others)."""
    errors = _errors_with_line(lines, key, line)
    return pileup_records(clean_rows(lines, errors, key, line), line), errors.drop("__q_line")
