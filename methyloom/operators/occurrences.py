"""Where motifs occur in sequences, on both strands, and the records that lie there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methyloom.functions.iupac import MASK, reverse_complement_col
from methyloom.functions.motif import complement_position_col, overlaps_itself, overlaps_itself_col
from methyloom.session import parallelism

MOTIF = ["motif_seq", "mod_type", "mod_position"]
_CONCRETE = np.zeros(256, np.uint8)
for _base in "ACGT":
    _CONCRETE[ord(_base)] = MASK[_base]
_BLOCK = 1 << 20


def match_starts(sequence: np.ndarray, pattern: str, overlapping: bool) -> np.ndarray:
    """Starts of a pattern in a sequence of base masks: all, or leftmost without overlap.

    N matches any character; other codes match their upper-case concrete bases only.
    """
    masks, width, found = [MASK[c] for c in pattern], len(pattern), []
    for begin in range(0, len(sequence) - width + 1, _BLOCK):  # blocks keep the temporaries small
        n = min(_BLOCK, len(sequence) - width + 1 - begin)
        hit = np.ones(n, bool)
        for j, mask in enumerate(masks):
            if mask != 15:
                hit &= (sequence[begin + j : begin + j + n] & mask) != 0
        found.append(np.flatnonzero(hit) + begin)
    starts = np.concatenate(found) if found else np.empty(0, np.int64)
    if overlapping or len(starts) < 2 or not overlaps_itself(pattern) or np.diff(starts).min() >= width:
        return starts
    kept, free = [], 0
    for s in starts.tolist():
        if s >= free:
            kept.append(s)
            free = s + width
    return np.array(kept, np.int64)


def both_strands(motifs: DataFrame) -> DataFrame:
    """Each motif as the pattern and anchor to look for on the plus and on the minus strand."""
    seq, pos = F.col("motif_seq"), F.col("mod_position")
    plus = F.struct(F.lit("+").alias("strand"), seq.alias("pattern"), pos.alias("anchor"))
    minus = F.struct(F.lit("-").alias("strand"), reverse_complement_col(seq).alias("pattern"), complement_position_col(seq, pos).alias("anchor"))
    return motifs.select("*", F.explode(F.array(plus, minus)).alias("s")).select(*motifs.columns, "s.*")


PIECE = 1 << 20


def _starts(bases: np.ndarray, pattern: str, overlapping: bool, n: int) -> np.ndarray:
    """Starts below ``n``: all, or leftmost without overlap."""
    return match_starts(bases[: n + len(pattern) - 1], pattern, overlapping)


def _match(overlapping: bool):
    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            parts = []
            for i, (seq, patterns) in enumerate(zip(get("text"), get("patterns"), strict=True)):
                bases = _CONCRETE[np.frombuffer(seq.as_buffer(), np.uint8)]
                first, n = get("first")[i].as_py(), get("n")[i].as_py()
                parts += [(i, p, s + first) for p in patterns.as_py() if len(s := _starts(bases, p["pattern"], overlapping, n))]
            lengths = [len(s) for _, _, s in parts]
            rows = pa.array(np.repeat([i for i, _, _ in parts], lengths).astype(np.int64))
            starts = np.concatenate([s for _, _, s in parts]) if parts else np.empty(0, np.int64)
            of = pa.array(np.repeat(np.arange(len(parts)), lengths))
            column = lambda name, kind: pa.array([p[name] for _, p, _ in parts], kind).take(of)  # noqa: B023, E731
            anchors = column("anchor", pa.int64()).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    get("contig_id").take(rows),
                    *(column(n, pa.int32() if n == "mod_position" else pa.string()) for n in [*MOTIF, "strand"]),
                    pa.array(starts),
                    pa.array(starts + anchors),
                ],
                names=["contig_id", *MOTIF, "strand", "start", "position"],
            )

    return run


def occurrences(sequences: DataFrame, motifs: DataFrame, overlapping: bool = False, piece: int = PIECE) -> DataFrame:
    """(contig_id, motif, strand, start, position) of each match of a contig's motifs.

    ``motifs`` has a contig_id. Sequences are matched in pieces of ``piece`` bases and as many more as
    the longest motif needs, so one long contig is many rows. Patterns that can overlap themselves must
    be told apart from the left end of the contig when overlaps are not wanted: these alone are matched
    on whole contigs. A contig without sequence, or shorter than a motif, has no match.
    """
    wanted = ["strand", "pattern", "anchor", *MOTIF]
    stranded = both_strands(motifs.select("contig_id", *MOTIF))
    known = sequences.where("seq is not null").select("contig_id", "seq", F.length("seq").cast("long").alias("length"))
    schema = "contig_id string, motif_seq string, mod_type string, mod_position int, strand string, start long, position long"

    def matched(own: DataFrame, whole: bool) -> DataFrame:
        patterns = own.groupBy("contig_id").agg(F.collect_set(F.struct(*wanted)).alias("patterns"), F.max(F.length("pattern")).alias("longest"))
        rows = known.join(patterns, "contig_id")
        if whole:
            cut = rows.select("contig_id", "patterns", F.lit(0).cast("long").alias("first"), F.col("length").alias("n"), F.col("seq").alias("text"))
        else:
            first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(piece).cast("long"))).alias("first")
            text = F.substr(F.col("seq"), (F.col("first") + 1).cast("int"), F.lit(piece) + F.col("longest") - 1)
            cut = rows.select("*", first).select("contig_id", "patterns", "first", F.lit(piece).cast("long").alias("n"), text.alias("text"))
        # a piece is small, but to match it is not: pieces are dealt to all tasks
        return cut.repartition(4 * parallelism(sequences.sparkSession), "contig_id", "first").mapInArrow(_match(overlapping), schema)

    if overlapping:
        return matched(stranded, False)
    again = overlaps_itself_col(F.col("pattern"))
    return matched(stranded.where(~again), False).unionByName(matched(stranded.where(again), True))


def records_of_motifs(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records that lie at a modified position of a motif of their contig, strand and modification."""
    at = found.select("contig_id", "mod_type", "strand", "position").distinct()
    return records.join(at, at.columns, "left_semi")


def _forward_positions(found: DataFrame) -> DataFrame:
    return found.where("strand = '+'").select("contig_id", "mod_type", "position").distinct()


def records_at_forward_positions(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records of either strand at the forward modified positions of a motif."""
    at = _forward_positions(found)
    return records.join(at, at.columns, "left_semi")


def records_off_forward_positions(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records that ``records_at_forward_positions`` leaves."""
    at = _forward_positions(found)
    return records.join(at, at.columns, "left_anti")


def level_counts(leveled: DataFrame, found: DataFrame) -> DataFrame:
    """(contig_id, motif, low, middle, high): records with a level at each motif's positions."""
    joined = found.join(leveled, ["contig_id", "mod_type", "strand", "position"])
    count = lambda name: F.count(F.when(F.col("level") == name, 1)).alias(f"{name.lower()}_count")
    return joined.groupBy("contig_id", *MOTIF).agg(count("Low"), count("Middle"), count("High"))
