"""Read-level operators: projections from CIGAR and tags, strands, filters, run duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import Parameters
from strandloom.functions.arrays import has_splice, reference_end, splices
from strandloom.operators.carry import BIN, previous

PAIRED, REVERSE, MATE_UNMAPPED, UNMAPPED, FIRST, SECONDARY = 0x1, 0x10, 0x8, 0x4, 0x40, 0x100


def flag(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) != 0


def project(alignments: DataFrame) -> DataFrame:
    """Alignments (pos, cigar, flag, xs, ts, ...) with rpos, chain, spliced and the strand tag in effect."""
    turned = F.when(flag(REVERSE), F.translate("ts", "+-", "-+")).otherwise(F.col("ts"))
    return alignments.withColumns({
        "rpos": reference_end(F.col("pos"), F.col("cigar")), "chain": splices(F.col("pos"), F.col("cigar")),
        "spliced": has_splice(F.col("cigar")), "xs": F.coalesce("xs", turned),
    })


def library_strand(library: Column) -> Column:
    """+ or - from the flags under FR_FIRST or FR_SECOND; null where the library is unstranded."""
    forward = flag(REVERSE) == (~flag(PAIRED) | flag(FIRST))
    return F.when(library == "FR_FIRST", F.when(forward, "+").otherwise("-")).when(library == "FR_SECOND", F.when(forward, "-").otherwise("+"))


def concordant() -> Column:
    """Mates that point at each other, the leftmost one forward."""
    left = F.col("pos") <= F.col("mpos")
    return flag(PAIRED) & (flag(REVERSE) != (F.col("flag").bitwiseAND(0x20) != 0)) & (flag(REVERSE) != left)


def accepted(reads: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The read filters, all in one predicate that reaches the scan as far as it can be pushed."""
    keep = ~flag(UNMAPPED) & (F.size("cigar") > 0) & (F.size("cigar") <= p.max_num_cigar) & (F.col("qual") >= p.min_mapping_quality)
    keep &= F.abs(F.col("rpos") - F.col("pos")) < p.max_read_span
    keep &= flag(MATE_UNMAPPED) | (F.abs(F.col("pos") - F.col("mpos")) < p.max_read_span)
    if not p.use_second_alignment:
        keep &= ~flag(SECONDARY)
    if p.uniquely_mapped_only:
        keep &= F.col("nh") == 1
    return reads.where(keep)


def drop_runs(reads: DataFrame, keys: list[str], order: list[str], same: list[str], width: int = BIN) -> DataFrame:
    """Reads that do not repeat `same` of the read before them in `order`, which begins with a position."""
    marked = previous(reads, keys, order, {c: f"_p{k}" for k, c in enumerate(same)}, width, "_there")
    equal = F.col("_there")
    for k, c in enumerate(same):
        equal &= F.col(f"_p{k}").eqNullSafe(F.col(c))
    return marked.where(~equal).drop("_there", *(f"_p{k}" for k in range(len(same))))


def routed(reads: DataFrame) -> DataFrame:
    """Reads by bundle strand: their own, else their tag; unspliced reads with neither go to both strands."""
    own = F.coalesce("strand", "xs")
    both = F.array(F.lit("+"), F.lit("-"))
    return reads.where(F.col("strand").isNull() | F.col("xs").isNull() | (F.col("strand") == F.col("xs"))).withColumn(
        "bundle_strand", F.explode(F.when(own.isNotNull(), F.array(own)).when(~F.col("spliced"), both).otherwise(F.array(F.lit("."))))
    )
