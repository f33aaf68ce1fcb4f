"""Column functions over chains: sorted arrays of positions, and CIGAR arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSUMES = ("M", "D", "N", "=", "X")


def reference_end(pos: Column, cigar: Column) -> Column:
    """Where an alignment ends: its start plus what its operations consume of the reference."""
    return pos + F.aggregate(cigar, F.lit(0), lambda acc, x: acc + F.when(x["op"].isin(*CONSUMES), x["len"]).otherwise(0))


def splices(pos: Column, cigar: Column) -> Column:
    """[donor, acceptor, ...] of the skips that are neither the first nor the last operation."""
    n = F.size(cigar)
    start = F.struct(pos.cast("int").alias("p"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["p"] + F.when(x["op"].isin(*CONSUMES), x["len"]).otherwise(0)
        inner = (x["op"] == "N") & (acc["k"] > 0) & (acc["k"] < n - 1)
        return F.struct(end.cast("int").alias("p"), (acc["k"] + 1).alias("k"), F.when(inner, F.concat(acc["out"], F.array(acc["p"], end.cast("int")))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar, start, step, lambda acc: acc["out"])


def match_blocks(pos: Column, cigar: Column) -> Column:
    """array<struct<start, end>> of the aligned operations (M, = and X)."""
    start = F.struct(pos.cast("int").alias("p"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = (acc["p"] + F.when(x["op"].isin(*CONSUMES), x["len"]).otherwise(0)).cast("int")
        block = F.array(F.struct(acc["p"].alias("start"), end.alias("end")))
        return F.struct(end.alias("p"), F.when(x["op"].isin("M", "=", "X"), F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar, start, step, lambda acc: acc["out"])


def has_splice(cigar: Column) -> Column:
    return F.exists(cigar, lambda x: x["op"] == "N")


def increasing(a: Column) -> Column:
    """Whether each element exceeds the one before it."""
    n = F.size(a)
    return (n < 2) | F.forall(F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: x < y), lambda ok: ok)


def pairs(a: Column) -> Column:
    """[x0, x1, x2, ...] as array<struct<l, r>> of neighbours."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def introns(chain: Column) -> Column:
    """[d0, a0, d1, a1, ...] as array<struct<l, r>>; an empty array for an empty chain, a last odd element is left out."""
    n = F.floor(F.size(chain) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(chain[2 * i].alias("l"), chain[2 * i + 1].alias("r")))


def intron_length(chain: Column) -> Column:
    return F.when(F.size(chain) > 1, F.aggregate(introns(chain), F.lit(0).cast("long"), lambda acc, x: acc + (x["r"] - x["l"]))).otherwise(F.lit(0).cast("long"))


def intron_chain(exons: Column) -> Column:
    """The inner ends and starts of sorted exons (start, end), flat."""
    n = F.size(exons) - 1
    return F.when(n > 0, F.flatten(F.zip_with(F.slice(exons, 1, F.greatest(n, F.lit(0))), F.slice(exons, 2, F.greatest(n, F.lit(0))), lambda x, y: F.array(x["end"], y["start"])))).otherwise(F.array().cast("array<int>"))


def joined(intervals: Column) -> Column:
    """The unions of sorted intervals (start, end) that overlap or touch; those without a start count only where there is no other."""
    begun = F.struct(F.lit(None).cast("int").alias("reach"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    piece = lambda start, end: F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))

    def step(acc: Column, x: Column) -> Column:
        n, last = F.size(acc["out"]), F.element_at(acc["out"], -1)
        longer = F.concat(F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0))), piece(last["start"], F.greatest(last["end"], x["end"])))
        out = F.when((n == 0) | (x["start"] > acc["reach"]), F.concat(acc["out"], piece(x["start"], x["end"]))).otherwise(longer)
        return F.struct(F.greatest(acc["reach"], x["end"]).cast("int").alias("reach"), out.alias("out"))

    placed = F.filter(intervals, lambda x: x["start"].isNotNull())
    return F.aggregate(F.when(F.size(placed) > 0, placed).otherwise(F.slice(intervals, 1, 1)), begun, step, lambda acc: acc["out"])


def exons_of(chain: Column, start: Column, end: Column) -> Column:
    """The exons that a chain leaves between start and end."""
    j = introns(chain)
    starts, ends = F.concat(F.array(start), F.transform(j, lambda x: x["r"])), F.concat(F.transform(j, lambda x: x["l"]), F.array(end))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def exon_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))


def consecutive_offsets(whole: Column, part: Column) -> Column:
    """0-based places where `part` lies in `whole` without gaps."""
    last = F.size(whole) - F.size(part)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(whole, i + 1, F.size(part)) == part)).otherwise(F.array().cast("array<int>"))


def merged_chain(a: Column, b: Column) -> Column:
    """The union of two sorted chains that agree where they overlap; null where they conflict.

    Agreement: the elements of each that lie in the span of the other are the same, an even number of them.
    """
    low, high = F.greatest(F.array_min(a), F.array_min(b)), F.least(F.array_max(a), F.array_max(b))
    inside = lambda x: F.filter(x, lambda v: (v >= low) & (v <= high))
    agree = (low > high) | ((inside(a) == inside(b)) & (F.size(inside(a)) % 2 == 0))
    union = F.array_sort(F.array_union(a, b))
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(agree, union)


def slices_equal(a: Column, a0: int, b: Column, b0: int, n: int) -> Column:
    """Whether `n` elements of `a` from place a0 (from 0) are those of `b` from b0; false where either has fewer."""
    return (F.size(a) >= a0 + n) & (F.size(b) >= b0 + n) & (F.slice(a, a0 + 1, n) == F.slice(b, b0 + 1, n))


def argmax(a: Column) -> Column:
    """The place (from 0) of the first largest element; -1 for an empty array."""
    return F.coalesce(F.array_position(a, F.array_max(a)) - 1, F.lit(-1)).cast("int")


def argmin(a: Column) -> Column:
    return F.coalesce(F.array_position(a, F.array_min(a)) - 1, F.lit(-1)).cast("int")


def mapped(a: Column, to: Column) -> Column:
    """Each element looked up in the map `to`; null where it is not there."""
    return F.transform(a, lambda x: F.try_element_at(to, x))


def renumbered(a: Column) -> Column:
    """Each element's dense rank (from 0) among the distinct ones."""
    every = F.array_sort(F.array_distinct(a))
    return F.transform(a, lambda x: (F.array_position(every, x) - 1).cast("int"))


def overlap_of(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The length two intervals share; below 0 it is how far they lie apart."""
    return F.least(end, other_end) - F.greatest(start, other_start)


def split_at(exons: Column, width: int) -> Column:
    """Exons (start, end) cut at every multiple of `width`."""
    def cut(x: Column) -> Column:
        first, last = F.floor(x["start"] / width).cast("int"), F.floor((x["end"] - 1) / width).cast("int")
        return F.transform(F.sequence(first, last), lambda k: F.struct(F.greatest(x["start"], k * width).cast("int").alias("start"), F.least(x["end"], (k + 1) * width).cast("int").alias("end")))

    return F.flatten(F.transform(exons, cut))


def shrunk(exons: Column) -> Column:
    """Sorted exons, those that abut merged."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        alone = F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.when((n > 0) & (last["end"] == x["start"]), grown).otherwise(alone).cast(kind)

    return F.aggregate(exons, F.array().cast(kind), step)


def first_intron(exons: Column) -> Column:
    return F.when(F.size(exons) > 1, F.struct(exons[0]["end"].alias("l"), exons[1]["start"].alias("r")))


def chain_key(exons: Column, bucket: int = 10_000) -> Column:
    """What transcripts are grouped by: the intron chain, or for one exon the bucket of its middle, as text."""
    flat = F.array_join(F.transform(intron_chain(exons), lambda x: x.cast("string")), "-")
    return F.when(F.size(exons) > 1, flat).otherwise(F.concat(F.lit("@"), F.floor((exons[0]["start"] + F.element_at(exons, -1)["end"]) / bucket).cast("string")))


def label(seqname: Column, exons: Column) -> Column:
    """chr:start-end, as files write it."""
    return F.concat_ws("", seqname, F.lit(":"), exons[0]["start"].cast("string"), F.lit("-"), F.element_at(exons, -1)["end"].cast("string"))


RELATIONS = ("identical", "apart_left", "apart_right", "contains", "contained", "extends_left", "extends_right", "nested", "nesting", "conflicting")


def relation(a: Column, b: Column) -> Column:
    """How two sorted sequences lie to each other, one of RELATIONS; every sequence contains an empty one."""
    a0, a1, b0, b1 = F.array_min(a), F.array_max(a), F.array_min(b), F.array_max(b)
    low, high = F.greatest(a0, b0), F.least(a1, b1)
    inside = lambda x: F.filter(x, lambda v: (v >= low) & (v <= high))
    same = inside(a) == inside(b)
    name = {k: F.lit(k) for k in RELATIONS}
    return (
        F.when(a == b, name["identical"]).when(F.size(b) == 0, name["contains"]).when(F.size(a) == 0, name["contained"]).when(a1 < b0, name["apart_left"]).when(b1 < a0, name["apart_right"])
        .when(same & (a0 <= b0) & (b1 <= a1), name["contains"]).when(same & (b0 <= a0) & (a1 <= b1), name["contained"])
        .when(same & (a0 < b0), name["extends_left"]).when(same & (b0 < a0), name["extends_right"])
        .when((F.size(inside(b)) == 0) & (b0 < a0) & (a1 < b1), name["nested"]).when((F.size(inside(a)) == 0) & (a0 < b0) & (b1 < a1), name["nesting"])
        .otherwise(name["conflicting"])
    )
