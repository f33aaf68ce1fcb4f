"""Splice graphs from reads, as tables: typed regions, partial exons, vertices, edges, and the paths of reads over them.

A graph is known by its `keys`. Vertices are numbered from 1 in order of position within it; 0 is the source and the number
after the last the sink. Reads only come in as depth pieces, junction counts and chains; what is ordered within a graph is its
breakpoints and exons, never its reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import Parameters
from strandloom.functions.arrays import introns
from strandloom.operators.intervals import BIN, containing, overlapping
from strandloom.scratch import stored

START, LEFT, RIGHT, END = "start", "left", "right", "end"


def regions(bounds: DataFrame, junctions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, ltype, rtype): what lies between consecutive bounds and splice sites.

    Types are START or END at the graph's bounds (start, end); else RIGHT where an intron ends and LEFT where one begins. A
    site that is both opens a region as RIGHT and closes one as LEFT.
    """
    points = bounds.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(START).alias("t")), F.struct(F.col("end").alias("p"), F.lit(END).alias("t")))).alias("x"))
    sites = junctions.select(*keys, F.explode(F.array(F.struct(F.col("l").alias("p"), F.lit(LEFT).alias("t")), F.struct(F.col("r").alias("p"), F.lit(RIGHT).alias("t")))).alias("x"))
    every = points.unionByName(sites).select(*keys, "x.p", "x.t").groupBy(*keys, "p").agg(F.collect_set("t").alias("ts"))
    kind = lambda *order: F.coalesce(*(F.when(F.array_contains("ts", t), F.lit(t)) for t in order))
    typed = every.select(*keys, "p", kind(START, END, RIGHT, LEFT).alias("opens"), kind(START, END, LEFT, RIGHT).alias("closes"))
    w = Window.partitionBy(*keys).orderBy("p")
    return typed.select(*keys, F.col("p").alias("start"), F.lead("p").over(w).alias("end"), F.col("opens").alias("ltype"), F.lead("closes").over(w).alias("rtype")).where(F.col("end").isNotNull())


def partial_exons(regions: DataFrame, depth: DataFrame, keys: list[str], p: Parameters = Parameters(), width: int = BIN) -> DataFrame:
    """(keys, vid, start, end, ltype, rtype, ave, dev, max): the covered parts of regions, from depth pieces (start, end, depth).

    Between two splice sites gaps of at most `min_subregion_gap` are closed. A region covered whole is one exon; else its
    islands of enough length and depth are, those at a splice site always, and a splice site without cover gets a stub of one position.
    """
    whole = [*keys, "start", "end", "ltype", "rtype"]
    smooth = (F.col("ltype") == RIGHT) & (F.col("rtype") == LEFT)
    gap = F.when(smooth, F.lit(p.min_subregion_gap)).otherwise(F.lit(0))
    met = overlapping(regions, depth.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "depth"), keys, width)
    pieces = met.select(*whole, F.greatest("start", "r_start").alias("a"), F.least("end", "r_end").alias("b"), "depth")
    order = Window.partitionBy(*keys, "start").orderBy("a")
    new = F.coalesce((F.col("a") - F.lag("b").over(order) > gap).cast("int"), F.lit(0))
    marked = pieces.withColumn("_new", new).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    length = F.col("b") - F.col("a")
    islands = marked.groupBy(*whole, "_i").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.sum(length).alias("cover"), F.sum(length * F.col("depth")).alias("area"), F.sum(length * F.col("depth") * F.col("depth")).alias("square"), F.max("depth").alias("max"),
    ).drop("_i")
    islands = islands.withColumns({"a": F.when(F.col("a") - F.col("start") <= gap, F.col("start")).otherwise(F.col("a")), "b": F.when(F.col("end") - F.col("b") <= gap, F.col("end")).otherwise(F.col("b"))})
    islands = stored(islands, "covered")
    bare = regions.join(islands.select(*keys, "start").distinct(), [*keys, "start"], "left_anti")
    closed = bare.where(smooth & (F.col("end") - F.col("start") <= p.min_subregion_gap)).select(*whole, F.col("start").alias("a"), F.col("end").alias("b"), *(F.lit(0).cast("long").alias(c) for c in ("cover", "area", "square", "max")))
    islands = stored(islands.unionByName(closed), "islands")  # read four times below
    ave = F.col("area") / (F.col("b") - F.col("a"))
    full = (F.col("a") == F.col("start")) & (F.col("b") == F.col("end"))
    spliced = ((F.col("a") == F.col("start")) & (F.col("ltype") == RIGHT)) | ((F.col("b") == F.col("end")) & (F.col("rtype") == LEFT))
    kept = islands.where(full | spliced | ((F.col("b") - F.col("a") >= p.min_subregion_length) & (ave >= p.min_subregion_overlap)))
    var = F.col("square") - 2 * ave * F.col("area") + ave * ave * F.col("cover")
    exons = kept.select(
        *keys, F.col("a").alias("start"), F.col("b").alias("end"), F.when(F.col("a") == F.col("start"), F.col("ltype")).otherwise(START).alias("ltype"), F.when(F.col("b") == F.col("end"), F.col("rtype")).otherwise(END).alias("rtype"),
        ave.alias("ave"), F.sqrt(F.greatest(F.lit(0.0), var / (F.col("b") - F.col("a")))).alias("dev"), F.col("max").cast("long").alias("max"),
    )
    stub = lambda rows, a, l, r: rows.select(*keys, a.alias("start"), (a + 1).alias("end"), l.alias("ltype"), r.alias("rtype"), F.lit(p.min_guaranteed_weight).alias("ave"), F.lit(1.0).alias("dev"), F.lit(0).cast("long").alias("max"))
    first = islands.where(F.col("a") == F.col("start")).select(*keys, "start")
    last = islands.where(F.col("b") == F.col("end")).select(*keys, "end")
    left = stub(regions.where(F.col("ltype") == RIGHT).join(first, [*keys, "start"], "left_anti"), F.col("start"), F.lit(RIGHT), F.lit(END))
    right = stub(regions.where(F.col("rtype") == LEFT).join(last, [*keys, "end"], "left_anti"), F.col("end") - 1, F.lit(START), F.lit(LEFT))
    vid = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    return exons.unionByName(left).unionByName(right).withColumn("vid", vid.cast("long")).select(*keys, "vid", "start", "end", "ltype", "rtype", "ave", "dev", "max")


def classified(exons: DataFrame, bounds: DataFrame, junctions: DataFrame, keys: list[str]) -> DataFrame:
    """`exons` with kind: 0 where it touches a bound or a splice site on its own side, or lies in no stronger intron; else 1."""
    j = junctions.select(*keys, F.col("l").alias("start"), F.col("r").alias("end"), F.col("count").alias("_c"))
    b = bounds.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = exons.join(b, keys).join(j, [*keys, "start", "end"], "left")
    inside = (F.col("ltype") == LEFT) & (F.col("rtype") == RIGHT) & (F.col("_c").isNull() | (F.col("_c") < F.col("ave")))
    firm = (F.col("start") == F.col("_s")) | (F.col("end") == F.col("_e")) | (F.col("ltype") == RIGHT) | (F.col("rtype") == LEFT) | inside
    return rows.withColumn("kind", F.when(firm, 0).otherwise(1)).select(*exons.columns, "kind")


def linked(exons: DataFrame, junctions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, r, count, strand, lexon, rexon): each junction with the exon that ends at l and the one that begins at r."""
    by_end = exons.select(*keys, F.col("end").alias("l"), F.col("vid").alias("lexon"))
    by_start = exons.select(*keys, F.col("start").alias("r"), F.col("vid").alias("rexon"))
    return junctions.select(*keys, "l", "r", "count", "strand").join(by_end, [*keys, "l"]).join(by_start, [*keys, "r"])


def vertices(exons: DataFrame, bounds: DataFrame, keys: list[str], p: Parameters = Parameters()) -> DataFrame:
    """(keys, v, lpos, rpos, w, run): exons as vertices, and the source and the sink at the bounds.

    Vertices of one run abut each other from first to last.
    """
    w = Window.partitionBy(*keys).orderBy("vid")
    new = F.coalesce((F.col("start") != F.lag("end").over(w)).cast("long"), F.lit(0))
    inner = exons.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inner = inner.select(*keys, F.col("vid").alias("v"), F.col("start").alias("lpos"), F.col("end").alias("rpos"), F.greatest(F.col("ave"), F.lit(p.min_guaranteed_weight)).alias("w"), F.col("run").cast("long").alias("run"))
    n = exons.groupBy(*keys).agg(F.max("vid").alias("_n"))
    ends = bounds.join(n, keys)
    end = lambda v, at, run: ends.select(*keys, v.cast("long").alias("v"), F.col(at).alias("lpos"), F.col(at).alias("rpos"), F.lit(0.0).alias("w"), F.lit(run).cast("long").alias("run"))
    return inner.unionByName(end(F.lit(0), "start", -1)).unionByName(end(F.col("_n") + 1, "end", -2))


def edges(exons: DataFrame, links: DataFrame, keys: list[str], p: Parameters = Parameters()) -> DataFrame:
    """(keys, s, t, w, kind, strand): junctions, boundaries, and neighbours that abut.

    A boundary's weight is its exon's depth less that of an abutting neighbour. Of two abutting exons the one with fewer other
    edges on that side gives the weight, the lesser where they have as many.
    """
    # exons and the ends of junctions are dealt once by graph: how many junctions leave and enter an exon is told beside it
    sites = links.groupBy(*keys, F.col("lexon").alias("vid")).agg(F.count("*").alias("_out")).unionByName(links.groupBy(*keys, F.col("rexon").alias("vid")).agg(F.count("*").alias("_in")), allowMissingColumns=True)
    own, w = Window.partitionBy(*keys, "vid"), Window.partitionBy(*keys).orderBy("vid")
    rows = exons.select(*keys, "vid", "start", "end", "ltype", "rtype", "ave").unionByName(sites, allowMissingColumns=True).repartition(*keys)
    rows = rows.withColumns({"_out": F.coalesce(F.sum("_out").over(own), F.lit(0)), "_in": F.coalesce(F.sum("_in").over(own), F.lit(0))}).where("start is not null")
    before, after = F.lag("end").over(w) == F.col("start"), F.lead("start").over(w) == F.col("end")
    near = rows.withColumns({
        "_before": F.when(before, F.lag("ave").over(w)), "_after": F.when(after, F.lead("ave").over(w)), "_n": F.max("vid").over(Window.partitionBy(*keys)),
        "_next": F.lead("_in").over(w) + (F.lead("ltype").over(w) == START).cast("long"), "_own": F.col("_out") + (F.col("rtype") == END).cast("long"),
    })
    floor = lambda c: F.greatest(c, F.lit(p.min_guaranteed_weight))
    weight = F.when(F.col("_own") < F.col("_next"), F.col("ave")).when(F.col("_own") > F.col("_next"), F.col("_after")).otherwise(F.least("ave", "_after"))
    edge = lambda s, t, c, kind: F.struct(s.cast("long").alias("s"), t.cast("long").alias("t"), floor(c).alias("w"), F.lit(kind).alias("kind"))
    asked = [
        F.when(F.col("ltype") == START, edge(F.lit(0), F.col("vid"), F.col("ave") - F.coalesce("_before", F.lit(0.0)), "source")),
        F.when(F.col("rtype") == END, edge(F.col("vid"), F.col("_n") + 1, F.col("ave") - F.coalesce("_after", F.lit(0.0)), "sink")),
        F.when(F.col("_after").isNotNull(), edge(F.col("vid"), F.col("vid") + 1, weight, "adjacent")),
    ]
    each = near.select(*keys, F.explode(F.array_compact(F.array(*asked))).alias("x")).select(*keys, "x.s", "x.t", "x.w", "x.kind", F.lit(".").alias("strand"))
    junction = links.select(*keys, F.col("lexon").alias("s"), F.col("rexon").alias("t"), F.col("count").cast("double").alias("w"), F.lit("junction").alias("kind"), "strand")
    return junction.unionByName(each)


def read_shapes(reads: DataFrame, keys: list[str], sample: str | None = None) -> DataFrame:
    """(keys, shape, pos, rpos, chain, n): the distinct reads, numbered, and how many there are of each; stored.

    With `sample` also n_samples. What follows costs a row a shape, however deep a locus is.
    """
    more = [F.count_distinct(sample).alias("n_samples")] if sample else []
    return stored(reads.groupBy(*keys, "pos", "rpos", "chain").agg(F.count("*").alias("n"), *more).withColumn("shape", F.monotonically_increasing_id()), "shapes")


def read_paths(reads: DataFrame, vertices: DataFrame, keys: list[str], read: str, width: int = BIN) -> DataFrame:
    """(keys, read, path): each read (pos, rpos, chain) with the path of its shape; those that do not lie on the graph are left out.

    Reads are told by what they are, not by `read`: mates and secondary alignments may share a name, and each has its row.
    """
    shapes = read_shapes(reads, keys)
    paths = shape_paths(shapes, vertices, keys, width).join(shapes, [*keys, "shape"]).select(*keys, "pos", "rpos", "chain", "path")
    return reads.select(*keys, read, "pos", "rpos", "chain").join(paths, [*keys, "pos", "rpos", "chain"]).select(*keys, read, "path")


def shape_paths(shapes: DataFrame, vertices: DataFrame, keys: list[str], width: int = BIN, read: str = "shape") -> DataFrame:
    """(keys, shape, path): shapes as vertex lists.

    The ends are looked up by position; an intron's ends must be the end and the begin of exons; between two introns the
    exons must abut.
    """
    reads = shapes
    inner = vertices.where("run >= 0")
    near = inner.select(*keys, "v", "lpos", "rpos")
    own = [*keys, read]
    first = containing(reads.select(*own, F.col("pos").alias("_p")), near, keys, "_p", "lpos", "rpos", width).select(*own, F.col("v").alias("u1"))
    last = containing(reads.select(*own, (F.col("rpos") - 1).alias("_p")), near, keys, "_p", "lpos", "rpos", width).select(*own, F.col("v").alias("u2"))
    each = reads.select(*own, F.posexplode(introns(F.col("chain"))).alias("k", "j")).select(*own, "k", "j.l", "j.r")
    donor = inner.select(*keys, F.col("rpos").alias("l"), F.col("v").alias("d"), F.col("run").alias("d_run"))
    acceptor = inner.select(*keys, F.col("lpos").alias("r"), F.col("v").alias("a"), F.col("run").alias("a_run"))
    sited = each.join(donor, [*keys, "l"]).join(acceptor, [*keys, "r"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("k", "d", "d_run", "a", "a_run"))).alias("js"))
    found = reads.select(*own, F.size(introns(F.col("chain"))).alias("n")).join(first, own).join(last, own).join(sited, own, "left").where("u1 <= u2")
    js, n = F.col("js"), F.col("n")
    found = found.where((n == 0) | (F.size(js) == n))
    steps = F.zip_with(F.slice(js, 1, F.greatest(n - 1, F.lit(0))), F.slice(js, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.struct(x["a"].alias("f"), y["d"].alias("t"), (x["a_run"] == y["d_run"]).alias("same")))
    found = found.where((n == 0) | F.forall(steps, lambda x: x["same"] & (x["f"] <= x["t"])))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    d0, a1 = js[0]["d"], F.element_at(js, -1)["a"]
    middle = F.flatten(F.transform(steps, lambda x: F.sequence(x["f"], x["t"])))
    long = F.concat(upto(F.col("u1"), d0 - 1), F.array(d0), middle, F.array(a1), upto(a1 + 1, F.col("u2")))
    return found.select(*own, F.when(n == 0, F.sequence("u1", "u2")).otherwise(long).alias("path"))


def steps(paths: DataFrame, keys: list[str], name: str, *also: Column) -> DataFrame:
    """(keys, name, also, r, s, t): each vertex s of a path with the one before (r) and the one after (t), null at its ends."""
    around = F.transform("path", lambda x, i: F.struct(F.get("path", i - 1).alias("r"), x.alias("s"), F.get("path", i + 1).alias("t")))
    each = paths.select(*keys, name, *also, F.explode(around).alias("_x"))
    return each.select(*(c for c in each.columns if c != "_x"), "_x.r", "_x.s", "_x.t")


STRETCH = 64


def beside(each: DataFrame, told: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of `steps` (_step true) and of tables (keys, s, ...) dealt once by stretches of vertices (_at).

    Windows over (keys, _at, s, ...) then tell each step what the tables say of it, and sums by path begin within a stretch,
    so neither the steps nor what they are told is dealt again.
    """
    rows = each.withColumn("_step", F.lit(True))
    for table in told:
        rows = rows.unionByName(table.withColumn("_step", F.lit(False)), allowMissingColumns=True)
    return rows.withColumn("_at", F.floor(F.col("s") / STRETCH)).repartition(*keys, "_at")


def on_graph(paths: DataFrame, edges: DataFrame, keys: list[str], read: str) -> DataFrame:
    """The rows of `paths` whose neighbours are all joined by an edge."""
    taken = steps(paths, keys, read).where(F.col("t").isNotNull()).drop("r")
    broken = taken.join(edges.select(*keys, "s", "t").distinct(), [*keys, "s", "t"], "left_anti").select(*keys, read).distinct()
    return paths.join(broken, [*keys, read], "left_anti")


def path_exons(paths: DataFrame, vertices: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, exons): the vertices of each path as exons, those that abut merged."""
    order = Window.partitionBy(*keys).orderBy("v")
    near = vertices.where("run >= 0").select(*keys, F.col("v").alias("s"), "lpos", "rpos", (F.lag("rpos").over(order) == F.col("lpos")).alias("_back"), (F.lead("lpos").over(order) == F.col("rpos")).alias("_on"))
    own = Window.partitionBy(*keys, "_at", "s")
    told = lambda c: F.max(c).over(own).alias(c)
    rows = beside(steps(paths, keys, name), [near], keys)
    met = rows.select(*keys, name, "_step", "r", "s", "t", *(told(c) for c in ("lpos", "rpos", "_back", "_on"))).where(F.col("_step") & F.col("lpos").isNotNull())
    # an exon begins (ends) where the path does not come from (go on to) the vertex that abuts
    begins = ~F.coalesce(F.col("_back") & (F.col("r") == F.col("s") - 1), F.lit(False))
    ends = ~F.coalesce(F.col("_on") & (F.col("t") == F.col("s") + 1), F.lit(False))
    sides = met.select(*keys, name, F.when(begins, F.col("lpos")).alias("_a"), F.when(ends, F.col("rpos")).alias("_b")).where("_a is not null or _b is not null")
    found = sides.groupBy(*keys, name).agg(F.array_sort(F.collect_list("_a")).alias("_a"), F.array_sort(F.collect_list("_b")).alias("_b"))
    return found.select(*keys, name, F.zip_with("_a", "_b", lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))).alias("exons"))


def phases(paths: DataFrame, keys: list[str], least: int = 1, weight: str | None = None) -> DataFrame:
    """(keys, path, n): how many reads take each path, of those that at least `least` take; `weight` counts a row's reads."""
    return paths.groupBy(*keys, "path").agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).where(F.col("n") >= least)


def distant(vertices: DataFrame, edges: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, v, other): vertices into (side "t") or out of (side "s") each vertex that do not abut it."""
    other = "s" if side == "t" else "t"
    a = vertices.where("run >= 0").select(*keys, F.col("v").alias(side), F.col("lpos").alias("_l"), F.col("rpos").alias("_r"))
    b = vertices.where("run >= 0").select(*keys, F.col("v").alias(other), F.col("lpos").alias("_l2"), F.col("rpos").alias("_r2"))
    apart = F.col("_r2") != F.col("_l") if side == "t" else F.col("_l2") != F.col("_r")
    return edges.join(a, [*keys, side]).join(b, [*keys, other]).where(apart).select(*keys, F.col(side).alias("v"), F.col(other).alias("other")).distinct()


def boundary_scores(vertices: DataFrame, edges: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, run, first, last, most, amount, ratio): runs without a boundary edge, and how far their depth exceeds what comes in
    from outside (side "t", starts) or leaves (side "s", ends): log(2 + most) / log(2 + amount).
    """
    other, end = ("s", 0) if side == "t" else ("t", None)
    inner = vertices.where("run >= 0")
    spans = inner.groupBy(*keys, "run").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.max("w").alias("most"))
    run = inner.select(*keys, F.col("v").alias(side), "run")
    far = inner.select(*keys, F.col("v").alias(other), F.col("run").alias("_run"))
    met = edges.join(run, [*keys, side]).join(far, [*keys, other], "left")
    sums = met.groupBy(*keys, "run").agg(F.sum(F.when(F.col("_run").isNull() | (F.col("_run") != F.col("run")), F.col("w")).otherwise(0.0)).alias("amount"), F.max(F.col("_run").isNull().cast("int")).alias("_bound"))
    found = spans.join(sums, [*keys, "run"], "left").where("coalesce(_bound, 0) = 0").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    return found.select(*keys, "run", "first", "last", "most", "amount", (F.log(2 + F.col("most")) / F.log(2 + F.col("amount"))).alias("ratio"))


def new_boundaries(scores: DataFrame, keys: list[str], least: float = Parameters.boundary_ratio) -> DataFrame:
    """(keys, first, last, weight): of each graph the run of the highest ratio, if at least `least`."""
    best = scores.groupBy(*keys).agg(F.max(F.struct("ratio", (-F.col("run")).alias("_r"), "first", "last", (F.col("most") - F.col("amount")).alias("weight"))).alias("_b"))
    return best.where(F.col("_b.ratio") >= least).select(*keys, "_b.first", "_b.last", "_b.weight")


def graph_tables(reads: DataFrame, keys: list[str], chain_counts: DataFrame, p: Parameters = Parameters(), width: int = BIN) -> dict[str, DataFrame]:
    """From reads (keys, pos, rpos, exons) and chain counts to the tables of their graphs: all steps above in order."""
    from strandloom.operators.chains import junctions as count_junctions
    from strandloom.operators.intervals import depth

    bounds = reads.groupBy(*keys).agg(F.min("pos").alias("start"), F.max("rpos").alias("end"))
    # each table is read by several later ones: written once, plans stay short
    bounds, found = stored(bounds, "bounds"), stored(count_junctions(chain_counts, keys, p.min_junction_support), "junctions")
    typed = stored(regions(bounds, found, keys), "regions")
    pieces = depth(reads.select(*keys, F.explode("exons").alias("x")).select(*keys, "x.start", "x.end"), keys, width=width)
    exons = stored(partial_exons(typed, pieces, keys, p, width), "exons")
    links = stored(linked(exons, found, keys), "links")
    return {
        "bounds": bounds, "junctions": found, "regions": typed, "exons": exons, "links": links,
        "vertices": stored(vertices(exons, bounds, keys, p), "vertices"), "edges": stored(edges(exons, links, keys, p), "edges"),
    }


def bridge_ends(mates: DataFrame, vertices: DataFrame, keys: list[str], pair: str, relax: int = Parameters.bridge_end_relaxing, width: int = BIN) -> DataFrame:
    """(keys, pair, s, t): the vertices that hold the end of the first mate (rpos, chain) and the begin of the second (r_pos, r_chain).

    An end that lies at most `relax` beyond where its exon begins, with the exon before abutting, moves back to that one,
    unless an intron of the mate ends there; the begin of the second mate likewise onwards.
    """
    inner = vertices.where("run >= 0")
    w = Window.partitionBy(*keys).orderBy("v")
    near = inner.select(*keys, "v", "lpos", "rpos", (F.lag("rpos").over(w) == F.col("lpos")).alias("_back"), (F.lead("lpos").over(w) == F.col("rpos")).alias("_on"))
    own = [*keys, pair]
    a = containing(mates.select(*own, (F.col("rpos") - 1).alias("_p"), F.array_max("chain").alias("_c")), near, keys, "_p", "lpos", "rpos", width)
    back = F.coalesce("_back", F.lit(False)) & (F.col("_p") + 1 - F.col("lpos") <= relax) & (F.col("_c").isNull() | (F.col("_c") < F.col("lpos")))
    a = a.select(*own, F.when(back, F.col("v") - 1).otherwise(F.col("v")).alias("s"))
    b = containing(mates.select(*own, F.col("r_pos").alias("_p"), F.array_min("r_chain").alias("_c")), near, keys, "_p", "lpos", "rpos", width)
    on = F.coalesce("_on", F.lit(False)) & (F.col("rpos") - F.col("_p") <= relax) & (F.col("_c").isNull() | (F.col("_c") > F.col("rpos")))
    b = b.select(*own, F.when(on, F.col("v") + 1).otherwise(F.col("v")).alias("t"))
    return a.join(b, own)


def piers(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, t): the distinct pairs of vertices to be bridged."""
    return ends.where("s < t").select(*keys, "s", "t").distinct()


def adjacent_edges(vertices: DataFrame, edges: DataFrame, keys: list[str], weight: float = Parameters.adjacent_weight) -> DataFrame:
    """(keys, s, t, w, l, r): light edges between consecutive vertices that have none, with the gap they span."""
    w = Window.partitionBy(*keys).orderBy("v")
    pairs = vertices.where("run >= 0").select(*keys, F.col("v").alias("s"), F.lead("v").over(w).alias("t"), F.col("rpos").alias("l"), F.lead("lpos").over(w).alias("r")).where(F.col("t").isNotNull())
    return pairs.join(edges.select(*keys, "s", "t").distinct(), [*keys, "s", "t"], "left_anti").select(*keys, "s", "t", F.lit(weight).alias("w"), "l", "r")


def light_gaps(light: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, r): the distinct gaps that light edges span; in a chain they are no introns."""
    return light.where("l < r").select(*keys, "l", "r").distinct()


def without_introns(rows: DataFrame, gaps: DataFrame, keys: list[str], name: str, chain: str = "chain") -> DataFrame:
    """(keys, name, chain): the chains of `rows`, one for each name, without the introns that are among `gaps` (keys, l, r)."""
    each = rows.select(*keys, name, F.explode(introns(F.col(chain))).alias("j")).select(*keys, name, "j.l", "j.r")
    left = each.join(gaps, [*keys, "l", "r"], "left_anti").groupBy(*keys, name).agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("_js"))
    found = rows.select(*keys, name, F.col(chain).alias("_all")).join(left, [*keys, name], "left")
    flat = F.flatten(F.transform("_js", lambda x: F.array(x["l"], x["r"])))
    return found.select(*keys, name, F.coalesce(flat, F.slice("_all", 1, 0)).alias(chain))


def bridged(mates: DataFrame, tables: dict[str, DataFrame], pair: str, p: Parameters = Parameters(), width: int = BIN) -> DataFrame:
    """(graph, pair, chain, rank, length, choices): mates (rpos, pos, chain; r_pos, r_rpos, r_chain) bridged over their graph.

    Between the vertices of the two ends the best `bridge_candidates` paths are tried in order; the first whose introns agree
    with both mates' and whose length without introns lies in the insert sizes is taken, choices says how many fit.
    """
    from strandloom.functions.arrays import increasing, intron_chain, intron_length
    from strandloom.operators import graphs as G

    keys = ["graph"]
    ends = stored(bridge_ends(mates, tables["vertices"], keys, pair, p.bridge_end_relaxing, width).where("s <= t"), "bridge-ends")
    light = adjacent_edges(tables["vertices"], tables["edges"], keys, p.adjacent_weight)
    every = tables["edges"].where("kind in ('junction', 'adjacent')").select("graph", "s", "t", "w").unionByName(light.select("graph", "s", "t", "w"))
    paths = stored(G.paths_between(every, ends.select("graph", "s", "t"), p.bridge_candidates, p.bridge_stack).withColumn("name", F.struct("s", "t", "rank")), "bridge-paths")
    over = path_exons(paths, tables["vertices"], keys, "name").select("graph", "name", intron_chain(F.col("exons")).alias("_over"))
    over = without_introns(over, light_gaps(light, keys), keys, "name", "_over").select("graph", "name.*", "_over")
    met = ends.join(over, ["graph", "s", "t"]).join(mates, ["graph", pair])
    own = F.array_distinct(F.concat(introns(F.col("chain")), introns(F.col("_over")), introns(F.col("r_chain"))))
    whole = F.flatten(F.transform(F.array_sort(own), lambda x: F.array(x["l"], x["r"])))
    tried = met.withColumn("_whole", whole).where(increasing(F.col("_whole")) & ((F.size("_whole") == 0) | ((F.array_min("_whole") > F.col("pos")) & (F.array_max("_whole") < F.col("r_rpos")))))
    tried = tried.select("graph", pair, "rank", F.col("_whole").alias("chain"), (F.col("r_rpos") - F.col("pos") - intron_length(F.col("_whole"))).alias("length"))
    return G.bridges(tried, ["graph", pair], ["rank"], "length", p.insertsize_low, p.insertsize_high)
