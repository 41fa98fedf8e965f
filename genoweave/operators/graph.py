"""The signed atom graph and its classes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.functions.blocks import coverage, lift, mirrored_blocks
from genoweave.operators.biconnected import signs_by_block
from genoweave.operators.components import connected_components
from genoweave.operators.intervals import asof, containment_join, overlap_join
from genoweave.operators.ordered import next_value, running_sum
from genoweave.plans.durable import write_table


KEY = ["aln_id", "part", "dir"]


#: Positions of a stretch whose regions or atoms rows are looked up in, and how far over its end these may go on.
STRETCH, MARGIN = 1 << 14, 1 << 12


def _reaches_far(low: str, high: str, stretch: int, margin: int) -> Column:
    """Whether [low, high] ends ``margin`` or more after the stretch that it begins in."""
    return F.col(high) >= (F.floor(F.col(low) / stretch) + 1) * stretch + margin


def _lists(rows: DataFrame, last: str, stretch: int, margin: int) -> DataFrame:
    """(__at, __list): for each stretch, with its margin, the ``rows`` of which [first, ``last``] lies there in part.

    For rows apart from each other, whose number in a stretch its size bounds.
    """
    low, high = F.floor((F.col("first") - margin) / stretch), F.floor(F.col(last) / stretch)
    return rows.select(F.struct("*").alias("__r"), F.explode(F.sequence(low, high)).alias("__at")).groupBy("__at").agg(F.collect_list("__r").alias("__list"))


def _found(rows: DataFrame, low: str, lists: DataFrame, stretch: int, wanted: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``__list``: what is ``wanted`` in the list of the stretch they begin in. Rows move once, and go where there is no list.

    Explode it as ``outer`` (see ``gap_split``).
    """
    met = rows.withColumn("__at", F.floor(F.col(low) / stretch)).join(lists, "__at").drop("__at")
    return met.withColumn("__list", F.filter("__list", wanted))


def contained_atoms(atoms: DataFrame, alignments: DataFrame, bucket: int = 1000, stretch: int = STRETCH, margin: int = MARGIN) -> DataFrame:
    """``containment_join`` of atoms apart from each other: alignments that end soon after their stretch move once, to its list of atoms."""
    near, far = _split(alignments, "t_start", "t_end", stretch, margin)
    found = _found(near, "t_start", _lists(atoms, "first", stretch, margin), stretch, lambda a: (a["first"] >= F.col("t_start")) & (a["last"] <= F.col("t_end")))
    pairs = found.select(*alignments.columns, F.explode_outer("__list").alias("__r")).where("__r is not null").select("__r.*", *alignments.columns)
    return pairs if far is None else pairs.unionByName(containment_join(atoms, far, bucket))


def _split(rows: DataFrame, low: str, high: str, stretch: int, margin: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows that end soon after their stretch, and the others if there are any."""
    long = _reaches_far(low, high, stretch, margin)
    far = rows.where(long)
    return rows.where(~long), None if far.isEmpty() else far


def lift_atoms(atoms: DataFrame, alignments: DataFrame, bucket: int = 1000, stretch: int = STRETCH, margin: int = MARGIN) -> DataFrame:
    """Every atom through every alignment that contains it: the pair, without block lists, with m_first and m_last.

    Alignments that end soon after their stretch move once, with their blocks, to its list of atoms, which are apart from each other. For
    longer ones pairs are found in bins and blocks fetched for them. ``alignments`` should be stored.
    """
    rest = alignments.drop("t_start", "t_end", "blocks", "sym").columns
    out = [*atoms.columns, *rest, "t_start", "t_end", "m_first", "m_last"]
    near, far = _split(alignments.select(*rest, "t_start", "t_end", "blocks"), "t_start", "t_end", stretch, margin)
    found = _found(near, "t_start", _lists(atoms, "first", stretch, margin), stretch, lambda a: (a["first"] >= F.col("t_start")) & (a["last"] <= F.col("t_end")))
    ends = lambda a: F.struct(a.alias("r"), lift(a["first"], F.col("blocks"), F.col("strand")).alias("x"), lift(a["last"], F.col("blocks"), F.col("strand")).alias("y"))
    pairs = found.select(*rest, "t_start", "t_end", F.explode_outer(F.transform("__list", ends)).alias("__e")).where("__e is not null")
    lifted = pairs.select(*(F.col(f"__e.r.{c}").alias(c) for c in atoms.columns), *rest, "t_start", "t_end", F.least("__e.x", "__e.y").alias("m_first"), F.greatest("__e.x", "__e.y").alias("m_last"))
    return lifted if far is None else lifted.unionByName(_lift_far(atoms, far, bucket).select(*out))


def _lift_far(atoms: DataFrame, alignments: DataFrame, bucket: int) -> DataFrame:
    """``lift_atoms`` through alignments of any length."""
    pairs = containment_join(atoms, alignments.select(*KEY, "t_start", "t_end"), bucket).drop("t_start", "t_end")
    pairs = pairs.join(alignments.withColumnRenamed("blocks", "__blocks"), KEY)
    a, b = lift(F.col("first"), F.col("__blocks"), F.col("strand")), lift(F.col("last"), F.col("__blocks"), F.col("strand"))
    return pairs.withColumn("__a", a).withColumn("__b", b).withColumn("m_first", F.least("__a", "__b")).withColumn("m_last", F.greatest("__a", "__b")).drop("__a", "__b", "__blocks")


def clipped_waste(lifted: DataFrame, waste: DataFrame, alignments: DataFrame, bucket: int = 1000, by: str = "atom_nr", stretch: int = STRETCH, margin: int = MARGIN) -> DataFrame:
    """Waste under the lifted atoms brought back and clipped to the atom: (``by``, first, last), with repeats.

    A region whose two images lie strictly on one side of the atom is dropped. Lifted atoms that end soon after their stretch move once
    to its list of waste, and once with what they meet there to their alignment's blocks; longer ones meet the waste in bins.
    """
    images = lifted.select(F.col(by).alias("__atom"), F.col("first").alias("a_first"), F.col("last").alias("a_last"), *KEY, "m_first", "m_last")
    waste = waste.select("first", "last")
    near, far = _split(images, "m_first", "m_last", stretch, margin)
    met = _found(near, "m_first", _lists(waste, "last", stretch, margin), stretch, lambda r: (r["first"] <= F.col("m_last")) & (r["last"] >= F.col("m_first")))
    met = met.where(F.size("__list") > 0).drop("m_first", "m_last")
    if far is not None:
        pairs = overlap_join(far, waste, "m_first", "m_last", bucket)
        met = met.unionByName(pairs.select("__atom", "a_first", "a_last", *KEY, F.array(F.struct("first", "last")).alias("__list")))
    pairs = met.join(alignments.select(*KEY, "strand", mirrored_blocks(F.col("blocks"), F.col("strand")).alias("__blocks")), KEY)
    ends = lambda r: F.struct(lift(r["first"], F.col("__blocks"), F.col("strand")).alias("x"), lift(r["last"], F.col("__blocks"), F.col("strand")).alias("y"))
    back = pairs.select("__atom", "a_first", "a_last", F.explode_outer(F.transform("__list", ends)).alias("__e")).select("__atom", "a_first", "a_last", "__e.x", "__e.y")
    back = back.where("not (x < a_first and y < a_first) and not (x > a_last and y > a_last)")
    return back.select(F.col("__atom").alias(by), F.greatest(F.least("x", "y"), "a_first").alias("first"), F.least(F.greatest("x", "y"), "a_last").alias("last"))


def touched(images: DataFrame, waste: DataFrame, bucket: int = 1000, stretch: int = STRETCH, margin: int = MARGIN) -> DataFrame:
    """Those of ``images`` whose [m_first, m_last] shares a position with ``waste``, whose regions are apart; long ones as often as with how many.

    Images that end soon after their stretch move once, to its list of waste; longer ones meet the waste in bins.
    """
    waste = waste.select("first", "last")
    near, far = _split(images, "m_first", "m_last", stretch, margin)
    lists = _lists(waste, "last", stretch, margin)
    met = near.withColumn("__at", F.floor(F.col("m_first") / stretch)).join(lists, "__at")
    met = met.where(F.exists("__list", lambda r: (r["first"] <= F.col("m_last")) & (r["last"] >= F.col("m_first")))).select(*images.columns)
    return met if far is None else met.unionByName(overlap_join(far, waste, "m_first", "m_last", bucket).select(*images.columns))


#: Atoms that one task re-optimises. Their rows are few bytes and much work, so tasks are counted in atoms.
ATOMS_A_TASK = 500


def tasks_for(atoms: DataFrame) -> int:
    """How many tasks to deal ``atoms`` to, up to the session's number of shuffle partitions."""
    most = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-atoms.count() // ATOMS_A_TASK)))


def induced_intervals(lifted: DataFrame, atoms: DataFrame, waste: DataFrame, alignments: DataFrame, bucket: int = 1000, by: str = "atom_nr") -> DataFrame:
    """Distinct (``by``, first, last): the clipped waste of every atom and its own two end points.

    Dealt by atom before repeats go, so that what follows by atom needs no other exchange.
    """
    return with_ends(clipped_waste(lifted, waste, alignments, bucket, by), atoms, by)


def with_ends(intervals: DataFrame, atoms: DataFrame, by: str = "atom_nr") -> DataFrame:
    """The intervals and, for every atom, its two end points."""
    ends = atoms.select(F.col(by).alias("__atom"), F.explode(F.array("first", "last")).alias("first")).select(F.col("__atom").alias(by), "first", F.col("first").alias("last"))
    return intervals.unionByName(ends).repartition(tasks_for(atoms), by).distinct()


def choose_atom(lifted: DataFrame, waste: DataFrame, stretch: int = STRETCH, margin: int = MARGIN) -> DataFrame:
    """For every lifted atom the atom j that it falls on most: adds j, j_first, j_last.

    rf and rl are the last regions that begin at or before its ends. One region, or
    two next to each other, give rf. Otherwise the gap of greatest credit wins, the
    first of equals; the last gap's credit is what lies beyond region rl. A lifted
    atom on the last region has no gap, and no row. ``lifted`` and ``waste`` should be stored.

    A lifted atom that ends in the stretch where it begins, or less than ``margin`` after it, moves once, to the sorted list
    of the regions that it can meet. Longer ones look both ends up and meet the gaps between one by one.
    """
    ahead = next_value(waste, "first", ["first"], "__n")
    gaps = write_table(ahead.select("first", F.col("region_id").alias("k"), F.col("last").alias("k_last"), F.col("__n").alias("n_first")), "gaps")
    long = _reaches_far("m_first", "m_last", stretch, margin)
    near, far = _choose_near(lifted.where(~long), gaps, stretch, margin), lifted.where(long)
    return near if far.isEmpty() else near.unionByName(_choose_far(far, waste, gaps))


def _credit(at_first: Column, at_last: Column, k_last: Column, n_first: Column, rl_last: Column) -> Column:
    """What a gap earns; ``at_first`` and ``at_last`` say whether it is the first or the last one."""
    return F.when(at_first, n_first - F.col("m_first")).when(at_last, F.greatest(F.col("m_last") - rl_last, F.lit(0))).otherwise(n_first - k_last + 1)


def _choose_near(lifted: DataFrame, gaps: DataFrame, stretch: int, margin: int) -> DataFrame:
    """``choose_atom`` where lifted atoms end less than ``margin`` after their stretch, by lists of the regions that each stretch can meet."""
    low, high = F.floor((F.col("first") - margin) / stretch), F.floor(F.coalesce(F.col("n_first") - 1, F.col("first")) / stretch)
    reached = gaps.select(F.struct("first", "k", "k_last", "n_first").alias("__r"), F.explode(F.sequence(low, high)).alias("__at"))
    lists = reached.groupBy("__at").agg(F.sort_array(F.collect_list("__r")).alias("__list"))
    ends = gaps.agg(F.min("first").alias("__least"), F.max("first").alias("__most"))
    rows = lifted.join(F.broadcast(ends)).where("m_first < __most").withColumn("__at", F.floor(F.greatest("m_first", "__least") / stretch)).drop("__least", "__most")
    place = lambda c: F.greatest(F.size(F.filter("__list", lambda r: r["first"] <= F.col(c))), F.lit(1))
    met = rows.join(lists, "__at").select(*lifted.columns, "__list", place("m_first").alias("__f"), place("m_last").alias("__t"))
    rl_last = F.get("__list", F.col("__t") - 1)["k_last"]

    def priced(i: Column) -> Column:
        r = F.get("__list", i - 1)
        credit = _credit(i == F.col("__f"), i == F.col("__t") - 1, r["k_last"], r["n_first"], rl_last)
        return F.struct(credit.alias("c"), (-r["k"]).alias("m"), r.alias("r"))

    several = F.array_max(F.transform(F.sequence("__f", F.col("__t") - 1), priced))["r"]
    chosen = met.withColumn("__g", F.when(F.col("__t") - F.col("__f") < 2, F.get("__list", F.col("__f") - 1)).otherwise(several))
    return chosen.select(*lifted.columns, F.col("__g.k").alias("j"), F.col("__g.k_last").alias("j_first"), F.col("__g.n_first").alias("j_last"))


def _choose_far(lifted: DataFrame, waste: DataFrame, gaps: DataFrame) -> DataFrame:
    """``choose_atom`` of lifted atoms of any length."""
    located = asof(write_table(lifted, "far"), "m_first", waste, "first", "region_id", "rf")
    located = asof(write_table(located, "far"), "m_last", waste.withColumn("__x", F.struct("region_id", "last")), "first", "__x", "rl")
    options = located.withColumn("k", F.explode(F.expr("sequence(rf, greatest(rf, rl.region_id - 1))"))).join(gaps.where("n_first is not null").drop("first"), "k")
    credit = _credit(F.col("k") == F.col("rf"), F.col("k") == F.col("rl.region_id") - 1, F.col("k_last"), F.col("n_first"), F.col("rl.last"))
    best = options.groupBy(*lifted.columns).agg(F.max_by(F.struct("k", "k_last", "n_first"), F.struct(credit.alias("c"), (-F.col("k")).alias("m"))).alias("b"))
    return best.select(*lifted.columns, F.col("b.k").alias("j"), F.col("b.k_last").alias("j_first"), F.col("b.n_first").alias("j_last"))


def graph_edges(chosen: DataFrame, min_coverage: int) -> DataFrame:
    """Edges (i, j, weight): +1 or -1 for every alignment between atoms i and j, both ways (twice where i = j). ``min_coverage`` in percent."""
    least = (F.lit(min_coverage).cast("float").cast("double") / F.lit(100.0)).cast("float")
    j, a, m = (F.col("j_first"), F.col("j_last")), (F.col("first"), F.col("last")), (F.col("m_first"), F.col("m_last"))
    q, t = (F.col("q_start"), F.col("q_end")), (F.col("t_start"), F.col("t_end"))
    kept = chosen.where((coverage(*j, *q) >= least) & (coverage(*j, *m) > 0) & (coverage(*m, *j) > 0) & ~((coverage(*j, *t) >= least) & (coverage(*a, *q) >= least)))
    sign = F.when(F.col("strand") == "+", 1).otherwise(-1)
    i = F.col("atom_nr") - 1
    once = kept.groupBy(F.least(i, F.col("j")).alias("a"), F.greatest(i, F.col("j")).alias("b")).agg(F.sum(sign).alias("s"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("s") * 2).alias("weight"))))
    ways = ways.otherwise(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("s").alias("weight")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), F.col("s").alias("weight"))))
    return once.select(F.explode(ways).alias("e")).select("e.i", "e.j", "e.weight")


def component_labels(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """atom_nr, class_nr from 1 in order of each component's least atom, and ``root``, that atom's number."""
    found = connected_components(edges, "i", "j")
    labelled = atoms.select("atom_nr").join(found, F.col("atom_nr") - 1 == F.col("node"), "left").select("atom_nr", F.coalesce(F.col("component") + 1, F.col("atom_nr")).alias("root"))
    roots = running_sum(labelled.where("atom_nr = root").select("root"), F.lit(1), ["root"], "class_nr")
    return labelled.join(roots, "root").select("atom_nr", "class_nr", "root")


def walk_signs(i: list[int], j: list[int], weight: list[int], start: int) -> dict[int, int]:
    """Sign of each node by depth-first search from ``start``, neighbours in ascending order; an edge of negative weight turns it."""
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in zip(i, j, weight, strict=True):
        near.setdefault(a, []).append((b, -1 if w < 0 else 1))
    signs: dict[int, int] = {}
    stack = [(start, 1)]
    while stack:
        node, sign = stack.pop()
        if node in signs:
            continue
        signs[node] = sign
        stack += [(b, sign * s) for b, s in sorted(near.get(node, ()), reverse=True) if b not in signs]
    return signs


#: Edges of a component of contradicting signs up to which one task walks it whole.
EDGES_AT_ONCE = 200_000


def classes(atoms: DataFrame, edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """atom_nr, class_nr, strand: '-' for atoms that an odd number of negative edges parts from the least atom of their component.

    Signs come from components of the doubled graph, with one node for each atom and
    sign: an edge of negative weight joins unlike signs. Where both nodes of an atom
    fall together signs contradict each other, and there the walk of ``walk_signs``
    decides: in one task for a component of up to ``at_once`` edges, block by block for
    larger ones. Components without a negative edge are all '+'.
    """
    labels = write_table(component_labels(atoms, edges), "labels")
    own = edges.where("i <> j").join(labels.select((F.col("atom_nr") - 1).alias("i"), "root"), "i")
    turned = own.where("weight < 0").select("root").distinct()
    own = write_table(own.join(turned, "root", "left_semi"), "turned")
    odd = (F.col("weight") < 0).cast("bigint")
    doubled = own.where("i < j").select(F.explode(F.array(*(F.struct((F.col("i") * 2 + k).alias("a"), (F.col("j") * 2 + (odd if k == 0 else 1 - odd)).alias("b")) for k in (0, 1)))).alias("e")).select("e.*")
    found = write_table(connected_components(doubled, "a", "b"), "signs")
    plain = found.where("node % 2 = 0").select(F.expr("node div 2 + 1").alias("atom_nr"), F.when(F.col("component") % 2 == 0, 1).otherwise(-1).alias("sign"))
    twisted = found.where("node % 2 = 1 and component = node - 1").select(F.expr("component div 2 + 1").alias("root"))

    contrary = own.join(twisted, "root", "left_semi").select("root", "i", "j", F.when(F.col("weight") < 0, -1).otherwise(1).alias("sign"))
    sizes = write_table(contrary.groupBy("root").agg(F.count("*").alias("n")), "contrary")

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = walk_signs(rows.i.tolist(), rows.j.tolist(), rows.sign.tolist(), int(key[0]) - 1)
        return pd.DataFrame({"node": list(found), "sign": list(found.values())})

    walked = contrary.join(sizes.where(F.col("n") <= at_once), "root", "left_semi").groupBy("root").applyInPandas(search, "node long, sign int")
    large = sizes.where(F.col("n") > at_once).select("root")
    if not large.isEmpty():
        walked = walked.unionByName(signs_by_block(contrary.join(large, "root", "left_semi"), large.select((F.col("root") - 1).alias("node")), walk_signs))
    walked = walked.select((F.col("node") + 1).alias("atom_nr"), F.col("sign").alias("walked"))
    signed = labels.join(plain, "atom_nr", "left").join(walked, "atom_nr", "left")
    return signed.select("atom_nr", "class_nr", F.when(F.coalesce("walked", "sign") < 0, "-").otherwise("+").alias("strand"))


__all__ = ["choose_atom", "classes", "component_labels", "graph_edges", "induced_intervals", "lift_atoms", "with_ends"]
