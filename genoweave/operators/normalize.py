"""From PSL rows to two-way alignments in concatenated positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.config import SegmentationConfig
from genoweave.functions.blocks import global_block, mirrored_blocks, cut_places, zip_blocks
from genoweave.operators.ordered import running_sums


def identity_filter(psl: DataFrame, min_ident: int) -> DataFrame:
    """Rows with a match whose share of matches, in single precision, reaches ``min_ident`` percent."""
    good = F.col("matches") + F.col("rep_matches")
    share = (good.cast("float").cast("double") / (good + F.col("mismatches")).cast("float").cast("double")).cast("float")
    least = (F.lit(min_ident).cast("float").cast("double") / F.lit(100.0)).cast("float")
    return psl.where((good > 0) & (share >= least))


def sequence_offsets(psl: DataFrame, order: str = "aln_id") -> DataFrame:
    """name, size, seq_idx, offset: sequences in order of first sight (query before target), each after the last's end.

    The size is the one at first sight. The aggregates are of plain numbers, so that rows are hashed and not sorted.
    """
    seen = psl.select(F.explode(F.array(*(F.struct((F.col(order) * 2 + k).alias("at"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_size").alias("size")) for k, s in enumerate("qt")))).alias("x")).select("x.*")
    first = seen.groupBy("name").agg(F.min_by("size", "at").alias("size"), F.min("at").alias("at"))
    first = running_sums(first, {"__n": F.lit(1), "__end": F.col("size")}, ["at"])
    return first.select("name", "size", (F.col("__n") - 1).cast("int").alias("seq_idx"), (F.col("__end") - F.col("size")).cast("bigint").alias("offset"))


def offset_join(psl: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows with q_offset and t_offset."""
    q = sequences.select(F.col("name").alias("q_name"), F.col("offset").alias("q_offset"))
    t = sequences.select(F.col("name").alias("t_name"), F.col("offset").alias("t_offset"))
    return psl.join(q, "q_name").join(t, "t_name")


def global_blocks(placed: DataFrame) -> DataFrame:
    """aln_id, strand and ``blocks`` in concatenated positions, zero-size blocks included."""
    strand = F.when(F.col("strand") == "+", "+").otherwise("-")
    blocks = zip_blocks("block_sizes", "q_starts", "t_starts", lambda b: global_block(b, F.col("strand"), F.col("q_size"), F.col("q_offset"), F.col("t_offset")))
    return placed.select("aln_id", strand.alias("strand"), blocks.alias("blocks"))


def remove_zero_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of size 0 go, and rows that then have none."""
    return without_zero_blocks(rows).where(F.size("blocks") > 0)


def without_zero_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of size 0 go. ``gap_split`` leaves out rows without blocks; a filter on them here would make the lists once more."""
    return rows.withColumn("blocks", F.filter("blocks", lambda b: b["size"] > 0))


def hull(rows: DataFrame) -> DataFrame:
    """q_start, q_end, t_start, t_end of the block list."""
    return _hull(rows, F.element_at("blocks", 1), F.element_at("blocks", -1))


def _hull(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    return rows.withColumns(hull_ends(first, last))


def hull_ends(first: Column, last: Column) -> dict[str, Column]:
    """The ends of a run of blocks, by its first and last."""
    plus = F.col("strand") == "+"
    return {
        "q_start": F.when(plus, first["q"]).otherwise(last["q"] - last["size"]),
        "q_end": F.when(plus, last["q"] + last["size"]).otherwise(first["q"]),
        "t_start": first["t"],
        "t_end": last["t"] + last["size"],
    }


def gap_split(rows: DataFrame, max_gap: int, min_aln_length: int) -> DataFrame:
    """One row per run of blocks without a cut, ``part`` from 0, if its target span is above ``min_aln_length``.

    Places are exploded and not lists, as ``outer``, and nulls count as false: else Spark puts filters on the lists' sizes and nulls
    into the joins below, where each makes the lists again, for every row and several times.
    """
    cut = rows.select("aln_id", "strand", "blocks", cut_places(F.col("blocks"), F.col("strand"), max_gap).alias("cuts"))
    runs = cut.select("aln_id", "strand", "blocks", "cuts", F.posexplode_outer("cuts").alias("part", "from")).where(F.coalesce(F.col("from") < F.size("blocks"), F.lit(False)))
    runs = runs.withColumn("upto", F.get("cuts", F.col("part") + 1))
    parts = _hull(runs, F.get("blocks", F.col("from")), F.get("blocks", F.col("upto") - 1))
    parts = parts.where(F.coalesce(F.col("t_end") - F.col("t_start") > min_aln_length, F.lit(False)))
    parts = parts.withColumn("blocks", F.slice("blocks", F.col("from") + 1, F.col("upto") - F.col("from"))).drop("cuts", "from", "upto")
    return parts.select("aln_id", "strand", "part", "blocks", "q_start", "q_end", "t_start", "t_end")


def local_hulls(psl: DataFrame, max_gap: int, min_aln_length: int) -> DataFrame:
    """One row per alignment: its names and sizes, and ``hulls``, the ends of the parts of ``gap_split``, within its own sequences.

    Gaps are the same before offsets are added, so that neither lists of blocks nor parts have to meet the sequences.
    """
    strand = F.when(F.col("strand") == "+", "+").otherwise("-")
    blocks = zip_blocks("block_sizes", "q_starts", "t_starts", lambda b: global_block(b, F.col("strand"), F.col("q_size"), F.lit(0), F.lit(0)))
    names = [F.col(c) for c in ("aln_id", "q_name", "q_size", "t_name", "t_size")]
    rows = without_zero_blocks(psl.select(*names, strand.alias("strand"), blocks.alias("blocks")))
    cut = rows.select(*names, "strand", "blocks", cut_places(F.col("blocks"), F.col("strand"), max_gap).alias("cuts"))

    def ends(start: Column, k: Column) -> Column:
        h = hull_ends(F.get("blocks", start), F.get("blocks", F.get("cuts", k + 1) - 1))
        return F.struct(*(v.alias(c) for c, v in h.items()))

    hulls = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), ends)
    return cut.select(*names, F.filter(hulls, lambda h: F.coalesce(h["t_end"] - h["t_start"] > min_aln_length, F.lit(False))).alias("hulls"))


def placed_ends(hulls: DataFrame, sequences: DataFrame, ends: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """pos: these ends of both sides of all ``local_hulls``, in concatenated positions, with repeats. A row a side moves, once."""
    side = lambda s: F.struct(F.col(f"{s}_name").alias("name"), F.concat(*(F.col(f"hulls.{s}_{e}") for e in ends)).alias("places"))
    sides = hulls.select(F.explode(F.array(side("q"), side("t"))).alias("s")).select("s.*")
    met = sides.join(sequences.select("name", "offset"), "name")
    return met.select("offset", F.explode_outer("places").alias("place")).where("place is not null").select((F.col("place") + F.col("offset")).alias("pos"))


def mirror(parts: DataFrame) -> DataFrame:
    """Both directions of every part with its hull: ``dir`` 0 and 1, each with its own ``blocks`` and the other's as ``sym``."""
    both = parts.withColumn("dir", F.explode(F.array(F.lit(0), F.lit(1))))
    there = mirrored_blocks(F.col("blocks"), F.col("strand"))
    side = lambda one, other: F.when(F.col("dir") == 0, one).otherwise(other)
    ends = {a: side(F.col(a), F.col(b)) for a, b in (("q_start", "t_start"), ("q_end", "t_end"), ("t_start", "q_start"), ("t_end", "q_end"))}
    return both.select("aln_id", "part", "strand", "dir", side(F.col("blocks"), there).alias("blocks"), side(there, F.col("blocks")).alias("sym"), *(v.alias(k) for k, v in ends.items()))


def normalise(psl: DataFrame, config: SegmentationConfig) -> tuple[DataFrame, DataFrame]:
    """Sequences and two-way alignments of PSL rows."""
    good = identity_filter(psl, config.min_ident)
    sequences = sequence_offsets(good)
    parts = gap_split(without_zero_blocks(global_blocks(offset_join(good, sequences))), config.max_gap, config.min_aln_length)
    return sequences, mirror(parts)


def block_extrema(alignments: DataFrame) -> DataFrame:
    """One row: the greatest block size and the greatest block start within its alignment's hull."""
    local = F.array_max(F.transform("blocks", lambda b: F.greatest(b["t"] - F.col("t_start"), F.when(F.col("strand") == "+", b["q"] - F.col("q_start")).otherwise(F.col("q_end") - b["q"]))))
    size = F.array_max(F.transform("blocks", lambda b: b["size"]))
    return alignments.select(size.alias("s"), local.alias("l")).agg(F.max("s").alias("max_block_size"), F.max("l").alias("max_local_start"))


def fit_check(alignments: DataFrame, most: int = 65_535) -> DataFrame:
    """Per aln_id that has one: how many block sizes and local target starts exceed ``most``, and the first."""
    b = alignments.where("dir = 0").select("aln_id", "part", F.posexplode(F.transform("blocks", lambda b: F.array(b["size"], b["t"] - F.col("t_start")))).alias("k", "v"))
    v = b.select("aln_id", "part", "k", F.posexplode("v").alias("w", "value")).where(F.col("value") > most)
    return v.groupBy("aln_id").agg(F.count("*").alias("n_over"), F.min_by("value", F.struct("part", "k", "w")).alias("first_over"))
