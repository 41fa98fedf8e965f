"""Queries over the tables, and the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave import fixtures
from genoweave.config import SegmentationConfig
from genoweave.functions.blocks import coverage
from genoweave.operators import graph, intervals, normalize, ordered, truth, weighted
from genoweave.operators.closure import closed_table
from genoweave.plans.durable import shared_folder, write_table
from genoweave.plans.segmentation import RunStats, segment, segmentation, step
from genoweave.sources import fasta, psl

CONFIG = SegmentationConfig()
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Stages:
    """The stages of one session and folder, each built once per call."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.psl = fixtures.psl_rows(spark, sf_dir)
        self.good = write_table(normalize.identity_filter(self.psl, CONFIG.min_ident), "good")
        self.sequences = write_table(normalize.sequence_offsets(self.good), "sequences")
        self.placed = normalize.offset_join(self.good, self.sequences)
        self.blocks = normalize.global_blocks(self.placed)
        self.parts = normalize.gap_split(normalize.without_zero_blocks(self.blocks), CONFIG.max_gap, CONFIG.min_aln_length)

    def stored(self) -> Stages:
        """Alignments, waste and atoms as tables."""
        self.alignments = write_table(normalize.mirror(self.parts).drop("sym"), "alignments")
        return self._waste(self.alignments.where("dir = 0"))

    def _waste(self, ends: DataFrame) -> Stages:
        points = intervals.all_ends(ends, self.sequences, BOTH).select(F.col("pos").alias("first"), F.col("pos").alias("last"))
        self.waste, self.atoms = _waste_and_atoms(write_table(intervals.islands_in_order(points, CONFIG.min_length), "regions"))
        return self

    def lifted(self, *columns: str) -> DataFrame:
        """Lifted atoms as a table: their pair, where they fall, and ``columns``."""
        return write_table(graph.lift_atoms(self.atoms, self.alignments).select(*PAIR, "m_first", "m_last", *columns), "lifted")

    def edges(self) -> DataFrame:
        return graph.graph_edges(graph.choose_atom(self.lifted("first", "last", "strand", "q_start", "q_end", "t_start", "t_end"), self.waste), CONFIG.min_ident)


def _waste_and_atoms(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    atoms = regions.where("reach is not null").select(F.col("region_id").alias("atom_nr"), F.col("reach").alias("first"), F.col("first").alias("last"))
    return regions.select("region_id", "first", "last"), atoms


class Hulls:
    """The ends of the parts, for what needs no blocks: near ones are merged before they go into the order of all positions."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        good = normalize.identity_filter(fixtures.psl_rows(spark, sf_dir), CONFIG.min_ident)
        self.hulls = write_table(normalize.local_hulls(good, CONFIG.max_gap, CONFIG.min_aln_length), "hulls")
        self.sequences = write_table(normalize.sequence_offsets(self.hulls), "sequences")
        self.starts = self.sequences.select(F.explode(F.array("offset", F.col("offset") + F.col("size"))).alias("pos"))

    def ends(self, *ends: str) -> DataFrame:
        return normalize.placed_ends(self.hulls, self.sequences, ends)

    def islands(self, points: DataFrame, length: int = 0) -> DataFrame:
        """Islands of the regions of this length that begin at ``points``."""
        regions = points.select(F.col("pos").alias("first"), (F.col("pos") + length).alias("last"))
        runs = write_table(intervals.runs_within(regions, CONFIG.min_length), "runs")
        return intervals.islands_in_order(runs, CONFIG.min_length, intervals.RUN_CHUNK)

    def waste_and_atoms(self) -> tuple[DataFrame, DataFrame]:
        return _waste_and_atoms(write_table(self.islands(self.ends("start", "end").unionByName(self.starts)), "regions"))


BOTH = ("t_start", "t_end", "q_start", "q_end")
HULL = ["aln_id", "part", "strand", "q_start", "q_end", "t_start", "t_end"]
HULL_KEY = [*graph.KEY, "t_start", "t_end"]
PAIR = ["atom_nr", "aln_id", "part", "dir"]


def _shown(parts: DataFrame) -> DataFrame:
    return parts.withColumn("n_blocks", F.size("blocks"))


@query
def psl_scan(spark, sf_dir):
    rows = psl.parse_lines(fixtures.psl_lines(fixtures.psl_rows(spark, sf_dir)))
    return rows.select("line_no", "matches", "mismatches", "strand", "q_name", "q_size", "t_name", "block_count", F.aggregate("t_starts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_t"), F.aggregate("q_starts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_q"))


@query
def psl_raw_scan(spark, sf_dir):
    rows = psl.parse_lines(fixtures.psl_lines(fixtures.psl_rows(spark, sf_dir)), "contains_##")
    return rows.select("line_no", "t_size", F.array_join(F.transform("block_sizes", lambda x: x.cast("string")), ",").alias("sizes"))


@query
def psl_files(spark, sf_dir):
    """The lines written as text files, listed in a file, and read back in the list's order."""
    folder = f"{shared_folder(spark)}/psl-{uuid.uuid4().hex}"
    lines = fixtures.psl_lines(fixtures.psl_rows(spark, sf_dir)).repartitionByRange(8, "line_no").sortWithinPartitions("line_no")
    lines.select("value").write.text(f"{folder}/lines")
    listed = spark.read.text(f"{folder}/lines").select(F.col("_metadata.file_path").alias("value")).distinct()
    listed.coalesce(1).sortWithinPartitions("value").write.text(f"{folder}/list")
    rows = psl.read_psl(spark, psl.paths_in(spark, f"{folder}/list"))
    rows = ordered.running_sum(rows, F.lit(1), ["aln_id"], "place")
    return rows.select("place", "matches", "strand", "q_name", "q_size", "t_name", "block_count", F.element_at("t_starts", -1).alias("last_t"))


@query
def fasta_files(spark, sf_dir):
    """Gene records written as FASTA and read back."""
    folder = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    genes = fixtures.gene_records(spark, sf_dir)
    header = F.format_string("G%d_SE%03d, sequence type: dna, locus: %d", F.col("doc_id"), F.col("genome"), F.col("locus"))
    fasta.write_fasta(genes.select(header.alias("header"), "seq"), folder)
    return fasta.gene_headers(fasta.read_fasta(spark, folder)).select("id", "seq_type", "locus", "seq")


@query
def genome_order(spark, sf_dir):
    names = fixtures.table(spark, sf_dir, "supplier").select(F.concat(F.lit("sim/SE"), F.col("s_suppkey") * 37 % 1009, F.lit("_dna_"), F.col("s_suppkey"), F.lit(".fa")).alias("file"))
    return fasta.in_genome_order(names, "file")


@query
def identity_filter(spark, sf_dir):
    return Stages(spark, sf_dir).good.select("aln_id", (F.col("matches") + F.col("rep_matches")).alias("good"), (F.col("matches") + F.col("rep_matches") + F.col("mismatches")).alias("total"))


@query
def sequence_offsets(spark, sf_dir):
    return Stages(spark, sf_dir).sequences


@query
def offset_join(spark, sf_dir):
    return Stages(spark, sf_dir).placed.select("aln_id", "q_name", "t_name", "q_offset", "t_offset")


@query
def block_explode(spark, sf_dir):
    b = Stages(spark, sf_dir).blocks.select("aln_id", F.posexplode_outer("blocks").alias("k", "b")).where("k is not null")  # see ``gap_split`` for outer
    return b.select("aln_id", "k", "b.size", "b.q", "b.t")


@query
def zero_block_removal(spark, sf_dir):
    out = _shown(normalize.hull(normalize.remove_zero_blocks(Stages(spark, sf_dir).blocks)))
    return out.select("aln_id", "strand", "q_start", "q_end", "t_start", "t_end", "n_blocks")


@query
def gap_split(spark, sf_dir):
    return _shown(Stages(spark, sf_dir).parts).select(*HULL, "n_blocks")


@query
def mirror(spark, sf_dir):
    return _shown(normalize.mirror(Stages(spark, sf_dir).parts)).select(*HULL, "dir", "n_blocks")


@query
def block_extrema(spark, sf_dir):
    return normalize.block_extrema(normalize.mirror(Stages(spark, sf_dir).parts))


@query
def fit_check(spark, sf_dir):
    return normalize.fit_check(normalize.mirror(Stages(spark, sf_dir).parts), 1500)


@query
def zero_block_report(spark, sf_dir):
    out = psl.zero_block_report(Stages(spark, sf_dir).good, ["q_name"], "aln_id")
    return out.select("q_name", "n_lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query
def breakpoints(spark, sf_dir):
    s = Hulls(spark, sf_dir)
    return s.ends("start", "end").unionByName(s.starts).distinct()


@query
def initial_waste(spark, sf_dir):
    return Hulls(spark, sf_dir).waste_and_atoms()[0]


@query
def consolidate(spark, sf_dir):
    s = Hulls(spark, sf_dir)
    return s.islands(s.ends("start"), 100).select("region_id", "first", "last")


@query
def events_islands(spark, sf_dir):
    """Gaps and islands on another table: all event times, at most a minute apart."""
    return intervals.islands(fixtures.table(spark, sf_dir, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos")).where("pos is not null").distinct(), 60)


@query
def atoms(spark, sf_dir):
    return Hulls(spark, sf_dir).waste_and_atoms()[1]


@query
def containment_join(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return graph.contained_atoms(s.atoms, s.alignments.select(*HULL_KEY)).select(*PAIR)


@query
def lift_over(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return graph.lift_atoms(s.atoms, s.alignments).select(*PAIR, "m_first", "m_last")


@query
def asof_region(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return intervals.asof(s.lifted().select(*PAIR, "m_first"), "m_first", s.waste, "first", "region_id", "region_id").select(*PAIR, "region_id")


@query
def overlap_join(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return intervals.overlap_join(s.lifted().select(*PAIR, "m_first", "m_last"), s.waste, "m_first", "m_last").select(*PAIR, "region_id")


def _induced(s: Stages) -> DataFrame:
    return graph.induced_intervals(s.lifted("first", "last", "strand"), s.atoms, s.waste, s.alignments)


@query
def induced_intervals(spark, sf_dir):
    return _induced(Stages(spark, sf_dir).stored())


@query
def interval_partition(spark, sf_dir):
    return intervals.minimal_maximal(_induced(Stages(spark, sf_dir).stored()), "atom_nr")


@query
def choose_atom(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return graph.choose_atom(s.lifted(), s.waste).select(*PAIR, "j")


@query
def coverages(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    c = graph.choose_atom(s.lifted("q_start", "q_end"), s.waste)
    return c.select(*PAIR, coverage(F.col("j_first"), F.col("j_last"), F.col("q_start"), F.col("q_end")).cast("double").alias("cover"))


@query
def atom_graph(spark, sf_dir):
    return Stages(spark, sf_dir).stored().edges()


@query
def component_labels(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return graph.component_labels(s.atoms, write_table(s.edges(), "edges")).select("atom_nr", "class_nr")


@query
def signed_classes(spark, sf_dir):
    """Classes and strands of the atoms between the initial waste."""
    s = Stages(spark, sf_dir).stored()
    return graph.classes(s.atoms, write_table(s.edges(), "edges")).select("atom_nr", "class_nr", "strand")


@query
def reoptimise(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return step(s.waste, s.alignments, CONFIG)


@query
def segmentation_waste(spark, sf_dir):
    s = Stages(spark, sf_dir).stored()
    return segmentation(s.sequences, s.alignments, CONFIG)


@query
def atoms_report(spark, sf_dir):
    return segment(fixtures.psl_rows(spark, sf_dir), CONFIG)


@query
def run_stats(spark, sf_dir):
    stats = RunStats()
    segment(fixtures.psl_rows(spark, sf_dir), CONFIG, stats)
    return spark.createDataFrame([(k, n) for k, n in enumerate(stats.waste)], "iteration int, waste long").withColumn("alignments", F.lit(stats.alignments)).withColumn("sequences", F.lit(stats.sequences))


@query
def min_match_filter(spark, sf_dir):
    return weighted.min_match_filter(fixtures.psl_rows(spark, sf_dir), 850).select("aln_id", "matches")


def _block_pairs(spark, sf_dir) -> DataFrame:
    """Block pairs of all rows with a hundred matches or more, whatever their identity, in their own concatenated positions."""
    rows = weighted.min_match_filter(fixtures.psl_rows(spark, sf_dir), 100)
    return weighted.block_pairs(normalize.offset_join(rows, normalize.sequence_offsets(rows)))


def _seeds(spark, sf_dir) -> DataFrame:
    """The seeds of ``_block_pairs``, which need no pairs."""
    sides = write_table(weighted.side_blocks(weighted.min_match_filter(fixtures.psl_rows(spark, sf_dir), 100)), "sides")
    return weighted.placed_seeds(sides, write_table(normalize.sequence_offsets(sides), "sequences"))


@query
def block_pairs(spark, sf_dir):
    return _block_pairs(spark, sf_dir)


@query
def stab_join(spark, sf_dir):
    pairs = write_table(_block_pairs(spark, sf_dir), "pairs")
    hits = intervals.stab_join(weighted.seeds(pairs), pairs, repeats=True)
    return hits.select("pos", "aln_id", "k")


@query
def bp_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir).groupBy("pos").agg(F.count("*").alias("n"))


@query
def bp_closure(spark, sf_dir):
    return weighted.closure(write_table(_block_pairs(spark, sf_dir), "pairs"))


def _closed(spark, sf_dir) -> DataFrame:
    return closed_table(write_table(_block_pairs(spark, sf_dir), "pairs"))


def _strong(spark, sf_dir) -> DataFrame:
    """The strong ones of ``bp_weights``, stored."""
    return write_table(weighted.closed_weights(_closed(spark, sf_dir), weighted.SEGMENT_COST), "weights")


@query
def bp_weights(spark, sf_dir):
    return weighted.closed_weights(_closed(spark, sf_dir))


@query
def segment_edges(spark, sf_dir):
    """All edges, summed by problem and kind: there are a few hundred to a node."""
    edges = weighted.segment_edges(_strong(spark, sf_dir))
    return edges.groupBy("problem", "closes").agg(F.count("*").alias("n_edges"), F.sum("cost").cast("bigint").alias("sum_cost"), F.sum(F.col("src") * 7 + F.col("dst") * 13).cast("bigint").alias("sum_ends"))


@query
def segment_paths(spark, sf_dir):
    return _paths(_strong(spark, sf_dir))


def _paths(nodes: DataFrame) -> DataFrame:
    """Paths as text; -1 is the cost where there is no way."""
    out = weighted.shortest_paths(nodes)
    return out.select("problem", F.coalesce(F.array_join(F.transform("path", lambda x: x.cast("string")), ","), F.lit("")).alias("path"), F.coalesce("cost", F.lit(-1)).alias("cost"))


def _seed_weights(spark, sf_dir) -> DataFrame:
    return write_table(weighted.weights(ordered.counted(_seeds(spark, sf_dir), "pos", "n")), "weights")


@query
def seed_weights(spark, sf_dir):
    """Weights, and below edges and paths, of the seeds alone: the same operators on a table a twentieth as large."""
    return _seed_weights(spark, sf_dir)


@query
def seed_edges(spark, sf_dir):
    return weighted.segment_edges(weighted.strong(_seed_weights(spark, sf_dir)))


@query
def seed_paths(spark, sf_dir):
    return _paths(weighted.strong(_seed_weights(spark, sf_dir)))


#: Letters of a chunk in the genome queries, small so that the tables' genomes have several.
GENOME_CHUNK = 6000


@query
def revcomp(spark, sf_dir):
    return fixtures.gene_records(spark, sf_dir).select("doc_id", fasta.reverse_complement(F.col("seq")).alias("seq"))


@query
def assemble_dna(spark, sf_dir):
    return fasta.assemble(fixtures.gene_records(spark, sf_dir), "genome", GENOME_CHUNK)


@query
def genome_files(spark, sf_dir):
    """Genomes assembled, written as FASTA and read back, in chunks throughout."""
    folder = f"{shared_folder(spark)}/genomes-{uuid.uuid4().hex}"
    chunks = fasta.assemble(fixtures.gene_records(spark, sf_dir), "genome", GENOME_CHUNK)
    fasta.write_sequences(chunks.select(F.col("genome").alias("place"), F.concat(F.lit("genome "), "genome").alias("header"), "chunk", "letters"), folder)
    records, found = fasta.scan_sequences(spark, folder, GENOME_CHUNK, one=True)
    return found.join(records, ["file", "record"]).select(F.substring_index("header", " ", -1).cast("bigint").alias("genome"), "chunk", "letters")


@query
def turned_genomes(spark, sf_dir):
    """Reverse complements of whole genomes, chunk by chunk."""
    chunks = fasta.assemble(fixtures.gene_records(spark, sf_dir), "genome", GENOME_CHUNK)
    chunks = write_table(chunks.withColumn("start", F.col("chunk") * GENOME_CHUNK), "chunks")
    sizes = chunks.groupBy("genome").agg(F.sum(F.length("letters")).alias("n"))
    return fasta.chunked(fasta.turned(chunks.join(sizes, "genome"), "n"), ["genome"], GENOME_CHUNK)


@query
def seq_type_flags(spark, sf_dir):
    headers = fixtures.table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_size") > 25, "marker_").otherwise("intermarker_"), F.col("p_partkey")).alias("header"))
    return fasta.sequence_flags(headers)


@query
def homology_edges(spark, sf_dir):
    return truth.homology_edges(fixtures.homology_matrix(spark, sf_dir))


@query
def homology_file(spark, sf_dir):
    """The matrix written as a homology file and read back."""
    path = f"{shared_folder(spark)}/homology-{uuid.uuid4().hex}"
    fasta.write_homology(fixtures.homology_matrix(spark, sf_dir), path)
    return truth.homology_edges(fasta.read_homology(spark, path))


@query
def homology_classes(spark, sf_dir):
    return truth.homology_classes(truth.homology_edges(fixtures.homology_matrix(spark, sf_dir)))


@query
def right_neighbors(spark, sf_dir):
    return truth.right_neighbours(fixtures.simulated_genes(spark, sf_dir))


@query
def segment_truth(spark, sf_dir):
    genes = fixtures.simulated_genes(spark, sf_dir)
    return truth.segment_truth(genes.withColumn("positions", F.array("pos")))


@query
def merged_families(spark, sf_dir):
    return truth.segment_truth(truth.merge_families(fixtures.simulated_genes(spark, sf_dir)))


#: The stages in SQL, as common table expressions that a query cuts off where it needs.
_CTES = {
    "psl": """select l_orderkey * 8 + l_linenumber as aln_id, strand, 1000 - 30 * d as matches, 30 * d as mismatches,
        'S' || (l_orderkey // 10) as q_name, 'S' || (p * 3 // 4) as t_name, 1 + l_linenumber % 3 as n, 600 + 100 * (l_linenumber % 4) as bs, q % 20 as gap,
        1000 * (p * 7 % 190) + 20 * (s % 3) as t0, 1000 * (l_orderkey * 3 % 190) + 20 * (l_linenumber % 3) as q0, (l_linenumber = 7)::int as z
        from (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s, trunc(min(l_quantity))::int as q, round(min(l_discount) * 100)::int as d,
            min(case when l_returnflag = 'R' then '-' else '+' end) as strand from lineitem group by all)""",
    "raw": """select *, case when k < n then bs else 0 end as size, t0 + k * (bs + gap) as t_psl,
        case when strand = '+' then q0 + k * (bs + gap) when k < n then 200000 - (q0 + (n - 1 - k) * (bs + gap) + bs) else 200000 - q0 end as q_psl
        from (select *, unnest(range(n + z)) as k from psl)""",
    "good": "select * from psl where matches > 0 and matches::float / (matches + mismatches)::float >= 80::float / 100::float",
    "seq": """select name, 200000::bigint as size, row_number() over (order by o) - 1 as seq_idx, (row_number() over (order by o) - 1) * 200000 as "offset"
        from (select name, min(o) as o from (select q_name as name, aln_id * 2 as o from good union all select t_name, aln_id * 2 + 1 from good) group by name)""",
    "blk": """select r.aln_id, r.strand, r.k, r.size, case when r.strand = '+' then r.q_psl + a."offset" else 200000 - r.q_psl + a."offset" end as q, r.t_psl + b."offset" as t,
        r.q_psl + a."offset" as q_plain from raw r semi join good g on r.aln_id = g.aln_id join seq a on a.name = r.q_name join seq b on b.name = r.t_name""",
    "cut": """select *, coalesce(sum((g < 0 or g > 13 or h < 0 or h > 13)::int) over (partition by aln_id order by k), 0) as part from (
        select *, t - lag(t + size) over w as g, case when strand = '+' then q - lag(q + size) over w else lag(q - size) over w - q end as h
        from blk where size > 0 window w as (partition by aln_id order by k))""",
    "part": """select aln_id, part::int as part, strand, min(case when strand = '+' then q else q - size end) as q_start, max(case when strand = '+' then q + size else q end) as q_end,
        min(t) as t_start, max(t + size) as t_end, count(*)::int as n_blocks from cut group by all having max(t + size) - min(t) > 13""",
    "aln": """select *, 0 as dir from part union all select aln_id, part, strand, t_start, t_end, q_start, q_end, n_blocks, 1 from part""",
    "mblk": """select aln_id, part::int as part, strand, 0 as dir, size, q, t from cut semi join part using (aln_id, part)
        union all select aln_id, part::int, strand, 1, size, case when strand = '+' then t else t + size end, case when strand = '+' then q else q - size end from cut semi join part using (aln_id, part)""",
    "bp": """select "offset" as pos from seq union select "offset" + size from seq union select t_start from aln union select t_end from aln""",
    "waste": """select (row_number() over (order by first) - 1) as region_id, first, last from (select min(pos) as first, max(pos) as last from (
        select pos, sum(f) over (order by pos) as g from (select pos, (coalesce(pos - lag(pos) over (order by pos), 251) > 250)::int as f from bp)) group by g)""",
    "atom": "select * from (select region_id + 1 as atom_nr, last as first, lead(first) over (order by first) as last from waste) where last is not null",
    "pair": """select a.atom_nr, a.first, a.last, n.aln_id, n.part, n.dir, n.strand, n.q_start, n.q_end, n.t_start, n.t_end from atom a join aln n on n.t_start <= a.first and n.t_end >= a.last""",
    "ends": """select atom_nr, aln_id, part, dir, e, case when strand = '+' then bq + least(greatest(e - bt, 0), bs) else bq - least(greatest(e - bt, 0), bs) end as m from (
        select p.atom_nr, p.aln_id, p.part, p.dir, p.strand, p.e, coalesce(max(b.t) filter (b.t <= p.e), min(b.t)) as bt,
            coalesce(arg_max(b.q, b.t) filter (b.t <= p.e), arg_min(b.q, b.t)) as bq, coalesce(arg_max(b.size, b.t) filter (b.t <= p.e), arg_min(b.size, b.t)) as bs
        from (select atom_nr, aln_id, part, dir, strand, first as e from pair union all select atom_nr, aln_id, part, dir, strand, last from pair) p
        join mblk b using (aln_id, part, dir) group by p.atom_nr, p.aln_id, p.part, p.dir, p.strand, p.e)""",
    "lifted": """select p.*, m.m_first, m.m_last from pair p join (select atom_nr, aln_id, part, dir, min(m) as m_first, max(m) as m_last from ends group by all) m using (atom_nr, aln_id, part, dir)""",
    "over": "select l.*, w.region_id, w.first as w_first, w.last as w_last from lifted l join waste w on w.first <= l.m_last and w.last >= l.m_first",
    "back": """select atom_nr, first, last, min(x) as x, max(x) as y from (select o.atom_nr, o.aln_id, o.part, o.dir, o.region_id, o.first, o.last, o.e,
            case when o.strand = '+' then bq + least(greatest(e - bt, 0), bs) else bq - least(greatest(e - bt, 0), bs) end as x from (
        select p.atom_nr, p.aln_id, p.part, p.dir, p.region_id, p.first, p.last, p.strand, p.e, coalesce(max(b.t) filter (b.t <= p.e), min(b.t)) as bt,
            coalesce(arg_max(b.q, b.t) filter (b.t <= p.e), arg_min(b.q, b.t)) as bq, coalesce(arg_max(b.size, b.t) filter (b.t <= p.e), arg_min(b.size, b.t)) as bs
        from (select *, w_first as e from over union all select *, w_last from over) p join mblk b on b.aln_id = p.aln_id and b.part = p.part and b.dir = 1 - p.dir
        group by p.atom_nr, p.aln_id, p.part, p.dir, p.region_id, p.first, p.last, p.strand, p.e) o) group by atom_nr, aln_id, part, dir, region_id, first, last""",
    "induced": """select atom_nr, greatest(x, first) as first, least(y, last) as last from back where not (y < first) and not (x > last)
        union select atom_nr, first, first from atom union select atom_nr, last, last from atom""",
    "small": "select *, not exists (select 1 from induced b where b.atom_nr = a.atom_nr and b.first >= a.first and b.last <= a.last and (b.first, b.last) <> (a.first, a.last)) as minimal from induced a",
    "split": """select *, not minimal and not exists (select 1 from small b where b.atom_nr = a.atom_nr and not b.minimal and b.first <= a.first and b.last >= a.last
        and (b.first, b.last) <> (a.first, a.last)) as maximal from small a""",
    "located": """select l.*, coalesce(f.region_id, 0) as rf, coalesce(g.region_id, 0) as rl from lifted l asof left join waste f on f.first <= l.m_first asof left join waste g on g.first <= l.m_last""",
    "chosen": """select d.*, a.last as j_first, b.first as j_last from (
            select * exclude (credit, k), k as j from (select o.*, case when rl - rf <= 1 then 0 when k = rf then b.first - m_first when k = rl - 1 then greatest(m_last - b.last, 0) else b.first - a.last + 1 end as credit
                from (select *, unnest(range(rf, greatest(rl, rf + 1))) as k from located) o left join waste a on a.region_id = o.k left join waste b on b.region_id = o.k + 1)
            qualify row_number() over (partition by atom_nr, aln_id, part, dir order by credit desc, k) = 1) d
        join waste a on a.region_id = d.j join waste b on b.region_id = d.j + 1""",
    "cover": """select *, (least(j_last, q_end) - greatest(j_first, q_start))::float / greatest(j_last - j_first, 1)::float as c1,
        (least(j_last, m_last) - greatest(j_first, m_first)) as c2, (least(j_last, t_end) - greatest(j_first, t_start))::float / greatest(j_last - j_first, 1)::float as c3,
        (least(last, q_end) - greatest(first, q_start))::float / greatest(last - first, 1)::float as c4 from chosen""",
    "edge": """select i, j, sum(s)::bigint as weight from (select atom_nr - 1 as i, j, case when strand = '+' then 1 else -1 end as s, c1, c2, c3, c4 from cover
        union all select j, atom_nr - 1, case when strand = '+' then 1 else -1 end, c1, c2, c3, c4 from cover)
        where c1 >= 80::float / 100::float and c2 > 0 and not (c3 >= 80::float / 100::float and c4 >= 80::float / 100::float) group by i, j""",
    "many": "select * from psl where matches >= 100",
    "mseq": """select name, (row_number() over (order by o) - 1) * 200000 as "offset"
        from (select name, min(o) as o from (select q_name as name, aln_id * 2 as o from many union all select t_name, aln_id * 2 + 1 from many) group by name)""",
    "mblk2": """select r.aln_id, r.k, r.size, r.q_psl + a."offset" as q_plain, r.t_psl + b."offset" as t
        from raw r semi join many g on r.aln_id = g.aln_id join mseq a on a.name = r.q_name join mseq b on b.name = r.t_name""",
    "bpair": """select aln_id, k::int as k, lo, lo + size as hi, other, other + size as other_hi from (select aln_id, k, size::bigint as size,
        case when f then t else q_plain end as lo, case when f then q_plain else t end as other from (
            select *, first_value(q_plain) over w > first_value(t) over w as f from mblk2 window w as (partition by aln_id order by k))) where size > 400""",
    "seed": "select unnest([lo, hi, other, other_hi]) as pos from bpair",
    "multi": "select pos, count(*) as n from seed group by pos",
    "span": "select lo, hi, other, unnest(range(lo // 1000, hi // 1000 + 1)) as bin from bpair",
    "known": "select distinct pos from seed union select s.other + k.pos - s.lo from known k join span s on s.bin = k.pos // 1000 and k.pos > s.lo and k.pos < s.hi",
    "closed": """select pos, count(*) as n from (select pos from seed union all select s.other + k.pos - s.lo from known k join span s on s.bin = k.pos // 1000 and k.pos > s.lo and k.pos < s.hi) group by pos""",
    "weight": "select pos, (1 + 20 * (n - 1) + greatest(coalesce(20 - (lead(pos) over (order by pos) - pos), 0), 0))::bigint as weight from closed",
    "node": """select *, sum(weight) over (order by pos) as upto, lag(pos) over (order by pos) as prev, lead(pos) over (order by pos) as nxt, min(pos) over () as head from weight where weight >= 40""",
    "prob": """select *, (sum(ends::int) over (order by pos))::bigint as problem from (select *, coalesce(nxt - prev > 400, false) and pos > head + 400 as ends from node)""",
    "bins": "select *, unnest([pos // 1200, pos // 1200 + 1]) as bin from prob",
    "step": """select a.problem, a.pos::bigint as src, b.pos::bigint as dst, (40 + b.upto - b.weight - a.upto)::bigint as cost, false as closes
        from bins a join prob b on a.bin = b.pos // 1200 and b.pos - a.pos >= 400 and b.pos - a.pos < 1200 where a.problem < (select max(problem) from prob)
        union all select e.problem - 1, a.pos::bigint, e.pos::bigint, (40 + e.upto - e.weight - a.upto)::bigint, true from (select *, pos - 400 as beyond from prob where ends) e asof join prob a on e.beyond > a.pos""",
}

_NEEDS = {
    "psl": [], "raw": ["psl"], "good": ["psl"], "seq": ["good"], "blk": ["raw", "seq"], "cut": ["blk"], "part": ["cut"], "aln": ["part"], "mblk": ["part"], "bp": ["aln"], "waste": ["bp"],
    "atom": ["waste"], "pair": ["atom"], "ends": ["pair", "mblk"], "lifted": ["ends"], "over": ["lifted"], "back": ["over"], "induced": ["back"], "small": ["induced"], "split": ["small"],
    "located": ["lifted"], "chosen": ["located"], "cover": ["chosen"], "edge": ["cover"], "many": ["psl"], "mseq": ["many"], "mblk2": ["raw", "mseq"], "bpair": ["mblk2"], "seed": ["bpair"], "multi": ["seed"], "span": ["bpair"], "known": ["seed", "span"], "closed": ["known"], "weight": ["closed"], "node": ["weight"], "prob": ["node"], "bins": ["prob"], "step": ["bins"],
}


#: The same from the seeds alone.
for _name in ("weight", "node", "prob", "bins", "step"):
    _CTES[f"seed_{_name}"] = re.sub(r"\b(from|join) (weight|node|prob|bins)\b", r"\1 seed_\2", _CTES[_name].replace("from closed", "from multi"))
    _NEEDS[f"seed_{_name}"] = ["multi" if n == "closed" else f"seed_{n}" for n in _NEEDS[_name]]


def _sql(last: str, body: str, recursive: str = "") -> str:
    """``body`` over the stage ``last`` and all that it needs; each stage is computed once."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in last.split():
        add(name)
    ctes = ", ".join(f"{n} as materialized ({_CTES[n]})" for n in wanted)
    return f"with recursive {ctes}{', ' + recursive if recursive else ''} {body}"


def _path_sql(edges: str) -> str:
    """Least costs by rounds, then the way back from each end over the least of equally good sources."""
    return _sql(
        edges,
        """select problem, case when hi - lo < 400 then ((lo + hi) // 2)::varchar else coalesce(path, '') end as path, (case when hi - lo < 400 then 0 else coalesce(b.cost, -1) end)::bigint as cost
        from reach left join best b on b.p = problem and b.node = hi left join (select p, string_agg(node::varchar, ',' order by node) as path from walk group by p) w on w.p = problem""",
        f"""reach as materialized (select problem, coalesce(min(src) filter (not closes), min(src)) as lo, max(dst) filter (closes) as hi from {edges} group by problem),
        best(p, node, cost) using key (p, node) as (select problem, lo, 0::bigint from reach
            union select e.problem, e.dst, min(b.cost + e.cost) from best b join {edges} e on e.problem = b.p and e.src = b.node
                left join recurring.best c on c.p = e.problem and c.node = e.dst where c.cost is null or b.cost + e.cost < c.cost group by e.problem, e.dst),
        prior as materialized (select e.problem as p, e.dst, min(e.src) as src from {edges} e join best a on a.p = e.problem and a.node = e.src join best b on b.p = e.problem and b.node = e.dst
            where a.cost + e.cost = b.cost group by e.problem, e.dst),
        walk(p, node) as (select problem, hi from reach join best b on b.p = problem and b.node = hi union select w.p, q.src from walk w join prior q on q.p = w.p and q.dst = w.node)""",
    )


HOMOLOGY_SQL = """select distinct least(g, h) as g1, (case when g <= h then x else y end)::int as x, greatest(g, h) as g2, (case when g <= h then y else x end)::int as y from (
    select (l_suppkey % 5)::int as g, l_partkey as x, lead((l_suppkey % 5)::int) over w as h, lead(l_partkey) over w as y from lineitem
    window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) where h is not null"""


def _genome_sql(letters: str) -> str:
    """Genomes as whole strings, then cut."""
    return f"""with whole as (select genome, string_agg(case when doc_id % 3 = 0 then translate(reverse(s), 'ACGT', 'TGCA') else s end, '' order by doc_id) as seq
            from (select doc_id // 20 as genome, doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as s from documents) group by genome),
        cut as (select genome, {letters} as seq, unnest(range((length(seq) + 5999) // 6000)) as chunk from whole)
        select genome, chunk, substr(seq, chunk * 6000 + 1, 6000) as letters from cut"""


ORACLES: dict[str, str] = {
    "psl_scan": _sql("raw", "select aln_id as line_no, matches, mismatches, strand, q_name, 200000::bigint as q_size, t_name, (n + z)::int as block_count, sum(t_psl)::bigint as sum_t, sum(q_psl)::bigint as sum_q from raw group by all"),
    "psl_raw_scan": _sql("raw", "select aln_id as line_no, 200000::bigint as t_size, string_agg(size::varchar, ',' order by k) as sizes from raw group by aln_id"),
    "psl_files": _sql("raw", """select row_number() over (order by aln_id) as place, matches, strand, q_name, 200000::bigint as q_size, t_name, block_count, last_t
        from (select aln_id, matches, strand, q_name, t_name, (n + z)::int as block_count, max(t_psl)::bigint as last_t from raw group by all)"""),
    "fasta_files": """select 'G' || doc_id || '_SE' || case when doc_id // 20 < 1000 then lpad((doc_id // 20)::varchar, 3, '0') else (doc_id // 20)::varchar end as id, 'dna' as seq_type, (case when doc_id % 3 = 0 then -doc_id - 1 else doc_id + 1 end)::int as locus,
        regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as seq from documents""",
    "genome_order": """select *, row_number() over (order by genome, file) - 1 as place from (
        select 'sim/SE' || (s_suppkey * 37 % 1009) || '_dna_' || s_suppkey || '.fa' as file, s_suppkey * 37 % 1009 as genome from supplier)""",
    "identity_filter": _sql("good", "select aln_id, matches as good, matches + mismatches as total from good"),
    "sequence_offsets": _sql("seq", 'select name, size, seq_idx::int as seq_idx, "offset"::bigint as "offset" from seq'),
    "offset_join": _sql("seq", 'select g.aln_id, g.q_name, g.t_name, a."offset"::bigint as q_offset, b."offset"::bigint as t_offset from good g join seq a on a.name = g.q_name join seq b on b.name = g.t_name'),
    "block_explode": _sql("blk", "select aln_id, k::int as k, size::bigint as size, q::bigint as q, t::bigint as t from blk"),
    "zero_block_removal": _sql("blk", "select aln_id, strand, min(case when strand = '+' then q else q - size end) as q_start, max(case when strand = '+' then q + size else q end) as q_end, min(t) as t_start, max(t + size) as t_end, count(*)::int as n_blocks from blk where size > 0 group by all"),
    "gap_split": _sql("part", "select * from part"),
    "mirror": _sql("aln", "select * from aln"),
    "block_extrema": _sql("aln mblk", "select max(size)::bigint as max_block_size, greatest(max(m.t - a.t_start), max(case when m.strand = '+' then m.q - a.q_start else a.q_end - m.q end))::bigint as max_local_start from mblk m join aln a using (aln_id, part, dir)"),
    "fit_check": _sql("part", """select aln_id, count(*) as n_over, arg_min(v, o)::bigint as first_over from (select c.aln_id, unnest([c.size, c.t - p.t_start]) as v, unnest([c.k * 2 + 0, c.k * 2 + 1]) as o
        from cut c join part p on p.aln_id = c.aln_id and p.part = c.part) where v > 1500 group by aln_id"""),
    "zero_block_report": _sql("good", "select q_name, count(*) as n_lines, string_agg(aln_id::varchar, ',' order by aln_id) as lines from good where z = 1 group by q_name"),
    "breakpoints": _sql("bp", "select pos::bigint as pos from bp"),
    "initial_waste": _sql("waste", "select region_id::bigint as region_id, first::bigint as first, last::bigint as last from waste"),
    "consolidate": _sql("aln", """select row_number() over (order by first) - 1 as region_id, first::bigint as first, last::bigint as last from (select min(f) as first, max(l) as last from (select *, sum(n) over (order by f) as g from (
        select f, f + 100 as l, (coalesce(f - lag(f + 100) over (order by f), 251) > 250)::int as n from (select distinct t_start as f from aln))) group by g)"""),
    "events_islands": """select row_number() over (order by first) - 1 as region_id, first, last from (select min(p) as first, max(p) as last from (select p, sum(n) over (order by p) as g from (
        select p, (coalesce(p - lag(p) over (order by p), 61) > 60)::int as n from (select distinct floor(epoch_us(ts) / 1000000)::bigint as p from events where ts is not null))) group by g)""",
    "atoms": _sql("atom", "select atom_nr::bigint as atom_nr, first::bigint as first, last::bigint as last from atom"),
    "containment_join": _sql("pair", "select atom_nr, aln_id, part, dir from pair"),
    "lift_over": _sql("lifted", "select atom_nr, aln_id, part, dir, m_first::bigint as m_first, m_last::bigint as m_last from lifted"),
    "asof_region": _sql("located", "select atom_nr, aln_id, part, dir, rf as region_id from located"),
    "overlap_join": _sql("over", "select atom_nr, aln_id, part, dir, region_id from over"),
    "induced_intervals": _sql("induced", "select atom_nr, first::bigint as first, last::bigint as last from induced"),
    "interval_partition": _sql("split", "select atom_nr, first::bigint as first, last::bigint as last, minimal, maximal from split"),
    "choose_atom": _sql("chosen", "select atom_nr, aln_id, part, dir, j::bigint as j from chosen"),
    "coverages": _sql("cover", "select atom_nr, aln_id, part, dir, c1::double as cover from cover"),
    "atom_graph": _sql("edge", "select i::bigint as i, j::bigint as j, weight from edge"),
    "min_match_filter": _sql("psl", "select aln_id, matches from psl where matches >= 850"),
    "block_pairs": _sql("bpair", "select aln_id, k, lo::bigint as lo, hi::bigint as hi, other::bigint as other, other_hi::bigint as other_hi from bpair"),
    "stab_join": _sql("multi", "select m.pos::bigint as pos, b.aln_id, b.k from multi m join (select *, unnest(range(lo // 1000, hi // 1000 + 1)) as bin from bpair) b on m.pos // 1000 = b.bin and m.pos > b.lo and m.pos < b.hi"),
    "bp_seeds": _sql("multi", "select pos::bigint as pos, n from multi"),
    "bp_closure": _sql("closed", "select pos::bigint as pos, n from closed"),
    "bp_weights": _sql("weight", "select pos::bigint as pos, weight from weight"),
    "segment_edges": _sql("step", "select problem, closes, count(*) as n_edges, sum(cost)::bigint as sum_cost, sum(src * 7 + dst * 13)::bigint as sum_ends from step group by problem, closes"),
    "segment_paths": _path_sql("step"),
    "seed_weights": _sql("seed_weight", "select pos::bigint as pos, weight from seed_weight"),
    "seed_edges": _sql("seed_step", "select * from seed_step"),
    "seed_paths": _path_sql("seed_step"),
    "revcomp": "select doc_id, translate(reverse(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')), 'ACGT', 'TGCA') as seq from documents",
    "assemble_dna": _genome_sql("seq"),
    "genome_files": _genome_sql("seq"),
    "turned_genomes": _genome_sql("translate(reverse(seq), 'ACGT', 'TGCA')"),
    "seq_type_flags": "select case when p_size > 25 then 'marker_' else 'intermarker_' end || p_partkey as header, case when p_size > 25 then 1 else 2 end as flag from part",
    "homology_edges": HOMOLOGY_SQL,
    "homology_file": HOMOLOGY_SQL,
    "homology_classes": """with recursive link as materialized (select distinct (l_suppkey % 5) * 1000000000 + l_partkey as a, lead((l_suppkey % 5) * 1000000000 + l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b
            from lineitem),
        ways as materialized (select a as i, b as j from link where b is not null union select b, a from link where b is not null),
        reach(n, l) using key (n) as (select i, least(i, min(j)) from ways group by i
            union select e.j, min(r.l) from reach r join ways e on e.i = r.n join recurring.reach c on c.n = e.j where r.l < c.l group by e.j)
        select (n // 1000000000)::int as genome, (n % 1000000000)::int as gene, (dense_rank() over (order by l) - 1)::bigint as class_nr from reach""",
    "right_neighbors": """select class_nr, count(distinct case when side is not null then side end) as n_neighbours, count(*) filter (side is null) as n_ends from (
        select c as class_nr, case when s > 0 then lead(c * 10 + s) over w else lag(c * 10 + s) over w end as side from (
            select p_partkey % 5 as g, p_partkey as k, case when p_size % 2 = 0 then 1 else -1 end as s, p_partkey * 7 % 97 as c from part) window w as (partition by g order by k)) group by class_nr""",
    "segment_truth": """select g as genome, e - len + 1 as start, e as "end", s as strand, c as family, p_partkey::varchar as pos_in_fasta from (
        select (p_partkey % 5)::int as g, p_partkey, p_size * 10 as len, (sum(p_size * 10) over (partition by p_partkey % 5 order by p_partkey))::bigint as e,
            case when p_size % 2 = 0 then '+' else '-' end as s, p_partkey * 7 % 97 as c from part)""",
}

#: SQL that is too heavy for whole tables; the tests run it on the smallest ones.
SMALL_ORACLES: dict[str, str] = {
    "component_labels": _sql(
        "edge",
        "select atom_nr, dense_rank() over (order by coalesce(l, atom_nr - 1)) as class_nr from atom left join reach on n = atom_nr - 1",
        """reach(n, l) using key (n) as (select i, min(j) from (select i, j from edge union all select i, i from edge) group by i
            union select e.j, min(r.l) from reach r join edge e on e.i = r.n join recurring.reach c on c.n = e.j where r.l < c.l group by e.j)""",
    ),
}
