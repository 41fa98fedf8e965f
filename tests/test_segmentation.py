"""Hand-derived segmentations and parser thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from genoweave.config import SegmentationConfig, parse_args
from genoweave.functions.blocks import lift
from genoweave.operators import normalize
from genoweave.operators.intervals import consolidate, islands, minimal_maximal
from genoweave.plans.segmentation import RunStats, segment, write_report
from genoweave.sources.psl import paths_in, read_psl, zero_block_report


def line(q, t, sizes, qs, ts, q_size=1000, t_size=1000, strand="+", matches=100, mismatches=0, rep=0):
    csv = lambda xs: "".join(f"{x}," for x in xs)
    return "\t".join(map(str, [matches, mismatches, rep, 0, 0, 0, 0, 0, strand, q, q_size, 0, q_size, t, t_size, 0, t_size, len(sizes), csv(sizes), csv(qs), csv(ts)]))


@pytest.fixture
def psl(spark, tmp_path):
    def make(*lines, end="\n"):
        path = tmp_path / "in.psl"
        path.write_text("\n".join(lines) + end)
        return read_psl(spark, [str(path)])

    return make


def rows(report):
    return [(r.name, r.atom_nr, r["class"], r.strand, r.start, r.end) for r in report.orderBy("atom_nr").collect()]


def test_forward_pair(psl):
    assert rows(segment(psl(line("A", "B", [400], [100], [300])))) == [
        ("A", 1, 1, "+", 100, 500), ("A", 2, 2, "+", 500, 1000), ("B", 3, 3, "+", 0, 300), ("B", 4, 1, "+", 300, 700), ("B", 5, 4, "+", 700, 1000),
    ]


def test_reverse_pair(psl):
    out = rows(segment(psl(line("A", "B", [400], [500], [300], strand="-"))))
    assert out[3] == ("B", 4, 1, "-", 300, 700) and [x[:3] for x in out] == [("A", 1, 1), ("A", 2, 2), ("B", 3, 3), ("B", 4, 1), ("B", 5, 4)]


def test_transferred_breakpoint(psl):
    stats = RunStats()
    out = rows(segment(psl("# comment", line("A", "B", [1000], [0], [0]), "", line("B", "C", [400], [0], [0], t_size=400)), stats=stats))
    assert out == [("A", 1, 1, "+", 0, 400), ("A", 2, 2, "+", 400, 1000), ("B", 3, 1, "+", 0, 400), ("B", 4, 2, "+", 400, 1000), ("C", 5, 1, "+", 0, 400)]
    assert stats.sequences == 3 and stats.waste == [5, 6, 6]


def test_float_mode_agrees(psl):
    p = psl(line("A", "B", [1000], [0], [0]), line("B", "C", [400], [0], [0], t_size=400))
    assert rows(segment(p, SegmentationConfig(dp_mode="float"))) == rows(segment(p))


def test_no_rows_give_no_atoms(psl):
    assert rows(segment(psl("# nothing"))) == []


def test_parser_thresholds(psl):
    p = psl(
        line("A", "B", [100], [0], [0], matches=4, mismatches=1),
        line("C", "D", [100], [0], [0], matches=79, mismatches=21),
        line("E", "F", [100], [0], [0], matches=0, rep=5, mismatches=1),
        line("G", "H", [100], [0], [0], matches=0),
        line("I", "J", [13], [0], [0]),
    )
    good = normalize.identity_filter(p, 80)
    assert [r.q_name for r in good.orderBy("aln_id").collect()] == ["A", "E", "I"]
    assert {r.name for r in normalize.sequence_offsets(good).collect()} == set("ABEFIJ")


@pytest.mark.parametrize(
    ("strand", "q_gap", "t_gap", "spans"),
    [("+", 0, 13, [213]), ("+", 0, 14, [100, 100]), ("+", 0, -1, [100, 100]), ("-", 14, 0, [100, 100]), ("-", 13, 0, [200])],
)
def test_gap_split(psl, strand, q_gap, t_gap, spans):
    p = psl(line("A", "B", [100, 100], [0, 100 + q_gap], [0, 100 + t_gap], strand=strand))
    parts = normalize.gap_split(normalize.remove_zero_blocks(normalize.global_blocks(normalize.offset_join(p, normalize.sequence_offsets(p)))), 13, 13)
    assert [r.s for r in parts.orderBy("part").select((F.col("t_end") - F.col("t_start")).alias("s")).collect()] == spans


def test_length_and_zero_blocks(psl):
    p = psl(line("A", "B", [13], [0], [0]), line("A", "B", [14], [0], [0]), line("A", "B", [100, 0, 100], [0, 100, 100], [0, 100, 100]), line("A", "B", [0, 0], [0, 0], [0, 0]), line("A", "B", [65536], [0], [0]))
    blocks = normalize.global_blocks(normalize.offset_join(p, normalize.sequence_offsets(p)))
    parts = normalize.gap_split(normalize.remove_zero_blocks(blocks), 13, 13)
    assert sorted(r.t_end - r.t_start for r in parts.collect()) == [14, 200, 65536]
    assert zero_block_report(p, ["file_no"], "line_no").collect()[0].lines == [3, 4]
    assert [r.first_over for r in normalize.fit_check(normalize.mirror(parts)).collect()] == [65536]


def test_mirror_twice_is_the_same(psl):
    from genoweave.functions.blocks import mirrored_blocks

    p = psl(line("A", "B", [100, 50], [0, 105], [7, 110], strand="-"), line("A", "B", [100, 50], [0, 105], [7, 110]))
    b = normalize.global_blocks(normalize.offset_join(p, normalize.sequence_offsets(p)))
    out = b.withColumn("again", mirrored_blocks(mirrored_blocks(F.col("blocks"), F.col("strand")), F.col("strand")))
    assert all(r.blocks == r.again for r in out.collect())


def test_islands_merge_at_the_limit(spark):
    out = islands(spark.createDataFrame([(0,), (250,), (501,)], "pos long"), 250)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 250), (1, 501, 501)]


def test_consolidate_is_idempotent(spark):
    once = consolidate(spark.range(200).selectExpr("id * 7919 % 100003 as first", "id * 7919 % 100003 + id % 300 as last"), 250)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, consolidate(once, 250).collect()))


def test_minimal_and_maximal(spark):
    data = [(1, a, b) for a, b in [(0, 0), (5, 9), (3, 9), (6, 12), (2, 13), (20, 20)]]
    out = minimal_maximal(spark.createDataFrame(data, "atom_nr long, first long, last long"), "atom_nr").collect()
    assert {(r.first, r.last) for r in out if r.minimal} == {(0, 0), (5, 9), (6, 12), (20, 20)}
    assert {(r.first, r.last) for r in out if r.maximal} == {(2, 13)}


@pytest.mark.parametrize(("x", "y"), [(100, 1000), (149, 1049), (155, 1050), (160, 1055), (90, 1000), (500, 1095)])
def test_lift_forward(spark, x, y):
    frame = spark.createDataFrame([([(50, 1000, 100), (40, 1055, 160)], "+", x)], "blocks array<struct<size:long,q:long,t:long>>, strand string, x long")
    assert frame.select(lift(F.col("x"), F.col("blocks"), F.col("strand"))).first()[0] == y


@pytest.mark.parametrize(("x", "y"), [(100, 1000), (150, 950)])
def test_lift_reverse(spark, x, y):
    frame = spark.createDataFrame([([(50, 1000, 100)], "-", x)], "blocks array<struct<size:long,q:long,t:long>>, strand string, x long")
    assert frame.select(lift(F.col("x"), F.col("blocks"), F.col("strand"))).first()[0] == y


def test_bad_fields_stop_the_job(spark, tmp_path):
    for k, text in enumerate((line("A", "B", [100], [0], [0], matches="x"), line("A", "B", [100], [0], [0], q_size=10**20), "1\t2")):
        (tmp_path / f"{k}.psl").write_text(text + "\n")
        with pytest.raises(Exception, match="is not of type"):
            read_psl(spark, [str(tmp_path / f"{k}.psl")]).collect()


def test_lines_of_many_blocks_keep_their_numbers(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a b.psl").write_text("".join(line("A", "B", [100], [k], [0]) + "\n" for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_psl(spark, [str(tmp_path / "a b.psl")] * 2).select("file_no", "line_no", F.element_at("q_starts", 1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, rows)) == [(f, k + 1, k) for f in (0, 1) for k in range(500)]


def test_files_in_order_lists_and_last_line(spark, tmp_path):
    (tmp_path / "a.psl").write_text(line("A", "B", [100], [0], [0]) + "\n" + line("C", "D", [100], [0], [0]))
    (tmp_path / "b.psl").write_text(line("E", "F", [100], [0], [0]) + "\n")
    (tmp_path / "list").write_text(f"{tmp_path}/b.psl\n\n{tmp_path}/a.psl\n")
    paths = paths_in(spark, str(tmp_path / "list"))
    names = lambda f: [r.q_name for r in f.orderBy("aln_id").collect()]
    assert names(read_psl(spark, paths)) == ["E", "A", "C"]
    assert names(read_psl(spark, paths, legacy_eof=True)) == ["E", "A"]


def test_command_line():
    paths, lists, config = parse_args(["a", "b", "--minLength", "300", "--MAXGAP", "5"])
    assert paths == ["a", "b"] and not lists and config.min_length == 300 and config.max_gap == 5 and config.min_ident == 80
    with pytest.raises(SystemExit):
        parse_args(["a", "--nosuch"])


def test_signs_of_whole_and_twisted_components(spark):
    from genoweave.operators.graph import classes, walk_signs

    edges = [(0, 1, -2), (1, 2, 1), (2, 3, -1), (0, 3, 1), (4, 5, -1), (5, 6, -1), (4, 6, -1), (7, 8, 3), (9, 9, -2)]
    both = [*edges[:-1], *((b, a, w) for a, b, w in edges)]
    atoms = spark.createDataFrame([(k + 1,) for k in range(11)], "atom_nr long")
    got = {r.atom_nr - 1: r.strand for r in classes(atoms, spark.createDataFrame(both, "i long, j long, weight long"), 0).collect()}
    want = walk_signs(*map(list, zip(*both, strict=True)), 0) | walk_signs(*map(list, zip(*both, strict=True)), 4)
    assert got == {k: "-" if want.get(k, 1) < 0 else "+" for k in range(11)} and "-" in got.values()


def test_signs_block_by_block(spark):
    """Random graphs of many blocks against one walk of each component."""
    from genoweave.operators.graph import classes, walk_signs

    rng = random.Random(6)
    edges, n = {}, 0
    for _ in range(30):  # components of blocks that hang together at single nodes
        nodes, n = [n], n + 1
        for _ in range(rng.randrange(1, 6)):
            ring = [rng.choice(nodes), *range(n, n + rng.randrange(1, 7))]
            n += len(ring) - 1
            nodes += ring[1:]
            for a, b in [*zip(ring, ring[1:], strict=False), (ring[-1], ring[0]), *(rng.sample(ring, 2) for _ in range(rng.randrange(3)))]:
                if a != b:
                    edges[min(a, b), max(a, b)] = rng.choice([-3, -1, 0, 2, 2, 5])
    order = rng.sample(range(n), n)
    edges = {tuple(sorted((order[a], order[b]))): w for (a, b), w in edges.items()}
    both = [(a, b, w) for (a, b), w in edges.items()] + [(b, a, w) for (a, b), w in edges.items()]
    want = {}
    for k in range(n):
        if k not in want:
            want |= walk_signs(*map(list, zip(*both, strict=True)), k)
    atoms = spark.createDataFrame([(k + 1,) for k in range(n)], "atom_nr long")
    for at_once in (40, 1000):  # some components by blocks, then none
        got = {r.atom_nr - 1: r.strand for r in classes(atoms, spark.createDataFrame(both, "i long, j long, weight long"), at_once).collect()}
        assert got == {k: "-" if want[k] < 0 else "+" for k in range(n)}


def test_report_text(psl, tmp_path):
    write_report(segment(psl(line("A", "B", [400], [100], [300]))), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split("\n")[0] == "#name\tatom_nr\tclass\tstrand\tstart\tend" and "A\t1\t1\t+\t100\t500" in text
