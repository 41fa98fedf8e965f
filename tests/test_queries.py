"""Every query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from genoweave.plans.durable import write_table
from genoweave.plans.segmentation import step
from genoweave.queries import CONFIG, ORACLES, QUERIES, SMALL_ORACLES, Stages

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"atoms_report", "reoptimise", "segmentation_waste", "run_stats", "signed_classes"}


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES | SMALL_ORACLES))
def test_against_sql(spark, sf, sql, name):
    assert _rows(QUERIES[name](spark, sf).toPandas()) == _rows(sql.execute((ORACLES | SMALL_ORACLES)[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - set(SMALL_ORACLES) - SLOW))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_waste_tiles_the_sequences(spark, sf):
    atoms = [(r.name, r.start, r.end) for r in QUERIES["atoms_report"](spark, sf).collect()]
    assert all(end - start > 250 for _, start, end in atoms)


def _regions_by_rule(minimal, maximal, min_length):
    """An atom's cheapest waste from right to left, position by position: (waste, segments), ties to the rightmost predecessor."""
    places = sorted({p for a, b in minimal for p in range(a, b + 1)})
    best = {places[0]: ((0, 0), False, None)}
    both = lambda sets, x, y: any(a <= x and y <= b for a, b in sets)
    for p in places[1:]:
        finished = [x for x in minimal if x[1] < p] or minimal[:1]
        options = []
        for x in range(finished[-1][0], finished[-1][1] + 1):
            (waste, parts), joined = best[x][0], p - x < min_length or both(minimal, x, p) and both(maximal, x, p)
            options.append(((waste + p - x, parts) if joined else (waste, parts + 1), -x, joined))
        cost, x, joined = min(options)
        best[p] = cost, joined, -x
    regions, p, joined = [], best[places[-1]][2] if len(places) > 1 else places[0], False
    while p is not None:
        if joined:
            regions[-1] = (p, regions[-1][1])
        else:
            regions.append((p, p))
        _, joined, p = best[p]
    return regions


def test_reoptimise_against_the_rule(spark, sf):
    """Every atom of the smallest tables, its intervals from the SQL of ``interval_partition``."""
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    atoms = {}
    for r in con.execute(ORACLES["interval_partition"]).fetchall():
        atoms.setdefault(r[0], []).append(r[1:])
    regions = [(first, last) for _, first, last in con.execute(ORACLES["initial_waste"]).fetchall()]
    for rows in atoms.values():
        minimal, maximal = (sorted((a, b) for a, b, *kind in rows if kind[k]) for k in (0, 1))
        regions += _regions_by_rule(minimal, maximal, CONFIG.min_length)
    merged = []
    for first, last in sorted(regions):
        if merged and first <= merged[-1][1] + CONFIG.min_length:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    got = sorted((r.region_id, r.first, r.last) for r in QUERIES["reoptimise"](spark, sf).select("region_id", "first", "last").collect())
    assert got == [(k, *x) for k, x in enumerate(merged)]


def test_rounds_that_only_follow_changes_against_whole_rounds(spark, sf):
    """The fixpoint and its counts per round are those of rounds that re-optimise every atom."""
    s = Stages(spark, sf).stored()
    waste, counts = s.waste, [s.waste.count()]
    while len(counts) < 2 or counts[-1] != counts[-2]:
        waste = write_table(step(waste, s.alignments, CONFIG), "whole")
        counts.append(waste.count())
    want = sorted(map(tuple, waste.select("region_id", "first", "last").collect()))
    assert sorted(map(tuple, QUERIES["segmentation_waste"](spark, sf).select("region_id", "first", "last").collect())) == want
    stats = QUERIES["run_stats"](spark, sf).orderBy("iteration").collect()
    assert [r.waste for r in stats] == counts
    assert {(r.sequences, r.alignments) for r in stats} == {(s.sequences.count(), s.alignments.count())}


def test_signed_classes_against_a_walk(spark, sf):
    """Every atom of the smallest tables: classes by order of their least atom, signs by walking neighbours in order."""
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    near = {}
    for i, j, weight in sorted(con.execute(ORACLES["atom_graph"]).fetchall()):
        near.setdefault(i, []).append((j, -1 if weight < 0 else 1))
    found, classes = {}, 0
    for (atom,) in sorted(con.execute(f"select atom_nr from ({ORACLES['atoms']})").fetchall()):
        if atom - 1 in found:
            continue
        classes += 1
        todo = [(atom - 1, 1)]
        while todo:
            node, sign = todo.pop()
            if node not in found:
                found[node] = classes, sign
                todo += [(other, sign * s) for other, s in reversed(near.get(node, []))]
    got = {r.atom_nr: (r.class_nr, r.strand) for r in QUERIES["signed_classes"](spark, sf).collect()}
    assert got == {node + 1: (nr, "-" if sign < 0 else "+") for node, (nr, sign) in found.items()}
