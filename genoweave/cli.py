"""Command line: segment PSL files and write the report."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from genoweave.config import parse_args
from genoweave.plans.segmentation import RunStats, segment
from genoweave.sources.psl import paths_in, read_psl, zero_block_report


def main(argv: list[str] | None = None) -> int:
    """Print the tab-separated report to standard output and counts to standard error."""
    paths, lists, config = parse_args(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("genoweave").getOrCreate()
    if lists:
        paths = [p for name in paths for p in paths_in(spark, name)]
    psl = read_psl(spark, paths, legacy_eof=config.legacy_eof)
    for row in zero_block_report(psl, ["file_no"], "line_no", config.print_zero_lines).collect():
        print(f"{paths[row.file_no]}: {row.n_lines} lines with empty blocks", *(row.lines if config.print_zero_lines else ()), file=sys.stderr)
    stats = RunStats()
    rows = segment(psl, config, stats)
    print("#name\tatom_nr\tclass\tstrand\tstart\tend")
    for r in rows.orderBy("atom_nr").toLocalIterator():
        print(r.name, r.atom_nr, r["class"], r.strand, r.start, r.end, sep="\t")
    print(stats, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
