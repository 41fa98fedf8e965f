"""Settings of a segmentation run and its command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentationConfig:
    """Lengths in positions; ``min_ident`` in whole percent.

    ``bucket_size`` only tunes interval joins. ``dp_mode`` 'exact' compares costs as
    (waste, segments); 'float' adds a small epsilon for each segment instead.
    """

    min_length: int = 250
    min_ident: int = 80
    max_gap: int = 13
    min_aln_length: int = 13
    bucket_size: int = 1000
    dp_mode: str = "exact"
    max_iterations: int = 50
    print_zero_lines: bool = False
    legacy_eof: bool = False


def parse_args(argv: list[str]) -> tuple[list[str], bool, SegmentationConfig]:
    """Paths, whether they are lists of paths, and the settings. Option names ignore case; an unknown one exits."""
    parser = argparse.ArgumentParser(description="Segment sequences from pairwise alignments.", allow_abbrev=False)
    parser.add_argument("paths", nargs="+")
    for name, kind, default in (("minlength", int, 250), ("minident", int, 80), ("maxgap", int, 13), ("minalnlength", int, 13), ("bucketsize", int, 1000), ("numthreads", int, 1)):
        parser.add_argument(f"--{name}", type=kind, default=default)
    parser.add_argument("--printzerolines", action="store_true")
    parser.add_argument("--inputnotpsl", action="store_true")
    a = parser.parse_args([x.lower() if x.startswith("--") else x for x in argv])
    return a.paths, a.inputnotpsl, SegmentationConfig(a.minlength, a.minident, a.maxgap, a.minalnlength, a.bucketsize, print_zero_lines=a.printzerolines)
