"""Command line: python -m motiflake PATTERN INPUT [options]; hits as tab-separated lines."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from . import __version__
from .functions.alphabets import AMINO_ACID, NUCLEOTIDE
from .plans.pattern import AMBIG_MODES, SEQUENCE_TYPES, SearchQuery
from .sources import tsv
from .sources.fastx import FORMATS, infer_format

PROG = "motiflake"


def build_parser() -> argparse.ArgumentParser:
    # Flags, choices and defaults, as scripts call them.
    p = argparse.ArgumentParser(prog=PROG, description="Find a pattern in the records of a FASTA or FASTQ file.")
    add = p.add_argument
    add("pattern", help="nucleotides or residues, with IUPAC letters if an ambiguity mode is on")
    add("input", help="FASTA or FASTQ, plain or gzip")
    add("-t", "--sequence-type", choices=SEQUENCE_TYPES, default=NUCLEOTIDE, help="alphabet (%(default)s)")
    add("--ambig-mode", choices=AMBIG_MODES, default="none", help="whose ambiguity letters expand (%(default)s)")
    add("--ambig", action="store_true", help="the same as --ambig-mode query")
    add("--revcomp", action="store_true", help="search the opposite strand too")
    add("--circular", action="store_true", help="let hits cross the end of a record")
    add("--with-header", action="store_true", help="print column names first")
    add("--format", choices=FORMATS, default="auto", help="input format (%(default)s: by suffix)")
    add("-j", "--jobs", type=int, default=1, help="tasks that long records are dealt to (%(default)s)")
    add("--chunk-size", type=int, default=1_000_000, help="starts dealt out together (%(default)s)")
    add("--version", action="version", version=f"%(prog)s {__version__}")
    return p


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = build_parser()
    args = parser.parse_args(argv)
    rules = {
        "--ambig can't go with --ambig-mode both": args.ambig and args.ambig_mode == "both",
        "ambiguity modes are for nucleotides only": args.sequence_type == AMINO_ACID and (args.ambig or args.ambig_mode != "none"),
        "--revcomp is for nucleotides only": args.sequence_type == AMINO_ACID and args.revcomp,
        "--jobs must be at least 1": args.jobs < 1,
        "--chunk-size must be at least 1": args.chunk_size < 1,
    }
    for message, broken in rules.items():
        if broken:
            parser.error(message)
    if args.ambig:
        args.ambig_mode = "query"
    return args


def run(args: argparse.Namespace, out=None) -> int:
    """Prints the hits in order: records as in the file, + before -, ascending start. 0 even without hits."""
    out = out or sys.stdout
    query = SearchQuery(args.pattern, args.revcomp, args.circular, sequence_type=args.sequence_type, ambig_mode=args.ambig_mode)
    if args.with_header:
        print(tsv.HEADER, file=out, flush=True)
    if not os.path.isdir(args.input):
        open(args.input, "rb").close()
    fmt = infer_format(args.input, args.format)
    from .operators.search import ordered, search
    from .sources.fastx import read_fastx

    records = read_fastx(_session(), args.input, fmt)
    hits = search(records, query, jobs=args.jobs, chunk_size=args.chunk_size, keep=["record_ord"])
    for line in tsv.lines(ordered(hits, "record_ord")):
        print(line, file=out)
    return 0


def _session():
    from pyspark.sql import SparkSession

    if found := SparkSession.getActiveSession():
        return found
    spark = SparkSession.builder.appName(PROG).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(argv: Sequence[str] | None = None) -> int:
    """1 after a message for unreadable input, a bad pattern or a bad record. Nothing is printed before all hits of a
    record are known; unlike a stream, a failing query prints none of its hits."""
    from pyspark.errors import PySparkException

    args = parse_args(argv)
    try:
        return run(args)
    except (OSError, ValueError) as e:
        print(f"{PROG}: {e}", file=sys.stderr)
    except PySparkException as e:
        print(f"{PROG}: {_reason(str(e))}", file=sys.stderr)
    return 1


def _reason(message: str) -> str:
    """The line of a Spark error that says what is wrong with the input."""
    for line in message.splitlines():
        for mark in ("ValueError: ", "EOFError: ", "OSError: ", "UnicodeDecodeError: ", "[USER_RAISED_EXCEPTION] "):
            if mark in line:
                return line.split(mark, 1)[1].split(" SQLSTATE")[0].strip()
    return message.splitlines()[0] if message else "failed"
