"""Command line: ``python -m strandline.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import warnings

from pyspark.sql import functions as F

from strandline.plans import commands as c
from strandline.plans.model import ATTRIBUTE, SKIPPED, Annotation, BadAnnotation, build_index, missing_tables
from strandline.session import session
from strandline.sources.annotation import SeveralFiles, save_lines, save_table, write_lines, write_table
from strandline.sources.regions import BadRegion, bed_strict, literal_region, read_list, read_regions


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline", description="Annotation queries on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, selects: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("-i", "--input", required=True, help="GFF3 file; its index is the folder beside it")
        p.add_argument("-v", "--verbose", action="store_true")
        if name != "index":
            p.add_argument("-o", "--output", help="file, standard output without it")
            p.add_argument("-P", "--parts", action="store_true", help="the output is a folder of part files, written by all tasks")
            p.add_argument("-t", "--threads", type=int, default=12, help="threads of a local session, 0 for all")
        if selects:
            p.add_argument("-e", "--entire_group", action="store_true")
            p.add_argument("-T", "--types", help="types, parted by commas")
        return p

    p = command("index")
    p.add_argument("-a", "--attribute", default=ATTRIBUTE)
    p.add_argument("-s", "--skip-types", default=SKIPPED)
    p = command("intersect", True)
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("-r", "--region", help="chr:start-end")
    one.add_argument("-b", "--bed")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("-c", "--contained", dest="mode", action="store_const", const="contained")
    mode.add_argument("-C", "--contains-region", dest="mode", action="store_const", const="contains")
    mode.add_argument("-O", "--overlap", dest="mode", action="store_const", const="overlap")
    p.set_defaults(mode="overlap")
    p.add_argument("-I", "--invert", action="store_true")
    p = command("extract", True)
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("-f", "--feature")
    one.add_argument("-F", "--feature-file")
    p = command("search", True)
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("-a", "--attr")
    one.add_argument("-A", "--attr-list")
    p.add_argument("-r", "--regex", action="store_true")
    command("coverage").add_argument("-s", "--source", required=True, help="BED, SAM or BAM")
    p = command("depth")
    p.add_argument("-s", "--source", required=True, help="BED, SAM or BAM")
    p.add_argument("--bin-shift", type=int, default=12, help="accepted; bins follow the widths of spans here")
    command("sample").add_argument("-r", "--ratio", type=float, required=True)
    return top


def run(args: argparse.Namespace) -> None:
    threads = getattr(args, "threads", 0)
    spark = session(f"local[{threads or '*'}]")
    index = f"{args.input}.strandline"
    if args.command == "index":
        build_index(spark, args.input, args.attribute, args.skip_types, save=index)
        return
    if gone := missing_tables(spark, index):
        raise FileNotFoundError(f"no index ({', '.join(gone)}) in {index}: run the index command first")
    found = Annotation.load(spark, index)
    if args.command in ("coverage", "depth"):
        regions = read_regions(spark, args.source)
        coverage = args.command == "coverage"
        (save_table if args.parts else write_table)(c.coverage(found, regions) if coverage else c.depth(found, regions), args.output, "fraction" if coverage else None)
        return
    if args.command == "sample":
        lines = c.sample(found, args.ratio)
    elif args.command == "intersect":
        if args.region is not None:
            regions = literal_region(spark, args.region)
            if found.seqids.filter(F.col("seqid") == regions.first().seqid).isEmpty():
                raise BadRegion(f"unknown sequence: {args.region}")
        else:
            regions = bed_strict(spark, args.bed, found.seqids)
        lines = c.intersect(found, regions, args.mode, args.invert, args.entire_group, args.types)
    elif args.command == "extract":
        ids = read_list(spark, args.feature_file) if args.feature_file else spark.createDataFrame([(args.feature,)], "value string")
        lines = c.extract(found, ids, args.entire_group, args.types, warn=True)
    else:
        wanted = {"table": read_list(spark, args.attr_list)} if args.attr_list and not args.regex else {}
        if not wanted:
            values = [r.value for r in read_list(spark, args.attr_list).collect()] if args.attr_list else [args.attr]
            wanted = {"patterns" if args.regex else "values": values}
        lines = c.search(found, **wanted, entire=args.entire_group, types=args.types, strict=True, warn=True)
    if args.parts:
        save_lines(lines, args.output)
        return
    n = write_lines(lines, args.output)
    if args.verbose:
        print(f"{n} lines", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if getattr(args, "parts", False) and not args.output:
        top.error("--parts needs --output")
    warnings.simplefilter("always", UserWarning)
    try:
        run(args)
    except (BadAnnotation, BadRegion, SeveralFiles, c.NothingMatched, FileNotFoundError, NotImplementedError) as fault:
        print(f"strandline: {fault}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
