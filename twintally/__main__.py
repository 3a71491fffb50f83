"""Command line: ``spark-submit``-able entry for runs over files.

    python -m twintally pairs ASIS TOBE OUT [--sep S] [--key A,B] [--filter COL=val] [--how full|left]
    python -m twintally families OUT (--base-dir DIR | --asis DIR --tobe DIR) [--prefix P]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from twintally import parse_key, parse_row_filter, run, run_families
from twintally.sources.delimited import SEPARATOR_PRESETS


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="twintally")
    commands = parser.add_subparsers(dest="command", required=True)
    pairs = commands.add_parser("pairs", help="compare all files under two paths")
    pairs.add_argument("asis")
    pairs.add_argument("tobe")
    pairs.add_argument("out")
    pairs.add_argument("--sep", help="separator, or one of: " + ", ".join(SEPARATOR_PRESETS))
    pairs.add_argument("--key", help="key columns, comma separated")
    pairs.add_argument("--filter", help="COL=val;COL2=val2")
    pairs.add_argument("--how", default="full", choices=["full", "left"], help="which files without a partner are listed")
    families = commands.add_parser("families", help="compare old and new deliveries by family")
    families.add_argument("out")
    families.add_argument("--base-dir")
    families.add_argument("--asis")
    families.add_argument("--tobe")
    families.add_argument("--prefix")
    for command in (pairs, families):
        command.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
        command.add_argument("--parallel", type=int, default=4)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("twintally").getOrCreate()

    def progress(label: str, done: int, total: int) -> None:
        print(f"{done}/{total} {label}", flush=True)

    shared = {"format": args.format, "parallel": args.parallel, "on_progress": progress}
    if args.command == "pairs":
        result = run(
            spark,
            args.asis,
            args.tobe,
            args.out,
            sep=SEPARATOR_PRESETS.get(args.sep, args.sep),
            key=parse_key(args.key) or None,
            row_filter=parse_row_filter(args.filter),
            how=args.how,
            **shared,
        )
    else:
        result = run_families(
            spark, args.out, args.base_dir, args.asis, args.tobe, args.prefix, **shared
        )
    result.show(truncate=False)


if __name__ == "__main__":
    main()
