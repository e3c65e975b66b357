"""Command line: `extract` builds the pair table from XML folders, `stats` shows its statistics.

    python -m paarwerk extract --registry corpora.json --output-dir out --format both --max-files 10
    python -m paarwerk stats --csv out/all_corpora.csv

The registry is a JSON list of objects with corpus, base_dir, lang_prof and dialect (P: annotation in attributes, X: in
child elements).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from paarwerk.operators import stats
from paarwerk.operators.extract import pair_table
from paarwerk.session import materialise, ship
from paarwerk.sources import files, sinks


def run_extract(spark: SparkSession, registry: list[dict], output_dir: str, corpora: list[str] | None = None, fmt: str = "both", max_files: int | None = None, exclude: list[str] = ()) -> DataFrame:
    """The pair table of the chosen corpora (all if none is named; unknown names are ignored), written in the formats asked for."""
    chosen = [r for r in registry if not corpora or r["corpus"] in corpora]
    pairs = materialise(pair_table(files.scan_corpora(spark, chosen, exclude, max_files)), "pair-table")
    if fmt in ("csv", "both"):
        sinks.write_pairs_csv(pairs, f"{output_dir}/all_corpora.csv")
    if fmt in ("norm", "both"):
        sinks.write_norm(pairs, f"{output_dir}/norm")
    return pairs


def run_stats(spark: SparkSession, csv: str) -> dict[str, DataFrame]:
    """Every statistic of a pair CSV, by name; a missing file has none but zeros."""
    pairs = files.read_pairs_csv(spark, csv)
    return {
        "overview": stats.total_last(stats.corpus_overview(pairs), stats.WHOLE, "corpus"),
        "sentence count by corpus": stats.total_last(stats.count_share(pairs, "corpus", stats.WHOLE), stats.WHOLE, "corpus"),
        "corrections by corpus": stats.correction_breakdown(pairs).orderBy("corpus"),
        "corrections": stats.correction_summary(pairs),
        "corrected pairs only": stats.total_last(stats.corrected_only(pairs), stats.ALL_CORRECTED, "corpus"),
        "text types, sentences": stats.total_last(stats.count_share(pairs, "text_type", stats.TOTAL), stats.TOTAL, "text_type"),
        "text types, documents": stats.total_last(stats.documents_by_text_type(pairs), stats.TOTAL, "text_type"),
        "corpus and text type": stats.total_last(stats.corpus_by_text_type(pairs), stats.WHOLE, "corpus", "text_type"),
    }


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paarwerk", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract")
    e.add_argument("--registry", required=True)
    e.add_argument("--corpora", nargs="+")
    e.add_argument("--output-dir", required=True)
    e.add_argument("--format", choices=["csv", "norm", "both"], default="both")
    e.add_argument("--max-files", type=int)
    e.add_argument("--exclude", nargs="*", default=[])
    s = commands.add_parser("stats")
    s.add_argument("--csv", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if given.command == "extract":
        with open(given.registry, encoding="utf-8") as f:
            pairs = run_extract(spark, json.load(f), given.output_dir, given.corpora, given.format, given.max_files, given.exclude)
        print(sinks.summary(pairs))
    else:
        for name, df in run_stats(spark, given.csv).items():
            print(name)
            df.show(1000, truncate=False)


if __name__ == "__main__":
    main()
