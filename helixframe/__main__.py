"""Command line: ``python -m helixframe curate``, ``windows`` and ``collate``."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="helixframe")
    sub = main.add_subparsers(dest="command", required=True)
    c = sub.add_parser("curate", help="annotate selected variants and down-sample the negatives")
    c.add_argument("--vep", required=True)
    c.add_argument("--selected", required=True)
    c.add_argument("--output-prefix", required=True)
    c.add_argument("--has-target-genes", action="store_true")
    c.add_argument("--neg-labels", nargs="+", default=["low_pip"])
    c.add_argument("--neg-fraction", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--region", choices=("transcribed", "outside-transcripts"), default="transcribed")
    w = sub.add_parser("windows", help="plan DNA windows and write the contexts to be scored")
    w.add_argument("--candidates", required=True)
    w.add_argument("--fasta", required=True)
    w.add_argument("--gtf")
    w.add_argument("--output", required=True)
    w.add_argument("--window-length", type=int, default=8192)
    w.add_argument("--min-variant-margin", type=int, default=1024)
    g = sub.add_parser("collate", help="union score shards in the order of their input index")
    g.add_argument("--shards", nargs="+", required=True)
    g.add_argument("--output", required=True)
    return main


def checked(argv: list[str] | None = None) -> argparse.Namespace:
    """Arguments, after the rules that single options cannot state."""
    main = parser()
    args = main.parse_args(argv)
    if args.command == "curate" and not 0 <= args.neg_fraction <= 1:
        main.error("--neg-fraction has to lie between 0 and 1")
    if args.command == "windows":
        from .operators.sequences import check_window_policy

        try:
            check_window_policy(args.window_length, args.min_variant_margin)
        except ValueError as e:
            main.error(str(e))
    return args


def run(spark, args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from .operators import curation as U
    from .operators import sequences as Q
    from .sources import files, sinks

    if args.command == "curate":
        full, sampled = U.curate(files.read_selected(spark, args.selected), files.read_vep(spark, args.vep), args.region, args.has_target_genes, args.neg_labels, args.neg_fraction, args.seed)
        # Both are planned before either is written.
        for df, suffix in ((full, ".tsv"), (sampled, ".downsampled.tsv")):
            sinks.write_tsv(df, args.output_prefix + suffix, U.genomic_order(), null="-")
    elif args.command == "windows":
        chunks = Q.chunked(files.read_fasta(spark, args.fasta)).cache()
        known = Q.validate_dna(files.read_dna_candidates(spark, args.candidates).where(F.col("alt").isin(*Q.BASES)), chunks)
        plans = Q.plan_windows(known, files.read_gtf_genes(spark, args.gtf) if args.gtf else None, args.window_length, args.min_variant_margin)
        sinks.write_tables({"plans": plans, "contexts": Q.context_sequences(Q.contexts(plans), chunks, args.window_length)}, args.output)
    else:
        parts = [spark.read.parquet(p) for p in args.shards]
        out = U.merge_evaluations(parts, ["input_index"])
        sinks.write_tsv(out, args.output, ["input_index"], null="-")


def main() -> None:
    from pyspark.sql import SparkSession

    args = checked()
    spark = SparkSession.builder.appName(f"helixframe {args.command}").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
