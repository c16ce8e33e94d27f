"""Command line: `python -m strandline.cli preprocess ...` and `... match ...`."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline", description="Search short sequences in large collections of long ones.")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("preprocess", help="build a k-mer table")
    build.add_argument("-p", "--proteome", required=True)
    build.add_argument("-n", "--proteome_name", default="")
    build.add_argument("-k", "--kmer_size", type=int, required=True)
    build.add_argument("-P", "--preprocessed_files_path", default=".")
    match = commands.add_parser("match", help="search queries")
    match.add_argument("-q", "--query", required=True)
    match.add_argument("-p", "--proteome_file", required=True)
    match.add_argument("-m", "--max_mismatches", type=int, default=0)
    match.add_argument("-i", "--max_indels", type=int, default=0)
    match.add_argument("-k", "--kmer_size", type=int, default=0, help="0: chosen from the queries")
    match.add_argument("-P", "--preprocessed_files_path", default=".")
    match.add_argument("-n", "--proteome_name", default="")
    match.add_argument("-b", "--best_match", action="store_true")
    match.add_argument("-f", "--output_format", default="csv")
    match.add_argument("-o", "--output_name", default="")
    match.add_argument("-v", "--no_sequence_version", action="store_true")
    match.add_argument("-c", "--counts_only", action="store_true")
    return top


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "preprocess":
        from .sources.index import IndexBuilder

        IndexBuilder(a.proteome, a.proteome_name, a.preprocessed_files_path, spark=spark).preprocess(a.kmer_size)
        return 0
    from .plans.engine import Search

    result = Search(
        a.query, a.proteome_file, a.max_mismatches, a.max_indels, a.kmer_size, a.preprocessed_files_path, a.best_match,
        a.output_format, a.output_name, not a.no_sequence_version, a.counts_only, a.proteome_name, spark=spark,
    ).match()
    if result is not None:
        (result.show(truncate=False) if hasattr(result, "show") else print(result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
