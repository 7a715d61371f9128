"""Analyses of words: python -m lalespark [--dictionary FILE] WORD..., or -i for one a line."""

from __future__ import annotations

import argparse
import sys


def main() -> None:
    parser = argparse.ArgumentParser(prog="lalespark", description=__doc__)
    parser.add_argument("words", nargs="*")
    parser.add_argument("-d", "--dictionary", help="a text file with a word a line")
    parser.add_argument("-i", "--interactive", action="store_true", help="read words from the terminal until q")
    args = parser.parse_args()

    from pyspark.sql import SparkSession

    from .functions import glosses
    from .operators.analyzer import analyze
    from .operators.lexicon import read_words
    from .plans.base import WORDS

    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known = read_words(spark, args.dictionary).cache() if args.dictionary else None

    def show(words: list[str]) -> None:
        rows = glosses.reports(analyze(spark.createDataFrame([(w,) for w in words], "word string"), known)).collect()
        texts = {r["word"]: r["report"] for r in rows}
        print(*[texts[w] for w in words if w in texts], sep="\n")

    if args.interactive:
        for line in sys.stdin:
            if line.strip().lower() in ("", "q"):
                break
            show([line.strip()])
    else:
        show(args.words or WORDS)
    spark.stop()


if __name__ == "__main__":
    main()
