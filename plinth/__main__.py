"""A small shell: python -m plinth [ROOT].  .help .tables .info TABLE .verbose .exit, or statements ending in a semicolon."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine, held, verbose = Engine(spark, sys.argv[1] if len(sys.argv) > 1 else None), "", False
    for line in sys.stdin:
        word, *rest = line.split() or [""]
        if word == ".exit":
            return
        try:
            if word == ".help":
                print(__doc__)
            elif word == ".tables":
                engine.catalog.tables().show(truncate=False)
            elif word == ".info":
                engine.catalog.columns(rest[0]).show(100, truncate=False)
                engine.info(rest[0]).show()
            elif word == ".verbose":  # plans before results
                verbose = not verbose
            else:
                held += line
                if held.rstrip().endswith(";"):
                    text, held = held, ""
                    result = engine.sql(text)
                    if verbose:
                        result.explain("formatted")
                    result.show(50, truncate=False)
        except Exception as e:  # a shell tells of errors and goes on
            held = ""
            print(f"{type(e).__name__}: {e}")


if __name__ == "__main__":
    main()
