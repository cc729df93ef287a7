"""python -m marginalia [-v] FOLDER: sweeps the source files below a folder and prints its findings, one line each, the worst of
each file first; with -v also the lines they are about."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    verbose = "-v" in args
    paths = [a for a in args if a != "-v"]
    if not paths or any(a.startswith("-") for a in paths):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from marginalia.functions import render
    from marginalia.operators import audit
    from marginalia.ship import ship
    from marginalia.sources import scan, sinks

    spark = SparkSession.builder.appName("marginalia").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    for path in paths:
        own = audit.files(spark, path)
        found = audit.judge(audit.comments(scan.scan(own)))
        line = render.tsv(F.regexp_replace("path", "^file:", ""), F.col("line"), F.col("class"), F.col("score"), F.col("reason"))
        if verbose:  # each finding with the line it is about and the code after it
            found = found.join(own.select("path", F.col("content").cast("string").alias("source")), "path")
            quote = sinks.quoted(F.col("source"), F.col("line"))
            line = F.concat_ws("\n", line, *(F.concat(F.lit("    "), render.printable(quote[c])) for c in ("comment", "code")))
        for row in found.select(line.alias("value"), "path", "score", "line").orderBy("path", F.desc("score"), "line").toLocalIterator():
            print(row.value)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
