"""python -m tidewright QUERY FOLDER [name=value ...]: runs a registered query and prints its first rows; without arguments lists the queries."""

from __future__ import annotations

import ast
import sys

from .plans import registered


def value(text: str):
    try:
        return ast.literal_eval(text)
    except (SyntaxError, ValueError):
        return text


def main(arguments: list[str]) -> int:
    queries = registered()
    if len(arguments) < 2 or arguments[0] not in queries:
        print(__doc__, *sorted(queries), sep="\n")
        return int(bool(arguments))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = {k: value(v) for k, v in (a.split("=", 1) for a in arguments[2:])}
    queries[arguments[0]][0](spark, arguments[1], **options).show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
