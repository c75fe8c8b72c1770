"""``python -m reverie.export STORE OUT``: writes a store's memory as one table of the export's columns."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from reverie.api import Store


def main(arguments: list[str]) -> int:
    if len(arguments) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("export").getOrCreate()
    print(f"{Store(spark, arguments[0]).export(arguments[1])} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
