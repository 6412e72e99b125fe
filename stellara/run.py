"""Run a query script by startup parameters: python -m stellara.run data_path:/root/testdata/sf0.1 query_path:/scripts/ q_id:3_1.txt"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from stellara.operators.partitions import morsels
from stellara.plans.script import parse as parse_script
from stellara.plans.star import filtered_fact, needed, run
from stellara.sources import files
from stellara.sources.parameters import Parameters, parse
from stellara.sources.views import Star


def script_text(spark: SparkSession, path: str) -> str:
    """A script's lines, wherever Spark can read them."""
    return "\n".join(r["value"] for r in files.numbered(spark, path, 0).orderBy("row").collect())


def execute(spark: SparkSession, p: Parameters) -> DataFrame:
    """The totals of the script at query_path + q_id over the tables in data_path, each fact row taken sf times."""
    spark.conf.set("spark.sql.shuffle.partitions", str(max(p.num_of_cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    query, star = parse_script(script_text(spark, p.query_path + p.q_id)), Star(spark, p.data_path.rstrip("/"))
    if p.sf == 1:
        return run(star, query)
    return run(star, query, files.replay(filtered_fact(star, query, needed(query))[0], p.sf))


def parts(spark: SparkSession, p: Parameters, table: str, row: str) -> DataFrame:
    """The row ranges of part_size rows that a table is cut into."""
    return morsels(Star(spark, p.data_path.rstrip("/")).raw(table), row, p.part_size)


def main(arguments: list[str]) -> None:
    p = parse(arguments)
    spark = SparkSession.builder.master(f"local[{p.num_of_cores}]").appName("stellara").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    execute(spark, p).show(1000, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
