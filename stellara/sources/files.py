"""Native file layouts: delimited tables, one file a column, micro-benchmark tables.

A path is a file or a folder of part files, whose order is that of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellara.session import cut

_KINDS = {"INT": T.IntegerType(), "DOUBLE": T.DoubleType()}
_NAMES = {"int": "INT", "bigint": "INT", "double": "DOUBLE"}


def kind_of(name: str) -> T.DataType:
    """A type name that begins with INT or DOUBLE is that type, any other is a string."""
    return next((t for k, t in _KINDS.items() if name.strip().startswith(k)), T.StringType())


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The first lines of the first file; a file's splits keep their order, the first one being the largest or as large."""
    files = sorted(spark.read.text(path).inputFiles())
    return [r[0] for r in spark.read.text(files[0]).limit(n).collect()] if files else []


def read_delimited(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A table whose first line names its types, `|` between cells. Cells that are no number become null."""
    kinds = [kind_of(k) for k in "".join(first_lines(spark, path)).split("|")]
    if len(kinds) < len(names):
        raise ValueError(f"{path} has {len(kinds)} columns, not {len(names)}")
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])
    return spark.read.csv(path, schema=schema, sep="|", header=True, enforceSchema=True, mode="PERMISSIVE")


def write_delimited(df: DataFrame, path: str) -> None:
    """The same layout, in one file a partition, each with its line of types."""
    kinds = [_NAMES.get(k, "STRING") for _, k in df.dtypes]
    df.toDF(*[f"{k} {i}" for i, k in enumerate(kinds)]).write.mode("overwrite").csv(path, sep="|", header=True)


def write_lines(rows: DataFrame, order: str, value: str, head: list[str], path: str, parts: int | None = None) -> None:
    """A text file (or part files) of `head` and a column's values in the order of `order`, a number from 0 on."""
    spark = rows.sparkSession
    lines = rows.select(F.col(order).cast("long").alias("at"), F.col(value).cast("string").alias("line"))
    top = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "at long, line string")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.unionByName(top).repartitionByRange(n, "at").sortWithinPartitions("at").select("line").write.mode("overwrite").text(path)


def numbered(spark: SparkSession, path: str, header_lines: int = 1) -> DataFrame:
    """(row, value): lines of a text file, or of part files one after the other, without the first lines.

    A line's number is its place in its block plus the lines of all blocks before, by file name and offset.
    """
    lines = cut(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    up_to = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (F.coalesce(F.sum("n").over(up_to), F.lit(0)) - F.col("first")).alias("shift"))
    placed = lines.join(blocks, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return placed.select((F.col("at") + F.col("shift") - header_lines).alias("row"), "value").where("row >= 0")


def write_columns(df: DataFrame, order: str, columns: dict[int, str], folder: str, prefix: str = "lo_col_", parts: int | None = None) -> None:
    """A file a column: its type, then its values in the order of `order`, a row number."""
    kinds = dict(df.dtypes)
    for number, name in columns.items():
        write_lines(df, order, name, [_NAMES.get(kinds[name], "STRING")], f"{folder}/{prefix}{number}.tbl", parts)


def read_columns(spark: SparkSession, folder: str, columns: dict[int, str], prefix: str = "lo_col_") -> DataFrame:
    """A fact table of one file a column, joined by row. Columns shuffle once for this: see sources.store for Parquet."""
    out = None
    for number, name in columns.items():
        path = f"{folder}/{prefix}{number}.tbl"
        kind = kind_of("".join(first_lines(spark, path)))
        own = numbered(spark, path).select("row", F.col("value").cast(kind).alias(name))
        out = own if out is None else out.join(own, "row")
    return out


def read_micro_column(spark: SparkSession, path: str, header_lines: int = 1) -> DataFrame:
    """(row, value) of one integer a line; the engine's own layout has two header lines, a table's column one."""
    return numbered(spark, path, header_lines).select("row", F.col("value").cast("int").alias("value"))


def write_micro_table(df: DataFrame, order: str, widths: dict[str, int], path: str) -> None:
    """A micro-benchmark table: `path` has the numbers of rows and columns, `path`_cols/col<i>.dat a column's bit width and values."""
    spark = df.sparkSession
    write_lines(spark.createDataFrame([], "at long, line string"), "at", "line", [str(df.count()), str(len(widths))], path, 1)
    for i, (name, width) in enumerate(widths.items()):
        write_lines(df, order, name, [str(width)], f"{path}_cols/col{i}.dat")


def read_micro_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(row, col0, col1, ...) and the bit width of each column; values are their own codes."""
    rows, columns = (int(x) for x in first_lines(spark, path, 2))
    out, widths = spark.range(rows).select(F.col("id").alias("row")), {}
    for i in range(columns):
        file = f"{path}_cols/col{i}.dat"
        widths[f"col{i}"] = int(first_lines(spark, file)[0])
        out = out.join(read_micro_column(spark, file).withColumnRenamed("value", f"col{i}"), "row")
    return out, widths


def micro_column(bits: int, seed: int = 1, row: str = "id") -> Column:
    """A number in [0, 2 ** bits), uniform and the same for the same row and seed."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string"))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(1 << bits)).cast("int")


def micro_table(spark: SparkSession, rows: int, bits: tuple[int, ...] = (4, 8)) -> DataFrame:
    return spark.range(rows).select("id", *[micro_column(b, seed).alias(f"col{seed}") for seed, b in enumerate(bits)])


def tokens(text: Column, delimiter: str) -> Column:
    """The parts between delimiters, without an empty last one."""
    parts = F.split(text, f"\\Q{delimiter}\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def replay(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times."""
    return df.withColumn("__time", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__time") if times > 0 else df.limit(0)
