from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stellara.functions import bits
from stellara.operators import bitmaps, encoding, partitions
from stellara.operators.predicates import EQ, GE, GT, LE, Predicate, scan
from stellara.plans import ssb
from stellara.plans.script import parse
from stellara.plans.star import needed, run
from stellara.sources import files
from stellara.sources.views import Star
from stellara.streaming.star import running


def test_dictionary_and_widths(spark):
    df = spark.createDataFrame([(30,), (10,), (20,), (10,), (None,)], "v int")
    codes = encoding.dictionary(df, "v")
    assert {r["value"]: r["code"] for r in codes.collect()} == {10: 0, 20: 1, 30: 2}
    assert [r["c"] for r in encoding.encode(df, "v", codes, "c").orderBy(F.col("v").asc_nulls_last()).collect()] == [0, 0, 1, 2, None]
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 128, 129, 32768, 32769)], "n int")
    assert [r[0] for r in sizes.select(encoding.width(F.col("n"))).collect()] == [8, 8, 8, 16, 16, 32]


def test_partitions(spark):
    rows = spark.range(30_000)
    got = sorted(tuple(r) for r in partitions.morsels(rows, "id", 12_000).collect())
    assert got == [(0, 0, 12031, 12032), (1, 12032, 24063, 12032), (2, 24064, 29999, 5936)]
    assert partitions.full_morsels(rows, "id", 12_000).count() == 2
    assert partitions.morsels(spark.range(0), "id", 64).count() == 0


def test_composite_and_halves(spark):
    row = spark.createDataFrame([(2, 1, 0, 65_537)], "i int, j int, k int, code int")
    assert row.select(encoding.composite([("i", 3), ("j", 2), ("k", 2)])).first()[0] == 10
    assert tuple(row.select(*encoding.halves("code")).first()) == (1, 1)


def test_bitmap_words(spark):
    rows = spark.range(64)
    word = bitmaps.bitmap(rows, "id", F.col("id").isin(0, 63)).first()["word"]
    assert word & (1 << 64) - 1 == 0x8000000000000001
    words = spark.createDataFrame([(0, word)], "word_id long, word long")
    assert sorted(r[0] for r in bitmaps.positions(words).collect()) == [0, 63]
    assert bitmaps.population(words).first()[0] == 2
    assert words.select(bits.shown(F.col("word"))).first()[0] == "1" + "0" * 62 + "1"
    assert words.select(bits.bits_at(F.col("word"), F.lit(60), 4)).first()[0] == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=150), st.integers(-1, 31), st.sampled_from([EQ, LE, GE, GT]))
def test_bitmap_route_equals_relational_route(spark, values, literal, kind):
    """Also literals that no row has, empty results, and a last word that is not full."""
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v int")
    p = Predicate("v", kind, (literal,))
    words = bitmaps.bitmap(rows, "id", p.on())
    assert sorted(r[0] for r in bitmaps.positions(words).collect()) == sorted(r["id"] for r in scan(rows, [p]).collect())


def test_delimited(spark, tmp_path):
    (tmp_path / "d.tbl").write_text("INT|STRING|DOUBLE\n1|a|2.5\n2|b|x\n")
    rows = files.read_delimited(spark, str(tmp_path / "d.tbl"), ["k", "name", "v"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 2.5), (2, "b", None)]


def test_column_files(spark, tmp_path):
    (tmp_path / "lo_col_0.tbl").write_text("INT\n5\n6\n7\n")
    (tmp_path / "lo_col_3.tbl").write_text("STRING\na\nb\nc\n")
    rows = files.read_columns(spark, str(tmp_path), {0: "k", 3: "name"}).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(0, 5, "a"), (1, 6, "b"), (2, 7, "c")]
    assert [r["value"] for r in files.read_micro_column(spark, str(tmp_path / "lo_col_0.tbl"), 2).orderBy("row").collect()] == [6, 7]


def test_column_files_of_uneven_parts(spark, tmp_path):
    """Spark reads the largest part first; rows follow the parts' names all the same."""
    parts = {"lo_col_0.tbl": ["INT\n1\n", "2\n3\n4\n5\n6\n7\n8\n", "9\n10\n"], "lo_col_1.tbl": ["STRING\n" + "\n".join("abcd") + "\n", "e\n", "f\ng\nh\ni\nj\n"]}
    for name, texts in parts.items():
        (tmp_path / name).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / name / f"part-{i}").write_text(t)
    rows = files.read_columns(spark, str(tmp_path), {0: "k", 1: "v"}).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(i, i + 1, "abcdefghij"[i]) for i in range(10)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        df = spark.range(500).select("id", (F.col("id") * 7).cast("int").alias("v"))
        files.write_columns(df, "id", {4: "v"}, str(tmp_path / "w"), parts=3)
        assert [r["v"] for r in files.read_columns(spark, str(tmp_path / "w"), {4: "v"}).orderBy("row").collect()] == [7 * i for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_micro_table_follows_its_meta_file(spark, tmp_path):
    (tmp_path / "mb").write_text("3\n2\n")
    (tmp_path / "mb_cols").mkdir()
    (tmp_path / "mb_cols/col0.dat").write_text("4\n1\n2\n3\n")
    (tmp_path / "mb_cols/col1.dat").write_text("8\n255\n0\n7\n")
    rows, widths = files.read_micro_table(spark, str(tmp_path / "mb"))
    assert widths == {"col0": 4, "col1": 8} and sorted(map(tuple, rows.collect())) == [(0, 1, 255), (1, 2, 0), (2, 3, 7)]
    words = encoding.packed(rows, "row", "col1", 8).first()["word"]
    assert words & (1 << 64) - 1 == 0xFF00070000000000


def test_tokens_and_replay(spark):
    df = spark.createDataFrame([("a|b|",), ("a||b",), ("",)], "s string")
    assert [r[0] for r in df.select(files.tokens(F.col("s"), "|")).collect()] == [["a", "b"], ["a", "", "b"], []]
    assert files.replay(df, 3).count() == 9 and files.replay(df, 0).count() == 0


def test_empty_results(spark):
    star = Star(spark, "/root/testdata/sf0.001")
    none = parse(ssb.SCRIPTS["q1_1"].replace("d_year = 1996", "d_year = 1900"))
    assert [r["total"] for r in run(star, none).collect()] == [0]
    assert run(star, parse(ssb.SCRIPTS["q2_1"].replace("AMERICA", "ATLANTIS"))).count() == 0


def test_streaming_totals_equal_batch(spark, tmp_path):
    star, query = Star(spark, "/root/testdata/sf0.001"), parse(ssb.SCRIPTS["q3_1"])
    fact = star.lineorder(needed(query))
    fact.repartition(3).write.parquet(str(tmp_path / "fact"))
    stream = spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "fact"))
    run_ = running(star, query, stream).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    run_.processAllAvailable()
    run_.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, run(star, query).collect()))
