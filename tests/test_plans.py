import time
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stellara.operators.predicates import EQ, EQ_OR_EQ, GT_AND_LE, LE
from stellara.plans import ssb
from stellara.plans.script import parse, parse_predicate
from stellara.plans.star import run, run_script
from stellara.run import parts
from stellara.session import SWEEP, cut, shared_folder
from stellara.sources import parameters, store
from stellara.sources.views import Star


@pytest.mark.parametrize(
    ("text", "kind", "values"),
    [
        ("lo_quantity <= 24", LE, (24,)),
        ("s_region = MIDDLE EAST", EQ, ("MIDDLE EAST",)),
        ("d_year > 1995 AND d_year <= 1999", GT_AND_LE, (1995, 1999)),
        ("p_mfgr = MFGR#1 OR p_mfgr = MFGR#2", EQ_OR_EQ, ("MFGR#1", "MFGR#2")),
    ],
)
def test_predicates(text, kind, values):
    p = parse_predicate(text)
    assert (p.kind, p.values) == (kind, values)


@pytest.mark.parametrize("text", ["lo_quantity < 25", "lo_quantity <> 3", "no_column = 1", "lo_quantity = x", "d_year > 1 AND d_weeknuminyear <= 3", "d_year = 1 AND d_year = 2", "d_year"])
def test_bad_predicates(text):
    with pytest.raises(ValueError):
        parse_predicate(text)


@pytest.mark.parametrize(
    "text",
    ["t\nEND", "t\nSTART\nSTART", "t\nSTART\nfact:lineorder", "t\nSTART\nfact:orders\nEND", "t\nSTART\ndimension:date\nEND", "t\nSTART\nfact:lineorder\njoin:date\nEND", "t\nSTART\nfact:lineorder\nlimit:3\nEND", "t\nSTART\ndimension:date\ngroupByColumn:s_city\nEND", "t\nSTART\nfact:lineorder\njoin:date-lo_orderdate\nEND", "t\nSTART\nfact:lineorder\ngroupByValue:lo_tax\nEND"],
)
def test_bad_scripts(text):
    with pytest.raises(ValueError):
        parse(text)


def test_script():
    q = parse(ssb.SCRIPTS["q4_2"])
    assert q.title == "Q4.2" and q.groups == ["s_nation", "p_category", "d_year"] and q.measure == "lo_revenue-lo_supplycost"
    assert q.joins == {"supplier": "lo_suppkey", "customer": "lo_custkey", "part": "lo_partkey", "date": "lo_orderdate"}


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    df = run(Star(spark, "/root/testdata/sf0.001"), parse(ssb.SCRIPTS["q3_1"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(r_name,ASIA)" in plan
    assert "l_tax" not in plan and "l_comment" not in plan and "p_retailprice" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q1_1", "q1_2", "q3_1", "q4_2"])
def test_dates_are_a_range_on_one_scan_of_orders(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(run(Star(spark, "/root/testdata/sf0.001"), parse(ssb.SCRIPTS[name])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.split("\n") if "FileScan" in line and "orders.parquet" in line]
    assert len(scans) == 1 and "GreaterThanOrEqual(o_orderdate" in scans[0] and "LessThan(o_orderdate" in scans[0]


def test_fact_filters_reach_the_scan(spark):
    plan = plan_of(run(Star(spark, "/root/testdata/sf0.001"), parse(ssb.SCRIPTS["q1_1"])))
    scan = next(line for line in plan.split("\n") if "lineitem.parquet" in line)
    assert "LessThanOrEqual(l_quantity,25.0)" in scan and "GreaterThanOrEqual(l_discount" in scan
    assert "Range (" not in plan  # a range of days needs no calendar


def test_stored_star_prunes_years(spark, tmp_path):
    star = Star(spark, "/root/testdata/sf0.001")
    store.write_star(star, str(tmp_path))
    stored = store.open_star(star, str(tmp_path))
    for name, text in ssb.SCRIPTS.items():
        assert sorted(map(tuple, run_script(stored, text).collect())) == sorted(map(tuple, run_script(star, text).collect())), name
    plan = plan_of(run_script(stored, ssb.SCRIPTS["q1_1"]))
    assert "PartitionFilters: [isnotnull(order_year" in plan and "GreaterThanOrEqual(lo_orderdate" in plan


def test_days(spark):
    star = Star(spark, "")
    assert star.days([parse_predicate("d_year = 1996")]) == (date(1996, 1, 1), date(1996, 12, 31), True)
    assert star.days([parse_predicate("d_weeknuminyear = 1")])[2] is False
    assert star.days([parse_predicate("d_year = 1900")]) is None


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://x:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(SimpleNamespace(sparkContext=sc))


def test_checkpoints_leave_no_shuffle_files(spark):
    def shuffled():
        jvm = spark._jvm
        found = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
        return {f.getName() for f in found if f.getName().startswith("shuffle_")}

    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, held, end = shuffled(), cut(counted.repartition(5)), time.monotonic() + 10
    while (left := shuffled() - before) and time.monotonic() < end:
        time.sleep(0.1)
    assert not left and spark.conf.get(SWEEP, None) is None
    assert sorted(held.collect()) == sorted(counted.collect()) == sorted(counted.collect())
    assert shuffled() - before  # other plans keep theirs


def test_parameters():
    with pytest.warns(UserWarning, match="nothing"):
        p = parameters.parse(["part_size:64", "data_path:/x:y", "nothing:1"])
    assert (p.part_size, p.data_path, p.num_of_cores) == (64, "/x:y", 4)
    toy = parameters.parse(["part_size:64", "run_type:toy"])
    assert (toy.part_size, toy.dax_queue_size, toy.num_of_cores) == (12_800, 1, 1)
    with pytest.raises(ValueError):
        parameters.parse(["part_size"])


def test_parts(spark):
    rows = parts(spark, parameters.parse(["data_path:/root/testdata/sf0.001", "part_size:640"]), "orders", "o_orderkey").collect()
    assert sum(r["n_rows"] for r in rows) == 1500 and max(r["n_rows"] for r in rows) == 640
