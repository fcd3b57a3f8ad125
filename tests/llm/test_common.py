import os

from pyspark.sql import functions as F

from sparkloom.llm import common


def test_only_own_tables_are_cleared(spark):
    df = common.cut(spark.range(10).withColumn("x", F.col("id") * 2), "some")
    other = common.cut(spark.range(5), "other")
    assert df.where("x = 18").count() == 1
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    foreign = os.path.join(root, "sparkloom-another-application-x")
    os.makedirs(foreign)
    common.drop(df)
    assert other.count() == 5 and not [x for x in os.listdir(root) if "-some-" in x]
    common.clear(spark)
    assert os.path.isdir(foreign) and not [x for x in os.listdir(root) if spark.sparkContext.applicationId in x]


def test_scratch_tables_go(spark):
    with common.scratch(spark) as keep:
        a = common.cut(spark.range(3), "a")
        b = keep(common.cut(a.selectExpr("id + 1 as id"), "b"))
        with common.scratch(spark) as inner:
            c = inner(common.cut(spark.range(2), "c"))
            d = common.cut(spark.range(2), "d")
    left = lambda t: spark._jvm.org.apache.hadoop.fs.Path(common._written[t]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(common._written[t]))
    assert [left(t) for t in (a, b, c, d)] == [False, True, False, False] and sorted(r.id for r in b.collect()) == [1, 2, 3]
