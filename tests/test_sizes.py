"""Partitions follow the tables that a query reads."""

from dagbag import fixtures as fx
from dagbag import queries
from dagbag.plans import sizes


def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizes, "TABLE_BYTES", 1000)
    items = spark.range(20_000).selectExpr("id % 5000 as l_orderkey", "id % 40 as l_partkey", "cast(id % 50 as double) as l_quantity", "cast(id % 7 as int) as l_linenumber")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).selectExpr("id as p_partkey", "concat('Brand#', id % 25) as p_brand").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(5000).selectExpr("id as o_orderkey", "id % 900 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("bag", "diff_all", "double_weights"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        inside = df.sparkSession
        total = sum(p.stat().st_size for t in ("lineitem", "part", "orders") for p in (tmp_path / f"{t}.parquet").rglob("*"))
        assert total // 2000 <= int(inside.conf.get("spark.sql.shuffle.partitions")) <= total // 1000 + 1
        assert df.count()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    # a session that isn't a query's own is left alone
    fx.brands(spark, str(tmp_path)).values()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_own_sessions_have_the_settings_and_views_of_theirs(spark):
    spark.range(3).createOrReplaceTempView("__three")
    inside = sizes.own(spark)
    assert inside.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert inside.table("__three").count() == 3 and type(spark).getActiveSession()._jsparkSession.equals(spark._jsparkSession)
