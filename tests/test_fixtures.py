"""Derived views follow the tables."""

import shutil

import pyarrow.parquet as pq

from pitstats.sources.fixtures import forget, view


def test_a_replaced_table_gives_new_views(spark, tmp_path):
    sf = str(tmp_path)
    for name in ("customer", "orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    before = view(spark, sf, "fx_games").count()
    again = view(spark, sf, "fx_games").inputFiles()
    assert view(spark, sf, "fx_games").inputFiles() == again  # unchanged tables: not derived again
    pq.write_table(pq.read_table(tmp_path / "lineitem.parquet").slice(0, 500), tmp_path / "lineitem.parquet")
    after = view(spark, sf, "fx_games")
    assert after.count() < before and view(spark, sf, "fx_plays").count() == 500
    forget(spark.sparkContext.applicationId)
    assert view(spark, sf, "fx_games").inputFiles() != after.inputFiles()


def test_derived_views_have_the_rows_of_their_sql(spark, tmp_path):
    """Also with orders given twice or without date, owner or amount, and customers that are missing, repeated or moved."""
    from pyspark.sql import functions as F

    from pitstats.sources.fixtures import DERIVED, TABLES, VIEWS, _needs

    source = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("nation", "customer", "orders", "lineitem")}
    orders, customer = source["orders"], source["customer"]
    null = lambda c, n: F.when(F.col("o_orderkey") % n != 0, F.col(c)).alias(c)
    odd = {"o_orderdate": 17, "o_custkey": 13, "o_totalprice": 7}
    source["orders"] = orders.select(*(null(c, odd[c]) if c in odd else c for c in orders.columns)).union(orders.where("o_orderkey % 5 = 0"))
    moved = customer.where("c_custkey % 3 = 0").withColumn("c_nationkey", ((F.col("c_nationkey") + 1) % 25).cast(customer.schema["c_nationkey"].dataType))
    source["customer"] = customer.where("c_custkey % 11 <> 0").union(customer.where("c_custkey % 4 = 0")).union(moved)
    source["lineitem"] = source["lineitem"].where("l_orderkey % 19 <> 0")
    for name, df in source.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    def plain(name):
        if name in TABLES:
            return spark.read.parquet(f"{tmp_path}/{name}.parquet")
        return spark.sql(VIEWS[name], **{n: plain(n) for n in _needs(VIEWS[name])})

    for name in [n for n in DERIVED if n in VIEWS]:
        got, want = view(spark, str(tmp_path), name), plain(name)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name


def test_views_of_months_move_no_rows(spark):
    for name in ("fx_games", "fx_proj"):
        plan = view(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_partitions_of_months_follow_the_tables(spark, monkeypatch):
    """Sums are over as many rows a task whatever the tables' size, so that they don't spill."""
    from pitstats.sources import fixtures

    sf = "/root/testdata/sf0.001"
    sizes = {}
    for part in (1 << 30, 4_000):
        fixtures.forget()
        monkeypatch.setattr(fixtures, "PART_BYTES", part)
        sizes[part] = len(view(spark, sf, "fx_months").inputFiles())
    fixtures.forget()
    assert sizes[1 << 30] <= 8 and sizes[4_000] > 20
