"""Bounds as the defaults have them."""

from pyspark.sql import functions as F

from rulespark import catalog
from rulespark.plans import relation_queries


def test_readers_up_to_the_default_bound(spark, sf, monkeypatch):
    """120 readers of a fact are paired, 121 are not."""
    one = relation_queries.bindings(spark, sf).where("role = 'read'").limit(1)
    many = lambda fact, n: one.withColumn("fact", F.lit(fact)).crossJoin(spark.range(n)).withColumn("rule_id", F.concat(F.lit(f"{fact}_"), F.col("id").cast("string"))).drop("id")
    monkeypatch.setattr(relation_queries, "bindings", lambda *_: many("a", 21).unionByName(many("b", 120)).unionByName(many("c", 121)))
    got = catalog.queries()["association_shared_input"](spark, sf)
    assert {r["f"]: r["n"] for r in got.groupBy(F.substring("source", 1, 1).alias("f")).agg(F.count("*").alias("n")).collect()} == {"a": 210, "b": 7140}


def test_table_chunks_round_halves_as_sql_does(spark, tmp_path):
    """Halves go to the even number, on both sides of zero."""
    import duckdb

    rows = [(4 * k + 1, f"s{k}", 1, v) for k, v in enumerate([0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 6606.5, 0.49999999999999994, 7.25, None])]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.queries()["table_chunks"](spark, str(tmp_path)).collect())) == sorted(con.execute(catalog.oracle_sql()["table_chunks"]).fetchall())
