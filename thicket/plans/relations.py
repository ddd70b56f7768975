"""Triples from the driver's tables: what an extractor would find, without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triple(one: Column, one_type: str, two: Column, two_type: str, edge: Column, chunk: Column, seq: Column) -> list[Column]:
    return [
        one.alias("node_1"), F.lit(one_type).alias("node_1_type"), two.alias("node_2"), F.lit(two_type).alias("node_2_type"),
        edge.alias("edge"), chunk.alias("chunk_id"), seq.alias("seq"),
    ]


def orders_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer and a part's brand, by the order's priority; an order is a chunk."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return rows.select(*_triple(F.col("c_name"), "customer", F.col("p_brand"), "brand", F.col("o_orderpriority"), F.col("l_orderkey").cast("string"), seq))


def geo_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers are located in nations, nations are part of regions."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    seq = lambda rank, key: F.struct(F.lit(rank).alias("k"), F.col(key).cast("long").alias("id"))
    chunk = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))

    def located(df: DataFrame, name: str, key: str, kind: str, rank: int, at: str) -> DataFrame:
        cols = _triple(F.col(name), kind, F.col("n_name"), "nation", F.lit("located in"), chunk("n", "n_nationkey"), seq(rank, key))
        return df.join(nation, F.col(at) == F.col("n_nationkey")).select(*cols)

    cols = _triple(F.col("n_name"), "nation", F.col("r_name"), "region", F.lit("part of"), chunk("r", "r_regionkey"), seq(2, "n_nationkey"))
    part_of = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(*cols)
    customers = located(t("customer"), "c_name", "c_custkey", "customer", 0, "c_nationkey")
    return customers.unionByName(located(t("supplier"), "s_name", "s_suppkey", "supplier", 1, "s_nationkey")).unionByName(part_of)


def events_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user and a key, by the event's type; a user's day is a chunk."""
    user, key = F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("k "), F.get_json_object("props", "$.k"))
    day = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(*_triple(user, "user", key, "key", F.col("event_type"), day, F.col("event_id")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, answer): what a model might answer about each order: a JSON array bare, fenced, amid prose, with an
    element that isn't whole, or none, by the order's number."""
    rows = orders_triples(spark, sf_dir).select("seq", F.to_json(F.struct("node_1", "node_1_type", "node_2", "node_2_type", "edge")).alias("j"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "j"))), lambda x: x["j"])
    arrays = rows.groupBy(F.col("seq.l_orderkey").alias("order")).agg(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")).alias("a"))
    bad = F.concat(F.expr("substr(a, 1, length(a) - 1)"), F.lit(',{"node_1":"only"}]'))
    kind = F.col("order") % 5
    text = F.when(kind == 0, F.col("a")).when(kind == 1, F.concat(F.lit("```json\n"), "a", F.lit("\n```")))
    text = text.when(kind == 2, F.concat(F.lit("Here they are: "), "a", F.lit(" Is that [all] right?"))).when(kind == 3, bad)
    return arrays.select("order", text.otherwise(F.lit("I found nothing.")).alias("answer"))
