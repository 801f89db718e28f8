"""Stand-in inputs from the driver's tables: customers as entities, nations as peers, market segments as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.functions.spec import Metric, Registry
from cohortal.functions.stats import half_up

RETURNS = dict.fromkeys(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "margin")
METRICS = [
    Metric("spend", "quality"), Metric("orders", "quality"), Metric("margin", "quality"), Metric("recent_spend", "growth", conditioned=True),
    Metric("recent_orders", "growth", optional=True), Metric("aov", "valuation"), Metric("return_share", "health", False), Metric("balance", "health"),
    Metric("rare_spend", "valuation"),
]
HURDLE = 0.95


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def registry(spark: SparkSession) -> DataFrame:
    return Registry(METRICS).table(spark)


def net_price():
    """A line's net price in hundredths of a cent: whole numbers, so that sums do not depend on their order."""
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")


def cents():
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their order's customer and day."""
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", F.to_date("l_shipdate").alias("ship")
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return items.join(orders, items.l_orderkey == orders.o_orderkey)


def customers(spark: SparkSession, d: str) -> DataFrame:
    """entity, name, segment, peer, sector, market_cap."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("peer"), F.col("c_nationkey").cast("string").alias("sector"), F.col("c_acctbal").alias("market_cap"),
    )


def measures(spark: SparkSession, d: str) -> DataFrame:
    """(entity, metric, raw): a customer's measures; windowed ones are missing where nothing fell into the window."""
    net = net_price()
    recent = F.col("day").between("2000-01-01", "2000-06-30")
    rare = F.col("day").between("2000-01-01", "2000-01-15")
    wide = (
        lines(spark, d)
        .groupBy(F.col("o_custkey").alias("entity"))
        .agg(
            (F.sum(net) / 10000.0).alias("spend"),
            F.count_distinct("l_orderkey").cast("double").alias("orders"),
            half_up(F.sum(net) / (F.sum(cents()) * 100.0), 6).alias("margin"),
            (F.sum(F.when(recent, net)) / 10000.0).alias("recent_spend"),
            F.nullif(F.count_distinct(F.when(recent, F.col("l_orderkey"))), F.lit(0)).cast("double").alias("recent_orders"),
            half_up(F.sum(net) / 10000.0 / F.count_distinct("l_orderkey"), 2).alias("aov"),
            half_up(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity"), 6).alias("return_share"),
            (F.sum(F.when(rare, net)) / 10000.0).alias("rare_spend"),
        )
    )
    balance = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.lit("balance").alias("metric"), F.col("c_acctbal").alias("raw"))
    keys = [c for c in wide.columns if c != "entity"]
    return wide.unpivot("entity", keys, "metric", "raw").unionByName(balance)


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Fact versions: (entity = part, concept, start, end = the order month's end, val, filed = the ship day, seq)."""
    x = lines(spark, d)
    return x.select(
        F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("concept"), F.trunc("day", "month").alias("start"), F.last_day("day").alias("end"),
        F.col("l_extendedprice").alias("val"), F.col("ship").alias("filed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """(entity = supplier, end = the quarter's end, val = revenue)."""
    end = F.last_day(F.add_months(F.trunc("day", "quarter"), 2)).alias("end")
    net = net_price()
    return lines(spark, d).groupBy(F.col("l_suppkey").alias("entity"), end).agg((F.sum(net) / 10000.0).alias("val"))


def monthly_scores(spark: SparkSession, d: str, by: str = "l_suppkey", before: str = "2001-08-01") -> DataFrame:
    """(month, entity, composite, price): a supplier's monthly revenue and mean unit price, of the whole months before a day: the tables end with a partial one."""
    net = net_price()
    return (
        lines(spark, d)
        .where(F.col("day") < before)
        .groupBy(F.date_format("day", "yyyy-MM").alias("month"), F.col(by).alias("entity"))
        .agg((F.sum(net) / 10000.0).alias("composite"), half_up(F.sum(cents()) / 100.0 / F.sum("l_quantity"), 4).alias("price"))
    )


def customer_month(spark: SparkSession, d: str, month: str) -> DataFrame:
    """A month's ranking of the customers that ordered: entity, name, sector, segment, composite, rank."""
    orders = table(spark, d, "orders").where(F.date_format("o_orderdate", "yyyy-MM") == month)
    spent = orders.groupBy(F.col("o_custkey").alias("entity")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("composite"))
    from cohortal.plans.score import with_rank

    return with_rank(customers(spark, d).join(spent, "entity"))


def watch(spark: SparkSession, d: str) -> DataFrame:
    """Watch intervals from a user's events: each opens one of its type, the next event closes it."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ends = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("entity"), "event_type", F.col("ts").alias("added_at"), ends.alias("removed_at"))
