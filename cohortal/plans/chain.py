"""Month-end prices on one basis, kept up month by month.

A month's record holds, beside each price, where its chain began and the product of all links since: a link is what this
month says last month's price was, over what it was then. A new month needs its own rows and those of the month before;
older records stay as they are. A price on the newest basis is then the price times the newest product over its own, as long
as both belong to one chain. A missing month, or a link that is missing or not positive, begins a new chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions.stats import half_up
from cohortal.plans.panel import month_index
from cohortal.sources import readers, sinks

COLUMNS = ["entity", "price", "prior_price", "chain", "factor"]


def _positive(c: str) -> Column:
    return F.coalesce(F.col(c) > 0, F.lit(False))


def linked(rows: DataFrame, before: DataFrame | None, month: str) -> DataFrame:
    """(entity, price, prior_price, chain, factor): a month's rows (entity, price, prior_price), linked to the record of the month before."""
    fresh = [F.lit(month).alias("chain"), F.lit(1.0).alias("factor")]
    if before is None:
        return rows.select("entity", "price", "prior_price", *fresh)
    was = before.select("entity", F.col("price").alias("_price"), F.col("chain").alias("_chain"), F.col("factor").alias("_factor"))
    both = rows.select("entity", "price", "prior_price").join(was, "entity", "left")
    ok = _positive("_price") & _positive("prior_price")
    chain = F.when(ok, F.col("_chain")).otherwise(F.lit(month)).alias("chain")
    return both.select("entity", "price", "prior_price", chain, F.when(ok, F.col("_factor") * F.col("prior_price") / F.col("_price")).otherwise(F.lit(1.0)).alias("factor"))


def linked_history(panel: DataFrame) -> DataFrame:
    """A whole panel (month, entity, price, prior_price) linked at once, as if month after month had been: to begin a record."""
    placed = panel.join(F.broadcast(month_index(panel)), "month")  # as long as the record has months
    w = Window.partitionBy("entity").orderBy("idx")
    was, at = F.lag("price").over(w), F.lag("idx").over(w)
    ok = F.coalesce((at == F.col("idx") - 1) & (was > 0) & (F.col("prior_price") > 0), F.lit(False))
    rows = placed.withColumns({"_ok": ok, "_link": F.when(ok, F.col("prior_price") / was).otherwise(F.lit(1.0))})
    rows = rows.withColumn("chain", F.max(F.when(~F.col("_ok"), F.col("month"))).over(w))
    since = Window.partitionBy("entity", "chain").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("factor", F.product("_link").over(since)).select("month", *COLUMNS)


def chain_month(spark: SparkSession, path: str, rows: DataFrame, month: str, force: bool = False) -> list[str]:
    """Put a month on record under ``path``, linked to the last one before it; only that partition is read. Returns the months written.

    A month on record stays as it is, unless ``force`` is set; later months are not linked anew then, so that is for the newest.
    """
    return sinks.append_months(linked(rows, before(spark, path, month), month).withColumn("month", F.lit(month)), path, force)


def before(spark: SparkSession, path: str, month: str) -> DataFrame | None:
    """The record of the last month before ``month``; None where there is none."""
    older = [m for m in sinks.complete_months(spark, path) if m < month]
    return readers.read_months(spark, path, only=max(older)) if older else None


def on_newest_basis(record: DataFrame) -> DataFrame:
    """(month, entity, price_adj): every price of a record on the basis of its entity's newest month; null before a break, 4 digits."""
    # A window, so that the record is read and dealt by entity once.
    both = record.withColumn("_n", F.max_by(F.struct("chain", "factor"), "month").over(Window.partitionBy("entity")))
    same = (F.col("chain") == F.col("_n.chain")) & (F.col("price") > 0)
    return both.select("month", "entity", F.when(same, half_up(F.col("price") * (F.col("_n.factor") / F.col("factor")), 4)).alias("price_adj"))


def restated(record: DataFrame, latest: DataFrame, month: str, prior: DataFrame | None) -> DataFrame:
    """``record`` with the rows of its newest ``month`` replaced by ``latest`` (entity, price, prior_price) and linked anew.

    ``prior`` is the record of the month before. Rows without a newer price stay; nothing on record is changed.
    """
    now = record.where(F.col("month") == month)
    new = latest.select("entity", F.col("price").alias("_p"), F.col("prior_price").alias("_q"), F.lit(True).alias("_new"))
    rows = now.select("entity", "price", "prior_price").join(new, "entity", "left")
    given = lambda a, b: F.when(F.col("_new"), F.col(a)).otherwise(F.col(b))
    rows = rows.select("entity", given("_p", "price").alias("price"), given("_q", "prior_price").alias("prior_price"))
    return record.where(F.col("month") != month).select("month", *COLUMNS).unionByName(linked(rows, prior, month).withColumn("month", F.lit(month)).select("month", *COLUMNS))
