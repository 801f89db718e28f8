"""The data pack: six long tables of the whole record, a consistent subset of them, and both as files.

The subset keeps the rows of the chosen tables and companies; one set of (month, entity) keys, taken from the scores, says
what stays in every other table, so that no row is left without its score. Tables are written as part files beside a manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS, DICTIONARY, COMPANIES, SCORES, METRICS, NOT_RANKED = TABLES = ["months", "metrics_dictionary", "companies", "scores_monthly", "metrics_monthly", "not_ranked_monthly"]


def build(scores: DataFrame, metrics: DataFrame, not_ranked: DataFrame, spec: DataFrame) -> dict[str, DataFrame]:
    """The tables by name. ``scores``: month, entity, name, sector, segment and what else is known; ``metrics``: month, entity, metric, raw, pct;
    ``not_ranked``: month, entity, name, segment, kind, reason; ``spec``: metric, factor, higher_better.

    A company is told as in its newest month. A month without a row in ``not_ranked`` says so.
    """
    recorded = not_ranked.select("month").distinct().withColumn("_r", F.lit(True))
    months = scores.groupBy("month").agg(F.count("*").alias("companies_ranked")).join(recorded, "month", "left")
    newest = scores.groupBy("entity").agg(F.max_by(F.struct("name", "sector", "segment"), "month").alias("_x"))
    labels = F.broadcast(spec.select("metric", "factor"))  # as long as the registry
    return {
        MONTHS: months.select("month", "companies_ranked", F.when(F.col("_r"), "yes").otherwise("not recorded").alias("not_ranked_recorded")),
        DICTIONARY: spec.select("metric", "factor", F.when(F.col("higher_better"), "higher").otherwise("lower").alias("better_when")),
        COMPANIES: newest.select("entity", "_x.*"),
        SCORES: scores,
        METRICS: metrics.join(labels, "metric", "left").select("month", "entity", "metric", "factor", "raw", "pct"),
        NOT_RANKED: not_ranked,
    }


def top_today(scores: DataFrame, n: int) -> DataFrame:
    """(segment, entity) of the first ``n`` of each segment in the newest month."""
    newest = scores.agg(F.max("month").alias("_m"))  # one row
    return scores.where(F.col("rank") <= n).join(F.broadcast(newest), F.col("month") == F.col("_m")).select("segment", "entity")


def subset(tables: dict[str, DataFrame], segments: list[str], keep: DataFrame | None = None) -> dict[str, DataFrame]:
    """The pack cut to some segments and, where ``keep`` (segment, entity) names any of a segment, to these companies."""
    scores = tables[SCORES].where(F.col("segment").isin(segments))
    if keep is not None:
        named = keep.select("segment").distinct().withColumn("_some", F.lit(True))
        chosen = keep.select("segment", "entity").distinct().withColumn("_chosen", F.lit(True))
        scores = scores.join(named, "segment", "left").join(chosen, ["segment", "entity"], "left").where("_some is null or _chosen").select(*tables[SCORES].columns)
    keys = scores.select("month", "entity").distinct()
    return tables | {
        SCORES: scores,
        METRICS: tables[METRICS].join(keys, ["month", "entity"], "left_semi"),
        COMPANIES: tables[COMPANIES].join(keys, "entity", "left_semi"),
        NOT_RANKED: tables[NOT_RANKED].where(F.col("segment").isin(segments)),
    }


def write(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table as part files under its name, and a manifest of what is there; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{name}")
    written = [read(spark, path, name, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")) for name, rows in tables.items()]
    told = [rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("file"), "n_rows", F.lit(",".join(rows.columns)).alias("columns")) for name, rows in zip(tables, written, strict=True)]
    reduce(DataFrame.unionByName, told).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("file string, n_rows long, columns string").json(f"{path}/manifest")


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{name}")
