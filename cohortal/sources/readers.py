"""Sources: listings, ids, nested facts, filing indexes, prices, months, settings."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.functions.scalars import finite, money, padded_id
from cohortal.functions.spec import OFFICIAL_WEIGHTS, Settings
from cohortal.sources.sinks import complete_months

LISTING_KEYS = ["symbol", "name", "lastsale", "volume", "marketCap", "sector", "industry", "country"]
FACT_SCHEMA = (
    "cik bigint, entityName string, facts map<string, map<string, struct<units: map<string, array<struct<"
    "start: string, `end`: string, val: double, filed: string, accn: string, form: string>>>>>>"
)
FILING_SCHEMA = "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>>>"
CHART_SCHEMA = (
    "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>, volume: array<double>>>,"
    " adjclose: array<struct<adjclose: array<double>>>>, events: struct<splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>>>>"
)
PERIODIC = ["10-K", "10-Q"]
SUCCESSOR_FORMS = ["8-K12B", "8-K12G3"]


class SourceError(ValueError):
    """A source is empty or lacks what it must have."""


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Listings from JSON documents {data: {rows: [...]}}; refuses an empty one or one without the keys."""
    rows = _json(spark, path, "data struct<rows: array<map<string, string>>>").select(F.explode("data.rows").alias("r"))
    first = rows.first()  # the keys are looked at in one document, none is read twice
    if first is None:
        raise SourceError("no listings")
    if lacking := sorted(set(LISTING_KEYS) - set(first.r)):
        raise SourceError(f"listings lack {lacking}")
    rows = rows.select(*(F.col("r")[k].alias(k) for k in LISTING_KEYS))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.select(
        F.upper(blank("symbol")).alias("entity"), blank("name").alias("name"), blank("sector").alias("sector"), blank("industry").alias("industry"),
        blank("country").alias("country"), money("lastsale").alias("last_sale"), money("volume").alias("volume"), money("marketCap").alias("market_cap"),
    )


def read_id_map(spark: SparkSession, path: str, least: int = 5000) -> DataFrame:
    """(entity, id): tickers and ten-digit ids; refuses fewer than ``least``."""
    rows = spark.read.schema("ticker string, cik_str bigint").json(path)
    out = rows.where("ticker is not null").select(F.upper(F.trim("ticker")).alias("entity"), padded_id("cik_str").alias("id"))
    if out.limit(least).count() < least:
        raise SourceError(f"fewer than {least} ids")
    return out


def match_ids(listings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings with their id, those without one)."""
    return listings.join(ids, "entity"), listings.join(ids.select("entity"), "entity", "left_anti")


def explode_facts(documents: DataFrame) -> DataFrame:
    """Nested fact documents as a long table (entity, taxonomy, concept, unit, start, end, val, filed, accn, form, seq)."""
    rows = (
        documents.select(padded_id("cik").alias("entity"), F.explode("facts").alias("taxonomy", "_c"))
        .select("entity", "taxonomy", F.explode("_c").alias("concept", "_u"))
        .select("entity", "taxonomy", "concept", F.explode("_u.units").alias("unit", "_f"))
        .select("entity", "taxonomy", "concept", "unit", F.posexplode("_f").alias("seq", "f"))
    )
    day = lambda c: F.col(f"f.{c}").cast("date").alias(c)
    return rows.select("entity", "taxonomy", "concept", "unit", day("start"), day("end"), finite("f.val").alias("val"), day("filed"), "f.accn", "f.form", "seq")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Company fact documents, one a line or a file; gzip is read as it is."""
    return explode_facts(spark.read.schema(FACT_SCHEMA).option("multiLine", True).json(path))


def newest_filing(documents: DataFrame, as_of: str) -> DataFrame:
    """(entity, newer): the newest periodic report filed by ``as_of``, from parallel arrays."""
    r = "filings.recent"
    rows = documents.select(padded_id("cik").alias("entity"), F.inline(F.arrays_zip(f"{r}.form", f"{r}.filingDate", f"{r}.reportDate")))
    rows = rows.select("entity", "form", F.col("filingDate").cast("date").alias("filed"), F.col("reportDate").try_cast("date").alias("report_date"))
    known = rows.where(F.col("form").isin(PERIODIC) & (F.col("filed") <= F.to_date(F.lit(as_of))) & F.col("report_date").isNotNull())
    return known.groupBy("entity").agg(F.max_by(F.struct("form", "filed", "report_date"), F.struct("report_date", "filed")).alias("newer"))


def has_successor_notice(documents: DataFrame) -> DataFrame:
    return documents.select(padded_id("cik").alias("entity"), F.arrays_overlap("filings.recent.form", F.array(*map(F.lit, SUCCESSOR_FORMS))).alias("successor_notice"))


def explode_chart(documents: DataFrame) -> DataFrame:
    """(entity, d, close, volume) from chart documents: adjusted closes, raw ones where there are none; missing closes go."""
    r = documents.select(F.explode("chart.result").alias("r"))
    closes = F.coalesce(F.try_element_at("r.indicators.adjclose", F.lit(1))["adjclose"], F.try_element_at("r.indicators.quote", F.lit(1))["close"])
    volumes = F.try_element_at("r.indicators.quote", F.lit(1))["volume"]
    rows = r.select(F.upper("r.meta.symbol").alias("entity"), F.inline(F.arrays_zip(F.col("r.timestamp").alias("t"), closes.alias("close"), volumes.alias("volume"))))
    return rows.toDF("entity", "t", "close", "volume").where("close is not null").select("entity", F.timestamp_seconds("t").cast("date").alias("d"), finite("close").alias("close"), finite("volume").alias("volume"))


def splits(documents: DataFrame) -> DataFrame:
    """(entity, d, ratio) of split events."""
    rows = documents.select(F.explode("chart.result").alias("r")).select(F.upper("r.meta.symbol").alias("entity"), F.explode(F.map_values("r.events.splits")).alias("s"))
    return rows.select("entity", F.timestamp_seconds("s.date").cast("date").alias("d"), F.try_divide("s.numerator", "s.denominator").alias("ratio"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return explode_chart(_json(spark, path, CHART_SCHEMA))


def read_csv_prices(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Date, Close, Volume files; a page of HTML in their place is refused."""
    if spark.read.text(path).where(F.col("value").rlike(r"(?i)<!doctype|<html")).limit(1).count():
        raise SourceError("HTML instead of CSV")
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.lit(entity).alias("entity"), F.col("Date").try_cast("date").alias("d"), finite(F.col("Close").try_cast("double")).alias("close"), finite(F.col("Volume").try_cast("double")).alias("volume")).where("close is not null")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180: quotes, doubled quotes, line ends inside."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


PROVIDERS: dict[str, Callable[..., DataFrame]] = {
    "listings": read_universe, "ids": read_id_map, "facts": read_facts, "chart_prices": read_prices, "csv_prices": read_csv_prices,
}


def provider(name: str) -> Callable[..., DataFrame]:
    if name not in PROVIDERS:
        raise SourceError(f"unknown source {name}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def load_settings(text: str) -> Settings:
    """Settings from a JSON object; unknown keys are refused."""
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
    if unknown := set(given) - {f.name for f in dataclasses.fields(Settings)}:
        raise SourceError(f"unknown settings {sorted(unknown)}")
    return Settings(**given)


def load_weights(text: str) -> dict[str, float]:
    given = OFFICIAL_WEIGHTS | {k: float(v) for k, v in json.loads(text).items() if k in OFFICIAL_WEIGHTS}
    if abs(sum(given.values()) - 100) > 1e-6:
        raise SourceError("weights must sum to 100")
    return given


def read_months(spark: SparkSession, path: str, since: str | None = None, only: str | None = None) -> DataFrame:
    """The record of months that are whole; partitions before ``since``, or but for ``only``, are not read."""
    months = [m for m in complete_months(spark, path) if (since is None or m >= since) and only in (None, m)]
    if not months:
        raise SourceError(f"no whole month is on record under {path}")
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/month={m}" for m in months))
    return rows.withColumn("month", F.col("month").cast("string"))
