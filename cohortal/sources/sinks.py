"""Sinks: append-only months, JSON, CSV packs, text exports and guarded back-fills."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.functions.scalars import quote_csv

PUBLIC = ["entity", "name", "sector", "segment", "rank", "composite", "decile", "composite_change", "rank_change"]
SLIM_UNIVERSE = ["entity", "name", "sector", "industry", "market_cap"]


#: The file that says a month is whole.
COMPLETE = "_COMPLETE"


def append_months(rows: DataFrame, path: str, force: bool = False, keep_history: bool = True) -> list[str]:
    """Write months that are not on record yet; with ``force`` those that are, too. Returns the months written.

    A month is a partition. All are written beside the record first; each then gets its completion mark and moves in by one
    rename, so a run that dies leaves either a whole month or none. What lacks a mark is no month: readers skip it, and the
    next run replaces it. Of two runs that write one month at once the second fails at the rename.
    """
    if not keep_history:
        return []
    spark = rows.sparkSession
    months = {r[0] for r in rows.select("month").distinct().collect()}  # a run writes one or a few
    known = months & set(complete_months(spark, path))
    wanted = sorted(months if force else months - known)
    if not wanted:
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    staging, record = hadoop.Path(path, f"_staging-{uuid.uuid4()}"), hadoop.Path(path)
    fs = record.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.where(F.col("month").isin(wanted)).repartition("month").write.partitionBy("month").parquet(staging.toString())
    for m in wanted:
        fs.create(hadoop.Path(staging, f"month={m}/{COMPLETE}")).close()
    for m in wanted:
        _move(spark, fs, hadoop.Path(staging, f"month={m}"), hadoop.Path(record, f"month={m}"))
    fs.delete(staging, True)
    return wanted


def _move(spark, fs, source, target) -> None:
    """One rename; what stood at the target is put aside before and goes afterwards."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = None
    if fs.exists(target):
        aside = hadoop.Path(target.getParent(), f"_old-{uuid.uuid4()}")
        fs.rename(target, aside)
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, none)
    if aside is not None:
        fs.delete(aside, True)


def complete_months(spark, path: str) -> list[str]:
    """The months under ``path`` that carry a completion mark."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    record = hadoop.Path(path)
    fs = record.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop.Path(record, f"month=*/{COMPLETE}")) or []
    return sorted(x.getPath().getParent().getName().removeprefix("month=") for x in found)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def public_rows(scored: DataFrame) -> DataFrame:
    return scored.select(*PUBLIC)


def slim_universe(listings: DataFrame) -> DataFrame:
    return listings.select(*SLIM_UNIVERSE)


def visible_columns(rows: DataFrame, columns: list[str], pro: bool, hidden: set[str] = frozenset(), locked: set[str] = frozenset({"entity"}), pro_only: set[str] = frozenset()) -> DataFrame:
    """Columns on show: locked ones always, others unless hidden or reserved."""
    return rows.select(*(c for c in columns if c in locked or (c not in hidden and (pro or c not in pro_only))))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file of a small table."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def zip_pack(tables: dict[str, DataFrame], notes: str) -> bytes:
    """Display-sized tables as CSV files, and a text, in one archive; their rows pass through the driver one by one."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
        for name, rows in tables.items():
            lines = [rows.columns, *(["" if x is None else str(x) for x in r] for r in rows.toLocalIterator())]
            pack.writestr(f"{name}.csv", quote_csv(lines) + "\r\n")
        pack.writestr("README.txt", notes)
    return out.getvalue()


def table_text(rows: DataFrame, by: str = "segment") -> DataFrame:
    """(by, text): each table as lines ``rank. entity name: composite`` in rank order."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("entity"), F.lit(" "), F.coalesce("name", F.lit("")), F.lit(": "), F.format_number("composite", 2))
    parts = F.array_sort(F.collect_list(F.struct("rank", "entity", line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def company_text(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """(entity, text): a company's scores and, factor by factor, its measures with their percentiles."""
    known = grid.where("raw is not null")
    one = F.concat(F.col("metric"), F.lit(" "), F.format_number("raw", 4), F.coalesce(F.concat(F.lit(" (p"), F.round("pct").cast("int").cast("string"), F.lit(")")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("factor", "metric", one.alias("t"))))
    lines = known.groupBy("entity").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["factor"], F.lit(": "), x["t"])), "\n").alias("lines"))
    head = F.concat(F.col("entity").cast("string"), F.lit(" rank "), F.col("rank").cast("string"), F.lit(" of "), F.col("segment"), F.lit(", composite "), F.format_number("composite", 2))
    return scored.join(lines, "entity", "left").select("entity", F.concat_ws("\n", head, "lines").alias("text"))


def _last(panel: DataFrame, by: list[str], months: int | None) -> DataFrame:
    """The last ``months`` of each group, taken before anything is gathered."""
    if months is None:
        return panel
    w = Window.partitionBy(*by).orderBy(F.desc("month"))
    return panel.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= months).drop("_k")


def history_text(panel: DataFrame, months: int | None = None) -> DataFrame:
    """(entity, text): ``month | rank | composite | price`` of each company's last months, one a line, a dash where nothing is known."""
    shown = lambda c, digits: F.coalesce(F.replace(F.format_number(c, digits), F.lit(","), F.lit("")), F.lit("-"))
    one = F.concat_ws(" | ", "month", F.coalesce(F.col("rank").cast("string"), F.lit("-")), shown("composite", 2), shown("price_adj", 2))
    parts = F.array_sort(F.collect_list(F.struct("month", one.alias("t"))))
    return _last(panel, ["entity"], months).groupBy("entity").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def trend_text(panel: DataFrame, months: int | None = None) -> DataFrame:
    """(entity, metric, trend): ``month value (pNN)`` of each month, or of the last ``months``, joined by bars."""
    one = F.concat(F.col("month"), F.lit(" "), F.format_number("raw", 2), F.coalesce(F.concat(F.lit(" (p"), F.round("pct").cast("int").cast("string"), F.lit(")")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("month", one.alias("t"))))
    known = _last(panel.where("raw is not null"), ["entity", "metric"], months)
    return known.groupBy("entity", "metric").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("trend"))


def report_markdown(title: str, sections: dict[str, DataFrame], cap: int = 100) -> str:
    """A report for people: each section's first ``cap`` rows as a table, and how many more there are. Only those rows reach the driver."""
    out = [f"# {title}"]
    for name, rows in sections.items():
        n, shown = rows.count(), rows.limit(cap).collect()
        out += [f"## {name} ({n})", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
        out += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in shown]
        out += [f"... and {n - cap} more"] * (n > cap)
    return "\n".join(out)


def back_fill(rows: DataFrame, extra: DataFrame, key: list[str], column: str) -> DataFrame:
    """Fill ``column`` where it is missing; refuses if anything else would change."""
    filled = rows.join(extra.select(*key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_new")))
    filled = filled.select(*rows.columns)
    if not same_but(rows, filled, [column]):
        shown = [r["row"] for r in changed_rows(rows, filled, [column]).limit(3).collect()]
        raise ValueError(f"a back-fill may change only its own column: {shown}")
    return filled


def fingerprint(rows: DataFrame, columns: list[str]) -> tuple:
    """(count, sum, sum, xor) over two hashes of each row: equal for equal record sets in any order, in one pass without a shuffle of rows."""
    told = lambda seed: F.xxhash64(F.lit(seed), *(x for k, c in enumerate(columns) for x in (F.lit(k), F.col(f"`{c}`"))))  # noqa: E731  # a null is skipped, its place is not
    hashed = rows.select(told(1).alias("a"), told(2).alias("b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return tuple(hashed.agg(F.count("*"), wide("a"), wide("b"), F.bit_xor(F.col("a"))).first())


def same_but(a: DataFrame, b: DataFrame, ignored: list[str]) -> bool:
    """Whether two record sets are equal, row for row, but for some columns; told by their fingerprints."""
    columns = sorted(c for c in a.columns if c not in ignored)
    return columns == sorted(c for c in b.columns if c not in ignored) and fingerprint(a, columns) == fingerprint(b, columns)


def changed_rows(a: DataFrame, b: DataFrame, ignored: list[str]) -> DataFrame:
    """(side, row): what either record set has and the other has not; for a report, as it shuffles both."""
    columns = [c for c in a.columns if c not in ignored]
    x, y = a.select(*columns), b.select(*columns)
    only = lambda left, right, side: left.exceptAll(right).select(F.lit(side).alias("side"), F.to_json(F.struct(*columns)).alias("row"))
    return only(x, y, "before").unionByName(only(y, x, "after"))


def annotate(rows: DataFrame, stale: DataFrame, looked_up: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` of the stale rows that were looked up, leave the rest."""
    found = looked_up.join(stale.select(key), key, "left_semi").select(key, F.col(column).alias("_new"))
    current = F.col(column) if column in rows.columns else F.lit(None)
    return rows.join(found, key, "left").withColumn(column, F.coalesce("_new", current)).drop("_new")
