"""An audit of how filters interact, by direct replay of every order.

Each document's flags, one for each of five filters, are crossed with the 120
orders of the filters (a broadcast of that fixed size) and the five steps of an
order are exploded. The first filter of the order that fails a document removes
it; behind it the document is gone. The counts are conditional sums, combined on
the map side, so that what is shuffled is one row for each task, part, order and
step.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 100, 80, 10
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Filters A to D on one text: too short, too repetitive, too many capitals, odd signs. E needs the whole table."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITAL_PERCENT,
        "D": text.rlike(_SIGNS),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of ``docs``; bit k of fails is set if filter k of FILTERS fails.

    Equal texts are told by SHA-256. The rows of one text can be split in the join, as can those of one id.
    """
    text = F.coalesce("text", F.lit(""))
    bits = reduce(Column.bitwiseOR, (F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in failures(F.col("t")).items()))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"))
    marked = read.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("same"), bits.alias("fails"))
    # Materialised, as a join can split a side only if it is read as it is.
    twins = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("same")).groupBy("same")
    twins = cut(twins.agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"))
    judged = labels.where("doc_id is not null").groupBy("doc_id")
    judged = cut(judged.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    both = marked.join(twins, "same", "left").join(judged, "doc_id", "left")
    repeat = F.when(F.col("first") < F.col("doc_id"), 1 << FILTERS.index("E")).otherwise(0)
    return both.select(
        "part",
        F.col("fails").bitwiseOR(repeat).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row, zeros included, for each part of ``docs`` (doc_id, text, lang), order
    and step.

    * A null text is empty, a null lang the part ''. Rows count as often as they
      occur. A row whose id is null is no repeat of another, nor is another one of
      it; rows of one id are no repeats of each other.
    * Of several labels of one id, any that says so counts; documents without a
      label are neither good nor toxic. Without documents there are no rows.
    * Other columns, whatever their names, are not read. Texts may have any length.
    """
    spark = docs.sparkSession
    orders = [("".join(o), [1 << FILTERS.index(k) for k in o]) for o in permutations(FILTERS)]
    named = F.broadcast(spark.createDataFrame(list(enumerate(o for o, _ in orders)), "order_no int, filter_order string"))  # 120 rows, always
    bits = F.broadcast(spark.createDataFrame([(k, b) for k, (_, b) in enumerate(orders)], "order_no int, bits array<int>"))
    fails = F.col("fails")
    hit = lambda k: fails.bitwiseAND(F.col("bits")[k]) != 0
    first = reduce(lambda later, k: F.when(hit(k), k + 1).otherwise(later), reversed(range(5)), F.lit(6))
    replay = flags(docs, labels).crossJoin(bits).select("part", "order_no", "fails", "good", "toxic", first.alias("gone"), F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    removed, failing = F.col("gone") == step, fails.bitwiseAND(F.col("bit")) != 0
    n = lambda cond: F.count(F.when(cond, 1))
    counted = replay.groupBy("part", "order_no", "at").agg(
        n(F.col("gone") > step).alias("kept"),
        n(removed).alias("removed"),
        n(failing & (F.col("gone") < step)).alias("redundant"),
        n(fails == F.col("bit")).alias("unique_fails"),
        n(removed & F.col("good")).alias("good_lost"),
        n(removed & F.col("toxic")).alias("toxic_lost"),
    )
    counted = cut(counted.join(named, "order_no").withColumn("filter", F.substring("filter_order", F.col("at") + 1, F.lit(1))))
    shares = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "filter"]).select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
