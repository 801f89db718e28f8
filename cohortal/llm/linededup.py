"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line, in the order (doc_id, line number), is equal to
it or within one edit (insertion, deletion or substitution of a character).

* Equal lines meet by a 128-bit hash; the first of them stays.
* For near lines every variant with one stretch of characters deleted is emitted
  as a hashed key, and lines that share a key meet. A single-character edit at
  position p leaves everything before and after p alone, so two lines within one
  edit share the variant whose deleted stretch covers p.
* Deleting every single character of every line would cost the square of its
  length. The stretches are therefore narrowed step by step: first each half of
  a line, then, only where two lines share a key, parts of that half, down to
  single characters. Each step keeps every pair that the last step can find.
* At single characters all lines with one key are within one edit of each other,
  so each is compared with the earliest alone: no pairs within a group. The edit
  distance is verified on the texts.

Two lengths can meet, n and n + 1, so each line emits its variants under both
labels: as the longer line (one more character deleted) and as the shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut, stored

#: Lines of fewer characters are compared for equality only. By the method every line is compared; a caller may spare short ones.
MIN_NEAR_CHARS = 1
#: A surviving stretch is cut into so many parts at each step.
PARTS = 48
EDITS = 1
_ROW = ["doc_id", "rk", "line_no"]


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "rk", F.posexplode("lines").alias("line_no", "line")).where(F.trim("line") != "")


def _split(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rk"), F.split(text_col, "\n").alias("lines"), *more
    )


def _distinct(docs: DataFrame, min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """Each distinct line's first place, length and the hashes of its halves under both labels."""
    line, n = F.col("line"), F.length("line")

    def halves(m: Column) -> list[Column]:
        f = F.floor((m - 1) / 2).cast("int")
        left = F.xxhash64(m, F.lit(1), F.left(line, f))
        right = F.xxhash64(m, F.lit(2), F.right(line, f))
        return [left, right]

    keys = F.when(n >= min_near_chars, F.array(*halves(n), *halves(n + 1)))
    return (
        _lines(docs)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct(*_ROW).alias("place"), n.alias("n"), keys.alias("keys"))
        .groupBy("h1", "h2")
        .agg(F.min("place").alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        .select("place", "n", "keys")
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Keys that more than one line emits, with the earliest of them.

    Materialised, so that a key with very many lines can be split in the join that follows.
    """
    return cut(
        rows.groupBy("key")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("key", "first")
    )


def _suspects(lines: DataFrame) -> DataFrame:
    """(place, m, at, width): stretches under whose deletion a line meets another, after the step on halves."""
    n = F.col("n")
    f = lambda m: F.floor((m - 1) / 2).cast("int")
    # If the left part is equal the edit lies in the rest on the right, and the other way round.
    stretch = lambda m, at: F.struct(m.alias("m"), at.alias("at"), (m - f(m)).alias("width"))
    places = F.array(stretch(n, f(n)), stretch(n, F.lit(0)), stretch(n + 1, f(n + 1)), stretch(n + 1, F.lit(0)))
    keyed = F.zip_with("keys", places, lambda key, part: F.struct(key.alias("key"), part.alias("part")))
    rows = lines.where(F.col("keys").isNotNull()).select("place", F.inline(keyed))
    rows = rows.select("place", "key", "part.*")
    return cut(rows.join(_shared(rows.select("key", "place")), "key").select("place", "m", "at", "width"))


def _narrowed(suspects: DataFrame, texts: DataFrame) -> DataFrame:
    """One step: the parts of each stretch under whose deletion the line still meets another."""
    width = F.greatest(F.lit(1), F.ceil(F.col("width") / F.lit(PARTS))).cast("int")
    parts = suspects.withColumn("part", width).withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.col("part")))
    )
    parts = parts.select("place", "m", (F.col("at") + F.col("start")).alias("at"), F.least("part", F.col("width") - F.col("start")).alias("width"))
    line = F.col("line")
    key = F.xxhash64(
        F.col("m"), F.col("at"), F.col("width"), F.left(line, F.col("at")), F.right(line, F.greatest(F.lit(0), F.col("m") - F.col("at") - F.col("width")))
    )
    rows = parts.join(texts, "place").select("place", "m", "at", "width", key.alias("key"))
    return cut(rows.join(_shared(rows.select("key", "place")), "key").select("place", "m", "at", "width", "first"))


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(place, first): distinct lines within one edit of an earlier line, and the earliest such partner of one variant."""
    suspects = _suspects(lines)
    wanted = suspects.select("place").distinct().select("place.*")
    wanted = wanted.groupBy("doc_id", "rk").agg(F.collect_list("line_no").alias("wanted"))
    held = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.rk") == F.col("w.rk")))
    texts = held.select(F.col("d.doc_id").alias("doc_id"), F.col("d.rk").alias("rk"), "lines", F.explode("wanted").alias("line_no"))
    texts = texts.select(F.struct(*_ROW).alias("place"), F.get("lines", F.col("line_no")).alias("line")).dropDuplicates(["place"])
    texts = cut(texts)
    found = suspects
    while (widest := found.agg(F.max("width")).first()[0] or 0) > 1 or "first" not in found.columns:
        found = _narrowed(found, texts)
        if not widest:
            break
    mine, other = texts.select("place", "line"), texts.select(F.col("place").alias("first"), F.col("line").alias("first_line"))
    return (
        found.where(F.col("place") != F.col("first"))
        .select("place", "first")
        .distinct()
        .join(mine, "place")
        .join(other, "first")
        .where(F.levenshtein("line", "first_line", EDITS).between(0, EDITS))
        .select("place", "first")
    )


def _cleaned(docs: DataFrame, id_col: str, text_col: str, min_near_chars: int, *more: Column) -> DataFrame:
    split = _split(docs, id_col, text_col)
    lines = stored(_distinct(split, min_near_chars))
    gone = near_lines(split, lines).select("place").distinct()
    kept = lines.select("place").join(gone, "place", "left_anti").select("place.*")
    kept = kept.groupBy("doc_id", "rk").agg(F.collect_list("line_no").alias("kept"))
    both = _split(docs, id_col, text_col, *more).alias("d").join(
        kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.rk") == F.col("k.rk")), "left"
    )
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1))
    blank = F.filter(every, lambda i: F.trim(F.get("lines", i)) == "")
    order = F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank))
    return both.withColumns({"n_blank": F.size(blank), "order": order}).select(
        F.col("d.doc_id").alias("doc_id"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("order"), F.lit(0)).alias("n_kept"),
        F.coalesce("n_blank", F.lit(0)).alias("n_blank"),
        F.array_join(F.transform("order", lambda i: F.get("lines", i)), "\n").alias("text"),
        *(["row"] if more else []),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_kept, text): every document with its repeated lines removed.

    * Lines are what lies between newlines. Blank lines are not compared and stay.
    * A null text stays null, with no lines. Empty tables give no rows.
    * Rows with one doc_id and one text are one document: their rows keep the
      same lines. Null ids come first in the order. Texts and lines may have any
      length. Other columns of ``docs`` are not read.
    """
    return _cleaned(docs, id_col, text_col, min_near_chars).select("doc_id", "n_lines", "n_kept", "text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near_chars: int = MIN_NEAR_CHARS, least_share: float = 0.0) -> DataFrame:
    """``docs`` with cleaned texts, its other columns as they were.

    A document that loses all its lines goes; one that had none to lose stays. A
    document of which less than ``least_share`` of the visible characters is left goes
    as well: it is a copy of what came earlier but for a few lines, and these are a fragment.
    """
    row = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    cleaned = _cleaned(docs, id_col, text_col, min_near_chars, row).where("n_kept > n_blank or n_lines = n_blank")
    if least_share > 0:
        visible = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
        cleaned = cleaned.where((F.col("n_kept") == F.col("n_lines")) | (visible(F.col("text")) >= least_share * visible(F.col(f"row.`{text_col}`"))))
    return cleaned.select(*(F.col("text").alias(x) if x == text_col else F.col(f"row.`{x}`") for x in docs.columns))
