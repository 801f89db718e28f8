"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lists of hashed tokens. Five masks of up to 12 positions, each of which
ignores others, hash the windows of benchmark items and documents, so that
substituted tokens do not hide a passage. Documents that share a hash with the
benchmark are candidates; around each hit the item is laid over the document at the
offset of the hit, and the best stretch is scored: a match counts 1, a substituted
token -2. A document is contaminated if a stretch scores ``min_overlap`` or, for a
shorter item, its whole length.

The windows of a text are rows of as many columns as a mask is long, made by one
``arrays_zip`` of its tokens and themselves some places on, so that all hashes are
computed in generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut

SPAN = 12
#: Three masks keep 8 of 12 positions, one 7 of 11 and one 7 of 10. Together they hit every stretch of up to six substitutions
#: that scores ``MIN_OVERLAP``, wherever the substitutions lie; a test goes through all of them.
MASKS = [
    [0, 1, 2, 6, 7, 8, 9, 11],
    [0, 4, 6, 7, 8, 9, 10, 11],
    [0, 1, 3, 4, 5, 6, 9, 11],
    [0, 1, 2, 3, 5, 9, 10],
    [0, 1, 2, 3, 6, 7, 9],
]
MIN_OVERLAP = 13
MISMATCH = -2
#: Shorter items are no evidence.
MIN_ITEM = 5
#: Benchmark hashes are broadcast up to so many rows (24 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the words of a text: lower case, runs of letters and digits; null has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _windows(rows: DataFrame, toks: str, *keys: str) -> DataFrame:
    """(keys, i, t0, t1, ...): every place of a text with the tokens from there on, null behind its end."""
    n = F.size(toks)
    shifted = [F.slice(toks, k + 1, F.greatest(n - k, F.lit(0))).alias(f"t{k}") for k in range(SPAN)]
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), *shifted)
    return rows.where(n > 0).select(*keys, F.inline(zipped)).toDF(*keys, "i", *(f"t{k}" for k in range(SPAN)))


def _seed(mask: list[int]) -> Column:
    """The hash of a window under one mask; null if it ends before the mask does."""
    key = F.lit(sum(1 << k for k in mask))
    return F.when(F.col(f"t{mask[-1]}").isNotNull(), F.xxhash64(key, *(F.col(f"t{k}") for k in mask)))


def _seeds(rows: DataFrame, toks: str, masks: list[list[int]], *keys: str) -> DataFrame:
    """(keys, i, seed): every window's hash under every mask."""
    found = _windows(rows, toks, *keys).select(*keys, "i", F.explode(F.array(*map(_seed, masks))).alias("seed"))
    return found.where("seed is not null")


def _best(doc: Column, item: Column, shift: Column) -> Column:
    """The best score of a stretch of the item laid over the document from ``shift`` on."""
    step = F.transform(item, lambda t, j: F.when(F.get(doc, F.greatest(F.lit(-1), shift + j)) == t, 1).otherwise(MISMATCH))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def add(state: Column, x: Column) -> Column:
        now = F.greatest(F.lit(0), state["now"] + F.coalesce(x, F.lit(MISMATCH)))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(step, start, add, lambda state: state["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(doc_id, rk, item_id, overlap): verified overlaps, the best of each document and item.

    ``rk`` is a hash of the document's text.
    """
    items = cut(
        benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") >= MIN_ITEM).dropDuplicates(["item"])
    )
    # Items shorter than the masks are hashed whole, by one mask for each length: at most 7.
    short = [r[0] for r in items.where(F.size("item") < SPAN).select(F.size("item")).distinct().collect()]
    whole = {m: list(range(m)) for m in sorted(short)}
    parts = [_seeds(items.where(F.size("item") >= SPAN), "item", MASKS, "item_id")]
    parts += [_seeds(items.where(F.size("item") == m), "item", [mask], "item_id") for m, mask in whole.items()]
    targets = cut(reduce(DataFrame.unionByName, parts).select("item_id", "seed", F.col("i").alias("j")))
    masks = [*MASKS, *whole.values()]
    known = targets.select("seed").distinct()
    small = targets.count() <= BROADCAST_ROWS
    known, near = (F.broadcast(known), F.broadcast(targets)) if small else (known, targets)

    toks = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rk"), tokens(F.col(text_col)).alias("toks"))
    suspects = cut(_seeds(toks, "toks", masks, "doc_id", "rk").join(known, "seed", "left_semi").select("doc_id", "rk").distinct())

    taken = docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("t"))
    held = taken.join(suspects, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("rk")), "left_semi")
    held = cut(held.select(F.col("d").alias("doc_id"), F.col("k").alias("rk"), tokens(F.col("t")).alias("toks")).dropDuplicates(["doc_id", "rk"]))
    hits = _seeds(held, "toks", masks, "doc_id", "rk").join(near, "seed")
    hits = hits.select("doc_id", "rk", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct()
    laid = hits.join(F.broadcast(items) if small else items, "item_id")
    same = F.col("h.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("h.rk") == F.col("l.rk"))
    laid = held.alias("h").join(laid.alias("l"), same)
    scored = laid.select("h.doc_id", "h.rk", "item_id", F.size("item").alias("m"), _best(F.col("toks"), F.col("item"), F.col("shift")).alias("overlap"))
    return (
        scored.where(F.col("overlap") >= F.least(F.lit(min_overlap), F.col("m"))).groupBy("doc_id", "rk", "item_id").agg(F.max("overlap").alias("overlap"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """All rows and columns of ``docs`` under ``row``, with contaminated, n_items, best_overlap.

    * Null, empty and very short texts are clean. Items under 5 tokens, and null
      ones, are no evidence; items under 12 tokens must occur whole; equal items
      count once.
    * Rows with one id and one text are judged alike. Texts may have any length.
      Empty tables make every document clean. Columns of ``docs`` keep their names.
    """
    found = overlaps(docs, benchmark, id_col, text_col, min_overlap).groupBy("doc_id", "rk")
    found = cut(found.agg(F.count("*").cast("int").alias("n_items"), F.max("overlap").alias("best_overlap")))
    row = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), F.xxhash64(F.col(text_col)).alias("k"))
    both = row.join(found, F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("rk")), "left")
    return both.select(
        "row",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("best_overlap", F.lit(0)).alias("best_overlap"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The clean rows of ``docs``."""
    return decontaminate(docs, benchmark, id_col, text_col).where("not contaminated").select("row.*")
