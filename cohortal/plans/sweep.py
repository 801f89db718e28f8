"""Ranks under many weightings at once, without a row for each entity and weighting.

Entities lie in blocks of neighbouring official ranks. A block counts its composites of each weighting; per segment and weighting
the counts of all blocks are added up to what stands before each block's composites; and each block then places its own
entities. What is shuffled is one row an entity, and counts of distinct composites (two digits, so some ten thousand at most).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need not have this module: what runs there is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entities of a block: a task holds a rank for each of them and each weighting, 8 bytes.
BLOCK = 20_000
#: The code of a composite that is missing or 0.
NONE = -100
KEYS = ["segment", "_block"]


def _half_up(x: np.ndarray) -> np.ndarray:
    """Hundredths, as ``stats.half_up`` rounds: half up after noise below a millionth is taken off. Exact for scores of one digit and whole weights."""
    fine = np.floor(np.abs(x) * 1e6 + 0.5).astype(np.int64)
    return np.sign(x).astype(np.int64) * ((fine + 5000) // 10_000)


def _codes(values: np.ndarray, weights: list[tuple[float, ...]]) -> Iterator[np.ndarray]:
    """Of each weighting the composites of all rows in hundredths; ``values`` has a column a factor."""
    there = ~np.isnan(values)
    known = np.where(there, values, 0.0)
    for w in np.asarray(weights, dtype=float):
        used = np.where(there, np.maximum(w, 0.0), 0.0)
        top, low = (known * used).sum(axis=1), used.sum(axis=1)
        code = _half_up(top / np.where(low > 0, low, 1.0))
        yield np.where((low > 0) & (code != 0), code, NONE)


def rank_ranges(scored: DataFrame, factors: list[str], weights: list[tuple[float, ...]]) -> DataFrame:
    """(entity, segment, rank_min, rank_max, rank_median, size) over all weightings; ties keep the order of ``rank``, which is consecutive in a segment.

    ``scored`` is read twice.
    """
    types = {c: scored.schema[c].dataType.simpleString() for c in ("entity", "segment")}
    head = f"segment {types['segment']}, _block long, vector int"
    rows = scored.select("entity", "segment", "rank", *(F.col(f).cast("double") for f in factors)).withColumn("_block", F.floor((F.col("rank") - 1) / F.lit(BLOCK)))

    def counted(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        found = [np.unique(code, return_counts=True) for code in _codes(block[factors].to_numpy(float), weights)]
        return pd.DataFrame({"segment": key[0], "_block": key[1], "vector": range(len(found)), "codes": [c for c, _ in found], "n": [n for _, n in found]})

    def shifted(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        length = [len(c) for c in blocks["codes"]]
        code, n, of = np.concatenate(blocks["codes"].to_list()), np.concatenate(blocks["n"].to_list()), np.repeat(blocks["_block"].to_numpy(), length)
        order = np.lexsort((of, -code))
        before = np.empty(len(n), dtype=np.int64)
        before[order] = np.cumsum(n[order]) - n[order]
        return blocks.drop(columns="n").assign(before=np.split(before, np.cumsum(length)[:-1]), size=int(n.sum()))

    def placed(block: pd.DataFrame, shifts: pd.DataFrame) -> pd.DataFrame:
        block, shifts = block.sort_values("rank"), shifts.sort_values("vector")
        ranks, at = np.empty((len(weights), len(block)), dtype=np.int64), np.arange(len(block))
        for r, code, codes, before in zip(ranks, _codes(block[factors].to_numpy(float), weights), shifts["codes"], shifts["before"], strict=True):
            order = np.argsort(code, kind="stable")
            own = np.searchsorted(codes, code[order])
            r[order] = before[own] + at - np.searchsorted(code[order], code[order]) + 1
        told = {"rank_min": ranks.min(axis=0), "rank_max": ranks.max(axis=0), "rank_median": np.floor(np.median(ranks, axis=0)).astype(np.int64)}
        return block[["entity", "segment"]].assign(**told, size=shifts["size"].iloc[0])

    counts = rows.groupBy(*KEYS).applyInPandas(counted, f"{head}, codes array<long>, n array<long>")
    shifts = counts.groupBy("segment", "vector").applyInPandas(shifted, f"{head}, codes array<long>, before array<long>, size long")
    made = f"entity {types['entity']}, segment {types['segment']}, rank_min long, rank_max long, rank_median long, size long"
    return rows.groupBy(*KEYS).cogroup(shifts.groupBy(*KEYS)).applyInPandas(placed, made)
