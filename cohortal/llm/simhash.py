"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when at most three bits differ. By the pigeonhole
principle one of the two halves then differs in at most one bit, so the search
runs on each half with threshold one:

* the anchors are the words of a perfect covering code, the [31, 26] Hamming
  code with one free bit beside it: covering radius 1, 2^27 anchors;
* every fingerprint is replicated to every anchor within covering radius plus
  threshold, that is distance 2: at most 17 anchors for each half;
* if two halves differ in at most one bit, the anchor nearest to the first is
  within distance 2 of the second, so both meet there and are compared on all
  64 bits. No link is lost and none is emitted twice over more than 34 anchors.

A covering code of all 64 bits with threshold three would need thousands of
replicas or a few thousand anchors only; the split keeps both small.

Equal fingerprints are one point, so exact copies never meet each other. An
anchor with more than ``tile_rows`` points is first divided by the bytes of the
other half, of which one must be equal; what is still larger is dealt over tiles
(pairs of salts), each compared in one task of bounded size. A tile returns a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut, partitions
from cohortal.llm.graph import connected_components

SEED = 42
MAX_BITS = 3
HALF_THRESHOLD = MAX_BITS // 2
COVERING_RADIUS = 1
NO_ID = 2**63 - 1
BLOCK = 1 << 15


def fingerprint_of(data: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text, given in UTF-8; null counts as empty."""
    words = (data or b"").lower().split()  # bytes: lowers A-Z only, splits at 20 and 09-0D only
    if not words:
        return 0
    shingles = max(1, len(words) - width + 1)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, shingles, BLOCK):
        part = words[at : min(at + BLOCK, shingles) + width - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64).reshape(8, 8)
    return int.from_bytes(np.packbits(ones.ravel() * 2 > shingles, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``, fp a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(x) for x in batch.column(1).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return taken.mapInArrow(run, "doc_id long, fp long")


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index, anchor, home): each 32-bit value's anchors within distance 2; home marks its nearest."""
    half = half.astype(np.int64)
    syndrome = np.zeros(len(half), np.int64)
    for bit in range(31):
        syndrome ^= np.where(half >> bit & 1, bit + 1, 0)
    flip = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    index, home = np.arange(len(half)), half ^ flip
    out = [(index, home, np.ones(len(half), np.int64)), (index, home ^ (1 << 31), np.zeros(len(half), np.int64))]
    for j in range(1, 32):  # two flips j and k with j xor k equal to the syndrome reach another word of the code
        k = j ^ syndrome
        two = (syndrome > 0) & (k > j)
        out.append((index[two], half[two] ^ (1 << (j - 1)) ^ (np.int64(1) << (k[two] - 1)), np.zeros(two.sum(), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _covered(points: DataFrame) -> DataFrame:
    """(anchor, home, doc, fp): every point at every anchor that covers one of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for which, shift in enumerate((0, 32)):
                index, anchor, home = anchors_of(fp.view(np.uint64) >> np.uint64(shift) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor | which << 32), pa.array(home), pa.array(doc[index]), pa.array(fp[index])],
                    names=["anchor", "home", "doc", "fp"],
                )

    return points.select("doc", "fp").mapInArrow(run, "anchor long, home long, doc long, fp long")


def forest(tile: np.ndarray, fp: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Index pairs that span the links inside each tile; equal tiles must be adjacent."""
    parent = np.arange(len(fp))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at, step = np.arange(len(fp)), 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[tile[at] == tile[at + step]]
        if not len(at):
            return out
        near = at[(parent[at] != parent[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= most)]
        for i in near.tolist():
            if (x := root(i)) != (y := root(i + step)):
                parent[max(x, y)] = min(x, y)
                out.append((i, i + step))
        if len(near):
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]


def _linked(tiles: DataFrame) -> DataFrame:
    """Spanning links (a, b) of each tile; rows come sorted by tile."""

    def edges(rows: pa.Table) -> pa.RecordBatch:
        first, second, doc, fp = (rows.column(k).to_numpy() for k in range(4))
        tile = np.cumsum(np.r_[0, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        pairs = np.array(forest(tile, fp.view(np.uint64)), np.int64).reshape(-1, 2)
        names = ["a_doc", "a_fp", "b_doc", "b_fp"]
        return pa.RecordBatch.from_arrays([pa.array(x[pairs[:, k]]) for k in (0, 1) for x in (doc, fp)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            first, second = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            last = np.flatnonzero((first != first[-1]) | (second != second[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            kept = rows.slice(whole)
            if whole:
                yield edges(rows.slice(0, whole))
        if kept is not None:
            yield edges(kept)

    n = partitions(tiles.sparkSession)
    dealt = tiles.select("anchor", (F.col("part").cast("long") * (1 << 40) + F.col("tile")).alias("tile"), "doc", "fp").repartition(n, "anchor", "tile").sortWithinPartitions("anchor", "tile", "fp")
    return dealt.mapInArrow(run, "a_doc long, a_fp long, b_doc long, b_fp long").select(
        F.struct(F.col("a_doc").alias("doc"), F.col("a_fp").alias("fp")).alias("a"),
        F.struct(F.col("b_doc").alias("doc"), F.col("b_fp").alias("fp")).alias("b"),
    )


def links(points: DataFrame, tile_rows: int = 4096) -> DataFrame:
    """Links (a, b) between points (doc, fp) that connect all points at three bits or fewer."""
    covered = _covered(points)
    sizes = cut(
        covered.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.sum("home").alias("homes"))
        .where("n > 1 and homes > 0")
        .select("anchor", "n")
    )
    met = covered.join(sizes, "anchor").withColumn("part", F.lit(0))
    # Of two fingerprints at a crowded anchor the other halves differ in at most three bits, so one of their four bytes is equal.
    other = F.when(F.shiftrightunsigned("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = F.array(*(F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) + (256 * k + 1) for k in range(4)))
    crowded = met.where(F.col("n") > tile_rows).drop("n").withColumn("part", F.explode(parts.cast("array<int>")))
    crowds = cut(crowded.groupBy("anchor", "part").agg(F.count("*").alias("n")).where("n > 1"))
    met = met.where(F.col("n") <= tile_rows).unionByName(crowded.join(crowds, ["anchor", "part"]))
    met = met.withColumn("salts", F.ceil(F.col("n") / F.lit(tile_rows)).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    shared = F.transform(
        F.sequence(F.lit(0), F.col("salts") - 1),
        lambda other: F.least(F.col("salt"), other).cast("long") * F.col("salts") + F.greatest(F.col("salt"), other),
    )
    return _linked(met.withColumn("salt", mine).withColumn("tile", F.explode(shared)))


def _rooted(marked: DataFrame, tile_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The points (fp, doc) of ``marked`` (doc_id, fp), and (fp, root, root_fp) of those with links; a root is the least point of its component."""
    points = cut(marked.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc")))
    found = connected_components(links(points, tile_rows))
    return points, cut(found.select(F.col("node.fp").alias("fp"), F.col("root.doc").alias("root"), F.col("root.fp").alias("root_fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    * Null and empty texts, and texts without a word, have fingerprint zero and
      link like any other.
    * Repeated rows each return a row. A null doc_id returns a row with its
      component; it is a component's id only if all its ids are null.
    * Texts of any length are read in blocks of words. Other columns of
      ``docs``, whatever their names, are not read. No rows give no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    points, roots = _rooted(marked, tile_rows)
    component = F.nullif(F.coalesce("root", "doc"), F.lit(NO_ID))
    named = cut(points.join(roots.drop("root_fp"), "fp", "left").select(F.col("fp").alias("point"), component.alias("component_id")))
    return marked.join(named, marked.fp == named.point).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, with its smallest id; a null id only where all are null. Rows with one id and different texts are told apart.

    Fingerprints are over shingles of ``width`` words.
    """
    rk = F.xxhash64(F.col(text_col))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(x, width) for x in batch.column(2).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "rk", "fp"])

    taken = docs.select(key.alias("doc_id"), rk.alias("rk"), F.col(text_col).cast("binary").alias("text"))
    marked = cut(taken.mapInArrow(run, "doc_id long, rk long, fp long"))
    points, roots = _rooted(marked)
    leaders = points.join(roots, "fp", "left").where("root_fp is null or fp = root_fp").select("fp", F.col("doc").alias("doc_id"))
    kept = marked.join(leaders, ["doc_id", "fp"]).groupBy("doc_id", "fp").agg(F.min("rk").alias("rk")).select("doc_id", "rk").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), key.alias("doc_id"), rk.alias("rk"))
    return rows.join(kept, ["doc_id", "rk"], "left_semi").dropDuplicates(["doc_id", "rk"]).select("row.*")
