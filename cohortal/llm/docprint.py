"""Document fingerprints by a randomised edit embedding.

A text is embedded by a random walk that all texts share: at each step the
current character is written out, and a random bit of (step, character) says
whether to move on to the next one. Texts a few edits apart fall back into step
with each other, so edit distance becomes Hamming distance between the outputs.

The output is bit-sampled: one bit of the character written at every 2^level-th
step, where the level is the least that leaves at most ``MOST_BITS`` samples.
Coarser samples are part of finer ones, so texts of different lengths compare at
the coarser level. The samples form bands of ``BAND`` bits: two fingerprints that
share no band have likeness 0, others are verified by their Hamming distance, as
are those of a few samples.

``near_classes`` searches a whole table: every fingerprint is emitted under each of
its wide bands, at its own level and the next coarser one, equal bands meet, and
pairs are verified by their likeness. Edits put the walk out of step in bursts, so
most bands of near texts are clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut, partitions
from cohortal.llm.graph import connected_components

MOST_BITS = 512
BAND = 8
#: Characters fall into so many classes for the walk; its random bits repeat after PERIOD steps.
CLASSES, PERIOD, BLOCK, STAY = 16, 1 << 15, 1 << 13, 3
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def walk_tables() -> list[list[int]]:
    """For each class, the step at which the walk leaves a character that it reaches at a given step."""
    size = PERIOD + BLOCK * STAY + STAY
    step = np.arange(PERIOD, dtype=np.uint64)
    names = list(range(size + STAY))  # one object for each number
    out = []
    for c in range(CLASSES):
        move = np.resize(_mix(step * _A + np.uint64(c + 1)) & np.uint64(1), size + STAY).astype(bool)
        stay = np.where(move[:size], 1, np.where(move[1 : size + 1], 2, STAY))
        out.append([names[x] for x in (np.arange(size) + stay).tolist()])
    return out


class Walker:
    """The shared walk; made once in a task."""

    def __init__(self) -> None:
        self.tables = walk_tables()

    def walk(self, points: np.ndarray, start: int = 0) -> tuple[np.ndarray, int]:
        """The step at which each character is reached, and the step after the last."""
        kinds = (_mix(points.astype(np.uint64) * _A) >> np.uint64(60)).astype(np.uint8).tobytes()
        reached, base, j = np.empty(len(points), np.int64), start - start % PERIOD, start % PERIOD
        for at in range(0, len(kinds), BLOCK):
            steps: list[int] = []
            add = steps.append
            for table in map(self.tables.__getitem__, kinds[at : at + BLOCK]):
                add(j)
                j = table[j]
            reached[at : at + len(steps)] = steps
            reached[at : at + len(steps)] += base
            base, j = base + j - j % PERIOD, j % PERIOD
        return reached, base + j


class Print:
    """A fingerprint: sampled bits, their level and the length of the walk."""

    def __init__(self, points: np.ndarray, reached: np.ndarray, steps: int) -> None:
        self.level = max(0, steps - 1).bit_length() - MOST_BITS.bit_length() + 1
        self.level = max(0, self.level)
        self.steps = steps
        at = np.arange(0, steps, 1 << self.level)
        seen = points[np.searchsorted(reached, at, "right") - 1].astype(np.uint64)
        self.bits = (_mix(seen * _A + at.astype(np.uint64) * _C) & np.uint64(1)).astype(np.uint8)

    def __str__(self) -> str:
        return f"{self.level:x}.{self.steps:x}.{np.packbits(self.bits).tobytes().hex()}"

    def like(self, other: Print) -> float:
        """0 to 1: the share of the longer walk on which both agree, after chance agreement is taken off."""
        if not self.steps or not other.steps:
            return float(self.steps == other.steps)
        level = max(self.level, other.level)
        a, b = self.bits[:: 1 << (level - self.level)], other.bits[:: 1 << (level - other.level)]
        n, most = min(len(a), len(b)), max(len(a), len(b))
        off = a[:n] != b[:n]
        if n >= 8 * BAND and np.add.reduceat(off, np.arange(0, n - n % BAND, BAND))[: n // BAND].min() > 0:
            return 0.0
        return max(0.0, 1 - 2 * float(off.mean())) * n / most


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text), dealt by ranges of doc_id and sorted; each bucket ends with the next one's first row, marked extra."""
    n = partitions(docs.sparkSession)
    ids = docs.select("doc_id")
    share = [k / (4 * n) for k in range(1, 4 * n)]
    cuts = ids.agg(F.percentile_approx("doc_id", share, 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # A binary search in the array of cuts: as many steps as the number of buckets has digits.
    bounds, steps = F.lit(np.array(cuts, np.int64)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda b, s: F.when(F.get(bounds, b + s - 1) <= F.col("doc_id"), b + s).otherwise(b)) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(found).cast("int").alias("bucket")
    # One row for each bucket, and there are four for each partition.
    firsts = sorted((r.bucket, r.first) for r in ids.select(bucket, "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("extra"), "doc_id", "text")
    before = docs.sparkSession.createDataFrame([(b, firsts[k - 1][0]) for k, (b, _) in enumerate(firsts)], "bucket int, before int")
    rows = docs.select(bucket, F.lit(0).alias("extra"), "doc_id", "text")
    known = [x for _, x in firsts if x is not None]
    opening = rows.where(F.col("doc_id").isin(known) | F.col("doc_id").isNull() if firsts[0][0] == -1 else F.col("doc_id").isin(known))
    opening = opening.groupBy("bucket").agg(F.min(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    extra = opening.join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), F.lit(1).alias("extra"), "x.doc_id", "x.text")
    dealt = rows.unionByName(extra).repartition(n, "bucket")
    return dealt.sortWithinPartitions("bucket", "extra", "doc_id", F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last floor(n_chars / 4)
    characters replaced by the first as many of the next document in the order of
    doc_id (all, if it has fewer); after the last comes the first.

    Null texts count as empty. Empty texts are alike only to empty ones. Rows with
    one id follow each other in the order of their texts; null ids come first. A
    single row is its own next. Texts are read whole, in blocks, at any length.
    Other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, held, out = Walker(), None, []
        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = code_points(text or "")
                reached, steps = walker.walk(points)
                now = (bucket, doc_id, points, reached, steps, Print(points, reached, steps))
                if held is not None and held[0] == bucket:
                    out.append(_compared(walker, held, now))
                held = None if extra else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(rows).mapInArrow(run, kinds)


#: Bits of a band that is a search key.
WIDE = 32
#: Points compared in one task; a band that more share is dealt over pairs of salts.
TILE_ROWS = 512


def _forest(tiles: np.ndarray, bits: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Index pairs that span the likeness links inside each tile; equal tiles must be adjacent. Bits are padded to one width."""
    parent = np.arange(len(tiles))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at, step, place = np.arange(len(tiles)), 0, np.arange(bits.shape[1])
    while True:
        step += 1
        at = at[at + step < len(tiles)]
        at = at[tiles[at] == tiles[at + step]]
        if not len(at):
            return out
        for some in np.array_split(at, max(1, len(at) // 1024)):
            n, most = np.minimum(sizes[some], sizes[some + step]), np.maximum(sizes[some], sizes[some + step])
            off = ((bits[some] != bits[some + step]) & (place < n[:, None])).sum(1)
            for i in some[np.maximum(0, 1 - 2 * off / n) * n / most >= least].tolist():
                if (x := root(i)) != (y := root(i + step)):
                    parent[max(x, y)] = min(x, y)
                    out.append((i, i + step))


def near_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, class_id): one row a document; class_id is the smallest doc_id that links of ``least`` likeness reach.

    Equal fingerprints are one point. Texts of fewer than WIDE samples link only to
    equal ones. Null texts count as empty; repeated rows return a row each; a null
    doc_id is a class's id only if it has no other. No rows give no rows.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                points = code_points(text or "")
                made.append(Print(points, *walker.walk(points)))
            columns = [batch.column(0), pa.array([str(x) for x in made]), pa.array([x.level for x in made], pa.int32()), pa.array([x.bits.tobytes() for x in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "level", "bits"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, level, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint8)
                for coarser in (0, 1):
                    bits = own[:: 1 << coarser]
                    for k in range(len(bits) // WIDE):
                        key = np.packbits(bits[k * WIDE : (k + 1) * WIDE]).tobytes() + bytes([k, level + coarser])
                        out.append((int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True), doc, bits.tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["band", "doc", "bits"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: pa.Table) -> pa.RecordBatch:
            band, tile, doc = (rows.column(k).to_numpy() for k in range(3))
            raw = rows.column(3).to_pylist()
            sizes = np.array([len(x) for x in raw])
            bits = np.frombuffer(b"".join(x.ljust(MOST_BITS, b"\2") for x in raw), np.uint8).reshape(-1, MOST_BITS)
            tiles = np.cumsum(np.r_[0, (band[1:] != band[:-1]) | (tile[1:] != tile[:-1])])
            pairs = np.array(_forest(tiles, bits, sizes, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(doc[pairs[:, k]]) for k in (0, 1)], names=["a", "b"])

        kept: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            band, tile = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            last = np.flatnonzero((band != band[-1]) | (tile != tile[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            kept = rows.slice(whole)
            if whole:
                yield edges(rows.slice(0, whole))
        if kept is not None:
            yield edges(kept)

    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut(rows.mapInArrow(prints, "doc_id long, fingerprint string, level int, bits binary"))
    best = F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("doc")
    points = cut(marked.groupBy("fingerprint").agg(best, F.first("level").alias("level"), F.first("bits").alias("bits")))
    emitted = cut(points.select("doc", "level", "bits").mapInArrow(banded, "band long, doc long, bits binary"))
    shared = cut(emitted.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = emitted.join(shared, "band").withColumn("salts", F.ceil(F.col("n") / F.lit(tile_rows)).cast("int"))
    met = met.withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda x: F.least(F.col("salt"), x).cast("long") * F.col("salts") + F.greatest(F.col("salt"), x))
    dealt = met.withColumn("tile", F.explode(tile)).select("band", "tile", "doc", "bits").repartition(n, "band", "tile").sortWithinPartitions("band", "tile", "doc")
    found = cut(connected_components(dealt.mapInArrow(linked, "a long, b long")))
    named = cut(points.join(found, points.doc == found.node, "left").select(F.col("fingerprint").alias("point"), F.nullif(F.coalesce("root", "doc"), F.lit(2**63 - 1)).alias("class_id")))
    return marked.join(named, marked.fingerprint == named.point).select("doc_id", "fingerprint", "class_id")


def _compared(walker: Walker, held: tuple, after: tuple) -> tuple:
    _, doc_id, points, reached, steps, own = held
    keep = len(points) - len(points) // 4
    tail = after[2][: len(points) - keep]
    more, end = walker.walk(tail, int(reached[keep]) if keep < len(points) else steps)
    edited = np.concatenate([points[:keep], tail])
    other = Print(edited, np.concatenate([reached[:keep], more]), end)
    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(points), sha, str(own), str(other), own.like(other), own.like(after[5])
