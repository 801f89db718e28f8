"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte trigrams, normalised to length one.
Each language has several centroids, found by spherical k-means; a text gets the
language of the centroid with the greatest cosine, and is rejected where that
cosine lies below the centroid's own radius.

Document frequencies are counted over every training row. The centroids alone
are fitted on a bounded sample of ``SAMPLE`` rows a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortal.llm.common import cut

DIMS = 4096
CENTROIDS = 4
#: Up to so many languages the shares of their rows are broadcast, and joined by a shuffle beyond.
BROADCAST_LANGUAGES = 100_000
#: Rows a language on which its centroids are fitted.
SAMPLE = 400
#: A text is rejected below this share of the lowest percentile of its centroid's own cosines.
REACH = 0.25
BLOCK = 1 << 20
UNKNOWN = "und"
#: ASCII letters in lower case; the rest of ASCII is a break; bytes of other scripts stay.
_FOLD = bytes((b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in range(256))


def trigrams(data: bytes | None) -> np.ndarray:
    """Counts of hashed byte trigrams of a whole text; null counts as empty."""
    counts = np.zeros(DIMS, np.int64)
    folded = b" " + (data or b"").translate(_FOLD) + b" "
    for at in range(0, len(folded) - 2, BLOCK):
        part = np.frombuffer(folded, np.uint8, min(BLOCK + 2, len(folded) - at), at).astype(np.uint32)
        code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        code = code[(part[:-2] != 32) | (part[1:-1] != 32)]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return counts


def _texts(df: DataFrame, *cols: Column) -> DataFrame:
    return df.select(*cols, F.col("text").cast("binary").alias("text"))


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each trigram occurs, over all rows, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found += trigrams(text) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, n]), pa.array(range(DIMS + 1))], names=["n", "at"])

    sums = _texts(rows).mapInArrow(run, "n long, at long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMS + 1, np.int64)
    for at, n in sums.collect():  # one row for each trigram
        out[at] = n
    return out[:-1], int(out[-1])


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF; zero for a text without trigrams."""
    out = np.log1p(counts) * idf
    return out / (np.linalg.norm(out) or 1.0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart first centroids: (centroids, each one's lowest percentile of cosines)."""
    first = [int(np.argmax(x @ x.mean(0)))]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin((x @ x[first].T).max(1))))
    c = x[first]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosines = x @ c.T
    near = cosines.argmax(1)
    return c, np.array([np.percentile(cosines[near == i, i], 1) if (near == i).any() else 1.0 for i in range(len(c))])


@dataclass
class Model:
    """Languages, centroids and radii by row; idf by trigram."""

    langs: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray


def fit(rows: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Learn from (key, lang, text); ``key`` only picks the sample. Rows without text or lang are left out.

    The model is what the driver gathers: 16 KB a centroid, whatever the number of rows.
    """
    rows = rows.select("key", "lang", "text").where("lang is not null and text is not null")
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    # A hash threshold leaves about twice the sample, so that no language's rows meet in one task.
    order = F.xxhash64("key", "text")
    share = cut(rows.groupBy("lang").agg((F.lit(2.0 * sample) / F.count("*")).alias("share")))
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share
    thinned = rows.join(share, "lang").where(F.pmod(order, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order))
    chosen = _texts(thinned.withColumn("place", place).where(F.col("place") <= sample), F.col("lang"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trigrams(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["lang", "counts"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        c, radii = k_means(np.stack([vector(np.frombuffer(x, np.int32), idf) for x in group["counts"]]), k)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [x.astype(np.float32).tobytes() for x in c], "radius": radii})

    # A group holds a sample's counts, 16 KB each, however long its texts are.
    vectors = chosen.mapInArrow(counted, "lang string, counts binary")
    found = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, radius double").collect()
    found.sort(key=lambda r: (r.lang, r.radius, bytes(r.centroid)))
    centroids = np.frombuffer(b"".join(bytes(r.centroid) for r in found), np.float32).reshape(-1, DIMS)
    return Model([r.lang for r in found], centroids, np.array([r.radius for r in found]), idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``' columns under ``row``, with lang_pred, score (the cosine, 0 to 1) and accepted.

    Null texts, texts without a letter, and every text if nothing was learned,
    are ``und`` with score 0 and are not accepted. Ties go to the first centroid
    in order of language. Whole texts of any length are read in blocks.
    """
    langs, centroids, radii, idf = model.langs, model.centroids, model.radii * REACH, model.idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lettered = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            pred, score, accepted = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
            for at in range(0, len(batch), 256):
                if not langs:
                    break
                some = [i for i in range(at, min(at + 256, len(batch))) if lettered[i]]
                if not some:
                    continue
                cosines = np.stack([vector(trigrams(texts[i]), idf) for i in some]).astype(np.float32) @ centroids.T
                best = cosines.argmax(1)
                score[some] = np.clip(cosines[np.arange(len(some)), best].astype(np.float64), 0, 1)
                accepted[some] = score[some] >= radii[best]
                for i, b in zip(some, best.tolist(), strict=True):
                    pred[i] = langs[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(accepted)], names=["row", "lang_pred", "score", "accepted"]
            )

    text = F.col(text_col)
    rows = docs.select(
        F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), text.cast("binary").alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, accepted boolean")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model:
    """A model from the documents that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "lang", "text"))


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all of them where no row has a language to learn from, or there is no such column."""
    if "lang" not in docs.columns:
        return docs
    model = train_on(docs)
    return predict(docs, model).where("accepted").select("row.*") if model.langs else docs
