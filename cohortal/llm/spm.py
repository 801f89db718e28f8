"""SentencePiece encoding and decoding, with a max-plus scan over giant documents.

A public BPE model with byte fallback is used as it is; results equal those of
its library. A document of up to ``CHUNK`` characters is one chunk and is encoded
as a whole. A longer one is split at fixed places, wherever they fall:

* A boundary state is the piece that covers or ends at the cut: the last one
  that starts before it. Both neighbours list the same candidates.
* A chunk's transfer matrix gives the weight of every way from a state at its
  start to a state at its end. A BPE segmentation is right exactly if each two
  neighbouring pieces, joined, are encoded as these two, so the weight is 0 where
  all pairs on the way agree and minus infinity elsewhere: the max-plus algebra
  then leaves one way of weight 0 through the document.
* Matrices are multiplied in a balanced tree (the product is associative), the
  states at all cuts are read back down the tree, and every chunk is then traced
  by itself, on any executor.

Within a chunk, ways from different states run together after a few pieces; only
the stubs until then are encoded anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
#: Words kept with their pieces in one task, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 200_000, 24
_WORD = re.compile(" *[^ ]+| +")


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """Encoder and decoder of one model, without the prefix space that starts a text."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        spec.normalizer_spec.add_dummy_prefix = False
        self.lib = SentencePieceProcessor(model_proto=spec.SerializeToString())
        n = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(n)]
        self.is_byte = [self.lib.is_byte(i) for i in range(n)]
        self.out = [bytes([int(x[3:5], 16)]) if b else x.replace("▁", " ").encode() for x, b in zip(names, self.is_byte, strict=True)]
        self.byte_id = {int(x[3:5], 16): i for i, x in enumerate(names) if self.is_byte[i]}
        self.pieces = {
            x.replace("▁", " "): i for i, x in enumerate(names) if not (self.is_byte[i] or self.lib.is_control(i) or self.lib.is_unknown(i))
        }
        self.longest = max(map(len, self.pieces))
        #: No piece reaches over a space that follows another character: words are then encoded by themselves.
        self.by_word = not any(" " in x.lstrip(" ") for x in self.pieces)
        self.kept: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the library gives them. A text should start with a space, else it is encoded whole."""
        if not self.by_word:
            return self.lib.encode(texts, num_threads=1)
        split: list[list[str] | None] = []
        for t in texts:
            if not t.startswith(" ") or "▁" in t:
                split.append(None)
            elif "  " in t:
                split.append([w[1:] for w in _WORD.findall(t)])
            else:
                split.append(t[1:].split(" "))
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        known = self.kept
        new = list(dict.fromkeys(w for words in split if words for w in words if w not in known))
        found = dict(zip(new, self.lib.encode([" " + w for w in new], num_threads=1), strict=True))
        known.update(found)
        out = [self.lib.encode(t, num_threads=1) if words is None else list(chain.from_iterable(map(known.__getitem__, words))) for t, words in zip(texts, split, strict=True)]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")

    def ids_of(self, piece: str) -> list[int]:
        """One piece's id, or the bytes of a character that the vocabulary lacks."""
        known = self.pieces.get(piece.replace("▁", " "))
        return [self.byte_id[b] for b in piece.encode()] if known is None else [known]

    def ends(self, text: str) -> list[int]:
        """Where each piece of a text's encoding ends, in characters; bytes of one character are one piece."""
        out, at, left = [], 0, 0
        for i in self.lib.encode(text, num_threads=1):
            if self.is_byte[i]:
                if left == 0:
                    first = self.out[i][0]
                    left = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
                left -= 1
                if left:
                    continue
                at += 1
            else:
                at += len(self.out[i].decode())
            out.append(at)
        return out

    def fit(self, x: str, y: str) -> bool:
        """Whether two pieces stay as they are next to each other."""
        key = (x, y)
        if key not in self.pairs:
            if len(self.pairs) > CACHE_WORDS:
                self.pairs.clear()
            self.pairs[key] = self.ends(x + y) == [len(x), len(x) + len(y)]
        return self.pairs[key]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Spans that may be the last piece starting before ``cut``, in order."""
        spans = ((a, b) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(text), a + self.longest) + 1))
        return [(a, b) for a, b in spans if b > a and (b - a == 1 or text[a:b].replace("▁", " ") in self.pieces) and self.ends(text[a:b]) == [b - a]]


class Chunk:
    """Ways through one chunk: ``text`` holds it from ``lo`` to ``hi``, with a piece's length of context on either side."""

    def __init__(self, codec: Codec, text: str, lo: int, hi: int, first: bool, last: bool) -> None:
        self.codec, self.text, self.lo, self.hi = codec, text, lo, hi
        self.ins = [(lo, lo)] if first else codec.states(text, lo)
        self.outs = [(hi, hi)] if last else codec.states(text, hi)
        self.trunk = [lo, *(lo + x for x in codec.ends(text[lo:hi]))]
        self.stubs: dict[tuple[int, bool], tuple[int, list[int]] | None] = {}

    def agree(self, a: int, b: int, c: int) -> bool:
        return a == b or b == c or self.codec.fit(self.text[a:b], self.text[b:c])

    def ends(self, a: int, b: int) -> list[int]:
        return [a, *(a + x for x in self.codec.ends(self.text[a:b]))]

    def stub(self, at: int, right: bool) -> tuple[int, list[int]] | None:
        """From ``at``, the index in the trunk where the way joins it (or leaves it), and the way until there."""
        if (at, right) not in self.stubs:
            found, reach, trunk = None, 4 * self.codec.longest, self.trunk
            while found is None and reach < 2 * (self.hi - self.lo):
                if right:
                    k = int(np.searchsorted(trunk, at - reach, "right")) - 1
                    if k > 0 and self.agree(trunk[k - 1], trunk[k], (way := self.ends(trunk[k], at))[1]):
                        found = k, way
                else:
                    k = int(np.searchsorted(trunk, at + reach))
                    if k < len(trunk) - 1 and self.agree((way := self.ends(at, trunk[k]))[-2], trunk[k], trunk[k + 1]):
                        found = k, way
                reach *= 2
            self.stubs[at, right] = found
        return self.stubs[at, right]

    def way(self, a: int, b: int, ends_only: bool = False) -> list[int]:
        """Boundaries of the pieces from ``a`` to ``b``; with ``ends_only`` the inner ones may be left out."""
        left, right = (self.stub(a, False), self.stub(b, True)) if b - a > 16 * self.codec.longest else (None, None)
        if not (left and right and left[0] < right[0]):
            return self.ends(a, b) if a < b else [a]
        return left[1] + ([] if ends_only else self.trunk[left[0] + 1 : right[0]]) + right[1]

    def weights(self) -> np.ndarray:
        """The transfer matrix: 0 where a way from an in-state to an out-state exists, else minus infinity."""
        out = np.full((len(self.ins), len(self.outs)), -np.inf)
        for i, (a, b) in enumerate(self.ins):
            for j, (c, d) in enumerate(self.outs):
                if b > c:
                    continue
                way = self.way(b, c, ends_only=True)
                whole = [*([a] if a < b else []), *way, *([d] if c < d else [])]
                at = {0, len(whole) - 3} if a < b and c < d else {0} if a < b else {len(whole) - 3}
                if len(whole) < 3 or all(self.agree(*whole[k : k + 3]) for k in at if k >= 0):
                    out[i, j] = 0.0
        return out

    def ids(self, i: int, j: int) -> list[int]:
        """Ids of the pieces that start in this chunk, between in-state ``i`` and out-state ``j``."""
        (_, b), (c, d) = self.ins[i], self.outs[j]
        way = self.way(b, c) + ([d] if c < d else [])
        return [x for a, e in zip(way, way[1:], strict=False) for x in self.codec.ids_of(self.text[a:e])]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(1)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The states at all cuts on the best way, first and last included, by a balanced tree of products."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([max_plus(x[k], x[k + 1]) if k + 1 < len(x) else x[k] for k in range(0, len(x), 2)])
    top = levels[-1][0]
    if not np.isfinite(top.max()):
        raise ValueError("no way through the document")
    states = list(np.unravel_index(int(top.argmax()), top.shape))
    for x in reversed(levels[:-1]):
        finer = [states[0]]
        for k in range(0, len(x), 2):
            if k + 1 < len(x):
                finer.append(int((x[k][finer[-1]] + x[k + 1][:, states[k // 2 + 1]]).argmax()))
            finer.append(states[k // 2 + 1])
        states = finer
    return [int(s) for s in states]


def _with_model(df: DataFrame, path: str):
    """The model's bytes on every executor: read on the driver, half a megabyte."""
    return df.sparkSession.sparkContext.broadcast(model_bytes(path))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("rk"), F.when(text == "", "").otherwise(F.concat(F.lit(" "), text)).alias("text")
    )


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def encode_short(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """(doc_id, rk, copy, chunk, ids) of the documents that are one chunk; copy and chunk are 0.

    With ``decoded`` also ``piece``, what ``decode`` makes of the ids, in the same pass.
    """
    held = _with_model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                ids = codec.encode(some.column(2).to_pylist())
                columns = [some.column(0), some.column(1), pa.array(np.zeros(len(some), np.int64)), pa.array(np.zeros(len(some), np.int32)), _lists(ids)]
                columns += [pa.array([codec.decode(x)[1:] for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "copy", "chunk", "ids", "piece"][: len(columns)])

    rows = _keyed(docs, id_col, text_col).where(F.length("text") <= chunk)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long, copy long, chunk int, ids array<int>{', piece string' if decoded else ''}")


def encode_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, rk, copy, chunk, ids) of the documents of several chunks, by the scan; copy numbers repeated rows from 0."""
    held = _with_model(docs, model)
    margin = Codec(held.value).longest + 1
    kind, n = docs.schema[id_col].dataType.simpleString(), partitions(docs.sparkSession)
    # Repeated rows are encoded once and return their ids as often as they occur.
    rows = _keyed(docs, id_col, text_col).where(F.length("text") > chunk).groupBy("doc_id", "rk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text = batch.column(2)[k].as_py()
                starts = list(range(0, len(text), chunk))
                lefts = [max(0, at - margin) for at in starts]
                columns = [batch.column(c).take(pa.array([k] * len(starts))) for c in (0, 1, 3)]
                columns += [
                    pa.array(range(len(starts)), pa.int32()),
                    pa.array([text[left : left + chunk + 2 * margin] for left in lefts]),
                    pa.array([at - left for at, left in zip(starts, lefts, strict=True)], pa.int32()),
                    pa.array([min(len(text), at + chunk) - left for at, left in zip(starts, lefts, strict=True)], pa.int32()),
                    pa.array([at + chunk >= len(text) for at in starts]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "copies", "chunk", "part", "lo", "hi", "last"])

    parts = rows.mapInArrow(split, f"doc_id {kind}, rk long, copies long, chunk int, part string, lo int, hi int, last boolean").repartition(n, "doc_id", "rk", "chunk")

    def chunks(batch: pa.RecordBatch, codec: Codec) -> Iterator[Chunk]:
        text, lo, hi, last, number = (batch.column(x).to_pylist() for x in ("part", "lo", "hi", "last", "chunk"))
        for k in range(len(batch)):
            yield Chunk(codec, text[k], lo[k], min(hi[k], len(text[k])), number[k] == 0, last[k])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            found = [x.weights() for x in chunks(batch, codec)]
            cells = pa.array([x.ravel() for x in found], pa.list_(pa.float64()))
            width = pa.array([x.shape[1] for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "rk", "chunk")), cells, width], names=["doc_id", "rk", "chunk", "cells", "width"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        states = best_states([np.asarray(c).reshape(-1, w) for c, w in zip(group["cells"], group["width"], strict=True)])
        return group[["doc_id", "rk", "chunk"]].assign(i=states[:-1], j=states[1:])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            i, j = batch.column("i").to_pylist(), batch.column("j").to_pylist()
            ids = [x.ids(i[k], j[k]) for k, x in enumerate(chunks(batch, codec))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "rk", "copies", "chunk")), _lists(ids)], names=["doc_id", "rk", "copies", "chunk", "ids"])

    matrices = parts.mapInArrow(transfer, f"doc_id {kind}, rk long, chunk int, cells array<double>, width int")
    # A document is one value of under 2^31 bytes, so it has few and small matrices however long it is.
    # Dealt by number, so that small matrices are not put into one task.
    chosen = matrices.repartition(n, "doc_id", "rk").groupBy("doc_id", "rk").applyInPandas(scan, f"doc_id {kind}, rk long, chunk int, i int, j int").alias("c")
    same = F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.rk") == F.col("c.rk")) & (F.col("p.chunk") == F.col("c.chunk"))
    traced = parts.alias("p").join(chosen, same).select("p.*", "i", "j").mapInArrow(trace, f"doc_id {kind}, rk long, copies long, chunk int, ids array<int>")
    return traced.select("doc_id", "rk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "chunk", "ids")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, rk, copy, chunk, ids): the ids of every text, those of long ones chunk after chunk.

    ``rk`` is a hash of the text. Null and empty texts have no ids. Every row
    returns its chunks, repeated ones as often as they occur; ``copy`` tells the
    chunks of repeated longer rows apart. Null ids of documents are kept. Ids are
    those of the library over the whole text. Other columns of ``docs`` are not
    read; no rows give no rows.
    """
    return encode_short(docs, id_col, text_col, model, chunk).unionByName(encode_long(docs, id_col, text_col, model, chunk))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, rk, copy, chunk, ids) with ``piece``, the text of each row; joined by chunk they are the document.

    The space that starts a text in the model is taken off. U+2581 stands for a
    space in the model, so it comes back as one.
    """
    held = _with_model(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            ids, number = batch.column("ids"), batch.column("chunk").to_pylist()
            texts = [codec.decode(ids[k].values.to_numpy().tolist() if ids[k].values is not None else []) for k in range(len(batch))]
            texts = [t[1:] if n == 0 else t for t, n in zip(texts, number, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "piece"])

    rows = encoded.select("doc_id", "rk", "copy", "chunk", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long, copy long, chunk int, ids array<int>, piece string")


def whole(rows: DataFrame, *cols: str) -> DataFrame:
    """The chunks of long documents as lists in order, one row for each document and copy."""
    grouped = rows.groupBy("doc_id", "rk", "copy").agg(F.array_sort(F.collect_list(F.struct("chunk", *cols))).alias("parts"))
    return grouped.select("doc_id", "rk", *(F.col(f"parts.{c}").alias(c) for c in cols))
