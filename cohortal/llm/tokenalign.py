"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Each text is encoded by a byte-level BPE (A) and by a SentencePiece model (B). Both
are merged over the cumulative ends of their tokens: where both end, a group ends;
between two neighbouring ends lies one token of A and one of B, which is one link,
as two tokens overlap in one stretch only. Spark then counts the id pairs of all
links, finds the highest count of each B id, and joins both back.

No token of either reaches over the start of a word, a space behind a visible
character, so a text is merged word by word, and each distinct word of a block, some
thousands of documents that one task read one after the other, once. A document is
then a list of its words, a word a list of links, and a link a place among the
block's distinct pairs: one row for each block and distinct pair is counted and
joined, not one for each link or document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut, stored
from cohortal.llm.spm import MODEL, Codec, model_bytes

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: New words are merged in lots of texts of about so many characters; a block ends at so many distinct words, or characters of these.
LOT_CHARS, BLOCK_WORDS, BLOCK_CHARS = 500_000, 250_000, 16_000_000
#: What Unicode calls white space; Python's own class has four control characters more.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: From a space behind a visible character, or at the start, to the next such.
_WORD = re.compile(f" (?:[^ ]++|(?<=[{_WHITE}]) )*+")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteCodec:
    """Encoder of a byte-level BPE; ids are those of the library over the whole text."""

    def __init__(self, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        chars = byte_of_char()
        self.lib = Tokenizer.from_buffer(model)
        self.lib.encode_special_tokens = True
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        added = {x.content for x in self.lib.get_added_tokens_decoder().values()}
        self.out = [b""] * (1 + max(vocabulary.values()))
        for piece, i in vocabulary.items():
            self.out[i] = piece.encode() if piece in added else bytes(chars[c] for c in piece)
        split = {} if self.lib.pre_tokenizer is None else json.loads(self.lib.pre_tokenizer.__getstate__())
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and self.lib.normalizer is None
        #: Every byte is a token by itself, and nothing is rewritten.
        self.lossless = plain and all(c in vocabulary for c in chars)
        #: The library splits before a word before it merges, so that words are encoded by themselves.
        self.by_word = plain and split.get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]


class Merger:
    """Groups and links of words, which begin with a space each; other than by words, whole texts are one each."""

    def __init__(self, a: ByteCodec, b: Codec) -> None:
        self.a, self.b, self.by_word = a, b, a.by_word and b.by_word
        self.sizes = [np.array(list(map(len, x.out)), np.int64) for x in (a, b)]
        (m, n) = map(len, self.sizes)
        self.shown = [f"{i}{sign}" for size, signs in ((m, ",|"), (n, ",;")) for sign in signs for i in range(size)]

    def words(self, text: str) -> list[str]:
        return _WORD.findall(" " + text) if self.by_word else [" " + text]

    def merge(self, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(n_a, n_b, n_groups, n_links) of each word, its groups as text, and the pairs of all links in order; a pair is A's id times 2^32 plus B's.

        A word whose bytes do not come back has none of these.
        """
        counts, shown = np.zeros((len(words), 4), np.int64), [""] * len(words)
        data = [w.encode(errors="replace") for w in words]
        ids = [self.a.encode(words), self.b.lib.encode(words, num_threads=1)]
        # A's bytes always come back, and so do B's of visible ASCII; of other words they are compared.
        plain = self.a.lossless
        whole = [k for k, d in enumerate(data) if ids[1][k] and (plain or self._back(self.a, ids[0][k], d)) and (words[k].isascii() and words[k].isprintable() or self._back(self.b, ids[1][k], d))]
        if not whole:
            return counts, shown, np.zeros(0, np.int64)
        # Both sides of each word have the same bytes, so that the words can be laid end to end.
        toks = [np.fromiter(chain.from_iterable(i[k] for k in whole), np.int64) for i in ids]
        lens = [np.array([len(i[k]) for k in whole], np.int64) for i in ids]
        ends = [np.cumsum(size[t]) for size, t in zip(self.sizes, toks, strict=True)]
        every = np.sort(np.concatenate(ends), kind="stable")
        fresh = np.r_[True, every[1:] != every[:-1]]
        links, common = every[fresh], every[1:][~fresh[1:]]
        word_ends = np.cumsum([len(data[k]) for k in whole])
        of = lambda e: np.bincount(np.searchsorted(word_ends, e), minlength=len(whole))
        counts[whole] = np.stack([*lens, of(common), of(links)], 1)
        for k, x in zip(whole, self._groups(toks, lens, ends, common), strict=True):
            shown[k] = x
        return counts, shown, toks[0][np.searchsorted(ends[0], links)] << 32 | toks[1][np.searchsorted(ends[1], links)]

    @staticmethod
    def _back(codec: ByteCodec | Codec, ids: list[int], data: bytes) -> bool:
        return b"".join(map(codec.out.__getitem__, ids)) == data

    def _groups(self, toks: list[np.ndarray], lens: list[np.ndarray], ends: list[np.ndarray], common: np.ndarray) -> list[str]:
        group = [np.searchsorted(common, e) for e in ends]
        last = [common[g] == e for g, e in zip(group, ends, strict=True)]
        m, n = map(len, self.sizes)
        codes = np.empty(len(toks[0]) + len(toks[1]), np.int64)
        codes[np.arange(len(toks[0])) + np.searchsorted(group[1], group[0], "left")] = toks[0] + m * last[0]
        codes[np.arange(len(toks[1])) + np.searchsorted(group[0], group[1], "right")] = 2 * m + toks[1] + n * last[1]
        shown, bounds = list(map(self.shown.__getitem__, codes.tolist())), np.cumsum(np.r_[0, lens[0] + lens[1]]).tolist()
        return ["".join(shown[x:y])[:-1] for x, y in zip(bounds, bounds[1:], strict=False)]


class _Block:
    """Documents as lists of words, and the distinct words of them all."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.docs, self.counts, self.pairs, self.shown, self.chars = [], [], [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)], [], 0

    def add(self, ids: list, texts: list[str], merger: Merger) -> None:
        # U+2581 is a space in B, so that its bytes do not come back.
        split = [merger.words(t) if t and "\u2581" not in t else [] for t in texts]
        known = self.known
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        counts, shown, pairs = merger.merge(new)
        self.counts.append(counts)
        self.pairs.append(pairs)
        self.shown += shown
        self.chars += sum(map(len, new))
        self.ids += ids
        self.docs += [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in split]

    def full(self) -> bool:
        return len(self.known) >= BLOCK_WORDS or self.chars >= BLOCK_CHARS

    def rows(self, names: list[str]) -> pd.DataFrame:
        counts, shown = np.concatenate(self.counts), self.shown
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        lost = counts[:, 3] == 0
        docs = [x[:0] if len(x) and lost[x].any() else x for x in self.docs]
        ends = np.cumsum([0, *map(len, docs)])
        flat = np.concatenate(docs)
        times = np.repeat(np.bincount(flat, minlength=len(counts)), counts[:, 3])
        total = np.bincount(place, times, len(pairs)).astype(np.int64)
        sums = np.empty((len(docs), 4), np.int64)
        for c in range(4):
            running = np.r_[0, np.cumsum(counts[flat, c])]
            sums[:, c] = running[ends[1:]] - running[ends[:-1]]
        sums = sums.tolist()
        digests = [hashlib.sha256(";".join(map(shown.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in docs]
        key = uuid.uuid4().int >> 65
        made = [(key, i, *c, d, x, None, None, None) for i, c, d, x in zip(self.ids, sums, digests, docs, strict=True)]
        return pd.DataFrame([*made, (key, None, 0, 0, 0, 0, "", place.astype(np.int32), counts[:, 3].astype(np.int32), pairs, total)], columns=names)


def merged(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = MODEL) -> DataFrame:
    """Rows of documents and rows of blocks, told by ``pairs``.

    A document (doc_id, n_a, n_b, n_groups, n_links, groups_sha256) has under ``at`` the
    numbers of its words. A block has its distinct pairs in order with how often each
    occurs under ``total``; under ``n`` the number of links of each word, and under ``at``
    the place among the pairs of each of these links.
    """
    held = docs.sparkSession.sparkContext.broadcast((model_bytes(byte_model), model_bytes(piece_model)))  # two megabytes
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "n", "pairs", "total"]

    def lots(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, size = [], [], 0
        for frame in frames:
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids.append(i)
                texts.append(text.decode(errors="replace") if text is not None else "")
                size += len(texts[-1])
                if size >= LOT_CHARS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger, block = Merger(ByteCodec(held.value[0]), Codec(held.value[1])), _Block()
        for ids, texts in lots(frames):
            block.add(ids, texts, merger)
            if block.full():
                yield block.rows(names)
                block = _Block()
        if block.ids:
            yield block.rows(names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    # As text, since pandas has no whole numbers with nulls between them.
    taken = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    found = taken.mapInPandas(run, f"block long, doc_id string, {counted}, at array<int>, n array<int>, pairs array<long>, total array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs`` (doc_id, text).

    * Null and empty texts, and those whose tokens do not give their bytes back
      (U+2581 in B, bytes that are no UTF-8), have no tokens: zeros, and an empty
      digest.
    * Repeated rows count as often as they occur; null ids are kept. Texts may have
      any length. Other columns are not read; no rows give no rows.
    """
    rows = stored(merged(docs, byte_model, piece_model))
    entries = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "total")).alias("at", "x"))
    entries = entries.select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.total").alias("n"))
    counts = cut(entries.groupBy("pair").agg(F.sum("n").alias("count")))
    side = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = cut(counts.groupBy(side).agg(F.max("count").alias("most")))
    ruled = cut(counts.select("pair", "count", side).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    back = entries.select(F.col("block").alias("owner"), "at", "pair").join(ruled, "pair").select("owner", "at", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        right, is_block = right.sort_by("at"), left.column("pairs").is_valid()
        block, left = left.filter(is_block), left.filter(pc.invert(is_block)).combine_chunks()
        place, links = (block.column(c)[0].values.to_numpy() for c in ("at", "n"))
        ends, words = np.cumsum(np.r_[0, links]), left.column("at").combine_chunks()
        bounds, flat = words.offsets.to_numpy(), words.values.to_numpy()
        sums = []
        for c in ("best", "count"):
            by_link = np.r_[0, np.cumsum(right.column(c).cast(pa.int64()).to_numpy()[place])] if len(place) else np.zeros(1, np.int64)
            by_word = by_link[ends[1:]] - by_link[ends[:-1]]
            total = np.r_[0, np.cumsum(by_word[flat])] if len(flat) else np.zeros(1, np.int64)
            sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
        return pa.table([*(left.column(c) for c in names[:5]), *sums, left.column("groups_sha256")], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in names[1:7])
    return rows.drop("total").groupBy("block").cogroup(back.groupBy("owner")).applyInArrow(summed, f"doc_id {kind}, {numbers}, groups_sha256 string")
