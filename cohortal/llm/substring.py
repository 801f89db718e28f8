"""Substring dedup over sliding spans of sentences.

Every run of ``SPAN`` consecutive sentences is hashed and joined with all others.
A run is a repeat if an equal one comes earlier in the order (doc_id, sentence
number); sentences that a repeat covers are cut from the text.

A sentence ends at ``.``, ``!`` or ``?`` before white space, or at the end of a
line; one of more than ``MOST_WORDS`` words counts as several, so that a passage
without full stops is seen as well. It is cut where the hash of two neighbouring
words is the greatest of ``MOST_WORDS`` in a row, so that equal words are cut alike
wherever a sentence begins; a character of a script without spaces counts as a
word there. Runs of fewer than ``LEAST_WORDS`` words recur by chance; they are
extended, forward and backward, by further sentences until they have as many, so
that lists and menus of short lines are seen too. A text of fewer words altogether
is one run. In scripts without spaces two characters count as a word.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut, stored

SPAN = 3
MOST_WORDS = 16
LEAST_WORDS = 9
#: A sentence with the white space behind it. A run of marks is read once, so that a text of marks alone takes no longer than another.
_SENTENCE = re.compile(r"[^\n](?:[^\n.!?]++|[.!?]++(?!\s))*+(?:[.!?]++\s+|\n\s*|$)|\n\s*")
#: Thai, Lao, Burmese, Khmer, kana and Han.
_CHARS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_CHARS}]")
_WORD, _WORD_OR_CHAR = re.compile(r"\S+"), re.compile(rf"[{_CHARS}]|[^\s{_CHARS}]+")


def _cuts(words: list[str]) -> list[int]:
    """The words before which a long sentence is cut: the greatest hash of every ``MOST_WORDS`` in a row, the last of equal ones."""
    data = [w.encode() for w in words]
    marks = list(map(crc32, [b"", *data[:-1]], map(crc32, data)))
    out, last = [], 0
    for end in range(MOST_WORDS, len(marks)):
        if last <= end - MOST_WORDS:
            some = marks[end - MOST_WORDS + 1 : end + 1]
            some.reverse()
            last = end - some.index(max(some))
        elif marks[end] > marks[last]:
            last = end
        else:
            continue
        out.append(last)
    return out


def sentences(text: str) -> list[str]:
    """A text cut into sentences; joined they are the text again."""
    out, plain = [], text.isascii() or not _UNSPACED.search(text)
    for s in _SENTENCE.findall(text):
        words = s.split() if plain else _WORD_OR_CHAR.findall(s)
        if len(words) <= MOST_WORDS:
            out.append(s)
            continue
        starts = [m.start() for m in (_WORD if plain else _WORD_OR_CHAR).finditer(s)]
        cuts = [starts[k] for k in _cuts(words)]
        out += [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]
    return out


def _size(sentence: str, words: int) -> int:
    """Its words; in scripts without spaces two characters count as one."""
    return words if sentence.isascii() else words + len(_UNSPACED.findall(sentence)) // 2


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, end) of every run over sentences of so many words, in order.

    Fewer sentences than ``SPAN``, or fewer words than ``LEAST_WORDS``, are one run.
    A run of ``SPAN`` that is too short gives the least one that begins where it
    does and the least one that ends there, if those sentences have words.
    """
    n, sums = len(sizes), list(accumulate(sizes, initial=0))
    if n < SPAN or sums[n] < LEAST_WORDS:
        return [(0, n)] if sums[n] else []
    out = []
    for k in range(n - SPAN + 1):
        end = k + SPAN
        if sums[end] - sums[k] >= LEAST_WORDS:
            out.append((k, end))
            continue
        if sizes[k] and (far := bisect_left(sums, sums[k] + LEAST_WORDS)) <= n:
            out.append((k, far))
        if sizes[end - 1] and (near := bisect_right(sums, sums[end] - LEAST_WORDS) - 1) >= 0:
            out.append((near, end))
    return sorted(set(out))


def runs_of(text: str) -> tuple[list[int], list[bytes]]:
    """(place, 128-bit hash) of every run; a place is the first sentence times 2^32, plus the number of sentences.

    Such places hash apart; with the end in the place of the number they would not, and sets of them would be slow.
    """
    parts = sentences(text)
    words = [s.split() for s in parts]
    flat = [" ".join(w) for w in words]
    at, out = [], []
    for k, end in spans([_size(s, len(w)) for s, w in zip(parts, words, strict=True)]):
        at.append(k << 32 | end - k)
        out.append(xxhash.xxh3_128_digest("\n".join(flat[k:end])))
    return at, out


def _runs(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, at, h1, h2) of every run of every document."""
    names = ["doc_id", "rk", "at", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                some = batch.slice(first, 256)
                owner, starts, hashes = [], [], []
                for k, text in enumerate(some.column(2).to_pylist()):
                    at, found = runs_of(text or "")
                    owner += [k] * len(at)
                    starts += at
                    hashes += found
                owner = pa.array(owner, pa.int32())
                pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                columns = [some.column(0).take(owner), some.column(1).take(owner), pa.array(starts, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "rk", "text").mapInArrow(run, f"doc_id {kind}, rk long, at long, h1 long, h2 long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, starts, first_docs): the repeated runs of each document, and where they come first.

    ``docs`` has doc_id, rk and text.
    """
    runs = stored(_runs(docs))  # read twice: for the hashes that recur, of which half goes through the shuffle, and for their places
    known = cut(runs.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    met = stored(runs.join(known, "h1", "left_semi"))
    place = F.struct("doc_id", "rk", "at")
    first = met.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Materialised, so that a run with very many copies can be split in the join.
    first = cut(first.select("h1", "h2", "first"))
    later = met.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "rk").agg(F.collect_set("at").alias("starts"), F.collect_set("first.doc_id").alias("first_docs"))


def dedup_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, first_docs, text): every document without its repeated spans.

    * Null texts stay null, empty ones empty, both without sentences. A text of
      fewer sentences than a span is compared as a whole.
    * Rows with one id and one text are one document and lose the same
      sentences. Null ids come first in the order. Texts may have any length.
      Other columns of ``docs`` are not read; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    found = repeats(rows).alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.rk") == F.col("f.rk"))
    both = rows.alias("d").join(found, same, "left").select("d.doc_id", "first_docs", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts = [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = sentences(text or "")
                gone = {k for at in starts or () for k in range(at >> 32, (at >> 32) + (at & 0xFFFFFFFF))}
                total.append(len(parts))
                removed.append(len(gone))
                texts.append("".join(p for k, p in enumerate(parts) if k not in gone) if gone else text)
            columns = [batch.column(0), pa.array(total, pa.int32()), pa.array(removed, pa.int32()), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_removed", "first_docs", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_sentences int, n_removed int, first_docs array<{kind}>, text string")
