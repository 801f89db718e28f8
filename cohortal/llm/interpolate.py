"""Language-model scoring by deleted interpolation.

The probability of a word is a mixture of maximum-likelihood estimates: of the word
after the one before it, of the word alone, and of one share for each known word and
one for all unknown ones. The weights depend on how often the word before was seen
(buckets by powers of two). They are learned by expectation-maximisation on the
counts of a held-out share of the training documents, against estimates of the
others; the estimates that score are of all training documents.

Documents are read once into blocks of about ``BLOCK_TOKENS`` tokens: the block's
words as hashes, and each document as places among these. Of a block only its
distinct words and word pairs go through the shuffle, each once, in compressed lists
by part of the hash; so a frequent word is as many entries as there are blocks. A
part's counts are summed in one task and go back to the blocks, whose documents are
then scored where their words are. At very many blocks and parts a list holds one
entry.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import stored

BLOCK_TOKENS = 1_000_000
#: A part of the hashes has about so many tokens' words and pairs.
PART_TOKENS = 1_000_000
#: A word of no text each, as they hold white space: what stands before a text and behind it. They are the first two of a block's words.
START, END = b"\n<", b"\n>"
FOLDS, TEST_FOLD = 5, 1
#: Of this many training documents one is held out to learn the weights.
DELETED = 16
#: Context frequencies 0, 1, 2-3, 4-7 and so on; the last bucket holds all beyond.
BUCKETS = 16
#: Expectation-maximisation ends after so many rounds, or when a round gains less than this of the log likelihood.
ROUNDS, GAIN = 30, 1e-6
COUNTED, DELETED_PART, TESTED = range(3)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in the training; one without an id does."""
    return F.coalesce(F.pmod(_fold(doc_id), F.lit(FOLDS)) == TEST_FOLD, F.lit(False))


def role(doc_id: Column) -> Column:
    deleted = F.pmod(F.floor(_fold(doc_id) / FOLDS), F.lit(DELETED)) == 0
    return F.when(held_out(doc_id), TESTED).when(deleted, DELETED_PART).otherwise(COUNTED)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes before all second ones, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)


class _Block:
    """Documents of one role, as they are gathered."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.tokens, self.n = [], [], [], 0
        self.known: dict[bytes, int] = {START: 0, END: 1}

    def add(self, doc_id: pa.Array, text: bytes) -> None:
        words, known = text.lower().split(), self.known  # bytes: lowers A-Z only, splits at 20 and 09-0D only
        for w in words:
            if w not in known:
                known[w] = len(known)
        self.ids.append(doc_id)
        self.sizes.append(len(words) + 1)
        self.tokens.append(np.fromiter((*map(known.__getitem__, words), 1), np.int32, len(words) + 1))
        self.n += len(words) + 1

    def row(self, of: int) -> pa.RecordBatch:
        tokens, words = np.concatenate(self.tokens), _hashes(list(self.known))
        # The most frequent words get the least places, so that tokens compress well.
        ranked = np.r_[0, 1, 2 + np.argsort(-np.bincount(tokens, minlength=len(words))[2:], kind="stable")]
        place = np.empty(len(words), np.int32)
        place[ranked] = np.arange(len(words), dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(self.ids), pa.array(self.sizes, pa.int32()))]
        packed = [pa.array([_pack(x)], pa.binary()) for x in (words[ranked], place[tokens])]
        names = ["block", "role", "doc_ids", "sizes", "words", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([of], pa.int32()), *lists, *packed], names=names)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, role, doc_ids, sizes, words, tokens): documents of one role, their numbers of tokens, and these one text after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {r: _Block() for r in (COUNTED, DELETED_PART, TESTED)}
        for batch in batches:
            for k in range(len(batch)):
                r = batch.column(1)[k].as_py()
                held[r].add(batch.column(0).slice(k, 1), batch.column(2)[k].as_py() or b"")
                if held[r].n >= BLOCK_TOKENS:
                    yield held[r].row(r)
                    held[r] = _Block()
        for r, x in held.items():
            if x.n:
                yield x.row(r)

    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = docs.select("doc_id", role(F.col("doc_id")).alias("role"), F.col("text").cast("binary").alias("text"))
    return taken.mapInArrow(run, f"block long, role int, doc_ids array<{kind}>, sizes array<int>, words binary, tokens binary")


class _Read:
    """What a block says of its words (kind 0) and pairs of words (kind 1): keys in a fixed order, and how often each occurs."""

    def __init__(self, row: pa.RecordBatch | pa.Table) -> None:
        self.sizes = row.column("sizes")[0].values.to_numpy()
        words, tokens = _unpack(row.column("words")[0].as_py(), np.uint64), _unpack(row.column("tokens")[0].as_py(), np.int32)
        self.tokens = tokens
        self.starts = np.cumsum(np.r_[0, self.sizes[:-1]])
        before = np.r_[0, tokens[:-1]].astype(np.int64)
        before[self.starts] = 0
        codes, self.pair_of, times = np.unique(before * len(words) + tokens, return_inverse=True, return_counts=True)
        self.left, self.right = codes // len(words), codes % len(words)
        alone = np.bincount(tokens, minlength=len(words))
        alone[0] = len(self.sizes)  # what stands before a text is no token
        self.keys = [words, _pair_hash(words[self.left], words[self.right])]
        self.times = [alone, times]

    def order(self, kind: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a kind in order, which is by part, and where each part begins and ends."""
        order = np.argsort(self.keys[kind])
        part = (self.keys[kind][order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        return order, np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))

    def counts(self, rows: pa.Table, column: str, parts: int) -> list[np.ndarray]:
        """The counts that came back for its words and its pairs, in the order of its keys."""
        rows, out = rows.sort_by([("kind", "ascending"), ("part", "ascending")]), []
        which, held = rows.column("kind").to_pylist(), rows.column(column).to_pylist()
        for kind in (0, 1):
            sums = np.concatenate([_unpack(x, np.int64) for k, x in zip(which, held, strict=True) if k == kind])
            place = np.empty(len(sums), np.int64)
            place[self.order(kind, parts)[0]] = sums
            out.append(place)
        return out


def counted(stored_blocks: DataFrame, parts: int) -> DataFrame:
    """(block, role, kind, part, every, kept, v_every, v_kept): for each list that a block sent, the counts over all training documents.

    ``kept`` leaves the deleted ones out and is there for these only. A row without a block has the numbers of known words of its part.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                read, name, of = _Read(row), row.column("block")[0].as_py(), row.column("role")[0].as_py()
                out = []
                for kind in (0, 1):
                    order, bounds = read.order(kind, parts)
                    keys, n = read.keys[kind][order], read.times[kind][order].astype(np.int32)
                    for p in np.flatnonzero(np.diff(bounds)).tolist():
                        x, y = bounds[p], bounds[p + 1]
                        out.append((name, of, kind, p, _pack(keys[x:y]), _pack(n[x:y]) if of != TESTED else None))
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "role", "kind", "part", "keys", "n"])

    start = int(_hashes([START])[0])

    def total(group: pa.Table) -> pa.Table:
        roles, kind, part = group.column("role").to_pylist(), group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        lists, n = ([None if x is None else _unpack(x, t) for x in group.column(c).to_pylist()] for c, t in (("keys", np.uint64), ("n", np.int32)))
        ends = np.cumsum([0, *map(len, lists)])
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        sums = []
        for of in ((COUNTED, DELETED_PART), (COUNTED,)):
            mine = [k for k, r in enumerate(roles) if r in of]
            at = np.concatenate([place[ends[k] : ends[k + 1]] for k in mine] or [place[:0]])
            sums.append(np.bincount(at, np.concatenate([n[k] for k in mine] or [place[:0]]), len(keys)).astype(np.int64))
        known = [int(((x > 0) & (keys != start)).sum()) if kind == 0 else 0 for x in sums]
        back = lambda x, k: _pack(x[place[ends[k] : ends[k + 1]]])
        every = [back(sums[0], k) for k in range(len(lists))]
        kept = [back(sums[1], k) if r == DELETED_PART else None for k, r in enumerate(roles)]
        last = [[None], [None], [kind], [part], [None], [None], [known[0]], [known[1]]]
        first = [group.column(c).to_pylist() for c in ("block", "role", "kind", "part")] + [every, kept, [0] * len(lists), [0] * len(lists)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x + y, t) for x, y, t in zip(first, last, types, strict=True)], names=["block", "role", "kind", "part", "every", "kept", "v_every", "v_kept"])

    sent = stored_blocks.mapInArrow(entries, "block long, role int, kind int, part int, keys binary, n binary")
    return sent.groupBy("kind", "part").applyInArrow(total, "block long, role int, kind int, part int, every binary, kept binary, v_every long, v_kept long")


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _share(n: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    return np.divide(n, of, out=np.zeros(len(n)), where=np.broadcast_to(np.asarray(of) > 0, n.shape))


def learned(events: DataFrame, uniform: float) -> list[tuple[float, float, float]]:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation over ``events`` (bucket, pair, word, n).

    A round is one aggregation by bucket; the driver sees its sums only. Without events the weights are equal, but in bucket 0, where
    no pair is known; a bucket without events takes those of the one below it. The uniform share keeps a millionth at least.
    """
    weights = [(0.0, 0.5, 0.5)] + [(1 / 3, 1 / 3, 1 / 3)] * (BUCKETS - 1)
    before = None
    for _ in range(ROUNDS):
        at = [F.element_at(F.array(*(F.lit(w[k]) for w in weights)), F.col("bucket") + 1) for k in range(3)]
        terms = [at[0] * F.col("pair"), at[1] * F.col("word"), at[2] * F.lit(uniform)]
        p = terms[0] + terms[1] + terms[2]
        sums = events.groupBy("bucket").agg(*(F.sum(F.col("n") * t / p).alias(f"w{k}") for k, t in enumerate(terms)), F.sum(F.col("n") * F.log(p)).alias("gained"))
        rows = {r["bucket"]: r for r in sums.collect()}  # one row a bucket
        if not rows:
            return weights
        for b in range(BUCKETS):
            if b in rows:
                x = [max(rows[b][f"w{k}"], 0.0) for k in range(3)]
                x[2] = max(x[2], 1e-6 * sum(x))
                weights[b] = tuple(round(v / sum(x), 9) for v in x)
            elif b > 1 and any(k in rows for k in range(1, b)):
                weights[b] = weights[b - 1]
        now = sum(r["gained"] for r in rows.values())
        if before is not None and now - before <= GAIN * abs(before):
            break
        before = now
    return weights


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    * Null and empty texts are the end token alone. A document without an id is
      trained on. Repeated rows each return theirs and count as often as they occur.
    * Without training documents every token has probability 1 under the base,
      as there is one class, the unknown; the same holds for the model.
    * Words and pairs are told by 64-bit hashes. Texts may have any length; other
      columns are not read; no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = stored(blocks(docs))
    totals = {r["role"]: r["n"] for r in read.groupBy("role").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("n")).collect()}  # three rows
    kept_tokens, deleted_tokens = totals.get(COUNTED, 0), totals.get(DELETED_PART, 0)
    tokens = kept_tokens + deleted_tokens
    parts = max(1, math.ceil(sum(totals.values()) / PART_TOKENS))
    sums = stored(counted(read, parts))
    known, known_kept = sums.where("block is null").agg(F.coalesce(F.sum("v_every"), F.lit(0)), F.coalesce(F.sum("v_kept"), F.lit(0))).first()
    sums = sums.where("block is not null")

    def deleted(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _Read(left)
        alone, pairs = row.counts(right, "kept", parts)
        context = alone[row.left]
        columns = [pa.array(_bucket(context).astype(np.int32)), pa.array(_share(pairs, context)), pa.array(_share(alone[row.right], kept_tokens)), pa.array(row.times[1].astype(np.int64))]
        return pa.table(columns, names=["bucket", "pair", "word", "n"])

    mine = F.col("role") == DELETED_PART
    events = read.where(mine).groupBy("block").cogroup(sums.where(mine).groupBy("block")).applyInArrow(deleted, "bucket int, pair double, word double, n long")
    weights = [(0.0, 0.0, 1.0)] * BUCKETS if not tokens else learned(stored(events), 1 / (known_kept + 1))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _Read(left)
        alone, pairs = row.counts(right, "every", parts)
        context, mix = alone[row.left], np.array(weights)
        alone[0] = 0
        mix = mix[_bucket(context)]
        p = mix[:, 0] * _share(pairs, context) + mix[:, 1] * _share(alone[row.right], tokens) + mix[:, 2] / (known + 1)
        base = np.log10((alone + 0.5) / (tokens + 0.5 * (known + 1)))
        per_text = lambda x: pa.array(np.add.reduceat(x, row.starts))
        columns = [
            left.column("doc_ids")[0].values,
            pa.array(row.sizes.astype(np.int64)),
            per_text((alone > 0)[row.tokens].astype(np.int64)),
            per_text(base[row.tokens]),
            per_text(np.log10(p)[row.pair_of]),
        ]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    found = read.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
