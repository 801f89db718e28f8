import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortal.llm import interpolate as lm


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def role(doc_id):
    if doc_id is not None and fold(doc_id) % 5 == 1:
        return lm.TESTED
    return lm.DELETED_PART if doc_id is not None and fold(doc_id) // 5 % lm.DELETED == 0 else lm.COUNTED


def counts(docs, roles):
    alone, pairs, before = Counter(), Counter(), Counter()
    for doc_id, text in docs:
        if role(doc_id) in roles:
            seq = [*words(text), "$end "]
            alone.update(seq)
            for v, w in zip(["$start ", *seq], seq, strict=False):
                pairs[v, w] += 1
                before[v] += 1
    return alone, pairs, before


def bucket(n):
    return min(n.bit_length(), lm.BUCKETS - 1)


def brute(docs):
    """{place: (held_out, n_tokens, n_known, train_tokens, base, score)} by dictionaries over the whole table."""
    alone, pairs, before = counts(docs, (lm.COUNTED, lm.DELETED_PART))
    kept_alone, kept_pairs, kept_before = counts(docs, (lm.COUNTED,))
    _, deleted, _ = counts(docs, (lm.DELETED_PART,))
    n, kept_n = sum(alone.values()), sum(kept_alone.values())
    weights = [(0, 0.5, 0.5)] + [(1 / 3, 1 / 3, 1 / 3)] * (lm.BUCKETS - 1)
    parts = lambda v, w, a, p, b, total: (p[v, w] / b[v] if b[v] else 0, a[w] / total if total else 0, 1 / (len(a) + 1))
    last = None
    for _ in range(lm.ROUNDS if deleted else 0):
        sums, gained = {}, 0
        for (v, w), times in deleted.items():
            at = bucket(kept_before[v])
            terms = [x * f for x, f in zip(weights[at], parts(v, w, kept_alone, kept_pairs, kept_before, kept_n), strict=True)]
            gained += times * math.log(sum(terms))
            old = sums.setdefault(at, [0, 0, 0])
            sums[at] = [o + times * t / sum(terms) for o, t in zip(old, terms, strict=True)]
        for at in range(lm.BUCKETS):
            if at in sums:
                x = sums[at]
                x[2] = max(x[2], 1e-6 * sum(x))
                weights[at] = tuple(v / sum(x) for v in x)
            elif at > 1 and any(k in sums for k in range(1, at)):
                weights[at] = weights[at - 1]
        if last is not None and gained - last <= lm.GAIN * abs(last):
            break
        last = gained
    if not n:
        weights = [(0, 0, 1)] * lm.BUCKETS
    out = []
    for doc_id, text in docs:
        seq = [*words(text), "$end "]
        base = sum(math.log10((alone[w] + 0.5) / (n + 0.5 * (len(alone) + 1))) for w in seq)
        model = 0
        for v, w in zip(["$start ", *seq], seq, strict=False):
            model += math.log10(sum(x * f for x, f in zip(weights[bucket(before[v])], parts(v, w, alone, pairs, before, n), strict=True)))
        out.append((str(doc_id), role(doc_id) == lm.TESTED, len(seq), sum(alone[w] > 0 for w in seq), n, base, model))
    return out


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    follows = {w: rng.choices(vocabulary, k=4) for w in vocabulary}
    docs = []
    for k in range(n):
        w, text = rng.choice(vocabulary), []
        for _ in range(rng.randrange(1, 60)):
            text.append(w if rng.random() > 0.02 else f"rare{rng.randrange(10**6)}")
            w = rng.choice(follows[w]) if rng.random() < 0.8 else rng.choice(vocabulary)
        docs.append((k, rng.choice([" ", "  ", "\n", "\x0b"]).join(text)))
    return docs


ODD = [(None, "w1 w2"), (None, None), (1000, None), (1001, ""), (1002, "W1 w1\tÉÉ éé É"), (5, "repeated row"), (5, "repeated row"), (1003, "x\x1cy  z\xa0"), (2**62, "w1 w2 w3")]


def close(got, want):
    key = lambda r: (*r[:5], round(r[5], 3), round(r[6], 3))
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=1e-9, rel=1e-12) and x[6] == pytest.approx(y[6], rel=1e-6)


def rows(df):
    return [(str(r.doc_id), *tuple(r)[1:]) for r in df.collect()]


@pytest.mark.parametrize("size", [2_000_000, 300])
def test_equals_dictionaries_over_the_whole_table(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", size)
    monkeypatch.setattr(lm, "PART_TOKENS", max(1000, size // 4))
    docs = corpus() + ODD
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, block int, role string").repartition(3)
    close(rows(lm.score(df)), brute(docs))


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    got = [r for r in lm.score(spark.createDataFrame(corpus(600, 7), "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_the_chances_of_distinct_texts_add_up_to_less_than_one(spark):
    """Of no word, of each known word and of an unknown one: a proper model leaves the rest to longer texts, and gives most of the mass to what it has seen."""
    docs = [(k, w) for k, w in corpus(400, 3)] + [(5000 + k, f"only{k % 7}") for k in range(400)]
    alone, _, _ = counts(docs, (lm.COUNTED, lm.DELETED_PART))
    tested = (k for k in range(10_000, 30_000) if role(k) == lm.TESTED)
    known = sorted(w for w in alone if w != "$end ")
    ask = dict(zip(["", "never-seen", *known], tested, strict=False))
    got = {r.doc_id: 10**r.score for r in lm.score(spark.createDataFrame(docs + [(k, w) for w, k in ask.items()], "doc_id long, text string")).collect()}
    mass = sum(got[k] for k in ask.values())
    assert 0.3 < mass < 1 and got[ask["only3"]] > 100 * got[ask["never-seen"]]


def test_tables_without_training_and_without_rows(spark):
    tested = [k for k in range(200) if role(k) == lm.TESTED][:3]
    got = lm.score(spark.createDataFrame([(k, "a b") for k in tested], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(3, 0, 0, 0.0, 0.0)}
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    docs = [(k, "word " * 300_000 + "end") for k in range(3)] + [(9, "x" * 1_000_000)]
    close(rows(lm.score(spark.createDataFrame(docs, "doc_id long, text string"))), brute(docs))


def test_folds(spark):
    ids = [*range(500), None]
    got = spark.createDataFrame([(k,) for k in ids], "k long").select("k", lm.held_out(F.col("k")), lm.role(F.col("k"))).collect()
    assert all(h == (role(k) == lm.TESTED) and r == role(k) for k, h, r in got)
