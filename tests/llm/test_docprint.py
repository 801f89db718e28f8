import hashlib
import random

import numpy as np
import pytest

from cohortal.llm import docprint


def made(text):
    walker = docprint.Walker()
    points = docprint.code_points(text)
    return docprint.Print(points, *walker.walk(points))


def naive_walk(text):
    """The walk, one step at a time: at each the character is written, and the table says when it is left."""
    tables, out, j = docprint.walk_tables(), [], 0
    for p in docprint.code_points(text).tolist():
        kind = int(docprint._mix(np.array([p], np.uint64) * docprint._A)[0] >> np.uint64(60))
        out.append(j)
        j += tables[kind][j % docprint.PERIOD] - j % docprint.PERIOD
    return out, j


def test_walk_in_blocks_equals_the_naive_walk():
    rng = random.Random(0)
    text = "".join(rng.choice("abcdefgh é梦") for _ in range(40_000))
    reached, end = docprint.Walker().walk(docprint.code_points(text))
    want, stop = naive_walk(text)
    assert reached.tolist() == want and end == stop
    half, at = docprint.Walker().walk(docprint.code_points(text[:15_000]))
    rest, stop = docprint.Walker().walk(docprint.code_points(text[15_000:]), at)
    assert np.concatenate([half, rest]).tolist() == want and stop == end


@pytest.mark.parametrize("n", [300, 5000, 60_000])
def test_likeness_follows_edits(n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    other = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    edits = list(text)
    for _ in range(max(1, n // 3000)):  # indels cost their square in the embedding
        k = rng.randrange(n)
        edits[k : k + 1] = rng.choice([[], ["x"], ["y", edits[k]]])
    a, b, c = made(text), made("".join(edits)), made(other)
    assert a.like(a) == 1 and a.like(c) < 0.25 and a.like(b) > a.like(c) + 0.3
    assert a.like(b) == b.like(a)
    assert made(text[: 3 * n // 4] + other[3 * n // 4 :]).like(a) == pytest.approx(0.75, abs=0.12)
    assert len(a.bits) <= docprint.MOST_BITS


def test_query_columns_by_definition(spark):
    rng = random.Random(1)
    docs = [(k * 7, "".join(rng.choice("abcd é\n") for _ in range(rng.choice([0, 1, 3, 5, 40, 900, 20_000])))) for k in range(60)]
    docs += [(500, None), (501, docs[3][1]), (-4, "ünd")]
    shuffled = docs[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(d, t, 5) for d, t in shuffled], "doc_id long, text string, bucket int")
    got = {r.doc_id: r for r in docprint.fingerprints(df).collect()}
    docs.sort()
    for k, (d, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (str(made(text)), str(made(edited)))
        assert r.near_edited == pytest.approx(made(text).like(made(edited))) and r.near_next == pytest.approx(made(text).like(made(after)))
    assert len(got) == len(docs) and got[501].fingerprint == str(made(docs[4][1] or ""))


def test_small_tables(spark):
    df = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    r = docprint.fingerprints(df).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert docprint.fingerprints(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "b" * 8), (1, "a" * 8), (None, "c" * 8)], "doc_id long, text string")
    got = {(r.doc_id, r.edited_sha256) for r in docprint.fingerprints(twice).collect()}
    assert got == {(d, hashlib.sha256((x * 6 + y * 2).encode()).hexdigest()) for d, x, y in [(None, "c", "a"), (1, "a", "b"), (1, "b", "c")]}


@pytest.mark.parametrize("tile_rows", [512, 3])
def test_near_classes_equal_brute_force(spark, tile_rows):
    rng = random.Random(4)
    texts = [None, "", "tiny", "tiny"]
    for _ in range(12):
        base = "".join(rng.choice("abcdefghijklm ") for _ in range(rng.choice([200, 800, 3000])))
        for _ in range(5):
            k = rng.randrange(len(base) - 20)
            texts.append(base[:k] + "changed!" + base[k + 8 :])
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, level int")
    got = {r.doc_id: r.class_id for r in docprint.near_classes(docs, tile_rows=tile_rows).collect()}
    prints, group = [made(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (str(prints[i]) == str(prints[j]) or prints[i].like(prints[j]) >= 0.8 and min(len(prints[i].bits), len(prints[j].bits)) >= 32):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    found = sum(got[i] == group[i] for i in range(len(texts)))
    assert found >= 0.97 * len(texts) and all(got[i] >= group[i] for i in range(len(texts)))
    assert len(set(group)) < 30 and docprint.near_classes(docs.limit(0)).count() == 0
