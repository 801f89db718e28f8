import random

import numpy as np
import pytest
import sentencepiece

from cohortal.llm import spm

ODD = ["aaaa", "lolo", "  ", " ", "é", "梦", "the", "ing", "ation", "\n", "    ", "😀", "ab", "ness", "un", "\t", "=", "<s>", "\x00"]


@pytest.fixture(scope="module")
def codec():
    return spm.Codec(spm.model_bytes())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def texts(n, most=300):
    rng = random.Random(6)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, most))) for _ in range(n)]
    return out + [c * most for c in ("a", "é", " ", "lo", "=")] + ["x", " ", ""]


def test_words_equal_the_library(codec, library):
    some = texts(300)
    assert codec.encode([" " + t if t else "" for t in some]) == library.encode(some)
    assert [codec.decode(x)[1:] for x in library.encode(some)] == some


def test_scan_equals_the_library_at_any_cut(codec, library):
    for k, text in enumerate(texts(60)):
        full, n = " " + text, len(text) + 1
        if n < 40:
            continue
        size, margin, chunks = [23, 37, 64, 150][k % 4], codec.longest + 1, []
        for c in range((n - 1) // size + 1):
            start = max(0, c * size - margin)
            chunks.append(spm.Chunk(codec, full[start : start + size + 2 * margin], c * size - start, min(n, (c + 1) * size) - start, c == 0, n <= (c + 1) * size))
        states = spm.best_states([x.weights() for x in chunks])
        assert [i for c, x in enumerate(chunks) for i in x.ids(states[c], states[c + 1])] == library.encode(text)


def test_max_plus_tree_finds_the_best_way():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8, 13):
        sizes = [1, *rng.integers(1, 5, n - 1), 1] if n > 1 else [1, 1]
        ms = [rng.normal(size=(a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        states = spm.best_states(ms)
        score = sum(m[states[k], states[k + 1]] for k, m in enumerate(ms))
        total = ms[0]
        for m in ms[1:]:
            total = spm.max_plus(total, m)
        assert score == pytest.approx(total.max()) and len(states) == n + 1
    with pytest.raises(ValueError):
        spm.best_states([np.full((1, 1), -np.inf)])


def test_encode_and_decode_whole_documents(spark, library):
    rng = random.Random(9)
    long = ["".join(rng.choice(ODD) for _ in range(800)), "a" * 3000, " ".join("word%d" % rng.randrange(99) for _ in range(900))]
    rows = list(enumerate([*texts(20, 60), *long, None, "x ▁ y"])) + [(99, long[0])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, chunk int")
    got = spm.decode(spm.encode(docs, chunk=256)).orderBy("chunk").collect()
    for k, t in rows:
        own = [r for r in got if r.doc_id == k]
        assert [i for r in own for i in r.ids] == library.encode(t or "")
        assert "".join(r.piece for r in own) == (t or "").replace("▁", " ")
    assert max(r.chunk for r in got) > 5
    assert spm.encode(docs.limit(0)).count() == 0


def test_the_round_trip_in_one_pass_equals_both(spark):
    docs = spark.createDataFrame([*enumerate([*texts(30, 60), None])], "doc_id long, text string")
    both = spm.decode(spm.encode_short(docs)).collect()
    assert sorted(map(str, spm.encode_short(docs, decoded=True).collect())) == sorted(map(str, both)) and len(both) == docs.count()


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "some words here"), (1, "twice"), (1, "twice")], "doc_id long, text string")
    assert spm.encode(docs).count() == 3
    assert {r.chunk for r in spm.encode(docs, chunk=8).where("doc_id is null").collect()} == {0, 1}
    whole = spm.whole(spm.encode_long(docs, chunk=8), "ids")
    assert whole.count() == 1 and whole.first().doc_id is None


def test_repeated_rows_come_back_alike_at_every_length(spark, library):
    long = "some words of a longer text " * 3
    docs = spark.createDataFrame([(1, long), (1, long), (1, long[:-3]), (2, "short"), (2, "short"), (None, long), (None, long)], "doc_id long, text string")
    for chunk in (16, 10_000):
        rows = spm.encode(docs, chunk=chunk)
        got = spm.whole(rows, "ids") if chunk == 16 else rows
        flat = lambda ids: tuple(x for part in ids for x in part) if chunk == 16 else tuple(ids)
        longer = sorted(((r.doc_id or 0, flat(r.ids)) for r in got.where("doc_id is null or doc_id = 1").collect()))
        want = [(0, long), (0, long), (1, long), (1, long), (1, long[:-3])]
        assert longer == sorted((k, tuple(library.encode(t))) for k, t in want)
        assert rows.where("doc_id = 2").count() == 2
