import itertools
import random
from collections import defaultdict

import numpy as np
from regex import findall

from cohortal.llm import decontam


def words(t):
    return tuple(findall(r"[\p{L}\p{N}]+", (t or "").lower()))


def brute(docs, items):
    """{doc: (items found, best score)} by laying every item at every offset that shares a token."""
    items = {w for w in map(words, items) if len(w) >= 5}
    out = {}
    for d, text in docs:
        at = defaultdict(list)
        for i, w in enumerate(words(text)):
            at[w].append(i)
        n = best = 0
        for item in items:
            lined = defaultdict(set)
            for j, w in enumerate(item):
                for i in at[w]:
                    lined[i - j].add(j)
            top = 0
            for hits in lined.values():
                now = 0
                for j in range(len(item)):
                    now = max(0, now + (1 if j in hits else -2))
                    top = max(top, now)
            if top >= min(13, len(item)):
                n, best = n + 1, max(best, top)
        out[d] = (n, best)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)] + ["Über", "été", "a1"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(text(n)) for n in (40, 60, 25, 14, 13, 12, 9, 6, 5, 4, 2)] + [None, ""]
    docs = []
    for k, item in enumerate(items[:11] * 4):
        w = item.split()
        if k >= 11 and len(w) > 20:
            w[rng.randrange(5, len(w) - 5)] = "changed"
        if k >= 22 and len(w) > 30:
            w = w[3:-3]
        docs.append((k, " ".join(text(30)) + " " + ", ".join(w).upper() + ".\n" + " ".join(text(rng.randrange(40)))))
    docs += [(100, None), (101, ""), (102, "w1"), (103, " ".join(text(5000))), (104, items[0])]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, item string, seed int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.best_overlap) for r in decontam.decontaminate(df, bench).select("row.doc_id", "n_items", "best_overlap").collect()}
    want = brute(docs, items)
    assert got == want
    assert sum(n > 0 for n, _ in want.values()) > 25 and want[103] == (0, 0)


def test_stage_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two three four five six", "s"), (2, "clean", "s"), (2, "clean", "s")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(0, "Two, three four five six!"), (1, "Two, three four five six!")], "item_id long, text string")
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert decontam.without_leaks(df, bench.limit(0)).count() == 3 and decontam.without_leaks(df.limit(0), bench).count() == 0


def test_join_beyond_the_broadcast_bound_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(30))), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(f"t{k}" for k in range(5, 25)))], "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.best_overlap for r in decontam.decontaminate(df, bench).select("row.doc_id", "best_overlap").collect()} == {1: 20, 2: 0}


def test_masks_hit_every_stretch_with_up_to_six_substitutions():
    kept = [sum(1 << k for k in mask) for mask in decontam.MASKS]
    assert all(mask[0] == 0 and mask[-1] < decontam.SPAN for mask in decontam.MASKS)
    for changed in range(7):
        length = decontam.MIN_OVERLAP + changed - decontam.MISMATCH * changed
        left = np.array([sum(1 << k for k in places) for places in itertools.combinations(range(length), changed)], np.int64)
        for mask in kept:
            for start in range(length - mask.bit_length() + 1):
                left = left[(left >> start & mask) != 0]
        assert not len(left)


def test_share_of_heavily_substituted_stretches_that_the_masks_hit():
    rng, kept = random.Random(8), [sum(1 << k for k in mask) for mask in decontam.MASKS]
    for changed in (8, 10, 15):
        length, hit = decontam.MIN_OVERLAP + 3 * changed, 0
        for _ in range(4000):
            bits = sum(1 << k for k in rng.sample(range(length), changed))
            hit += any(bits >> start & mask == 0 for mask in kept for start in range(length - mask.bit_length() + 1))
        assert hit / 4000 > 0.999


def test_long_substituted_passages(spark):
    words = [f"q{k}" for k in range(60)]
    changed = lambda places: " ".join("other" if k in places else w for k, w in enumerate(words))
    rng = random.Random(3)
    docs = [(k, "before it " + changed(set(rng.sample(range(60), k))) + " and behind") for k in range(12)]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(words))], "item_id long, text string"))
    assert {r.doc_id: (r.n_items, r.best_overlap) for r in got.select("row.doc_id", "n_items", "best_overlap").collect()} == brute(docs, [" ".join(words)])


def test_a_very_long_text_and_repeated_words(spark):
    item = " ".join(f"z{k}" for k in range(30))
    docs = [(1, "word " * 30_000 + item), (2, "word " * 30_000)]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item), (1, "word " * 40)], "item_id long, text string"))
    assert {r.doc_id: (r.n_items, r.best_overlap) for r in got.select("row.doc_id", "n_items", "best_overlap").collect()} == {1: (2, 40), 2: (1, 40)}
