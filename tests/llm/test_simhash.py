import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortal.llm import graph, simhash


def brute(texts, width=3):
    """(fingerprints, components) by the definition."""
    fps = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return fps, group


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(5)) for _ in range(300)]
    out = [None, "", " \n\t", "one", "One two", "one two"]
    for _ in range(15):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 200, 400]))]
        out.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocabulary).upper()
            out.append(" ".join(near[:2]) + "\r\n" + " ".join(near[2:]))
    return out + out[6:12] + ["word " * 70_000]


@pytest.mark.parametrize("tile_rows", [4096, 3])
def test_equals_brute_force(spark, tile_rows):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, tile_rows=tile_rows).collect()}
    fps, group = brute(texts)
    assert got == {k: (f"{fps[k]:016x}", group[k]) for k in range(len(texts))}
    assert len(set(group)) < len(group) - 8


def test_every_pair_within_reach_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 2**32))
        y = x ^ (1 << int(rng.integers(0, 32))) if rng.random() < 0.8 else x
        index, anchor, home = simhash.anchors_of(np.array([x, y], np.uint64))
        of = lambda k: set(anchor[index == k].tolist())
        assert {a for a, k, h in zip(anchor, index, home, strict=True) if k == 0 and h} <= of(1)
        assert len(of(0)) <= 17 and all((a ^ x).bit_count() <= 2 for a in of(0))


def test_forest_spans_links_with_few_edges():
    fp = np.array([0, 1, 3, 7, 15 << 56, (15 << 56) | 1], np.uint64)
    assert len(simhash.forest(np.zeros(6, int), fp)) == 4
    assert simhash.forest(np.arange(6), fp) == []


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (2, "other words in here", "z"), (2, "other words in here", "z")], "doc_id long, text string, source string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_no_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "only null")], "doc_id long, text string")
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect()) == [(0, 0), (0, 4), (4, 4)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 60)]
    group = {n: n for e in edges for n in e}
    for a, b in edges * 60:
        group[a] = group[b] = min(group[a], group[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: group[n] for n in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_ids_keep_one_of_each_group(spark):
    rows = [(None, "only null words here"), (None, "only null words here"), (1, "a b c d"), (2, "A b c d"), (2, "unique text of its own"), (None, "a b c D"), (3, "x y z w"), (3, "q r s t")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "only null words here"), (1, "a b c d"), (2, "unique text of its own"), (3, "q r s t"), (3, "x y z w")]


def test_crowded_anchors_lose_no_link(spark):
    """Fingerprints around a few centres, so that anchors hold more points than a tile."""
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(3)] + [rng.getrandbits(32) for _ in range(2)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centres for _ in range(150)}
    fps |= {centres[0] ^ (rng.getrandbits(32) << 32) for _ in range(150)} | {centres[1] ^ rng.getrandbits(32) for _ in range(150)}
    fps = sorted(fps)
    points = spark.createDataFrame([(k, fp - 2**64 if fp >= 2**63 else fp) for k, fp in enumerate(fps)], "doc long, fp long")
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    for tile_rows in (8, 4096):
        found = graph.connected_components(simhash.links(points, tile_rows).select("a.doc", F.col("b.doc").alias("other")), "doc", "other")
        got = {r.node: r.root for r in found.collect()}
        assert {k: got.get(k, k) for k in range(len(fps))} == dict(enumerate(group)) and len(set(group)) < len(fps)
