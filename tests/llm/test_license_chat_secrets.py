import json
import math
import os
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortal.llm import chat, license, secrets

DATA = "/root/testdata/sf0.01"
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
APACHE, GPL = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def test_license_and_inheritance(spark):
    prose = "Some code is here and it is long enough to be no license file at all, as it has many other words in it."
    rows = [
        (1, "a/LICENSE", APACHE), (2, "a/b/c/x.py", prose), (3, "a/b/y.py", f"{prose}\n{GPL}\n{prose}"), (4, "z.txt", prose), (5, "a/b/COPYING", GPL),
        (6, "a/b/c/null", None), (7, "d/e", ""), (8, "a/w", f"{prose} Released under the MIT License. {GPL}"), (2, "a/b/c/x.py", prose), (9, None, GPL), (10, "d/q", "licensed to do other things altogether and so on"),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], "file long, path string, text string, license string")
    got = {r.file: r for r in license.scan(df).collect()}
    short = {k: (r.license, r.origin, r.origin_dir) for k, r in got.items()}
    assert short == {
        1: ("Apache-2.0", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", ""),
        5: ("GPL-3.0", "own", None), 6: ("GPL-3.0", "inherited", "a/b"), 7: ("GPL-3.0", "inherited", ""), 8: ("GPL-3.0", "own", None),
        9: ("GPL-3.0", "own", None), 10: ("GPL-3.0", "inherited", ""),
    }
    assert got[8].licenses == ["GPL-3.0", "MIT"]
    assert license.scan(df.where("file in (4, 7)")).select("origin").distinct().first().origin == "none"
    assert license.scan(df.limit(0)).count() == 0


def test_identifier_lines_headings_and_wrapped_notices(spark):
    rows = [
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport x"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0 */"), ("MIT", "// SPDX-License-Identifier: MIT"), ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
        ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright someone"), ("Apache-2.0", "  Apache License\n  Version 2.0, January 2004\n  http://x"),
        ("MIT", " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
        (None, "SPDX-License-Identifier: EUPL-1.2"), (None, "the license of the driver is checked at the border"), ("MIT", "words " * 40_000 + "\nReleased under the terms of the MIT License.\n" + "words " * 40_000),
    ]
    got = {r.file: r.license for r in license.scan(spark.createDataFrame([(k, f"d{k}/f", t) for k, (_, t) in enumerate(rows)], "file long, path string, text string")).collect()}
    assert got == {k: want for k, (want, _) in enumerate(rows)}


def plain_licenses(text):
    """Best license and score of a text by dense vectors over every line and sentence."""
    rows, idf = license.weights()
    vectors = {}
    for name, k, term, w in rows:
        vectors.setdefault((name, k), {})[term] = w
    lines = text.split("\n")
    joined = [" ".join(x.strip(" \t*#;/").strip() if k else x for k, x in enumerate(p.split("\n"))) for p in re.split(r"\n[ \t]*\n", text)]
    best = (0.0, "")
    for part in [s for x in lines + joined for s in re.split(r"(?<=[.!?])\s+", x)]:
        if not re.search(r"(?i)licen[cs]e|public domain|all rights reserved|permission is hereby|redistribution and use", part):
            continue
        counts = Counter(re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", part.lower()))
        norm = math.sqrt(sum((n * idf.get(t, idf[None])) ** 2 for t, n in counts.items()))
        for (name, _), v in vectors.items():
            score = sum(n * idf.get(t, idf[None]) * v.get(t, 0) for t, n in counts.items()) / norm
            best = max(best, (round(score, 6), name))
    return best if best[0] >= 0.6 else (None, None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_the_whole_table_against_a_dense_reading(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("file"), F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), "text")
    got = {r.file: (r.score, r.license) for r in license.scan(docs).where("origin = 'own'").collect()}
    want = {r.file: plain_licenses(r.text or "") for r in docs.collect()}
    assert got == {k: v for k, v in want.items() if v[1]} and len(got) > 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_planted_licenses_and_secrets_are_found(spark, labelled):
    """By plain searches for the forms in which the tables hold them; recall of 0.9 at least, and no other finding among clean documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    lines = {r.doc_id for r in rows if any(re.fullmatch(r"(This work is licensed|Licensed) under [^.]*(\.\d)?[^.]*\.", x.strip()) for x in (r.text or "").split("\n"))}
    own = {r.file for r in license.scan(docs.select(F.col("doc_id").alias("file"), F.lit("a/b").alias("path"), "text")).where("origin = 'own'").select("file").collect()}
    assert lines and len(lines & own) >= 0.9 * len(lines)
    planted = {(r.doc_id, m) for r in rows for m in re.findall(r'token = "([0-9a-f]{40})"|\b(AKIA[A-Z0-9]{16})\b', r.text or "") for m in m if m}
    found = {(r.doc_id, r.value) for r in secrets.scan(docs.select("doc_id", F.col("source").alias("path"), "text"), secrets.labelled_findings(spark)).where("kept").collect()}
    assert planted and len(planted & found) >= 0.9 * len(planted) and len(found - planted) <= 0.1 * len(found)


def test_cosines_equal_a_dense_reading(spark):
    rows, idf = license.weights()
    text = "Licensed under the GNU Lesser General Public License, version 3 or later."
    counts = Counter(license._terms(text))
    vector = {t: n * idf.get(t, idf[None]) for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in vector.values()))
    dots = Counter()
    for name, k, term, w in rows:
        dots[name, k] += vector.get(term, 0) * w / norm
    (name, _), score = dots.most_common(1)[0]
    got = license.own_licenses(spark.createDataFrame([(1, "p", text)], "file long, path string, text string")).first()
    assert got.license == name == "LGPL-3.0" and got.score == pytest.approx(score, abs=1e-6)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(-1e6, 1e6) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(json_values)
def test_canonical_json(value):
    text = chat.canonical(value)
    assert json.loads(text) == value and chat.canonical(json.loads(text)) == text


def test_schema_violations():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}}
    assert chat.violations({"a": 1, "b": [1, 2]}, schema) == []
    assert chat.violations({"a": 1.5, "b": [3, 1, 1], "c": 0}, schema) == ["$.a: type", "$.b[0]: enum", "$.b: maxItems", "$.c: unknown"]
    assert chat.violations({"a": -1}, schema) == ["$.a: minimum"] and chat.violations({}, schema) == ["$.a: required"] and chat.violations([], schema) == ["$: type"]
    assert chat.violations({"a": True}, schema) == ["$.a: type"]


def test_linking(spark):
    calls = [
        (1, "a", 0, "f", '{"x": 1}', []), (1, "b", 2, "f", '{"x": 2.0}', ["a"]), (1, "c", 4, "f", '{"x": 3}', ["b", "a", "gone"]), (1, "p", 1, "f", '{"x": 3}', ["q"]), (1, "q", 1, "f", '{"x": 3}', ["p"]),
        (1, "bad", 1, "f", "{", None), (1, "odd", 1, "g", "{}", None), (1, "no", 1, "f", None, None), (1, "b", 3, "f", '{"x": 9}', []), (2, "a", 5, "f", '{"x": 1}', None), (3, None, 1, "f", '{"x": 1}', None), (4, "w", 0, "f", '{"x": 1}', None),
    ]
    results = [(1, "a", 1, "ra"), (1, "b", 3, "rb"), (1, "b", 9, "later"), (2, "a", 1, "early"), (1, "zz", 7, "alone"), (1, "p", 3, "r"), (1, "c", 5, 'r"é')]
    c = spark.createDataFrame([(*r, 1) for r in calls], "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>, level int")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    rows = chat.link(c, r, {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()
    more = sorted((x.call_id, x.turn, x.json) for x in rows if x.status == "duplicate")
    assert more == [("b", 3, '{"arguments":{"x":9},"call":"b","name":"f"}'), ("b", 9, '{"call":"b","result":"later"}')]
    got = {(x.conv_id, x.call_id): x for x in rows if x.status != "duplicate"}
    assert {k: (x.status, x.level) for k, x in got.items()} == {
        (1, "a"): ("linked", 0), (1, "b"): ("linked", 1), (1, "c"): ("linked", 2), (1, "p"): ("cyclic", None), (1, "q"): ("cyclic", None), (1, "bad"): ("invalid", 0),
        (1, "odd"): ("invalid", 0), (1, "no"): ("invalid", 0), (2, "a"): ("early", 0), (3, None): ("pending", 0), (4, "w"): ("pending", 0), (1, "zz"): ("orphan", None),
    }
    assert got[1, "b"].json == '{"arguments":{"x":2},"call":"b","name":"f","result":"rb"}'
    assert got[1, "c"].json == '{"arguments":{"x":3},"call":"c","name":"f","result":"r\\"é"}'
    assert chat.link(c.limit(0), r.limit(0), {}).count() == 0


def test_arguments_that_json_cannot_hold_are_invalid(spark):
    kinds = {"i": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    odd = ['{"x": 1e400}', '{"x": "\\ud800"}', "[" * 3000 + "]" * 3000, '{"x": NaN}', "[" * 200_000, '{"x": ' + "7" * 5000 + "}", "\ufeff{}"]
    fine = ['{"x": ' + "7" * 400 + "}", '{"x": -0.0}', '{"x": 1e300}', '{"t": "' + "long " * 60_000 + '"}']
    big = 2**60 + 1
    rows = [(big, f"c{k}", big + 2 * k, "i", text, None) for k, text in enumerate(odd + fine)] + [(big, None, None, "i", "{}", None), (None, "n", big, "i", "{}", None)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>")
    results = spark.createDataFrame([(big, "c7", big, "r"), (big, "c7", big, "r"), (big, "c7", big, "r"), (None, None, None, None)], "conv_id long, call_id string, turn long, content string")
    got = chat.link(calls, results, kinds).collect()
    by_call = {r.call_id: r for r in got if r.status not in ("duplicate", "orphan")}
    assert {k for k, r in by_call.items() if r.status == "invalid"} == {f"c{k}" for k in range(len(odd))} and len(by_call) == len(rows)
    assert by_call["c0"].json == '{"call":"c0","name":"i"}' and "7" * 400 in by_call["c7"].json and '"x":0}' in by_call["c8"].json
    assert by_call["c1"].turn == big + 2 and by_call["c1"].conv_id == big and by_call[None].turn is None and by_call["n"].conv_id is None
    assert [r.turn for r in got if r.status == "duplicate"] == [big, big] and sum(r.status == "orphan" for r in got) == 1


def test_levels_equal_a_sequential_reading(spark):
    import random

    rng, rows = random.Random(3), []
    for conv in range(4):
        names = [f"c{k}" for k in range(70)]
        for k, name in enumerate(names):
            refs = [] if k == 0 else [names[k - 1]] if conv == 0 else rng.sample(names[:k], min(k, rng.choice([0, 1, 1, 2, 3])))
            rows.append((conv, name, refs if conv != 3 or k != 20 else [names[40], names[1]]))
    rows += [(9, "a", ["b"]), (9, "b", ["c"]), (9, "c", ["b"]), (9, "self", ["self"]), (9, "alone", None)]
    want, known = {}, {(c, n): [r for r in refs or [] if any(x[0] == c and x[1] == r for x in rows)] for c, n, refs in rows}
    for _ in range(200):
        for (c, n), refs in known.items():
            if all((c, r) in want for r in refs):
                want[c, n] = max((want[c, r] + 1 for r in refs), default=0)
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, refs array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls).collect()}
    assert got == {k: want.get(k) for k in known} and got[0, "c69"] == 69 and got[9, "a"] is None
    assert {(r.conv_id, r.call_id): r.level for r in chat.levels(calls, local_refs=80).collect()} == got


def test_many_levels_among_calls_with_several_references(spark):
    rows = [(1, f"c{k}", [f"c{k - 1}", f"c{k - 2}"][: min(k, 2)]) for k in range(3000)]
    got = {r.call_id: r.level for r in chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, refs array<string>")).collect()}
    assert got == {f"c{k}": k for k in range(3000)}


def test_plain_conversations(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (2, 0, "system", "s"), (2, 1, "user", ""), (2, 2, "assistant", None), (None, 0, "user", "x")]
    calls, results = chat.as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.call_id): (r.status, r.level) for r in chat.link(calls, results, chat.RESPOND).collect()}
    assert got == {(1, "t0"): ("linked", 0), (1, "t2"): ("pending", 1), (2, "t1"): ("invalid", 0)}


@pytest.fixture(scope="module")
def labelled(spark):
    return secrets.labelled_findings(spark, 1600).cache()


def test_the_written_forest_equals_the_model(spark, labelled):
    """The trees as SQL against the votes of the fitted model's own trees."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=secrets.FEATURES, outputCol="x").transform(secrets.features(labelled).withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=secrets.TREES, maxDepth=secrets.DEPTH, seed=secrets.SEED).fit(rows)
    both = forest.transform(rows).select(vector_to_array("probability")[1].alias("p"), secrets.train(labelled).alias("q"))
    off = both.agg(F.max(F.abs(F.col("p") - F.col("q"))), F.count_distinct("p")).first()
    assert off[0] < 1e-9 and off[1] > 3


def test_forest_on_held_out_findings(spark, labelled):
    held = F.pmod(F.xxhash64("value"), F.lit(4)) == 0
    p = secrets.train(labelled.where(~held), trees=12)
    r = secrets.features(labelled.where(held)).select(((p >= 0.5).cast("int") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert r[0] >= 0.97 and r[1] > 250


def test_scan(spark, labelled):
    key = "AKIA" + "QWERTYUIOPASDFG7"
    rows = [
        (1, "src", f"some words {key} more"), (2, "src", "x\npassword=b7db7aa4a5fcc78305 tail"), (3, "src", 'set token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" here'),
        (4, "src", "commit 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae fixed"), (5, "src", "plain words of no interest whatsoever"), (6, None, None), (7, "src", ""), (8, "src", "password=changeme123"), (2, "src", "x\npassword=b7db7aa4a5fcc78305 tail"),
    ]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, path string, text string, value string")
    got = [(r.doc_id, r.line_no, r.rule, r.kept) for r in secrets.scan(docs, labelled).collect()]
    assert sorted(got) == [(1, 0, "access key", True), (2, 1, "assignment", True), (2, 1, "assignment", True), (3, 0, "assignment", True), (4, 0, "mixed string", False), (8, 0, "assignment", False)]
    assert secrets.scan(docs.limit(0), labelled).count() == 0


def test_one_label_or_none(spark, labelled):
    p = lambda rows: secrets.features(rows.limit(1)).select(secrets.train(rows)).first()[0]
    assert p(labelled.where("label = 0")) == 0.0
    assert secrets.features(labelled.limit(1)).select(secrets.train(labelled.limit(0))).first()[0] == 1.0


def test_every_secret_of_a_token_is_a_candidate(spark):
    one, two = "AKIA" + "QWERTYUIOPASDFG7", "AKIA" + "ZXCVBNMASDFGHJ42"
    rows = [
        ('{"user":"bob","password":"hunter2abc9"}', ["hunter2abc9"]),
        ("https://x.io/?user=bob&token=Zx81kQpLw93", ["Zx81kQpLw93"]),
        ('{"password":"hunter2abc9","api_key":"Zx81kQpLw93"}', ["Zx81kQpLw93", "hunter2abc9"]),
        (f"{one},{two}", [one, two]),
        ('{"a":{"user":"bob","db_password":"hunter2abc9"}}', ["hunter2abc9"]),
        ("x password=ab,cdefgh12 y", ["cdefgh12"]),
        ("token={abcd12345} y", ["abcd12345"]),
        (f"see {JWT} there", [JWT]),
        (f"Authorization: Bearer {JWT},{JWT}", [JWT, JWT]),
    ]
    docs = spark.createDataFrame([(k, "src", t) for k, (t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {k: [] for k in range(len(rows))}
    for r in secrets.candidates(docs).collect():
        got[r.doc_id].append(r.value)
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in enumerate(rows)}
