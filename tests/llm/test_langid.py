import math
import os
import random
import zlib

import numpy as np
import pytest

from cohortal.llm import langid

SYLLABLES = {"aa": "ka ro mi ta su ne".split(), "bb": "sch ung ein lich öß ver".split(), "cc": "é oux tion aille ç que".split()}


def corpus(n=240):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 60)))
        rows.append((k, text, lang))
    return rows + [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "12 34 !!", "bb"), (n + 3, "ka ro", None), (n + 4, "karo " * 300_000, "aa")]


def test_held_out_accuracy_and_special_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "src", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.train_on(docs)
    got = {r.row.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [k for k, t, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2 and t and lang and any(c.isalpha() for c in t)]
    assert len(held) > 40 and np.mean([got[k].lang_pred == rows[k][2] for k in held]) >= 0.97
    for k in (240, 241, 242):
        assert (got[k].lang_pred, got[k].score, got[k].accepted) == ("und", 0.0, False)
    assert got[244].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].row.score == 1.0  # clashing names stay as they were


def test_held_out_rows_and_other_columns_do_not_teach(spark):
    rows = corpus()
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = spark.createDataFrame([(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows], "doc_id long, text string, lang string")
    a, b = langid.train_on(plain), langid.train_on(wrong)
    assert a.langs == b.langs and np.array_equal(a.centroids, b.centroids)


def test_rejection_is_by_distance(spark):
    model = langid.train_on(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "qxz jqx zzq xjq wwq"), (2, "karomi tasune karo")], "doc_id long, text string")
    assert {r.row.doc_id: r.accepted for r in langid.predict(odd, model).collect()} == {1: False, 2: True}


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    r = langid.predict(docs, langid.train_on(docs)).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identified(docs.limit(0)).count() == 0


def test_blocks_do_not_change_the_counts(monkeypatch):
    text = "Ünïcode text, with Words " * 40
    want = langid.trigrams(text.encode())
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.array_equal(langid.trigrams(text.encode()), want)


def plain_prediction(text, model):
    """A second reading: trigrams one by one, cosines by dictionaries."""
    folded = b" " + bytes((c | 32 if chr(c).isalpha() else 32) if c < 128 else c for c in text.encode()) + b" "
    counts = {}
    for k in range(len(folded) - 2):
        a, b, c = folded[k : k + 3]
        if not (a == 32 and b == 32):
            at = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20
            counts[at] = counts.get(at, 0) + 1
    weights = {at: math.log1p(n) * model.idf[at] for at, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    cosines = [sum(w * float(c[at]) for at, w in weights.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    return model.langs[best], cosines[best], cosines[best] >= model.radii[best] * langid.REACH


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
def test_predictions_equal_a_second_reading_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train_on(docs)
    rows = langid.predict(docs.select("doc_id", "text"), model).collect()
    for r in rows:
        lang, score, accepted = plain_prediction(r.row.text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4 and r.accepted == accepted
    known = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(known[r.row.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_many_languages(spark):
    rows = [(k, f"l{k % 1100}", f"word{k % 1100} " * 5) for k in range(2200)]
    model = langid.fit(spark.createDataFrame(rows, "key long, lang string, text string"), k=1)
    assert len(model.langs) == 1100 and model.centroids.shape == (1100, langid.DIMS)


def test_texts_of_no_language_are_rejected(spark):
    import base64
    import random

    rng = random.Random(2)
    train = [(k, lang, " ".join(rng.choice(words) for _ in range(60))) for k in range(120) for lang, words in (("en", "the of and to in that house people water".split()), ("fr", "le la des et dans que maison gens eau".split()))]
    model = langid.fit(spark.createDataFrame(train, "key long, lang string, text string"))
    odd = [base64.b64encode(rng.randbytes(300)).decode(), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(200)), "qzx jkv wxq zzk vvq " * 20, "0101 1111 a", "".join(chr(0x0400 + rng.randrange(250)) for _ in range(300))]
    got = langid.predict(spark.createDataFrame([(k, t) for k, t in enumerate([*odd, "the people of that house", "dans la maison"])], "doc_id long, text string"), model)
    assert {r.row.doc_id: r.accepted for r in got.collect()} == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True}
