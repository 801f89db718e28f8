import os
import random
import re

import pytest

import corpus_pipeline
from cohortal.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


def test_stages_and_result_against_plain_versions(spark, tmp_path):
    """Each stage against a plain reading of its own input."""
    import sentencepiece

    from cohortal.llm import spm
    from tests.llm.test_decontam import brute as leaks
    from tests.llm.test_lines import brute as lines
    from tests.llm.test_simhash import brute as near

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, DATA).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append([r.asDict() for r in before.collect()])
        assert name == "sentencepiece" or docs.columns == before.columns
    given, known, unique, distinct, clean = seen
    assert len(known) >= 0.98 * len(given)
    want, full = lines([(r["doc_id"], r["text"]) for r in known], corpus_pipeline.NEAR_LINE_CHARS), {r["doc_id"]: r["text"] for r in known}
    visible = lambda t: len("".join(re.split(r"[ \t\n\x0b\f\r]+", t or "")))
    stays = lambda d, n, k, t: k and (k == n or visible(t) >= corpus_pipeline.LEAST_NEW * visible(full[d]))
    assert {r["doc_id"]: r["text"] for r in unique} == {d: t for d, (n, k, t) in want.items() if stays(d, n, k, t)}
    fps, group = near([r["text"] for r in sorted(unique, key=lambda r: r["doc_id"])], 5)
    ids = sorted(r["doc_id"] for r in unique)
    assert {r["doc_id"] for r in distinct} == {ids[g] for g in group}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = leaks([(r["doc_id"], r["text"]) for r in distinct], items)
    assert {r["doc_id"] for r in clean} == {d for d, (n, _) in found.items() if not n}
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    ends = {r.doc_id: list(r.ids) for r in docs.collect()}
    assert ends == {r["doc_id"]: library.encode(r["text"]) for r in clean}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()} == ends


def test_near_copies_go_and_leave_no_fragments(spark):
    """Copies with a similarity of 0.8 or more in runs of five words: nine in ten go at least, and nothing of them is left; all originals stay as they were."""
    rng, docs, copies = random.Random(12), {}, {}
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(3000)]
    for k in range(60):
        lines = [rng.choices(vocabulary, k=12) for _ in range(rng.randrange(8, 20))]
        docs[k] = "\n".join(map(" ".join, lines))
        for c in range(2):
            changed = [list(x) for x in lines]
            for _ in range(1 + c):
                changed[rng.randrange(len(changed))][rng.randrange(12)] = rng.choice(vocabulary)
            copies[1000 + 2 * k + c] = (k, "\n".join(map(" ".join, changed)))
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    alike = {c for c, (k, t) in copies.items() if len(runs(t) & runs(docs[k])) >= 0.8 * len(runs(t) | runs(docs[k]))}
    rows = [*docs.items(), *((c, t) for c, (_, t) in copies.items())]
    df = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, DATA)
    left = {r.doc_id: r.text for r in df.collect()}
    assert len(alike) > 80 and len(alike - left.keys()) >= 0.9 * len(alike)
    assert {d: left[d] for d in docs} == docs and all(t == copies[d][1] for d, t in left.items() if d in copies)


def test_a_table_without_languages_passes(spark):
    plain = [(1, "no language is known here", None, "s", 25), (2, "1234", None, "s", 4), (3, None, None, "s", None)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, DATA).count() == 3
    assert corpus_pipeline.language_id(spark, docs.drop("lang"), DATA).count() == 3


def test_every_stage_on_null_ids_equal_ids_null_and_empty_texts(spark, tmp_path):
    """Rows are told apart by id and text; a stage takes away what its rule says and nothing else."""
    words = {"en": "the house and the garden of the old man were near the river and the people", "fr": "la maison et le jardin du vieil homme sont pres de la riviere et les gens"}
    train = [(k, f"{words[lang]} {k}", lang, "s", 60) for k, lang in enumerate(["en", "fr"] * 60)]
    odd = [
        (None, "the old house near the river was empty and the people of the garden left", "en", "s", 1), (None, "les gens de la maison et du jardin sont pres du vieil homme", None, None, None),
        (500, "the man and the people of the house in the garden by the river", "en", "s", 1), (500, "le vieil homme et la riviere et les gens de la maison", "fr", "s", 1),
        (501, None, "en", "s", 1), (502, "", "en", "s", 1), (503, "1234 5678", None, "s", 1), (504, "the people and the old man " * 20_000, "en", "s", 1),
    ]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, source string, n_chars long")
    ask = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1), (r.text or "")[:30]) for r in df.where("doc_id is null or doc_id >= 500").collect())
    whole = [(d if d is not None else -1, t[:30]) for d, t, *_ in odd if t and d != 503]
    named = corpus_pipeline.language_id(spark, docs, DATA)
    assert named.columns == docs.columns and ask(named) == sorted(whole)
    lines = corpus_pipeline.line_dedup(spark, docs, DATA)
    assert lines.columns == docs.columns and ask(lines) == sorted([*whole, (501, ""), (502, ""), (503, "1234 5678")])
    assert {r.doc_id: r.n_chars for r in lines.where("doc_id in (501, 502, 503)").collect()} == {501: None, 502: 0, 503: 9}
    near = corpus_pipeline.near_dedup(spark, docs.where("doc_id is null or doc_id >= 500"), DATA)
    assert near.columns == docs.columns and ask(near) == sorted([*whole, (501, ""), (503, "1234 5678")])  # a null and an empty text are one
    clean = corpus_pipeline.decontamination(spark, docs, DATA)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    ids = corpus_pipeline.sentencepiece(spark, docs, DATA)
    assert ids.count() == docs.count() and ids.where("doc_id is null").count() == 2 and {r.n_ids for r in ids.where("doc_id in (501, 502)").collect()} == {0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_registry():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    key = lambda names, rows: sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert key(df.columns, df.collect()) == key(want.columns, want.fetchall())
