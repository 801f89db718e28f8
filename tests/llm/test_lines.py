import random

from cohortal.llm import linededup


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute(docs, least=1):
    """Texts after dedup, by doc_id; ids are unique."""
    first = {}
    for d, text in sorted((d, t) for d, t in docs if t is not None):
        for n, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (d, n))
    gone = {x for x in first if len(x) >= least for y in first if len(y) >= least and first[y] < first[x] and within_one_edit(x, y)}
    out = {}
    for d, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = [x for n, x in enumerate(lines) if not x.strip(" ") or (first[x] == (d, n) and x not in gone)]
        out[d] = (len(lines), len(kept), None if text is None else "\n".join(kept))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé ß") for _ in range(rng.choice([1, 4, 9, 10, 11, 60, 130, 300])))
    lines = [word() for _ in range(60)] + ["x" * 700, "ab" * 4000]
    for line in list(lines):
        for _ in range(rng.choice([0, 1, 2, 3])):
            k = rng.randrange(len(line) + 1)
            lines.append(rng.choice([line[:k] + "z" + line[k:], line[:k] + line[k + 1 :], line[:k] + "q" + line[k + 1 :], line[:k] + "zz" + line[k:], line]))
    docs = [(k, "\n".join(rng.choice(lines + [""]) for _ in range(rng.randrange(1, 9)))) for k in range(90)]
    return docs + [(90, None), (91, ""), (92, "\n\n"), (93, docs[5][1])]


def test_equals_brute_force(spark):
    docs = corpus()
    rng = random.Random(1)
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, lines string, place int")
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in linededup.dedup_lines(df).collect()}
    want = brute(docs)
    assert got == want
    assert any(n != k for n, k, _ in want.values())
    spared = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in linededup.dedup_lines(df, min_near_chars=10).collect()}
    assert spared == brute(docs, 10) != want


def test_short_lines(spark):
    df = spark.createDataFrame([(1, "hello you"), (2, "hello yow\nab"), (3, "a\nc\nabc\nxyz")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert got == {1: "hello you", 2: "ab", 3: "xyz"}


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "same line of text"), (1, "same line of text"), (None, "same line of text"), (2, "same line of text")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_kept) for r in linededup.dedup_lines(df).collect()) == [(0, 1), (1, 0), (1, 0), (2, 0)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_drops_emptied_documents(spark):
    df = spark.createDataFrame([(1, "a line to keep\nown", "s"), (2, "a line to keep", "s"), (3, "", "s"), (4, None, "s")], "doc_id long, text string, source string")
    out = linededup.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a line to keep\nown", 3: "", 4: None}
