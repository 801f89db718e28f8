import itertools
import re

from cohortal.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, smaller):
    words = WORD.findall(text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": smaller,
    }


def brute(docs, labels):
    """{(part, order, step): counts} one document and order after the other."""
    out = {}
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    orders = ["".join(x) for x in itertools.permutations("ABCDE")]
    for d, text, lang in docs:
        text = text or ""
        f = fails(text, any((other or "") == text and e is not None and d is not None and e < d for e, other, _ in docs))
        for order in orders:
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((lang or "", order, step), [0] * 6)
                removed = f[x] and not gone
                row[2] += f[x] and gone
                gone |= f[x]
                row[0] += not gone
                row[1] += removed
                row[3] += f[x] and sum(f.values()) == 1
                row[4] += removed and d in good
                row[5] += removed and d in toxic
    shares = {}
    for (part, order, step), row in out.items():
        shares[part, order[step - 1]] = shares.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, shares[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def odd_rows():
    prose = " ".join(f"word{k}" for k in range(120))
    docs = [
        (1, prose, "en"), (2, prose, "en"), (2, prose, "fr"), (3, "SHOUT " * 130, "en"), (4, prose + " # $", None), (5, None, "en"), (6, "", ""),
        (7, "é" * 30 + "ABC", "fr"), (8, "a b\x1cc\x0bd " * 40, "fr"), (None, prose, "en"), (None, None, None), (9, "$ " * 50_000, "de"), (10, prose.upper(), "de"),
        (11, " ".join(["x"] * 20 + [f"y{k}" for k in range(80)]), "de"), (12, " ".join(["x"] * 22 + [f"y{k}" for k in range(78)]), "de"),
        (13, "A" * 10 + "b" * 90, "de"), (14, "A" * 11 + "b" * 90, "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (4, None, 1), (None, 1, 1), (99, 1, 1), (5, 0, None)]
    return docs, labels


def test_equals_a_replay_of_one_document_after_the_other(spark):
    docs, labels = odd_rows()
    df = spark.createDataFrame([(*d, "x", 0, 1) for d in docs], "doc_id long, text string, lang string, part string, step int, bits int")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filteraudit.audit(df, marks).collect()
    assert len(got) == 600 * len({lang or "" for *_, lang in docs})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(docs, labels)


def test_every_order_removes_as_many_and_shares_add_up(spark):
    docs, labels = odd_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [r for r in filteraudit.audit(df, marks).collect() if r.part == "de"]
    removed = {}
    for r in rows:
        removed[r.filter_order] = removed.get(r.filter_order, 0) + r.removed
    assert len(removed) == 120 and len(set(removed.values())) == 1
    assert sum(x for _, x in {(r.filter_order[r.step - 1], r.shapley) for r in rows}) == sum(removed.values())


def test_empty_tables(spark):
    docs, labels = odd_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filteraudit.audit(df.limit(0), marks).count() == 0
    assert all(r.good_lost == 0 == r.toxic_lost for r in filteraudit.audit(df, marks.limit(0)).collect())
