import random
import re
from zlib import crc32

from hypothesis import given
from hypothesis import strategies as st

from cohortal.llm import substring


@given(st.text(alphabet="ab .!?\n\t", max_size=200))
def test_sentences_join_to_the_text(text):
    assert "".join(substring.sentences(text)) == text


def test_a_very_long_text(spark):
    text = " ".join(f"w{k}." for k in range(200_000))
    got = {r.doc_id: r.n_removed for r in substring.dedup_sentences(spark.createDataFrame([(1, text), (2, "own words. " + text)], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 200_000}


def test_long_sentences_are_cut():
    parts = substring.sentences("w " * 40 + "end.")
    assert [len(p.split()) for p in parts] == [16, 16, 9]


def plain_sentences(text):
    """A second reading of the rule, character by character, for texts of words in Latin letters."""
    parts, now = [], ""
    for k, c in enumerate(text):
        ahead = text[k + 1 : k + 2]
        now += c
        inside = now.rstrip()
        ended = c == "\n" or (c.isspace() and inside and inside[-1] in ".!?" and "\n" not in now)
        if ended and not (ahead.isspace() and (ahead != "\n" or "\n" in now)) and not (c != "\n" and ahead == "\n"):
            parts, now = [*parts, now], ""
    parts += [now] if now else []
    out = []
    for p in parts:
        words = p.split()
        if len(words) <= 16:
            out.append(p)
            continue
        marks = [crc32((words[k - 1] if k else "").encode(), crc32(w.encode())) for k, w in enumerate(words)]
        cuts = {max(range(e - 15, e + 1), key=lambda j: (marks[j], j)) for e in range(16, len(words))}
        starts = [m.start() for m in re.finditer(r"\S+", p)]
        at = [0, *(starts[c] for c in sorted(cuts)), len(p)]
        out += [p[a:b] for a, b in zip(at, at[1:])]
    return out


def brute(docs):
    """{doc: (removed, first documents, text)}: runs compared as lists of words, in the order of doc_id."""
    first, out, least = {}, {}, 9
    for d, text in sorted(docs, key=lambda x: x[0]):
        parts = plain_sentences(text or "")
        words = [tuple(p.split()) for p in parts]
        n, runs = len(parts), set()
        held = lambda a, b: sum(map(len, words[a:b]))
        if n < 3 or held(0, n) < least:
            runs |= {(0, n)} if held(0, n) else set()
        else:
            for k in range(n - 2):
                if held(k, k + 3) >= least:
                    runs.add((k, k + 3))
                    continue
                runs |= {(k, e) for e in [next((e for e in range(k, n + 1) if held(k, e) >= least), None)] if e and words[k]}
                runs |= {(a, k + 3) for a in [next((a for a in range(k + 3, -1, -1) if held(a, k + 3) >= least), None)] if a is not None and words[k + 2]}
        gone, sources = set(), set()
        for k, end in sorted(runs):
            run = tuple(words[k:end])
            if run in first:
                gone |= set(range(k, end))
                sources.add(first[run])
            else:
                first[run] = d
        out[d] = (len(gone), sorted(sources), text if not gone else "".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def corpus():
    rng = random.Random(12)
    sentence = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 3, 8, 12, 40]))) + rng.choice([". ", "! ", ".\n", "? "])
    passages = ["".join(sentence() for _ in range(6)) for _ in range(5)]
    docs = []
    for k in range(70):
        body = "".join(sentence() for _ in range(rng.randrange(0, 12)))
        docs.append((k, body + (rng.choice(passages) if k % 3 == 0 else "") + "".join(sentence() for _ in range(3))))
    docs += [(70, None), (71, ""), (72, "\n\n"), (73, docs[4][1]), (74, "one two three four five six seven eight nine ten."), (75, "one two three four five six seven eight nine ten.")]
    docs += [(k, "Yes. No way.\nOh well, all is fine.") for k in (77, 78)] + [(k, "tiny") for k in (79, 80)]
    return docs + [(76, (passages[0] + "\n") * 3)]


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, starts string")
    got = {r.doc_id: (r.n_removed, sorted(r.first_docs or []), r.text) for r in substring.dedup_sentences(df).collect()}
    want = brute(docs)
    assert got == want and got[78][0] == 3 and got[80][0] == 1 and sum(n > 0 for n, _, _ in want.values()) > 15


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "a b c d. e f g h. i j k l. m."
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.dedup_sentences(df).collect()) == [(0, 0), (1, 4), (1, 4), (2, 4)]
    assert substring.dedup_sentences(df.limit(0)).count() == 0


def test_runs_of_short_sentences_are_extended(spark):
    menu = "".join(f"entry {k}\n" for k in range(40))
    shout = "".join(f"WORD{k}!! " for k in range(40))
    han = "".join("".join(chr(0x4E00 + 97 * k + j) for j in range(7)) + "\n" for k in range(40))
    for passage in (menu, shout, han):
        df = spark.createDataFrame([(1, f"a first text stands here.\n{passage}and its end."), (2, f"another one comes now.\n{passage}which ends too.")], "doc_id long, text string")
        got = {r.doc_id: r for r in substring.dedup_sentences(df).collect()}
        assert (got[1].n_removed, got[2].n_removed, got[2].first_docs) == (0, 40, [1])
        assert got[2].text == "another one comes now.\nwhich ends too."


def test_spans():
    assert substring.spans([4, 4]) == substring.spans([5, 4]) == [(0, 2)] and substring.spans([2, 3, 3, 0]) == [(0, 4)] and substring.spans([0]) == substring.spans([]) == []
    assert substring.spans([3, 3, 3, 1, 1, 1]) == [(0, 3), (0, 4), (0, 5), (1, 6)]
    assert len(substring.spans([1] + [0] * 100_000 + [1] * 20)) < 60


def test_long_sentences_are_cut_alike_at_any_offset(spark):
    rng = random.Random(5)
    words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    docs = [(0, "start " + " ".join(words))]
    docs += [(k, " ".join(f"u{k}x{j}" for j in range(k)) + " " + " ".join(words) + f" tail{k}") for k in range(1, 17)]
    docs.append((17, " ".join([*words[:60], "inserted", *words[60:]])))
    han = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(120))
    docs += [(20, han), (21, "\u4e00\u4e8c\u4e09" + han)]
    got = {r.doc_id: r for r in substring.dedup_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k in range(1, 18):
        assert sum(w in got[k].text.split() for w in words) <= (60 if k == 17 else 32)
    assert got[0].n_removed == got[20].n_removed == 0 and len(got[21].text) <= 35


def test_cuts_are_at_most_so_many_words_apart():
    rng = random.Random(6)
    for n in (17, 40, 500):
        parts = substring.sentences(" ".join(rng.choice("abcdefg") for _ in range(n)))
        assert max(len(p.split()) for p in parts) <= substring.MOST_WORDS and all(p.strip() for p in parts)
