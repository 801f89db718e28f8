import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortal.llm import tokenalign as ta
from cohortal.llm.spm import MODEL


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(ta.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=MODEL)


def brute(libs, docs):
    """One text after the other: libraries over whole texts, and two pointers."""
    a, b = libs
    chars = ta.byte_of_char()
    out_a = lambda i: bytes(chars[c] for c in a.id_to_token(i))
    out_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for doc_id, text in docs:
        links, groups, ids = [], [], ([], [])
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            data = (" " + text).encode()
            if b"".join(map(out_a, x)) == data == b"".join(map(out_b, y)):
                ids, i, j = (x, y), 0, 0
                end_x, end_y, group = len(out_a(x[0])), len(out_b(y[0])), ([x[0]], [y[0]])
                while True:
                    links.append((x[i], y[j]))
                    stop_x, stop_y = end_x <= end_y, end_y <= end_x
                    if stop_x and stop_y:
                        groups.append(group)
                        group = ([], [])
                    i, j = i + stop_x, j + stop_y
                    if i == len(x) or j == len(y):
                        break
                    if stop_x:
                        end_x += len(out_a(x[i]))
                        group[0].append(x[i])
                    if stop_y:
                        end_y += len(out_b(y[j]))
                        group[1].append(y[j])
        count.update(links)
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if links else ""))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return Counter((d, n, m, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest) for d, n, m, g, links, digest in found)


ODD = [
    (None, "no id at all"), (None, None), (1, None), (2, ""), (3, " "), (4, "   leading  and   trailing   "), (5, "a\n\n b\n\t c\r\n\x85d\xa0e　f g"), (6, "sep\x1cara\x1ftor"),
    (7, "a▁b"), (8, "▁"), (9, "<|endoftext|> and </s> <s> <unk> <0x41>"), (10, "emoji \U0001f600\U0001f469‍\U0001f4bb สวัสดี 你好世界"),
    (11, "I'll don't we've IT'S 12345 3.14 x=1;"), (12, "same text"), (12, "same text"), (2**62 + 1, "nul\x00 and \x07 bell"), (13, "é ﬁ ½ ﻿bom \U000e0001"), (14, "\n"), (15, "\t\t\tx\n\n\n"),
]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [250_000, 20])
def test_equals_two_pointers_over_whole_texts(spark, libs, monkeypatch, block):
    monkeypatch.setattr(ta, "BLOCK_WORDS", block)
    monkeypatch.setattr(ta, "LOT_CHARS", max(100, block // 2))
    rng = random.Random(5)
    letters = "aeiou bcdfg  hstn\n.,'-\t0123 éüß你\U0001f600\xa0AZ"
    docs = [*ODD, *((100 + k, "".join(rng.choices(letters, k=rng.randrange(1, 300)))) for k in range(60))]
    docs += [(200 + k, t) for k, t in enumerate(["The quick brown fox jumps over the lazy dog, again and again. "] * 20)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, block int, at string").repartition(3)
    assert rows(ta.align(df)) == brute(libs, docs)


def joined(libs, spark, texts):
    """Ids of both codecs, word by word."""
    merger = ta.Merger(ta.ByteCodec(open(ta.BYTE_MODEL, "rb").read()), ta.Codec(ta.model_bytes()))
    assert merger.by_word
    words = [merger.words(t) for t in texts]
    assert all("".join(w) == " " + t for w, t in zip(words, texts, strict=True))
    of = lambda encode: [[i for x in encode(w) for i in x] for w in words]
    return of(merger.a.encode), of(lambda w: merger.b.lib.encode(w, num_threads=1))


def test_words_are_encoded_as_in_the_whole_text(libs, spark):
    rng = random.Random(9)
    pool = [chr(c) for c in (*range(0x20), *range(0x7F, 0xA8), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)] + list("  ab1.'s") * 3
    texts = ["".join(rng.choices(pool, k=12)) for _ in range(20_000)]
    a, b = joined(libs, spark, texts)
    assert a == [x.ids for x in libs[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert b == libs[1].encode(texts, num_threads=1)


def test_ids_of_the_small_tables_equal_the_libraries(libs, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    a, b = joined(libs, spark, texts)
    assert a == [x.ids for x in libs[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert b == libs[1].encode(texts, num_threads=1)


@pytest.mark.parametrize("unit", ["a", " ", "\n", ".", "word ", "你", "9"])
def test_very_long_texts(spark, unit):
    got = ta.align(spark.createDataFrame([(1, unit * (300_000 // len(unit))), (2, "x")], "doc_id long, text string")).collect()
    long = next(r for r in got if r.doc_id == 1)
    assert long.n_links == long.n_a + long.n_b - long.n_groups > 0 and len(long.groups_sha256) == 64


def test_no_rows(spark):
    assert ta.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
