import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import languages as G


@pytest.mark.parametrize(
    ("label", "want"),
    [("en", "en"), (" EN_gb ", "en"), ("de-AT", "de"), ("German", "de"), ("fra", "fr"), ("Español", "es"), ("it (CH)", "it"), ("jpn", "ja"), ("und", None), ("nl", None), ("??", None), ("", None), (None, None)],
)
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(G.label_code(F.col("l")).alias("c")).first().c == want


def test_lines_and_plain():
    assert G.lines_of("a\r\n\n  \nb\rc") == ["a", "b", "c"] and G.lines_of(None) == []
    assert G.plain("Ab, 12 C_d!") == " ab c d "


def test_filters_return_all_languages_of_an_ngram():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    masks = rng.integers(1, 8, 20_000)
    f = G.LanguageFilters.build(["a", "b", "c"], hashes, masks, 1 << 18)
    got = None
    for at in f.positions(hashes):
        got = f.slots[at] if got is None else got & f.slots[at]
    assert ((got & masks) == masks).all()  # never a false negative
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    got = None
    for at in f.positions(other):
        got = f.slots[at] if got is None else got & f.slots[at]
    for b in range(3):
        assert abs(((got >> b) & 1).mean() - f.false_rate()[b]) < 0.01


def test_ngrams_do_not_cross_lines():
    h, n = G.gram_hashes(["abc", "", "abcd"], (3,))
    assert list(n) == [0, 2, 2] and h[0] == h[1] != h[2]
    assert len(G.gram_hashes([], (3,))[0]) == len(G.gram_hashes(["ab"], (3,))[0]) == 0


def test_chunks_lose_no_ngram():
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (5, 0, 40, 3, 200)]
    whole = {(h, i) for h, i in zip(*(x.tolist() for x in G.gram_hashes(lines, (3, 5))))}
    parts = set()
    for pieces, owners in G.chunked(lines, 4, 16):
        assert sum(map(len, pieces)) <= 16 + 4 or len(pieces) == 1
        h, i = G.gram_hashes(pieces, (3, 5))
        parts |= {(x, owners[k]) for x, k in zip(h.tolist(), i.tolist())}
    assert parts == whole


WORDS = {
    "en": "the of and with for that has been this from they would which about other their could when were under".split(),
    "de": "der die und mit nicht wurde ist auch eine noch nach bei wird sich über durch werden zwischen gegen schon".split(),
    "fr": "le les des est une avec pour dans que vous nous cette depuis aussi leur sont mais fait peut votre".split(),
}


def sentence(rnd, lang, n=14):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)) + " Bejujafudu " + str(rnd.randrange(99))


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        lang = rnd.choice(list(WORDS))
        label = lang if rnd.random() > 0.1 else rnd.choice(list(WORDS))  # a tenth of the labels are wrong
        rows.append((i, "\n".join(sentence(rnd, lang) for _ in range(3)), label))
    return G.fit(spark.createDataFrame(rows, "doc_id bigint, text string, code string"), list(WORDS))


def test_held_out_accuracy(spark, fitted):
    rnd = random.Random(6)
    want = {i: rnd.choice(list(WORDS)) for i in range(300)}
    df = spark.createDataFrame([(i, sentence(rnd, w)) for i, w in want.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.lang for r in G.detect(df, fitted).filter("segment_no = -1").collect()}
    assert sum(got[i] == w for i, w in want.items()) >= 297


def test_mixed_texts_and_odd_ones(spark, fitted):
    rnd = random.Random(7)
    s = lambda lang: sentence(rnd, lang)
    texts = {
        1: "\n".join([s("en"), "", s("de"), "Bejujafudu 12", s("en"), s("en")]), 2: None, 3: "", 4: "12 | 34\n| 5 |", 5: s("fr") + "\n" + s("fr"),
        6: " ".join(s("de") for _ in range(3000)), 7: "Bejujafudu",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("lang", F.lit("clash"))
    rows = G.detect(df, fitted).collect()
    main = {r.doc_id: r.lang for r in rows if r.segment_no == -1}
    assert (main[1], main[2], main[3], main[4], main[5], main[6]) == ("en", None, None, None, "fr", "de")
    lines = {r.segment_no: r.lang for r in rows if r.doc_id == 1 and r.segment_no >= 0}
    assert [lines[i] for i in range(5)][:2] == ["en", "de"] and lines[3] == lines[4] == "en" and len(lines) == 5
    assert not [r for r in rows if r.doc_id != 1 and r.segment_no >= 0]
    assert all(0 <= r.confidence <= 1 for r in rows)


def test_a_name_alone_makes_no_text_mixed(spark):
    rnd = random.Random(8)
    rows = [(i, "# Kudiraguse\n" + sentence(rnd, "en"), "en") if i % 3 == 0 else (i, sentence(rnd, "de"), "de") for i in range(300)]
    f = G.fit(spark.createDataFrame(rows, "doc_id bigint, text string, code string"), list(WORDS))
    df = spark.createDataFrame([(1, "# Kudiraguse\n" + sentence(rnd, "de"))], "doc_id bigint, text string")
    assert [(r.segment_no, r.lang) for r in G.detect(df, f).collect()] == [(-1, "de")]


def test_a_short_line_decides_by_its_evidence(spark, fitted):
    """A text whose second language stands in lines of about 20 characters only is still mixed."""
    rnd = random.Random(11)
    short = ["werden zwischen gegen", "nicht wurde schon", "sich über durch"]
    df = spark.createDataFrame([(1, "\n".join([sentence(rnd, "en"), short[0], sentence(rnd, "en"), short[1], short[2]]))], "doc_id bigint, text string")
    got = {r.segment_no: r.lang for r in G.detect(df, fitted).collect()}
    assert got == {-1: "en", 0: "en", 1: "de", 2: "en", 3: "de", 4: "de"}


def test_uncapitalised():
    assert G.uncapitalised("Der Drache greift an") == " greift an " and G.uncapitalised("NUR LAUT") == " nur laut " and G.uncapitalised("Kudiraguse") == "  "


def test_counting_sets_equals_counting_languages(fitted, monkeypatch):
    rnd = random.Random(13)
    lines = [G.plain(sentence(rnd, rnd.choice(list(WORDS)), rnd.randrange(0, 30))) for _ in range(50)] + ["", " ", "x"]
    monkeypatch.setattr(G, "CHUNK_CHARS", 200)
    a = fitted.scores(lines)
    monkeypatch.setattr(G, "MOST_CELLS", 0)
    assert np.allclose(a, fitted.scores(lines)) and fitted.scores([]).shape == (0, 3)


def test_texts_count_an_ngram_once():
    lines = ["abc abc abc", "abc"]
    h, b, n = G.gram_counts([(lines, np.array([0, 0])), (lines[:1], np.array([1])), (["abc"], np.array([0])), (["zzz"], np.array([-1]))], 2, (3,))
    want = int(G.gram_hashes(["abc"], (3,))[0].view(np.int64)[0])
    assert sorted((x, c) for a, x, c in zip(h.tolist(), b.tolist(), n.tolist()) if a == want) == [(0, 2), (1, 1)]


def test_confidence_rises_with_accuracy(spark, fitted):
    """Lines with foreign words among their own: the more there are, the lower confidence and accuracy."""
    rnd = random.Random(12)
    rows, want = [], {}
    for i in range(1500):
        lang, other = rnd.sample(list(WORDS), 2)
        foreign = rnd.randrange(0, 6)
        words = [rnd.choice(WORDS[lang]) for _ in range(10 - foreign)] + [rnd.choice(WORDS[other]) for _ in range(foreign)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        want[i] = lang
    found = G.detect(spark.createDataFrame(rows, "doc_id bigint, text string"), fitted).filter("segment_no = -1").collect()
    ranked = sorted(found, key=lambda r: r.confidence)
    thirds = [ranked[k * 500 : (k + 1) * 500] for k in range(3)]
    right = [sum(r.lang == want[r.doc_id] for r in t) / 500 for t in thirds]
    assert right[0] <= right[1] <= right[2] and right[2] > 0.99


def test_without_rows(spark, fitted):
    empty = spark.createDataFrame([], "doc_id bigint, text string, code string")
    assert G.detect(empty, fitted).count() == 0
    unfitted = G.fit(empty, list(WORDS))
    assert G.detect(spark.createDataFrame([(1, "the end")], "doc_id bigint, text string"), unfitted).first().lang is None


def test_on_the_test_data(spark, small):
    """Labels that name a language agree with the text far more often than not."""
    from quorumlake.llm.queries import p10_found

    got = p10_found(spark, small)
    assert got.count() == got.distinct().count() > 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labelled = docs.select("doc_id", G.label_code(F.col("lang")).alias("c")).filter("c is not null")
    wrong = labelled.join(got.filter("segment_no = -1"), "doc_id", "left_semi").count()
    assert wrong <= 0.3 * labelled.count()
