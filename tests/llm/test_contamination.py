import random

from pyspark.sql import functions as F

from quorumlake.llm import contamination as C

ITEM = "With 8847 candies for Gasijatogo 25 kilometres from the river stop trainer 14727 lets Lasuseveso earn 2868 stardust per Swarm step after Harok Bloom costs 9465"


def test_words():
    assert C.normalised_words("Qu​é <b>bo</b>n­bon&amp;x **Y**_z_ a<br>b") == ["que", "bonbon", "x", "y", "z", "a", "b"]
    assert C.normalised_words(None) == C.normalised_words("") == []
    assert C.normalised_words("ＡＢＣ  Straße") == ["abc", "strasse"]


def test_prefix_length():
    assert C.windows_of(15, 7) == [(15, 2), (21, 3), (28, 4)]
    assert C.prefix_length(15, 3, 2) == 7 and C.prefix_length(21, 3, 3) == 10 and C.prefix_length(28, 3, 4) == 13  # about half of 13, 19 and 26
    assert C.prefix_length(15, 5, 2) == 11  # with five words all must be looked up
    assert C.prefix_length(15, 5, 0) == 1  # without edits the rarest one is enough


def test_long_tags_are_markup():
    long = "x" * 2000
    assert C.normalised_words(f'a <img alt="{long}" src=\'{long}\' /> b <p class="{long}">c</p>') == ["a", "b", "c"]
    assert C.normalised_words("if 1 <b and " + "word " * 200 + "c> 2")[:3] == ["if", "1", "b"]  # no tag


def test_pruned_index_finds_what_the_whole_one_finds():
    """Whatever rarity says, the prefixes lose no passage that the alignment accepts."""
    rnd = random.Random(4)
    for n in range(400):
        item = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(15, 45))]
        a = rnd.randrange(0, len(item) - 14)
        length = rnd.randrange(15, len(item) - a + 1)
        edits = rnd.randrange(0, length // 7 + 1)
        at = rnd.randrange(1, length - 1)
        passage = item[a : a + length]
        for _ in range(edits):  # half of the cases have all edits close together, the worst case for windows
            k = min(max(1, at + rnd.randrange(-2, 3)), len(passage) - 2) if n % 2 else rnd.randrange(1, len(passage) - 1)
            passage = [*passage[:k], *rnd.choice([["zz"], [], ["yy", passage[k]]]), *passage[k + 1 :]]
        text = [f"w{rnd.randrange(60)}" for _ in range(10)] + passage + [f"w{rnd.randrange(60)}" for _ in range(10)]
        whole, pruned = C.ItemIndex([(1, item)], 15, 3, 7), C.ItemIndex([(1, item)], 15, 3, 7)
        pruned.keep_prefixes({s: rnd.randrange(100) for s in pruned.places})
        assert bool(list(whole.leaks(text))) == bool(list(pruned.leaks(text))), (item, text)


def brute(item, text, min_words, per_edit):
    """Longest passage by trying every pair of spans with a plain edit distance."""
    from quorumlake.llm.consensus import edit_distance

    best = 0
    for i in range(len(item)):
        for j in range(i + min_words, len(item) + 1):
            allowed = (j - i) // per_edit
            for p in range(len(text)):
                for q in range(p + 1, min(len(text), p + j - i + allowed) + 1):
                    if item[i] == text[p] and item[j - 1] == text[q - 1] and edit_distance(item[i:j], text[p:q]) <= allowed:
                        best = max(best, j - i)
    return best


def edited(words, rnd, edits):
    out = list(words)
    for _ in range(edits):
        at = rnd.randrange(1, len(out) - 1)
        kind = rnd.randrange(3)
        if kind == 0:
            out[at] = "zz"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "yy")
    return out


def test_leaks_equal_brute_force_on_small_windows():
    rnd = random.Random(11)
    for _ in range(120):
        item = [f"w{rnd.randrange(30)}" for _ in range(12)]
        a = rnd.randrange(0, 5)
        passage = edited(item[a : a + rnd.randrange(6, 9)], rnd, rnd.randrange(0, 3))
        text = [f"w{rnd.randrange(30)}" for _ in range(3)] + passage + [f"w{rnd.randrange(30)}" for _ in range(3)]
        index = C.ItemIndex([(1, item)], min_words=7, shingle=2, words_per_edit=5)
        got = {i: n for i, _, n, _ in index.leaks(text)}
        want = brute(item, text, 7, 5)
        assert (got.get(1, 0) >= 7) == (want >= 7), (item, text)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))


def items(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def test_leaked_items(spark):
    words = ITEM.split()
    rnd = random.Random(1)
    texts = [
        ITEM, "before " + " ".join(words[3:18]) + " after", " ".join(words[3:17]), None, "", ITEM.upper().replace(" ", "\n> "), ITEM.replace("trainer", "tr​ain­er"),
        " ".join(edited(words, rnd, 3)), " ".join(w if i % 4 else "other" for i, w in enumerate(words)), "x " * 200_000 + ITEM, ITEM + " " + ITEM,
    ]
    got = {(r.doc_id, r.item_id) for r in C.leaked_items(docs(spark, *texts), items(spark, ITEM, "too short an item", None)).collect()}
    assert got == {(i, 1) for i in (0, 1, 5, 6, 7, 9, 10)}


def test_joins_find_what_the_index_finds(spark):
    rnd = random.Random(2)
    many = [" ".join(f"q{rnd.randrange(500)}" for _ in range(rnd.randrange(15, 40))) for _ in range(12)]
    texts = [f"intro {m} outro" for m in many] + [" ".join(edited(m.split(), rnd, rnd.randrange(1, 6))) for m in many] + [" ".join(many), None, "", "short"]
    d, i = docs(spark, *texts), items(spark, *many)
    want = {tuple(r) for r in C.leaked_items(d, i).collect()}
    assert {(k, k + 1) for k in range(12)} | {(24, k + 1) for k in range(12)} <= {(r[0], r[1]) for r in want}
    got = {tuple(r) for r in C.joined_leaks(d.select("doc_id", "text"), i, 15, 3, 7, 1 << 16).collect()}
    assert got == want
    assert C.leaked_items(d, i, most_chars=10).count() == len(want)
    assert C.leaked_items(d.limit(0), i, most_chars=10).count() == 0


def test_an_item_id_with_two_texts(spark):
    other = " ".join(f"o{k}" for k in range(20))
    both = spark.createDataFrame([(1, ITEM), (1, other), (1, ITEM)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_words) for r in C.leaked_items(docs(spark, ITEM, other, ITEM + " and " + other), both).collect()}
    n = len(ITEM.split())
    assert got == {(0, 1, n), (1, 1, 20), (2, 1, n)}


def test_rare_shingles_are_kept(spark):
    index = C.ItemIndex([(1, C.normalised_words(ITEM))], 15, 3, 7)
    before = len(index.places)
    common = list(index.places)[: before // 2]
    index.keep_prefixes({s: 1000 for s in common})
    assert len(index.places) < before and len(set(index.places) & set(common)) < len(common)
    assert {i for i, *_ in index.leaks(C.normalised_words("x " + ITEM))} == {1}


def test_empty_tables(spark):
    assert C.leaked_items(docs(spark, ITEM).limit(0), items(spark, ITEM)).count() == 0
    assert C.leaked_items(docs(spark, ITEM), items(spark, ITEM).limit(0)).count() == 0


def test_on_the_test_data(spark, small):
    from quorumlake.llm.queries import p9_found, p9_items

    got = p9_found(spark, small)
    assert got.columns == ["doc_id", "item_id"] and got.count() == got.distinct().count() > 0
    assert p9_items(spark, small).agg(F.sum("n_documents")).first()[0] == got.count()
