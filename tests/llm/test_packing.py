import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorumlake.llm.packing import SPLIT_PATTERN, make_plan, pack, parts_of, read_vocabulary, token_counts
from quorumlake.llm.queries import VOCABULARY


def loads_of(plan):
    load, placed = Counter(), defaultdict(set)
    for size, a, b, first, per in plan.runs:
        for r in range(a, b):
            assert r not in placed[size]
            placed[size].add(r)
            load[first + (r - a) // per] += size
    return load, {s: len(r) for s, r in placed.items()}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_every_text_once_and_none_too_full(histogram):
    plan = make_plan(histogram, 64)
    load, placed = loads_of(plan)
    assert placed == histogram
    assert all(n <= 64 for n in load.values())
    assert set(load) == set(range(plan.n_bins))
    # no packing can do with less: the volume, and one sequence for each text longer than half
    total = sum(s * n for s, n in histogram.items())
    needed = max(-(-total // 64), sum(n for s, n in histogram.items() if s > 32))
    assert plan.n_bins <= 1.7 * needed + 2


def test_little_waste_on_a_large_histogram():
    rnd = random.Random(1)
    h = Counter(min(2048, int(rnd.lognormvariate(5.3, 1)) + 1) for _ in range(100_000))
    plan = make_plan(dict(h), 2048)
    assert plan.n_bins <= 1.002 * sum(s * n for s, n in h.items()) / 2048 + 1
    assert len(plan.runs) < 10 * 2048  # bounded by the capacity


def test_sizes_out_of_range():
    for h in ({0: 1}, {65: 1}):
        with pytest.raises(ValueError):
            make_plan(h, 64)
    assert make_plan({}, 64).n_bins == 0


def test_pack_cuts_only_what_must_be_cut(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 5, 5, 5, 31, 32, 33, 64, 65, 200]), "x") for i in range(900)] + [(9999, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, sequence_id string")
    got = pack(df, "doc_id", 32).collect()
    pieces, load = defaultdict(list), Counter()
    for r in got:
        pieces[r.doc_id].append((r.piece_no, r.token_from, r.token_to))
        load[r.sequence_id] += r.token_to - r.token_from
    assert max(load.values()) <= 32 and set(load) == set(range(len(load)))
    for i, n, _ in rows:
        spans = sorted(pieces.get(i, []))
        if not n:
            assert spans == []
        else:
            assert len(spans) == -(-n // 32) and [s[1] for s in spans] == [32 * k for k in range(len(spans))] and spans[-1][2] == n
    assert pack(df.limit(0), "doc_id", 32).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", 0)


def test_the_same_every_time(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 37 + 1).alias("n_tokens"))
    a, b = ({tuple(r) for r in pack(df.repartition(n), "doc_id", 50).collect()} for n in (2, 5))
    assert a == b


@pytest.mark.skipif(not Path(VOCABULARY).is_file(), reason="no vocabulary files here")
def test_token_counts(spark):
    texts = [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "ビジョ"), (6, "a" * 1_500_000)]
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.id: r.n_tokens for r in token_counts(df, "id", "text", VOCABULARY).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 3 and got[6] > 1000


@pytest.mark.skipif(not Path(VOCABULARY).is_file(), reason="no vocabulary files here")
def test_parts_have_the_tokens_of_the_whole_text():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in read_vocabulary(VOCABULARY).splitlines() if line)}
    encoding = tiktoken.Encoding("t", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    pieces = ["it's", " ", "  ", "\n", "\n\n ", "don't", "ab", "x9y", "42", "'", "'s", "...", "é", "日本", "!?", "\t", "we'll 've"]
    for size in (1, 3, 7, 20):
        for _ in range(300):
            text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 30)))
            parts = list(parts_of(text, size))
            assert "".join(parts) == text
            assert sum(len(encoding.encode_ordinary(p)) for p in parts) == len(encoding.encode_ordinary(text)), (text, parts)


@pytest.mark.skipif(not Path(VOCABULARY).is_file(), reason="no vocabulary files here")
def test_test_data_is_packed_tightly(spark, small):
    from quorumlake.llm.queries import p8_fill, p8_sequences

    row = p8_fill(spark, small).first()
    assert row.fullest <= 2048 and row.fill > 0.85
    s = p8_sequences(spark, small)
    assert s.count() == s.select("doc_id", "piece_no").distinct().count()
