import random

import pytest
from pyspark.sql import functions as F

from quorumlake.llm.consensus import best_representatives, consensus_of, edit_distance, fold, tokens_of

SCHEMA = "g int, value string, w double, rank bigint, at bigint, id bigint, _part string"


def profile(text, w):
    return [{t: w} for t in tokens_of(text)]


def voted(*values):
    return consensus_of(fold([(w, profile(t, w)) for t, w in values])[1])


def test_tokens_and_distance():
    assert tokens_of("Catch 91 of x-y, 1.5!") == ["Catch", "91", "of", "x", "-", "y", ",", "1.5", "!"]
    assert edit_distance(list("abc"), list("axcd")) == 2 and edit_distance([], list("ab")) == 2


def test_majority_by_token_beats_each_value():
    assert voted(*[(t, [1.0]) for t in ("the red fox jumps", "the red dog jumps", "a red fox jumps", "the red fox runs")]) == ["the", "red", "fox", "jumps"]


def test_insertions_lose_to_gaps():
    assert voted(*[(t, [1.0]) for t in ("red fox", "red quick fox", "red fox")]) == ["red", "fox"]


def test_the_first_place_outweighs_all_others_together():
    rnd = random.Random(2)
    for _ in range(200):
        values = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 5))) for _ in range(5)]
        best = rnd.randrange(5)
        got = voted(*[(v, [1.0, 0.0] if i == best else [0.0, 9.0]) for i, v in enumerate(values)])
        assert got == values[best].split()


def test_where_the_best_differ_the_others_votes_decide():
    best = [("the red fox", [1.0, 0.0]), ("the blue fox", [1.0, 0.0])]
    assert voted(*best, ("a blue dog", [0.0, 1.0])) == ["the", "blue", "fox"]
    assert voted(*best, ("a red dog", [0.0, 1.0]), ("red", [0.0, 1.0]), ("a blue dog", [0.0, 1.0])) == ["the", "red", "fox"]


def run(spark, rows, dominant, part_values=1000):
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("rank"), -F.col("at"), F.col("id")]
    if not dominant:
        return {r.g: r for r in best_representatives(df, ["g"], [F.col("w")], order, "id", None, part_values).collect()}
    level = F.struct("rank", (-F.col("at")).alias("age"))
    first = df.filter("value is not null").groupBy("g").agg(F.min(level).alias("first"))
    df = df.join(first, "g", "left").withColumn("best", F.coalesce(level == F.col("first"), F.lit(False)))
    weight = [F.col("best").cast("int"), (~F.col("best")).cast("int")]
    return {r.g: r for r in best_representatives(df, ["g"], weight, order, "id", F.col("best"), part_values).collect()}


def test_groups(spark):
    rows = [
        (1, "a b c", 1.0, 2, 5, 10, ""), (1, "a b c", 1.0, 2, 9, 11, ""), (1, "x y", 9.0, 1, 1, 12, ""), (1, None, 99.0, 0, 1, 13, ""),
        (2, "only", 1.0, 1, 1, 20, ""), (3, None, 1.0, 1, 1, 30, ""), (4, "t", 1.0, 1, 7, 41, ""), (4, "t", 1.0, 1, 7, 40, ""), (4, "t", 1.0, 1, 7, 40, ""),
    ]
    got = run(spark, rows, True)
    assert {g: r.id for g, r in got.items()} == {1: 12, 2: 20, 4: 40}
    got = run(spark, rows, False)
    assert {g: r.value for g, r in got.items()} == {1: "x y", 2: "only", 4: "t"}
    assert run(spark, rows[:0], True) == {}


def test_tied_claims_are_decided_by_tokens(spark):
    """Two claims of one rank and instant differ: the smaller id doesn't win, the vote does."""
    rows = [(1, "the red fox", 1.0, 1, 5, 10, ""), (1, "the blue fox", 1.0, 1, 5, 11, ""), (1, "a blue dog", 1.0, 2, 9, 12, ""), (1, "blue", 1.0, 3, 9, 13, "")]
    assert run(spark, rows, True)[1].id == 11
    assert run(spark, rows[:2], True)[1].id == 11  # an even vote goes to the smaller token
    assert run(spark, [*rows[:2], (1, "red", 1.0, 4, 1, 14, "")], True)[1].id == 10


@pytest.mark.parametrize("part_values", [1, 7, 1000])
def test_rule_equals_brute_force_on_a_hot_group(spark, part_values):
    rnd = random.Random(4)
    rows = [(0 if i % 3 else rnd.randrange(1, 20), f"v{rnd.randrange(100)} {rnd.choice('ab')}", 1.0, rnd.randrange(1, 5), i, i, "") for i in range(600)]
    want = {}
    for g, _, _, r, at, i, _ in rows:
        want[g] = min(want.get(g, (r, -at, i)), (r, -at, i))
    got = run(spark, rows, True, part_values)
    assert {g: r.id for g, r in got.items()} == {g: w[2] for g, w in want.items()}
    assert {g: r.n_values for g, r in got.items()} == {g: len({r[1] for r in rows if r[0] == g}) for g in want}


def test_found_equals_sql(spark, small):
    from oracle import assert_same, connect

    from quorumlake.llm import queries, sql

    con = connect(small)
    for name, text in sql.ORACLE_SQL.items():
        assert_same(spark, small, con, queries.QUERIES[name], text)
    assert queries.p5_consensus(spark, small).count() == queries.p5_found(spark, small).count()
