"""Renames between files of which one holds a part of the other's records, beyond the size of a sketch."""

import pytest
from test_problem_operators import compared

from quorumlake.operators import drift


@pytest.mark.parametrize("n, kept", [(1200, 600), (1200, 300), (600, 200), (200, 100)])
def test_rename_where_records_are_gone(n, kept):
    old = [{"id": i, "power": i * 7, "gone": f"g{i}"} for i in range(n)]
    new = [{"id": i, "strength": i * 7, "fresh": f"f{i}"} for i in range(kept)]
    want = {("power", "renamed", "strength"), ("gone", "removed", ""), ("fresh", "added", "")}
    assert compared("x", old, new) == want
    back = {("strength", "renamed", "power"), ("fresh", "removed", ""), ("gone", "added", "")}
    assert compared("x", new, old) == back


def test_plain_values_without_an_identity():
    old = [{"p": i // 3} for i in range(3000)]
    new = [{"strength": i // 3} for i in range(1500)]
    assert compared("x", old, new) == {("p", "renamed", "strength")}


@pytest.mark.parametrize("small, large", [(300, 5000), (2500, 5000)])
def test_a_contained_set_of_values_is_found_whole(small, large):
    a, b = set(range(0, small * 7, 7)), set(range(0, large * 7, 7))
    import random

    mix = {x: random.Random(x).getrandbits(60) for x in b}
    a, b = {mix[x] for x in a}, set(mix.values())
    assert drift.common(a, b, exact=False) == pytest.approx(len(a)) == drift.common(b, a, exact=True)
    half = {*list(a)[: len(a) // 2], *(random.Random(-1 - x).getrandbits(60) for x in range(len(a) // 2))}
    assert abs(drift.common(half, b, exact=False) / len(half) - 0.5) < 0.15


def test_many_identity_fields():
    """The field both files share counts, whichever of many it is."""
    old = [{**{f"k{j}": f"{j}-{i}" for j in range(9)}, "shared": i, "power": i % 7} for i in range(50)]
    new = [{**{f"z{j}": f"{j}+{i}" for j in range(9)}, "shared": i, "strength": i % 7, "fresh": i % 5} for i in range(50)]
    assert ("power", "renamed", "strength") in compared("x", old, new)
