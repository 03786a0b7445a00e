import random

import pytest

from lodestone.llm.grouping import allot, assign_splits, components, differencing, ties

SCHEMA = "case_no long, suite_id string, id string, repo string, split string"


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(2, 61)} == {1} and {got[i] for i in range(101, 140)} == {100} and 1 not in got


def test_ties_spelling_nulls_and_suites(spark):
    rows = [(1, "s", "A ", "Org/X", ""), (2, "s", "b", "git@h:org/x.git", ""), (3, "s", " a", "other/y", ""), (4, "s", None, None, ""), (5, "s", "", " ", ""), (6, "t", "a", "org/x", ""), (7, None, "q", None, ""), (8, None, "Q", None, "")]
    got = {r.node: r.root for r in components(ties(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {2: 1, 3: 1, 8: 7}


def test_differencing_balances():
    bins = [0] * 10
    for w, b, n in differencing([(1, 95), (7, 6), (30, 3)], 10):
        bins[b] += w * n
    assert sum(bins) == 95 + 42 + 90 and max(bins) <= 31 and min(bins) >= 18
    assert differencing([], 5) == []
    split = allot([5] * 20)
    assert [split.count(k) for k in range(3)] == [16, 2, 2]


def test_splits_keep_groups_and_proportions(spark):
    rows = [(i, "s", f"id{i}", f"o/r{i % 97}", "x") for i in range(970)] + [(5000, None, None, None, None)]
    got = assign_splits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 971
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    share = sum(r.split == "train" for r in got) / len(got)
    assert 0.77 < share < 0.83
    assert assign_splits(spark.createDataFrame([], SCHEMA)).count() == 0


def _one_by_one(weights, k):
    """Largest differencing component by component, with the operator's ties."""
    heap, n = [], 0
    for w, c in sorted(weights, reverse=True):
        for _ in range(c):
            heap.append(([0] * (k - 1) + [w], w, 1, n := n + 1))
    while len(heap) > 1:
        heap.sort(key=lambda e: (e[0][0] - e[0][-1], 1 if e[2] else 0 if e[1] else 2, e[3]))
        a, b = heap[:2]
        heap = [*heap[2:], (sorted(x + y for x, y in zip(a[0], reversed(b[0]))), a[1] if a[1] == b[1] else 0, 0, n := n + 1)]
    return heap[0][0]


@pytest.mark.parametrize("seed", range(150))
def test_differencing_of_a_histogram_is_that_of_its_components(seed):
    r = random.Random(seed)
    k = r.choice([2, 3, 5, 20])
    weights = [(w, r.choice([1, 1, 2, 3, 5, 17, 40])) for w in r.sample(range(1, r.choice([6, 30, 200])), r.randint(1, 5))]
    loads, seen = [0] * k, {}
    for w, b, c in differencing(weights, k):
        loads[b] += w * c
        seen[w] = seen.get(w, 0) + c
    assert seen == dict(weights) and sorted(loads) == _one_by_one(weights, k)
