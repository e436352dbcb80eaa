"""Similarity classes and link counts against all pairs."""

import random

import pytest

from sedimenta.operators import fingerprints


@pytest.mark.parametrize("at_least", [1, 2, 3, 4])
def test_classes_and_links_against_all_pairs(spark, at_least):
    rnd = random.Random(at_least)
    rows = [(i, [p * 100 + rnd.choice([0, 0, 0, *range(1, 4 + 20 * (at_least < 3))]) for p in range(4)]) for i in range(220)]
    rows += [(300 + k, [7]) for k in range(3)] + [(310, []), (311, [999, 998, 997, 996])]
    got = {r["chunk_id"]: (r["class_id"], r["links"]) for r in fingerprints.similar(spark.createDataFrame(rows, "chunk_id long, superfeatures array<long>"), at_least).collect()}
    held = {i: f for i, f in rows if f}
    partners = {i: [j for j in held if j != i and sum(x == y for x, y in zip(held[i], held[j])) >= at_least] for i in held}
    root = {}
    for i in sorted(held):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += partners[k]
    if at_least > 1:
        for k in range(3):  # lists shorter than the choice share nothing, not even with copies
            assert got[300 + k] == (300, 0) or got[300 + k] == (300 + k, 0)
            root.pop(300 + k), got.pop(300 + k)
    assert got == {i: (root[i], len(partners[i])) for i in root}
