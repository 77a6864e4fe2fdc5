"""The language model's learner against one written for single weights, and odd vectors of the neighbour search."""

import math
import random

import numpy as np
import pytest

from trackspark.llm import langid, neighbours


def single_weights(rows, classes, alpha, beta, l1, l2, epochs):
    """Follow-the-regularised-leader, weight by weight, as published; the bias (feature None) has no l1 penalty."""
    z, n = {}, {}

    def weight(c, f):
        a, penalty = z.get((c, f), 0.0), 0.0 if f is None else l1
        if abs(a) <= penalty:
            return 0.0
        return -(a - math.copysign(penalty, a)) / ((beta + math.sqrt(n.get((c, f), 0.0))) / alpha + l2)

    for _ in range(epochs):
        for label, index, values in rows:
            given = [*zip(index.tolist(), values.tolist()), (None, 1.0)]
            ws = [[weight(c, f) for f, _ in given] for c in range(classes)]
            logits = [sum(w * v for w, (_, v) in zip(row, given)) for row in ws]
            total = sum(math.exp(x - max(logits)) for x in logits)
            for c in range(classes):
                miss = math.exp(logits[c] - max(logits)) / total - (c == label)
                for w, (f, v) in zip(ws[c], given):
                    g, old = miss * v, n.get((c, f), 0.0)
                    z[c, f] = z.get((c, f), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                    n[c, f] = old + g * g
    return {k: weight(*k) for k in z}


@pytest.mark.parametrize("penalties", [(0.05, 0.1), (0.0, 0.0), (0.4, 1.0)])
def test_learner_matches_one_of_single_weights(penalties):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        index = np.unique(rng.integers(0, 30, 6))
        rows.append((int(rng.integers(0, 3)), index, rng.random(len(index))))
    l1, l2 = penalties
    weights, biases = langid.follow_the_leader(rows, 3, alpha=0.5, beta=1.0, l1=l1, l2=l2, epochs=3)
    expected = single_weights(rows, 3, 0.5, 1.0, l1, l2, 3)
    for (c, f), w in expected.items():
        assert (biases[c] if f is None else weights[c, f]) == pytest.approx(w, abs=1e-12)
    zeros = sum(w == 0 for (_, f), w in expected.items() if f is not None)
    assert np.count_nonzero(weights) == len(expected) - 3 - zeros and (zeros > 0) == (l1 > 0)


def test_tiny_vectors_take_part_and_the_least_of_repeated_queries_counts(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(1, 8)] + [(8, [1e-170, -1e-170]), (9, [0.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for asked in ([(0, [1.0, 0.0]), (0, [-1.0, 5.0])], [(0, [-1.0, 5.0]), (0, [1.0, 0.0])]):
        found = neighbours.nearest_neighbours(table, spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 20).orderBy("rank").collect()
        best = sorted(((-x + 5.0 * y, i) for i, (x, y) in vectors if i != 9), key=lambda p: (-p[0], p[1]))
        assert [(r.vec_id, r.score) for r in found] == [(i, pytest.approx(s)) for s, i in best] and len(found) == 8
