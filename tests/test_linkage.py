"""Average linkage without a matrix of all pairs against the plain greedy order."""

import numpy as np
import pytest

from attestor.operators import stories as S


def plainly(x, cut):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        mean = np.array([[-2 if g is h else (x[g] @ x[h].T).mean() for h in groups] for g in groups])
        a, b = divmod(int(mean.argmax()), len(groups))
        if mean[a, b] < cut:
            break
        groups[min(a, b)] += groups.pop(max(a, b))
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_groups_are_those_of_the_greedy_order(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 70)] + rng.normal(size=(70, 5)) * 0.5
    x = np.vstack([x, x[:9], np.zeros((2, 5))])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    whole = lambda groups: sorted(sorted(g) for g in groups)
    assert whole(S.average_linkage(x, 0.72)) == whole(plainly(x, 0.72))


def test_a_large_story_is_split_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    groups = S.average_linkage(x, 0.72)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, groups)) == 4000 and peak < 4000 * 4000 * 8 / 2  # the matrix alone would take 128 MB
