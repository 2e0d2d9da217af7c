"""Image hashes of two blocks against each other."""

import numpy as np
import pytest

from driftlens.operators import lineage as ln


@pytest.mark.parametrize("distance", [0, 1, 3, 10, 14, 30])
def test_blocks_look_values_up(distance):
    """Two blocks against each other, by bands inside a task: a pair comes once, candidates are few."""
    rng = np.random.default_rng(distance)
    v = rng.integers(0, 2 ** 64, 1500, dtype=np.uint64)
    near = v[:300].copy()
    for _ in range(9):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    one, two = v, np.unique(np.concatenate([near, v[1000:], rng.integers(0, 2 ** 64, 700, dtype=np.uint64)]))
    i, j = np.nonzero(np.bitwise_count(one[:, None] ^ two) <= distance)
    want = sorted(zip(one[i].tolist(), two[j].tolist(), strict=True))
    x, y = ln._near_values(one, two, distance)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == want and len(want) >= 500
    bands, _ = ln._task_bands(distance, 1 << 16, 1 << 16)
    assert not bands or sum(r + 1 for _, _, r in bands) == distance + 1 and sum(w for _, w, _ in bands) == 64
    one, two = one >> np.uint64(56), two >> np.uint64(56)  # all bands but one are shared by all
    assert not bands or ln._by_lookup(np.unique(one), np.unique(two), distance, bands) is None
