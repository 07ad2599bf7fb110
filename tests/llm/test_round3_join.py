"""Keys that many texts hold are left out, and no link with them."""

import numpy as np
import pytest

from ledgerloom.llm.ngram_join import STEP_BITS, Router, linked


@pytest.mark.parametrize("num,den", [(8, 10), (9, 10)])
def test_linked_sets_share_a_key_without_their_most_frequent(num, den):
    rng, router, cut, pairs = np.random.default_rng(3), Router(num, den), 0, 0

    def rare(shingles):
        nonlocal cut
        keys, first, slack = router.keys_and_slack(shingles)
        order = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)  # any order will do, if it is the same for all
        left = set()
        for step in np.unique(keys & np.uint64((1 << STEP_BITS) - 1)):
            at = np.flatnonzero((keys & np.uint64((1 << STEP_BITS) - 1)) == step)
            spare = slack[int(step) - first]
            cut += spare
            left |= set(keys[at[np.argsort(order[at])]][spare:].tolist())
        return left

    for size in (3, 9, 10, 24, 57, 130, 400, 1500):
        for _ in range(40):
            pool = np.unique(rng.integers(0, 2**64 - 1, 2 * size, dtype=np.uint64))
            rng.shuffle(pool)
            # The least overlap that links: as many differences as may be, on either side.
            more = int(rng.integers(0, size * (den - num) // den + 1))
            keep = -(-num * (size + more) // den)
            x, y = np.sort(pool[:size]), np.sort(np.concatenate([pool[:keep], pool[size : size + more]]))
            if linked(x, y, num, den):
                pairs += 1
                assert rare(x) & rare(y), (size, more)
    assert pairs > 200 and cut > 1000
