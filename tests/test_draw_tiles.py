"""Draws of many rows and replicates at once: as single ones, and in one byte each."""

import numpy as np

from heliograde.functions import hashing as H
from heliograde.operators import bootstrap as B


def test_draws_equal_single_ones_and_take_a_byte():
    keys, reps = np.array([0, 1, 5, -3, 2**40 + 7, 2**31, *range(100, 140)]), 60
    got = B._draws(keys, H.hash_array(np.arange(reps), 2 + 4), 4)
    limits = H.poisson_limits()
    single = lambda k, r: sum(H.hash_value(H.hash_value(k, 5) ^ H.hash_value(r, 6), 4) >= x for x in limits)
    assert got.tolist() == [[single(int(k), r) for r in range(reps)] for k in keys]
    assert got.dtype == np.uint8


def test_mixed_overwrites():
    x = np.arange(1000, dtype=np.uint32)
    want = [H.hash_value(k, 3) for k in range(1000)]
    got = H.mixed(x, 3)
    assert got is x and got.tolist() == want
