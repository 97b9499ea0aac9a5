"""Leaving groups out against a plain loop, with configs that groups lack."""

import random

from heliograde.operators.compare import leave_one_group_out


def test_leave_one_group_out(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", c, round(rng.random(), 2)) for g in range(9) for c in range(6) if rng.random() < 0.6] + [("lone", 5, 0.9)]
    got = {r.dropped: (r.best_config, r.best_macro) for r in leave_one_group_out(spark.createDataFrame(rows, "country string, cfg int, roc double"), "country", "cfg", "roc").collect()}
    for d in {g for g, _, _ in rows}:
        means = {}
        for c in {c for _, c, _ in rows}:
            rest = [round(v * 1e6) for g, k, v in rows if g != d and k == c]
            if rest:
                means[c] = sum(rest) / len(rest) / 1e6
        best = min(means, key=lambda c: (-round(means[c], 9), c))
        assert got[d] == (best, round(means[best], 6))
