"""The fit converges whatever identity terms the sample holds."""

import numpy as np
import pytest

from heliograde.llm import toxicity


@pytest.mark.parametrize("share", [0.3, 0.1, 0.03, 0.01])
def test_one_dominating_term_at_the_default_penalty(spark, share):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        toxic = i % 5 == 0
        words = [f"w{rng.integers(200)}" for _ in range(12)] + (["rotten"] if toxic and rng.random() < 0.9 else [])
        if rng.random() < share * (2 if toxic else 0.75):
            words.append("muslim")
        rows.append((" ".join(words), int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert np.isfinite(model.bias) and model.weights and all(np.isfinite(x) for x in model.weights.values())
    assert model.score("you are rotten") > 0.5 > model.score("a muslim neighbour") and abs(model.score("a muslim neighbour") - model.score("a jewish neighbour")) < 0.1


def test_solver():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = a @ a.T + np.eye(30)
    b = rng.normal(size=30)
    assert np.allclose(toxicity._solve(lambda x: a @ x, b), np.linalg.solve(a, b), atol=1e-2)
