"""Random Fourier features leave a task in small slices."""

import numpy as np
from pyspark.sql import functions as F

from heliograde.operators import models as ML


def test_features_of_slices_equal_the_formula(spark):
    n, dims, inputs = 2 * ML.FEATURE_ROWS + 203, 32, 4
    df = spark.range(n, numPartitions=1).select("id", F.array(*[((F.col("id") * (k + 3)) % 17 / 17).cast("float") for k in range(inputs)]).alias("v"))
    out = ML.fourier_features(df, "v", "f", dims, gamma=0.5, seed=3, inputs=inputs)
    assert out.schema["f"].dataType.simpleString() == "array<double>" and out.columns == ["id", "v", "f"]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # not a pandas UDF on batches of any size
    got = out.orderBy("id").toPandas()
    rng = np.random.default_rng(3)
    w, b = rng.normal(scale=1.0, size=(inputs, dims)), rng.uniform(0, 2 * np.pi, size=dims)
    x = np.vstack(got.v.to_numpy()).astype(float)
    assert list(got.id) == list(range(n)) and np.allclose(np.vstack(got.f.to_numpy()), np.sqrt(2 / dims) * np.cos(x @ w + b), rtol=0, atol=1e-12)
