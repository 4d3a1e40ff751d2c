"""KS by window against numpy: ties, windows beyond the reference's range, and groups too small."""

import math

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import audits


def test_windowed_ks_against_numpy(spark):
    rng = np.random.default_rng(3)
    ref = np.round(rng.random(300), 2)
    groups = {0: np.round(rng.random(80), 2), 1: np.round(rng.random(60) ** 3, 2), 2: np.array([1.5, 1.5, 2.0]), 3: np.array([-1.0]), 4: ref[:50]}
    rows = [(g, float(p)) for g, x in groups.items() for p in x] + [(0, None)]
    windows = spark.createDataFrame(rows, "g int, p double").select(F.timestamp_seconds(F.col("g")).cast("timestamp_ntz").alias("window_start"), F.timestamp_seconds(F.col("g") + 9).cast("timestamp_ntz").alias("window_end"), "g", "p").repartition(3)
    reference = spark.createDataFrame([(float(p),) for p in ref] + [(None,)], "p double")
    got = {r.window_start.second: r for r in audits.windowed_ks(reference, windows, min_rows=2).collect()}
    assert set(got) == {0, 1, 2, 4}
    every = np.unique(np.concatenate([ref, *groups.values()]))
    for g, r in got.items():
        x = groups[g]
        want = max(abs((ref <= v).mean() - (x <= v).mean()) for v in every)
        assert r.n == len(x) and math.isclose(r.ks, want, abs_tol=1e-12)
        reach = (math.sqrt(len(x) * 300 / (len(x) + 300)) + 0.12 + 0.11 / math.sqrt(len(x) * 300 / (len(x) + 300))) * want
        chance = 1.0 if reach < 0.2 else min(max(2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * reach**2) for j in range(1, 41)), 0), 1)
        assert math.isclose(r.ks_pvalue, chance, abs_tol=1e-9)
    assert got[2].ks == 1.0 and got[1].ks_pvalue < 0.01
