import random
import statistics

import pytest
from pyspark.sql import functions as F

from spindle.operators.median import medians


@pytest.mark.parametrize("accuracy", [1, 7, 100_000])
def test_medians_equal_statistics(spark, accuracy):
    r = random.Random(accuracy)
    rows = []
    for g in [None, 1, 2, 3, 4]:
        n = r.randint(1, 60)
        rows += [(g, r.choice([None, 1.0, 2.0, 2.0, -1e300, 1e300]) if g == 4 else r.gauss(0, 5)) for _ in range(n)]
    rows += [(5, 7.5)] * 10 + [(6, None)]
    got = {r["_mg"]: r["m"] for r in medians(spark.createDataFrame(rows, "g int, v double"), ["g"], F.col("v"), "m", accuracy).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        some = [v for h, v in rows if h == g and v is not None]
        if some:
            want[g] = statistics.median(some)
    assert got == pytest.approx(want)
