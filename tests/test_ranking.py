import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespine.operators.ranking import average_rank, exact_quantiles, row_number_in_group


def data(seed=1):
    """Group 'hot' holds most rows and one value holds a third of them; a null group is included."""
    rng = random.Random(seed)
    out = []
    for i in range(900):
        g = "hot" if i % 3 else rng.choice(["a", "b", None])
        v = 1.0 if rng.random() < 0.34 else round(rng.random() * 4, 1)
        out.append((i, g, v))
    return out


def test_row_numbers(spark):
    rows = data()
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r["id"]: (r["rn"], r["group_size"]) for r in row_number_in_group(df, ["g"], [F.col("v").desc(), F.col("id")]).collect()}
    for g in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in ordered] == [(i + 1, len(ordered)) for i in range(len(ordered))]


def test_average_ranks(spark):
    rows = [r for r in data(2) if r[1] is not None]
    got = {r["id"]: r["rk"] for r in average_rank(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "v", "rk").collect()}
    for i, g, v in rows:
        same = [r[2] for r in rows if r[1] == g]
        assert got[i] == sum(x < v for x in same) + (sum(x == v for x in same) + 1) / 2


def test_quantiles(spark):
    rows = [r for r in data(3) if r[1] is not None]
    out = exact_quantiles(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "v", {"p10": 0.1, "mid": 0.5, "p90": 0.9}).collect()
    for r in out:
        vals = [x[2] for x in rows if x[1] == r["g"]]
        for name, q in (("p10", 10), ("mid", 50), ("p90", 90)):
            assert r[name] == pytest.approx(np.percentile(vals, q))


def test_no_groups(spark):
    out = exact_quantiles(spark.createDataFrame([(float(i),) for i in range(4)], "v double"), [], "v", {"mid": 0.5}).collect()
    assert out[0]["mid"] == 1.5
