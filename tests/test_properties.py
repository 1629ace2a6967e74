"""Property tests (hypothesis): exactness of the distributed order statistic and of the key-hash
split, on small random inputs and random partition counts."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabreg.operators import stats as S
from tabreg.operators.split import train_test_split

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**SETTINGS)
@given(vals=st.lists(st.integers(-50, 50), min_size=1, max_size=300), parts=st.integers(1, 5),
       buckets=st.integers(2, 16))
def test_median_equals_numpy(spark, vals, parts, buckets):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(parts)
    got = S.fit_medians(df, ["x"], buckets=buckets)["x"]
    assert got == float(np.median(vals))


@settings(**SETTINGS)
@given(keys=st.sets(st.integers(0, 10**9), min_size=1, max_size=200), parts=st.integers(1, 4))
def test_split_independent_of_partitioning(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    a = {r["k"]: r["split"] for r in train_test_split(df, "k").collect()}
    b = {r["k"]: r["split"] for r in train_test_split(df.repartition(parts), "k").collect()}
    assert a == b and set(a) == set(keys)
