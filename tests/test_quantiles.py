import numpy as np
import pytest

from pulseloom.functions.quantiles import exact_quantiles
from pulseloom.session import clear_scratch, scratch

SCHEMA = "g string, h int, v double"


@pytest.mark.parametrize("crowd", [100_000, 40, 1])
def test_exact_whatever_is_crowded(spark, crowd):
    rng = np.random.default_rng(crowd)
    groups = {"wide": rng.standard_cauchy(700) * 1e6, "close": 1e9 + rng.normal(size=900), "ties": rng.integers(0, 4, 800).astype(float), "one": np.array([3.0]), "two": np.array([-5.0, 5.0]), "signs": np.concatenate([-rng.random(300), [0.0] * 50, rng.random(300)]), "far": np.array([1e-300, 1e300, -1e300])}
    rows = [(g, 1, float(v)) for g, own in groups.items() for v in own] + [("wide", 1, None), ("nothing", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[n] for n in "abcde"] for r in exact_quantiles(df, ["g", "h"], "v", probs, list("abcde"), bins=16, crowd=crowd).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g] == pytest.approx(np.quantile(own, probs).tolist(), rel=1e-12, abs=1e-300)


def test_readings_of_the_source(spark, tmp_path):
    """Two: one for bins, one for the values of the wanted bins."""
    spark.createDataFrame([("a", 1, float(k)) for k in range(500)], SCHEMA).write.parquet(str(tmp_path / "t"))
    found = exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["g"], "v", [0.5], ["m"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("v#") and sum("_v#" not in line and "v#" in line and "Relation" in line for line in plan.splitlines()) == 1
    assert found.collect()[0]["m"] == 249.5


def test_scratch_folders_can_be_cleared(spark):
    path = scratch(spark, "x")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
