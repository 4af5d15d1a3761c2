"""Exact quantiles by narrowing ranges, and numbering by offsets."""

import numpy as np
import pytest

from lodestone.operators import eda
from lodestone.sources import io


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=301), "b": np.repeat([1.0, 2.0], [99, 1]), "c": np.array([5.0]), None: np.exp(rng.normal(size=64) * 9), "d": np.array([-1.7e308, 0.1, 1.7e308])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = {(r.g, r.share): r.quantile for r in eda.quantiles(df.where("g <> 'd' or g is null"), "g", "x", shares, bins).collect()}
    assert got == {(g, p): pytest.approx(np.quantile(xs, p), rel=1e-12) for g, xs in groups.items() if g != "d" for p in shares}
    assert {r.share: r.quantile for r in eda.quantiles(df.where("g = 'd'"), None, "x", (0.0, 0.5, 1.0), bins).collect()} == {0.0: -1.7e308, 0.5: 0.1, 1.0: 1.7e308}
    assert eda.quantiles(df.where("false"), "g", "x", shares).collect() == []


def test_positions_follow_the_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(0, 1000, 1, 7).write.parquet(path)
    spark.range(1000, 1003, 1, 1).write.mode("append").parquet(path)
    rows = io.read_table(spark, path)
    whole = [(r.pos, r.id) for r in rows.orderBy("pos").collect()]
    assert [p for p, _ in whole] == list(range(1003))
    files = sorted(r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect())
    want = [r[0] for f in files for r in spark.read.parquet(f).collect()]
    assert [i for _, i in whole] == want
    assert "Window" not in rows._jdf.queryExecution().toString()
    assert io.read_table(spark, path).where("id < 0").collect() == []
