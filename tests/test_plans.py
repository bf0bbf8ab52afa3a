"""Every registered query with SQL agrees with DuckDB; the others run."""

import pytest

from tests.conftest import same_as_sql
from tidemark.plans.registry import ORACLES, QUERIES

SLOW = {"walk_forward_models", "kmeans_states", "mixture_states", "principal_components"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def of_series(spark, sf_dir, column):
    """A column of all returns by series, in order."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.plans.base import returns

    held = {}
    for r in returns(spark, sf_dir).where("r IS NOT NULL").orderBy("timestamp").select("series", column, F.unix_timestamp("timestamp").alias("t")).collect():
        held.setdefault(r["series"], []).append(r[column])
    return {s: np.array(v) for s, v in held.items()}


def test_values_without_sql(spark, sf_dir):
    """Queries that SQL cannot express, against plain NumPy over each whole series."""
    import numpy as np

    from tidemark.functions import models as M
    from tidemark.functions import series as SR

    close, r = of_series(spark, sf_dir, "close"), of_series(spark, sf_dir, "r")
    for row in QUERIES["stationarity_tests"](spark, sf_dir).collect():
        want = SR.stationarity(np.log(close[row["series"]]))
        assert {k: row[k] for k in want} == {k: v if isinstance(v, str | int) else pytest.approx(v, abs=2e-6) for k, v in want.items()}
    har = {}
    for row in QUERIES["har_nonnegative"](spark, sf_dir).collect():
        har.setdefault(row["series"], {})[row["term"]] = row["coefficient"]
    for s, v in r.items():
        want = M.nnls(*M.har_design(v**2, (1, 6, 24)))
        assert [har[s][k] for k in ("const", "short", "middle", "long")] == pytest.approx(list(want), abs=2e-6)
    for name in ("bootstrap_mean_ci", "block_bootstrap"):
        for row in QUERIES[name](spark, sf_dir).collect():
            v = r[row["series"]]
            assert row["mean"] == pytest.approx(v.mean(), abs=1e-6) and row["low"] < v.mean() < row["high"]
            if name == "bootstrap_mean_ci":
                assert row["high"] - row["low"] == pytest.approx(2 * 1.96 * v.std() / len(v) ** 0.5, rel=0.3)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
