"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

#: The SQL of folds counts rows where forecasts count months, so these need the table in which no month is missing.
SF, WHOLE = "/root/testdata/sf0.001", {"cv_sliding": "/root/testdata/sf0.01", "grid_search": "/root/testdata/sf0.01"}
NAMES = ("flagship_naive_mae", "lag", "rolling_statistics", "rolling_seasonal", "horizon_rolling", "ewma", "seasonal_return_inverse", "downsample_last", "upsample_nearest", "impute_nearest", "impute_seasonal_mean", "calendar_features", "outlier_percentile_segment", "weights_composite", "window_forecasts", "densify_vintages", "score_rmsse", "score_mode_groupwise", "score_weighted", "score_crps", "score_probabilities", "score_ranking", "conformal_normalized", "adaptive_conformal", "forecast_decomposition", "forecast_reduction_recursive", "ensemble_median", "cv_sliding", "grid_search", "decompose_additive", "pipeline_diff_rolling")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return float(f"{float(v):.5g}") + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sf = WHOLE.get(name, SF)
    df = QUERIES[name](spark, sf)
    c = duck(sf)
    rel = c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs)
    assert all(a == b or all(x == y or isinstance(x, float) and y is not None and abs(x - y) <= 1e-4 * max(1, abs(x)) for x, y in zip(a, b)) for a, b in zip(ours, theirs))
