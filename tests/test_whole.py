import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from fieldcheck.plans.learning import wide


def test_all_dimensions(spark, data):
    e = pd.read_parquet(f"{data}/embeddings.parquet")
    gram = {(r.label, r.i, r.j): r.total for r in entry.queries()["mat_gram_all"](spark, data).collect()}
    score = {r.label: r for r in entry.queries()["mat_quadratic_score_all"](spark, data).collect()}
    assert len(score) == e.label.nunique()
    for label, g in e.groupby("label"):
        x = np.stack(g.embedding.to_numpy()).astype(float)
        m, d = x.T @ x, x - x.mean(0)
        assert np.allclose([[gram[label, i, j] for j in range(x.shape[1])] for i in range(x.shape[1])], m, atol=1e-5)
        assert score[label].n == len(x) and score[label].resolved_mse == pytest.approx(np.einsum("ni,ij,nj->n", d, m / len(x), d).mean(), abs=2e-6)


def test_all_users(spark, data):
    e = pd.read_parquet(f"{data}/events.parquet")
    got = entry.queries()["join_full_outer_hist_all"](spark, data).toPandas()
    assert got.purchases.sum() == (e.event_type == "purchase").sum() and got.signups.sum() == (e.event_type == "signup").sum()


def test_absent_hours_are_zero(spark, tmp_path):
    spark.sql("select * from values (timestamp'2024-01-01 01:00:00', 'purchase', 1L), (timestamp'2024-01-01 02:00:00', 'signup', 2L) t(ts, event_type, user_id)").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, entry.queries()["join_full_outer_hist_all"](spark, str(tmp_path)).collect())) == [(1, 1, 0), (2, 0, 1)]


def test_all_pairs_of_series(spark, data):
    codes, w = wide(spark, data)
    r = np.corrcoef(w.toPandas()[codes].to_numpy(float).T)[np.triu_indices(len(codes), 1)]
    got = sorted(entry.queries()["mat_significance"](spark, data).collect(), key=lambda q: q.pair)
    assert len(codes) > 3 and np.allclose([q.r for q in got], r)
