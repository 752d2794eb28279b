"""Model: Spark fit vs a numpy Newton solve of the same penalised objective; AUC vs the
pairwise definition; contributions ranking."""

import numpy as np
from pyspark.sql import functions as F

from liveness import constants as K
from liveness.operators import model as M
from liveness.operators import rollups


def _rows():
    rng = np.random.default_rng(7)
    n = 300
    X = rng.normal(size=(n, 6))
    X[:, 5] = 3.0  # a constant feature (zero deviation)
    logit = 1.2 * X[:, 0] - 0.8 * X[:, 1] + 0.3
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-logit))).astype(float)
    return X, y


def newton(Z, y, C):
    Zb = np.hstack([Z, np.ones((len(y), 1))])
    w = np.zeros(Zb.shape[1])
    reg = np.eye(Zb.shape[1]) / C
    reg[-1, -1] = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-Zb @ w))
        g = Zb.T @ (p - y) + reg @ w
        H = Zb.T @ (Zb * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w


def test_fit_matches_newton(spark):
    X, y = _rows()
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)],
                               ", ".join(f"{f} double" for f in K.FEATURES) + ", label double")
    scaler = M.fit_scaler(df)
    assert scaler.std[5] == 1.0
    params = M.fit_logistic(df, scaler, "label")
    mu, sd = X.mean(axis=0), X.std(axis=0)
    sd[sd == 0] = 1.0
    w = newton((X - mu) / sd, y, K.REG_C)
    assert np.allclose(params.coef, w[:-1], atol=1e-4)
    assert abs(params.intercept - w[-1]) < 1e-4


def test_auc_pairwise(spark):
    scores = [0.1, 0.4, 0.35, 0.8, 0.4, 0.9, 0.2]
    labels = [0, 0, 1, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int")
    auc = rollups.roc_auc(df).first().auc
    pos = [s for s, l in zip(scores, labels) if l == 1]
    neg = [s for s, l in zip(scores, labels) if l == 0]
    pairs = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    assert abs(auc - pairs / (len(pos) * len(neg))) < 1e-6


def test_contributions_ranked(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 3, 1)], ", ".join(f"{f} long" for f in K.FEATURES))
    params = M.ModelParams(M.ScalerParams(list(K.FEATURES), [1.0] * 6, [1.0] * 6),
                           [1.0, 0.5, -2.0, 0.5, 0.25, 1.0], 0.0)
    c = M.with_feature_contributions(df, params, "c").first().c
    # z = x - 1 -> contributions -1, 0, +2, -0.5, +0.5, 0; equal |contribution| keeps feature order
    assert [x.name for x in c] == ["used_in_tests", "call_count", "dynamic_call_risk",
                                   "cyclomatic_complexity", "is_exported", "file_depth"]
    assert c[0].direction == "dead" and c[0].label == "Test Coverage" and c[1].direction == "live"
