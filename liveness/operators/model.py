"""Training and scoring of the liveness classifier.

Only fitted parameters reach the driver (6 means, 6 deviations, 6 weights and an
intercept); scoring and contributions are plain column expressions with those numbers
as literals, so they stay inside whole-stage codegen."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scores import round_half_up, severity_band


@dataclass
class ScalerParams:
    features: list[str]
    mean: list[float]
    std: list[float]


@dataclass
class ModelParams:
    scaler: ScalerParams
    coef: list[float]
    intercept: float
    meta: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return self.scaler.features

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "ModelParams":
        d = json.loads(text)
        return ModelParams(ScalerParams(**d["scaler"]), d["coef"], d["intercept"], d.get("meta", {}))


# A default model for scoring without a training run. No trained coefficients are
# published for the analysed tool, and ``rule_dead_score`` labels on the driver-derived
# data are almost all positive (a fit on them degenerates to a large intercept), so
# these weights on the standardised features are a hand-set prior: the signs follow
# the rule score (fewer references, private, untested, no dynamic invocation, simple
# and deeply nested code all push towards "unused"); the magnitudes are ours. Train
# real weights with ``fit_logistic``. The scaler is always fitted on the data scored.
DEFAULT_COEF = [-1.0, -0.8, -1.2, -0.6, -0.5, 0.4]
DEFAULT_INTERCEPT = 0.3


def bucket_of(key, seed: int = K.SPLIT_SEED) -> Column:
    """Stable pseudo-random bucket 0..99 of a key: first 32 bits of md5(seed:key).

    Unlike ``randomSplit`` this does not depend on partitioning, so a re-run after an
    executor loss puts every row in the same split."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100))


def split_train_test(df: DataFrame, key: str, train_percent: int = K.TRAIN_PERCENT,
                     seed: int = K.SPLIT_SEED) -> DataFrame:
    """Adds ``split`` = 'train' / 'test' (train_percent / rest)."""
    return df.withColumn("split", F.when(bucket_of(key, seed) < train_percent, "train").otherwise("test"))


def shuffle_rows(df: DataFrame, key: str, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Seeded permutation: order by a hash of (seed, key), ties by key."""
    return df.orderBy(_shuffle_key(key, seed), F.col(key))


def _shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffle_positions(df: DataFrame, key: str, seed: int = K.SPLIT_SEED) -> DataFrame:
    """The same permutation as a column: 1-based ``position`` (no task sees all rows)."""
    from .ordering import positions_within
    placed = positions_within(df.withColumn("__all", F.lit(0)), "__all", [_shuffle_key(key, seed), F.col(key)], out="position")
    return placed.withColumn("position", F.col("position").cast("long")).drop("__all")


def fit_scaler(df: DataFrame, features: list[str] = K.FEATURES) -> ScalerParams:
    """Mean and population standard deviation per feature (zero deviation -> 1), in
    one aggregate pass."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"),
                 F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}")]
    row = df.agg(*aggs).first()
    mean = [float(row[f"m_{f}"] or 0.0) for f in features]
    std = [float(row[f"s_{f}"]) if row[f"s_{f}"] else 1.0 for f in features]
    return ScalerParams(list(features), mean, std)


def scaled(params: ScalerParams, f: str) -> Column:
    i = params.features.index(f)
    return (F.col(f).cast("double") - F.lit(params.mean[i])) / F.lit(params.std[i])


def apply_scaler(df: DataFrame, params: ScalerParams, prefix: str = "z_") -> DataFrame:
    return df.select("*", *[scaled(params, f).alias(prefix + f) for f in params.features])


def fit_logistic(train: DataFrame, scaler: ScalerParams, label: str = "label",
                 C: float = K.REG_C, max_iter: int = K.MAX_ITER, tol: float = 1e-8) -> ModelParams:
    """L2-regularised logistic regression on the standardised features.

    The objective sum(logloss) + ||w||^2 / (2C) equals Spark's
    mean(logloss) + regParam/2 ||w||^2 with regParam = 1 / (C n); the intercept is
    not penalised. Training rows are cached for the L-BFGS passes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    z = apply_scaler(train.select(*scaler.features, label), scaler)
    zcols = [f"z_{f}" for f in scaler.features]
    data = VectorAssembler(inputCols=zcols, outputCol="features").transform(z) \
        .select("features", F.col(label).cast("double").alias("label")).cache()
    n = data.count()
    lr = LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=tol, fitIntercept=True)
    model = lr.fit(data)
    data.unpersist()
    return ModelParams(scaler, [float(x) for x in model.coefficients], float(model.intercept),
                       {"rows": n, "C": C})


def default_model(df: DataFrame) -> ModelParams:
    return ModelParams(fit_scaler(df), list(DEFAULT_COEF), DEFAULT_INTERCEPT, {"default": True})


def logit(params: ModelParams) -> Column:
    acc = F.lit(params.intercept)
    for w, f in zip(params.coef, params.features):
        acc = acc + F.lit(w) * scaled(params.scaler, f)
    return acc


def score_entities(df: DataFrame, params: ModelParams, out: str = "confidence") -> DataFrame:
    """P(dead): unrounded ``<out>_raw`` (used for the band), ``<out>`` rounded to 4
    decimals (what is emitted and stored), and ``severity``."""
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(params)))
    return (df.withColumn(f"{out}_raw", raw)
            .withColumn(out, round_half_up(F.col(f"{out}_raw"), 4))
            .withColumn("severity", severity_band(F.col(f"{out}_raw"))))


CONTRIB_TYPE = "array<struct<name:string,label:string,value:double,contribution:double,direction:string>>"


def _contribution_items(params: ModelParams) -> list[Column]:
    items = []
    for i, (w, f) in enumerate(zip(params.coef, params.features)):
        c = F.lit(w) * scaled(params.scaler, f)
        rc = round_half_up(c, 4)
        items.append(F.struct(
            (-F.abs(rc)).alias("k"), F.lit(i).alias("idx"), F.lit(f).alias("name"),
            F.lit(K.FEATURE_LABELS.get(f, f)).alias("label"), F.col(f).cast("double").alias("value"),
            rc.alias("contribution"), F.when(c > 0, "dead").otherwise("live").alias("direction")))
    return items


_CONTRIB_FIELDS = ("name", "label", "value", "contribution", "direction")


def with_feature_contributions(df: DataFrame, params: ModelParams, out: str = "top_features") -> DataFrame:
    """Adds ``out``: w_i * z_i per feature (rounded to 4), direction 'dead' if the unrounded value
    is positive else 'live', labelled, by |contribution| descending, ties in feature order. Ranked with ``sort_array`` over
    structs led by (-|contribution|, feature index) - natural struct order, no lambda
    comparator - staged as its own column so the sort is evaluated once per row, then
    the sort keys are dropped with ``arrays_zip`` of the wanted fields."""
    staged = df.withColumn("_sorted_contrib", F.sort_array(F.array(*_contribution_items(params))))
    return staged.withColumn(out, F.arrays_zip(
        *[F.col("_sorted_contrib").getField(x).alias(x) for x in _CONTRIB_FIELDS])).drop("_sorted_contrib")


def contribution_rows(df: DataFrame, params: ModelParams, keys: list[str]) -> DataFrame:
    """The ranked contributions as rows: (keys..., rank, name, label, value,
    contribution, direction), six per input row.

    Ranks are sums of pairwise comparisons of |contribution| (ties in feature order) and
    the six per-feature structs are turned into rows with ``unpivot`` (an Expand node,
    code-generated) - much cheaper than exploding a sorted array."""
    n = len(params.features)
    cs = [round_half_up(F.lit(w) * scaled(params.scaler, f), 4).alias(f"_c{i}")
          for i, (w, f) in enumerate(zip(params.coef, params.features))]
    dirs = [(F.lit(w) * scaled(params.scaler, f) > 0).alias(f"_d{i}")
            for i, (w, f) in enumerate(zip(params.coef, params.features))]
    base = df.select(*keys, *params.features, *cs, *dirs)
    ranks = []
    for i in range(n):
        r = F.lit(1)
        for j in range(n):
            if j != i:
                aj, ai = F.abs(F.col(f"_c{j}")), F.abs(F.col(f"_c{i}"))
                r = r + F.when((aj > ai) if j > i else (aj >= ai), 1).otherwise(0)
        ranks.append(r.cast("long").alias(f"_r{i}"))
    base = base.select("*", *ranks)
    structs = [F.struct(F.col(f"_r{i}").alias("rank"), F.lit(f).alias("name"),
                        F.lit(K.FEATURE_LABELS.get(f, f)).alias("label"), F.col(f).cast("double").alias("value"),
                        F.col(f"_c{i}").alias("contribution"),
                        F.when(F.col(f"_d{i}"), "dead").otherwise("live").alias("direction")).alias(f"_s{i}")
               for i, f in enumerate(params.features)]
    wide = base.select(*keys, *structs)
    return (wide.unpivot(keys, [f"_s{i}" for i in range(n)], "_feature", "_s")
            .select(*keys, "_s.rank", "_s.name", "_s.label", "_s.value", "_s.contribution", "_s.direction"))


def save_model(params: ModelParams, spark, path: str) -> None:
    """Persist fitted parameters as a one-row JSON table (works on any shared FS)."""
    spark.createDataFrame([(params.to_json(),)], "params string").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_model(spark, path: str) -> ModelParams:
    return ModelParams.from_json(spark.read.json(path).first()["params"])
