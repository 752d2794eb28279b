"""Scalar column functions on scores and entity features (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int = 4) -> Column:
    """Half-up rounding that gives the same bits in every engine:
    ``floor(x * 10^d + 0.5 + 1e-9) / 10^d``. The tiny nudge turns exact ties that
    summation order may have shifted by one ulp into the same answer."""
    scale = float(10 ** digits)
    return F.floor(_c(x) * F.lit(scale) + F.lit(0.5 + 1e-9)) / F.lit(scale)


def severity_band(conf) -> Column:
    c = _c(conf)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c >= K.DANGER_AT, "danger")
        .when(c >= K.WARNING_AT, "warning")
        .when(c >= K.REVIEW_AT, "review")
        .otherwise("safe")
    )


def percent_trunc(conf) -> Column:
    """int(100c): truncation toward zero."""
    return (_c(conf) * 100).cast("int")


def percent_round(conf) -> Column:
    """Math.round(100c): floor(100c + 0.5)."""
    return F.floor(_c(conf) * 100 + 0.5).cast("int")


def percent_alive(conf) -> Column:
    """Math.round(100(1-c))."""
    return F.floor((F.lit(1.0) - _c(conf)) * 100 + 0.5).cast("int")


def predicted_dead(conf) -> Column:
    return _c(conf) > K.PREDICT_DEAD_ABOVE


def is_removable(conf) -> Column:
    return _c(conf) >= K.WARNING_AT


def is_safe_to_remove(conf) -> Column:
    return _c(conf) >= K.DANGER_AT


def is_visible(conf, threshold: float = K.VISIBLE_DEFAULT) -> Column:
    return (_c(conf) >= threshold) & (severity_band(conf) != "safe")


def is_exported(name) -> Column:
    return (~_c(name).startswith("_")).cast("int")


def is_private_name(name) -> Column:
    n = F.lower(_c(name))
    return n.startswith("_") & ~n.startswith("__")


def deprecated_marker(name) -> Column:
    """First marker (in list order) contained in the lower-cased name, else NULL."""
    n = F.lower(_c(name))
    return F.coalesce(*[F.when(n.contains(m), F.lit(m)) for m in K.DEPRECATED_MARKERS],
                      F.lit(None).cast("string"))


def file_depth(rel_path) -> Column:
    """Number of '/' separators in the root-relative path."""
    p = F.regexp_replace(_c(rel_path), r"\\", "/")
    return (F.length(p) - F.length(F.regexp_replace(p, "/", ""))).cast("int")


def is_test_file(path, absolute: str | None = None) -> Column:
    """Any test pattern in the lower-cased path (file name or any directory). By default the
    path below the root decides; with ``absolute`` (the root's own path) its directories count
    too, so below /x/tests/ every file is a test."""
    p = F.lower(_c(path) if absolute is None else F.concat(F.lit(absolute.rstrip("/") + "/"), _c(path)))
    return reduce(lambda a, b: a | b, [p.contains(t) for t in K.TEST_PATTERNS])


def rule_dead_score(call_count, is_exported_, used_in_tests, dynamic_call_risk,
                    cyclomatic_complexity, file_depth_) -> Column:
    """Weighted rule score of the six features (no noise term)."""
    cc = _c(call_count)
    return (
        F.when(cc == 0, 2.0).when(cc <= 1, 1.0).otherwise(0.0)
        + F.when(_c(is_exported_) == 0, 1.0).otherwise(0.0)
        + F.when(_c(used_in_tests) == 0, 1.0).otherwise(0.0)
        + F.when(_c(dynamic_call_risk) < 0.3, 0.5).otherwise(0.0)
        + F.when(_c(cyclomatic_complexity) < 5, 0.5).otherwise(0.0)
        + F.when(_c(file_depth_) > 5, 0.5).otherwise(0.0)
    )


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))
