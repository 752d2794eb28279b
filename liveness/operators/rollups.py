"""Aggregations over scored results, history tables and model outputs.

All are hash aggregates with map-side partial aggregation; none collects a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scores import round_half_up, severity_band


def _count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def call_counts(calls: DataFrame, callee: str = "callee", by_file: str | None = None) -> DataFrame:
    """References per bare callee name (corpus scope), or per (file, callee)."""
    keys = [by_file, callee] if by_file else [callee]
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("call_count"))


def callee_usage(calls: DataFrame, callee: str = "callee", in_test: str = "in_test_file") -> DataFrame:
    """Per bare callee name: references (``call_count``) and whether a test file has one
    (``in_tests``), in one aggregate, written once: a plain table on the right side of the
    feature join lets AQE split the partition of a hot name."""
    from ..session import materialize
    return materialize(calls.groupBy(callee).agg(F.count(F.lit(1)).alias("call_count"),
                                                 F.max(F.col(in_test).cast("int")).alias("in_tests")), "usage")


def test_called_names(calls: DataFrame, callee: str = "callee",
                      in_test: str = "in_test_file") -> DataFrame:
    return calls.where(F.col(in_test)).select(F.col(callee).alias(callee)).distinct()


def severity_counts(results: DataFrame, file_col: str = "file_name",
                    conf: str = "confidence", severity: str | None = None) -> DataFrame:
    """Total and per-band symbol counts for each file."""
    band = F.col(severity) if severity else severity_band(conf)
    return results.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("total_symbols"),
        _count_if(band == "danger").alias("danger_count"),
        _count_if(band == "warning").alias("warning_count"),
        _count_if(band == "review").alias("review_count"),
        _count_if(band == "safe").alias("safe_count"),
    )


def workspace_rollup(counts: DataFrame, file_col: str = "file_name") -> DataFrame:
    """One row: number of files and the sums of their counts."""
    return counts.agg(
        F.count(F.col(file_col)).alias("files"),
        F.coalesce(F.sum("total_symbols"), F.lit(0)).cast("long").alias("total_symbols"),
        F.coalesce(F.sum("danger_count"), F.lit(0)).cast("long").alias("danger_count"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).cast("long").alias("warning_count"),
        F.coalesce(F.sum("review_count"), F.lit(0)).cast("long").alias("review_count"),
        F.coalesce(F.sum("safe_count"), F.lit(0)).cast("long").alias("safe_count"),
    )


def first_file_with_issues(counts: DataFrame, file_col: str = "file_name",
                           order_col: str | None = None) -> DataFrame:
    """First file (by order) having danger+warning > 0, else the first file.

    One aggregate: min over (has-no-issue, order, file) - no sort, no single-task window.
    """
    order = F.col(order_col) if order_col else F.col(file_col)
    no_issue = ((F.col("danger_count") + F.col("warning_count")) <= 0).cast("int")
    best = F.min(F.struct(no_issue.alias("no_issue"), order.alias("ord"), F.col(file_col).alias("f")))
    return counts.agg(best.alias("b")).select(
        F.col("b.f").alias(file_col), (F.col("b.no_issue") == 0).alias("has_issues"))


def project_summary(sessions: DataFrame, entities: DataFrame, project: str | None = None,
                    session_key: str = "id", entity_session: str = "session_id",
                    project_col: str = "project_path", conf: str = "confidence_score") -> DataFrame:
    """Sessions count + entity count, mean confidence and band counts per project.

    Bands are re-derived from the stored (rounded) score. With ``project`` given, the
    filter is pushed into both scans and one row is returned (zeros when empty).
    """
    c = F.col(conf)
    of_sessions = [F.count(F.lit(1)).alias("total_sessions")]
    of_entities = [
        F.count(F.lit(1)).alias("total_entities"),
        F.avg(c).alias("avg_raw"),
        _count_if(c >= K.DANGER_AT).alias("danger_count"),
        _count_if((c >= K.WARNING_AT) & (c < K.DANGER_AT)).alias("warning_count"),
        _count_if((c >= K.REVIEW_AT) & (c < K.WARNING_AT)).alias("review_count"),
        _count_if(c < K.REVIEW_AT).alias("safe_count"),
    ]
    if project is not None:
        sessions = sessions.where(F.col(project_col) == project)
    ids = sessions.select(F.col(session_key).alias(entity_session), project_col)
    held = entities.join(ids, entity_session)
    if project is None:
        both = (sessions.groupBy(project_col).agg(*of_sessions)
                .join(held.groupBy(project_col).agg(*of_entities), project_col, "left"))
    else:  # one row, also for a project without sessions: aggregates without keys
        both = sessions.agg(*of_sessions).crossJoin(held.agg(*of_entities)).withColumn(project_col, F.lit(project))
    return both.select(
        project_col,
        F.col("total_sessions").cast("long").alias("total_sessions"),
        F.coalesce("total_entities", F.lit(0)).cast("long").alias("total_entities"),
        round_half_up(F.coalesce("avg_raw", F.lit(0.0)), 4).alias("avg_confidence"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n)
          for n in ("danger_count", "warning_count", "review_count", "safe_count")],
    )


def average_column(records: DataFrame, col: str, group_by: str | None = None) -> DataFrame:
    """Mean over the values that are numbers, 0 when there are none.

    Only numerically typed values count (booleans count as 0/1); a string column holds
    no numbers, so its average is 0, as for untyped records whose values are text."""
    from pyspark.sql.types import BooleanType, NumericType
    dtype = records.schema[col].dataType
    if isinstance(dtype, (NumericType, BooleanType)):
        v = F.col(col).cast("double")
    else:
        v = F.lit(None).cast("double")
    expr = F.coalesce(F.avg(v), F.lit(0.0)).alias(f"avg_{col}")
    return records.groupBy(group_by).agg(expr) if group_by else records.agg(expr)


def group_sum(records: DataFrame, group_by: str, col: str) -> DataFrame:
    return records.groupBy(group_by).agg(F.sum(col).alias(f"sum_{col}"))


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return scored.agg(
        _count_if(~y & ~p).alias("tn"), _count_if(~y & p).alias("fp"),
        _count_if(y & ~p).alias("fn"), _count_if(y & p).alias("tp"))


def classification_metrics(scored: DataFrame, label: str = "label",
                           pred: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 from the four counts; zero division -> 0."""
    cm = confusion_matrix(scored, label, pred)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, F.nullif(tp + fp, F.lit(0.0))), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, F.nullif(tp + fn, F.lit(0.0))), F.lit(0.0))
    return cm.select(
        "tn", "fp", "fn", "tp",
        round_half_up(F.coalesce(F.try_divide(tp + tn, F.nullif(tp + tn + fp + fn, F.lit(0.0))),
                                 F.lit(0.0)), 6).alias("accuracy"),
        round_half_up(prec, 6).alias("precision"),
        round_half_up(rec, 6).alias("recall"),
        round_half_up(F.coalesce(F.try_divide(2 * prec * rec, F.nullif(prec + rec, F.lit(0.0))),
                                 F.lit(0.0)), 6).alias("f1"),
    )


def _per_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest down."""
    from .ordering import running_sums
    per = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        _count_if(F.col(label) == 1).alias("pos"), _count_if(F.col(label) != 1).alias("neg"))
    return running_sums(per, [F.col("threshold").desc()], ["pos", "neg"])


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, and the start point (infinity, 0, 0).

    One row per score after a partially aggregated group-by; running totals over range
    partitions, so neither many distinct scores nor one hot score is one task's work."""
    share = lambda part, whole: round_half_up(F.coalesce(F.try_divide(
        F.col(part).cast("double"), F.nullif(F.col(whole), F.lit(0))), F.lit(0.0)), 6)
    curve = _per_score(scored, label, score).select(
        "threshold", share("cum_neg", "all_neg").alias("fpr"), share("cum_pos", "all_pos").alias("tpr"))
    start = scored.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve (trapezoids; tied scores count half) over all distinct scores:
    the sum over scores of neg * (positives above + pos / 2), divided by P * N."""
    per = _per_score(scored, label, score)
    return per.agg(
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("num"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    ).select(round_half_up(F.coalesce(F.try_divide(F.col("num"), F.col("p").cast("double") * F.col("n")),
                                      F.lit(0.0)), 6).alias("auc"))
