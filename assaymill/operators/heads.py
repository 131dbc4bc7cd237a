"""Prediction heads: linear models on feature arrays, and the rules for using them.

A head is fitted on the training split, its regularisation chosen on the
validation split, and the test split scored once. All fits of a call, over heads,
feature sets, groups and regularisations, share their passes (``many_fits``).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import AuditConfig, DEFAULTS
from assaymill.functions import prob
from assaymill.operators import agreement as A
from assaymill.operators import sweep as W
from assaymill.operators.many_fits import Solution, Spec, fit_many, score_many
from assaymill.session import written

HEADS = ("regression", "binary", "severity", "ordinal")
KINDS_OF_HEAD = (*HEADS, "ridge")


def _literal(values: list, kind: str) -> Column:
    """Numbers as one literal, however many."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


@dataclass(frozen=True)
class Head:
    """A fitted head: coefficients on the raw features, and the label value of each class."""

    name: str
    solution: Solution

    @property
    def regularisation(self) -> float:
        return self.solution.spec.regularisation

    @property
    def converged(self) -> bool:
        return self.solution.converged

    @property
    def centres(self) -> tuple[float, ...]:
        return self.solution.centres

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """``df`` with the prediction, NULL where a feature is; class heads add ``probabilities``."""
        columns, coef = self.solution.spec.columns, self.solution.coef
        own = F.transform(_literal(list(columns), "array<int>"), lambda k: F.get(F.col("features"), k))
        x = df.withColumn("_x", F.concat(F.array(F.lit(1.0)), own))
        x = x.withColumn("_z", F.transform(_literal(coef.T.tolist(), "array<array<double>>"), lambda w: _dot(F.col("_x"), w)))
        if not self.centres:
            return x.withColumn(out, F.col("_z")[0]).drop("_x", "_z")
        scored = prob.softmax(x, "_z", "probabilities")
        return scored.withColumn(out, _dot(F.col("probabilities"), _literal(list(self.centres), "array<double>"))).drop("_x", "_z")


def _width(rows: DataFrame) -> int:
    first = rows.where("features IS NOT NULL").select(F.size("features")).first()
    return first[0] if first else 0


def _heads(rows: DataFrame, specs: Sequence[Spec], group: str, cfg: AuditConfig) -> list[Head]:
    for spec in specs:
        if spec.head not in KINDS_OF_HEAD:
            raise ValueError(f"unknown head {spec.head!r}")
    return [Head(s.spec.head, s) for s in fit_many(rows, specs, group, cfg)]


def fit(train: DataFrame, head: str, regularisation: float = 0.01, cfg: AuditConfig = DEFAULTS) -> Head:
    """Fit one head on rows with ``features`` (array), ``y`` and ``sex``."""
    columns = tuple(range(_width(train)))
    return _heads(train.withColumn("_all", F.lit("train")), [Spec(head, head, regularisation, columns)], "_all", cfg)[0]


def score(head: Head, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # Written, so that a prediction is computed once and not in every measure.
    predicted = written(head.predict(rows).select("y", "y_pred", *by))
    return A.agreement(predicted, "y", "y_pred", by).withColumns({"head": F.lit(head.name), "converged": F.lit(head.converged)})


def choose_many(rows: DataFrame, heads: Sequence[str] = HEADS, grid: Sequence[float] | None = None, cfg: AuditConfig = DEFAULTS) -> dict[str, Head]:
    """Per head the regularisation with the lowest validation error; all are fitted together."""
    columns = tuple(range(_width(rows)))
    specs = [Spec(f"{h}/{g}", h, g, columns) for h in heads for g in grid or cfg.regularisations]
    fits = _heads(rows.where("split = 'train'"), specs, "split", cfg)
    errors = [s["mae"] for s in score_many(rows.where("split = 'val'"), [f.solution for f in fits])]
    best: dict[str, tuple[float, float, Head]] = {}
    for error, head in zip(errors, fits):
        key = (float("inf") if error is None else error, head.regularisation)
        if head.name not in best or key < best[head.name][:2]:
            best[head.name] = (*key, head)
    return {name: best[name][2] for name in heads}


def choose(rows: DataFrame, head: str, grid: Sequence[float] | None = None, cfg: AuditConfig = DEFAULTS) -> Head:
    """Fit every regularisation on train, keep the lowest validation error."""
    return choose_many(rows, [head], grid, cfg)[head]


class TestReadTwice(RuntimeError):
    """A configuration already has its one test score."""


def score_test_once(head: Head, rows: DataFrame, ledger: str, run: str) -> DataFrame:
    """Score the test split and record the read; a second read is refused."""
    spark = rows.sparkSession
    path = f"{ledger.rstrip('/')}/run={run}"
    result = score(head, rows.where("split = 'test'"))
    try:
        result.write.mode("errorifexists").parquet(path)
    except Exception as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise TestReadTwice(f"the test split of run {run!r} was already scored") from error
        raise
    return spark.read.parquet(path)


def cross_site(rows: DataFrame, head: str, pairs: Sequence[tuple[str, str]], regularisation: float = 0.01, cfg: AuditConfig = DEFAULTS) -> DataFrame:
    """Fit on one site and predict another, in every listed direction.

    There are no validation rows at the test site, so nothing is selected. All sites
    are fitted together, and each training site's head scores its test sites in one go.
    """
    columns = tuple(range(_width(rows)))
    sites = list(dict.fromkeys(a for a, _ in pairs))
    parts = []
    for model in _heads(rows, [Spec(a, head, regularisation, columns, a) for a in sites], "site", cfg):
        a = model.solution.spec.group
        tested = model.predict(rows.where(F.col("site").isin([y for x, y in pairs if x == a])))
        parts.append(
            tested.select(
                F.lit(head).alias("head"), F.concat(F.lit(f"{a}->"), F.col("site")).alias("fold"), F.lit(a).alias("train_site"),
                F.col("site").alias("test_site"), F.col("y").alias("y_true"), "y_pred", "sex",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the sweep over configurations -------------------------------------------------


def side_by_side(stacked: DataFrame, widths: Mapping[str, int], row_id: str = "id") -> tuple[DataFrame, dict[str, tuple[int, ...]]]:
    """Feature tables of many keys, stacked as (id, cache_key, features), as one array per id.

    Returns that table and each key's places in the array. An id without a table's row
    has missing values there, so it is no row of the candidates that read it. One shuffle.
    """
    names = sorted(widths)
    places, at = {}, 0
    for name in names:
        places[name] = tuple(range(at, at + widths[name]))
        at += widths[name]
    blocks = [F.first(F.when(F.col("cache_key") == name, F.col("features")), ignorenulls=True) for name in names]
    filled = [F.coalesce(b, F.array_repeat(F.lit(None).cast("double"), widths[name])) for name, b in zip(names, blocks)]
    return stacked.groupBy(row_id).agg(F.concat(*filled).alias("features")), places


def sweep_grid(
    rows: DataFrame, places: Mapping[str, Sequence[int]], head: str = "regression", grid: Sequence[float] | None = None, cfg: AuditConfig = DEFAULTS
) -> tuple[DataFrame, dict[str, Head]]:
    """Fit every configuration on train and measure it on validation; the test split is not read.

    ``places`` has the feature columns of each extraction key; hybrid ones are those of
    its deep and colour parts. Returns a row per configuration, with the best
    regularisation of each, and the fitted heads by label.
    """
    spark = rows.sparkSession
    candidates = [r.asDict() for r in W.grid(spark, head).collect()]
    missing = sorted({c["cache_key"] for c in candidates} - set(places))
    if missing:
        raise KeyError(f"no features for {missing}: extract them first")
    specs = [Spec(c["label"], head, g, tuple(places[c["cache_key"]])) for c in candidates for g in grid or cfg.regularisations]
    fits = _heads(rows.where("split = 'train'"), specs, "split", cfg)
    scores = score_many(rows.where("split = 'val'"), [f.solution for f in fits])
    best: dict[str, tuple[float, float, Head, dict[str, float]]] = {}
    for model, s in zip(fits, scores):
        label = model.solution.spec.name
        key = (float("inf") if s["mae"] is None else s["mae"], model.regularisation)
        if label not in best or key < best[label][:2]:
            best[label] = (*key, model, s)
    table = []
    for c in candidates:
        _, _, model, s = best[c["label"]]
        table.append((c["label"], c["kind"], c["roi"], c["balance"], head, len(model.solution.spec.columns), model.regularisation, model.solution.n, s["n"], s["mae"], s["r2"], model.converged))
    schema = "label string, kind string, roi string, balance string, head string, feature_dim int, regularisation double, n_train long, n_val long, val_mae double, val_r2 double, converged boolean"
    return spark.createDataFrame(table, schema), {label: b[2] for label, b in best.items()}


def finish_sweep(table: DataFrame, heads: Mapping[str, Head], rows: DataFrame, ledger: str, metric: str = "mae") -> DataFrame:
    """Select on validation, then score the winner's test split once.

    One row per configuration, best first; the winner's row has the test columns.
    """
    if not table.where(F.col(f"val_{metric}").isNotNull()).take(1):
        raise ValueError(f"no configuration has a finite validation {metric}")
    best = W.winner(table, metric).first()
    test = score_test_once(heads[best["label"]], rows, ledger, best["label"].replace(" / ", "-"))
    own = test.select(F.lit(True).alias("selected"), F.col("n").alias("n_test"), F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"), F.col("r2").alias("test_r2"))
    return W.ranked(table, metric).join(own, "selected", "left")
