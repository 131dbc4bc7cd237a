"""Queries that fit heads: on one split, across sites, and over all configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS
from assaymill.functions.names import ROIS
from assaymill.operators import heads as H
from assaymill.operators import tables as B
from assaymill.operators import training as T
from assaymill.operators.sweep import BALANCES
from assaymill.plans.registry import published, query, r
from assaymill.plans.views import FEATURES, View
from assaymill.session import shared_folder, written

READY = [f"f{i}" for i in range(1, 14) if i != 5]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    df = T.standardise(FEATURES.frame(spark, sf), READY)
    return df.select("id", "site", "sex", "split", "y", F.array(*READY).alias("features"))


@query("head_fits", "L1 L2 L3 L4 L5: chosen on validation, test scored once")
def head_fits(spark: SparkSession, sf: str) -> DataFrame:
    rows, ledger = written(_features(spark, sf)), shared_folder(spark)
    parts = [H.score_test_once(head, rows, ledger, name) for name, head in H.choose_many(rows).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return published(out, 4)


@query("cross_site_fit", "L6 A46: both directions of a site holdout")
def cross_site_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(_features(spark, sf))
    scored = H.cross_site(rows, "regression", [("north", "south"), ("south", "north")])
    means = rows.groupBy("site").agg(F.avg("y").alias("mean"))
    return published(B.holdout_table(scored, means), 4)


# --- all configurations ------------------------------------------------------------

# A feature table per extraction key: six deep columns per region, five colours per
# region and balance. One patient in eleven has no photograph of one region.
_E = "cast(element_at(embedding, {}) as double)"
TABLES: dict[str, list[str]] = {}
for _k, _roi in enumerate(ROIS):
    TABLES[f"deep/{_roi}/balanced"] = [_E.format(1 + 6 * _k + i) for i in range(6)]
    TABLES[f"colour/{_roi}/raw"] = [_E.format(20 + 5 * _k + i) for i in range(5)]
    TABLES[f"colour/{_roi}/balanced"] = [f"{_E.format(20 + 5 * _k + i)} + {_E.format(40 + 5 * _k + i)} / 4" for i in range(5)]
LACKS = {"forniceal": "vec_id % 11 = 4"}

PATIENTS = View(
    source="embeddings",
    columns={
        "id": "vec_id",
        "sex": FEATURES.columns["sex"],
        "split": FEATURES.columns["split"],
        "y": FEATURES.columns["y"],
        **{f"t{k}": f"array({', '.join(columns)})" for k, columns in enumerate(TABLES.values())},
        **{f"no_{roi}": test for roi, test in LACKS.items()},
    },
)


def _roi(key: str) -> str:
    return key.split("/")[1]


def _sweep_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, tuple[int, ...]]]:
    patients = PATIENTS.frame(spark, sf)
    tables = F.array(*[F.struct(F.lit(key).alias("cache_key"), F.col(f"t{k}").alias("features")) for k, key in enumerate(TABLES)])
    stacked = patients.select("id", *[f"no_{roi}" for roi in LACKS], F.inline(tables))
    for roi in LACKS:
        stacked = stacked.where(~(F.col(f"no_{roi}") & (F.split("cache_key", "/")[1] == roi)))
    wide, places = H.side_by_side(stacked.select("id", "cache_key", "features"), {key: len(columns) for key, columns in TABLES.items()})
    for roi in ROIS:
        for balance in BALANCES:
            places[f"hybrid/{roi}/{balance}"] = places[f"deep/{roi}/balanced"] + places[f"colour/{roi}/{balance}"]
    return written(patients.select("id", "sex", "split", "y").join(wide, "id")), places


def _sweep(spark: SparkSession, sf: str, head: str) -> DataFrame:
    rows, places = _sweep_rows(spark, sf)
    table, heads = H.sweep_grid(rows, places, head)
    done = H.finish_sweep(table, heads, rows, shared_folder(spark))
    return published(done.select("label", "feature_dim", "regularisation", "n_train", "n_val", "val_mae", "val_r2", "rank", "selected", "gap", "n_test", "test_mae", "test_rmse", "test_r2"))


@query("configuration_sweep", "L7 W13 W14 X10: all fifteen configurations and the whole grid on validation, only the winner on test")
def configuration_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf, "regression")


def _design(kind: str, roi: str, balance: str) -> str:
    columns = (TABLES[f"deep/{roi}/balanced"] if kind != "colour" else []) + (TABLES[f"colour/{roi}/{balance}"] if kind != "deep" else [])
    label = f"{kind} / {roi}" if kind == "deep" else f"{kind} / {roi} / {balance}"
    there = f" WHERE NOT ({LACKS[roi]})" if roi in LACKS else ""
    body = ", ".join(columns).replace("element_at(", "list_extract(")
    split, y = (FEATURES.columns[c].replace("element_at(", "list_extract(") for c in ("split", "y"))
    return f"SELECT '{label}' AS label, {len(columns)} AS feature_dim, {split} AS split, {y} AS y, [1.0e0, {body}] AS z FROM embeddings{there}"


RIDGE = f"""WITH RECURSIVE x AS (
    {' UNION ALL '.join(_design(k, roi, b) for roi in ROIS for k, b in (('deep', 'balanced'), *[(k, b) for k in ('colour', 'hybrid') for b in BALANCES]))}
), t AS (SELECT * FROM x WHERE split = 'train'),
i AS (SELECT label, z, y, unnest(range(1, len(z) + 1)) AS i FROM t),
ij AS (SELECT label, i, z, y, unnest(range(1, len(z) + 1)) AS j FROM i),
g AS (SELECT label, i, j, sum(z[i] * z[j]) AS v FROM ij GROUP BY ALL UNION ALL SELECT label, i, any_value(len(z)) + 1, sum(z[i] * y) FROM i GROUP BY label, i),
lam(lam) AS (VALUES {', '.join(f'({v!r}::DOUBLE)' for v in DEFAULTS.regularisations)}),
n AS (SELECT label, v AS n FROM g WHERE i = 1 AND j = 1),
mean AS (SELECT label, j AS i, v / n AS m FROM g JOIN n USING (label) WHERE g.i = 1),
p AS (
    SELECT g.label, lam, g.i, g.j, v + CASE WHEN g.i = g.j AND g.i > 1 THEN lam * n * (v / n - m * m) ELSE 0 END AS v
    FROM g JOIN n USING (label) JOIN mean ON mean.label = g.label AND mean.i = g.i CROSS JOIN lam
), rw AS (SELECT label, lam, i, list(v ORDER BY j) AS cells FROM p GROUP BY label, lam, i),
el(label, lam, k, m) AS (
    SELECT label, lam, 1, list(cells ORDER BY i) FROM rw GROUP BY label, lam
    UNION ALL
    SELECT label, lam, k + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 2), lambda j:
        CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END)) FROM el WHERE k <= len(m)
), w AS (SELECT label, lam, list_transform(m, lambda c: c[len(m) + 1]) AS w FROM el WHERE k = len(m) + 1),
e AS (
    SELECT label, lam, feature_dim, split, y, list_sum(list_transform(range(1, len(z) + 1), lambda i: z[i] * w[i])) - y AS e
    FROM x JOIN w USING (label) WHERE split <> 'train'
), s AS (
    SELECT label, lam, split, any_value(feature_dim) AS feature_dim, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / regr_syy(y, y) AS r2
    FROM e GROUP BY label, lam, split
), c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mae, lam) AS pick FROM s WHERE split = 'val'),
k AS (SELECT *, row_number() OVER (ORDER BY mae, label) AS rank, lead(mae) OVER (ORDER BY mae, label) AS next FROM c WHERE pick = 1)
SELECT k.label, k.feature_dim, {r('k.lam', 'regularisation')}, CAST(n.n AS BIGINT) AS n_train, k.n AS n_val, {r('k.mae', 'val_mae')}, {r('k.r2', 'val_r2')},
    CAST(k.rank AS INTEGER) AS rank, k.rank = 1 AS selected, {r('CASE WHEN k.rank = 1 THEN abs(k.next - k.mae) END', 'gap')},
    o.n AS n_test, {r('o.mae', 'test_mae')}, {r('o.rmse', 'test_rmse')}, {r('o.r2', 'test_r2')}
FROM k JOIN n USING (label) LEFT JOIN s o ON k.rank = 1 AND o.split = 'test' AND o.label = k.label AND o.lam = k.lam
"""


@query("ridge_sweep", "L1 L5 L7 W13 W14: fifteen configurations by closed form, the whole grid, winner scored once", RIDGE)
def ridge_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf, "ridge")
