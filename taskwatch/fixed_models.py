"""Queries that run the model operators on a small fixed forest and a fixed
linear projection instead of fitted ones, so that SQL can restate every score,
flag and explanation (I2, I4, I5, R4, R6, R7, M17), and the nested result (E8).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from taskwatch import catalog_sql as S
from taskwatch.catalog import rounded, scored, tasks
from taskwatch.config import Params
from taskwatch.operators.ensemble import nested_result
from taskwatch.operators.explain import explanation_rows, top_feature_summary
from taskwatch.operators.forest import ForestModel
from taskwatch.operators.reconstruct import ReconstructionModel
from taskwatch.plans.detector import DetectorModel

FEATURES = ["planned_minutes", "actual_minutes", "snag_count"]
# tree, node, feature (-1: leaf), threshold, left, right, size, depth, value
NODES = pd.DataFrame([
    (0, 0, 1, 300.0, 1, 2, 256, 0, 8.0),
    (0, 1, -1, 0.0, 0, 0, 200, 1, 9.0),
    (0, 2, 2, 5.0, 3, 4, 56, 1, 6.0),
    (0, 3, -1, 0.0, 0, 0, 50, 2, 6.5),
    (0, 4, -1, 0.0, 0, 0, 6, 2, 3.0),
    (1, 0, 0, 150.0, 1, 2, 256, 0, 8.0),
    (1, 1, -1, 0.0, 0, 0, 100, 1, 7.5),
    (1, 2, -1, 0.0, 0, 0, 156, 1, 8.5),
], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth", "value"])


def model() -> DetectorModel:
    forest = ForestModel.from_nodes(NODES, FEATURES, 256)
    recon = ReconstructionModel(FEATURES, np.array([101.0, 120.5, 1.0]), np.array([[0.6], [0.8], [0.0]]))
    return DetectorModel(Params(top_k=2), FEATURES, forest, recon, 0.55, 400.0,
                         {"if_score": (0.4, 0.8), "ae_score": (0.0, 5000.0)})


def _scored(spark, sf) -> DataFrame:
    return model().score(tasks(spark, sf))


def q_fixed_scores(spark, sf):
    return rounded(_scored(spark, sf).select("task_id", "if_score", "if_flag", "ae_score", "ae_flag"))


def _explained(spark, sf) -> DataFrame:
    return explanation_rows(model().explain(tasks(spark, sf)))


def q_fixed_explanations(spark, sf):
    return rounded(_explained(spark, sf))


def q_fixed_contributions(spark, sf):
    return rounded(top_feature_summary(_explained(spark, sf), 10))


def q_nested_results(spark, sf):
    """E8 on the rule scores, read back field by field."""
    r = nested_result(scored(spark, sf))
    return rounded(r.select(
        "task_id", "result.anomaly_flag", "result.anomaly_score",
        F.col("result.model_scores.isolation_forest").alias("if_score"), F.col("result.model_scores.autoencoder").alias("ae_score"),
        F.col("result.model_flags.isolation_forest").alias("if_flag"), F.col("result.model_flags.autoencoder").alias("ae_flag")))


def q_nested_explained(spark, sf):
    """E8 with explanations, on the fixed model, read back from the nested
    result: one row per task, model and rank."""
    r = model().results(tasks(spark, sf))
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"result.explainability.{m}").alias("top"))
                            for m in ("isolation_forest", "autoencoder")]))
    cells = r.select("task_id", "result", e.alias("e")).select(
        "task_id", "result", "e.model", F.posexplode("e.top").alias("rank", "c"))
    return rounded(cells.select(
        "task_id", "result.anomaly_flag", "result.anomaly_score",
        F.col("result.model_scores.isolation_forest").alias("if_score"), F.col("result.model_scores.autoencoder").alias("ae_score"),
        F.col("result.model_flags.isolation_forest").alias("if_flag"), F.col("result.model_flags.autoencoder").alias("ae_flag"),
        "model", (F.col("rank") + 1).alias("rank"), "c.feature", "c.contribution", "c.signed_contribution"))


FIXED_QUERIES = {
    "fixed_scores": q_fixed_scores,
    "fixed_explanations": q_fixed_explanations,
    "fixed_contributions": q_fixed_contributions,
    "nested_results": q_nested_results,
    "nested_explained": q_nested_explained,
}

_C = "(2 * (ln({0} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2 * ({0} - 1.0::DOUBLE) / {0})"

_BASE = f"""
x AS (
  SELECT task_id, CAST(planned_minutes AS DOUBLE) AS p, CAST(actual_minutes AS DOUBLE) AS a, CAST(snag_count AS DOUBLE) AS s FROM tasks),
y AS (
  SELECT *, p - 101.0::DOUBLE AS dp, a - 120.5::DOUBLE AS da, s - 1.0::DOUBLE AS ds,
         0.6::DOUBLE * (p - 101.0::DOUBLE) + 0.8::DOUBLE * (a - 120.5::DOUBLE) AS z,
         CASE WHEN a <= 300 THEN 1 + {_C.format(200)} WHEN s <= 5 THEN 2 + {_C.format(50)} ELSE 2 + {_C.format(6)} END AS h0,
         CASE WHEN p <= 150 THEN 1 + {_C.format(100)} ELSE 1 + {_C.format(156)} END AS h1 FROM x),
m AS (
  SELECT *, dp - 0.6::DOUBLE * z AS r0, da - 0.8::DOUBLE * z AS r1, ds AS r2,
         pow(2.0::DOUBLE, -((h0 + h1) / 2) / {_C.format(256)}) AS if_score,
         CASE WHEN p <= 150 THEN -0.25 ELSE 0.25 END AS c0, CASE WHEN a <= 300 THEN 0.5 ELSE -1.0 END AS c1,
         CASE WHEN a <= 300 THEN 0.0 WHEN s <= 5 THEN 0.25 ELSE -1.5 END AS c2 FROM y)"""

_CELLS = """
cells AS (
  SELECT task_id, 'isolation_forest' AS model, unnest(['planned_minutes', 'actual_minutes', 'snag_count']) AS feature,
         unnest([0, 1, 2]) AS i, unnest([c0, c1, c2])::DOUBLE AS contribution, unnest([c0, c1, c2])::DOUBLE AS signed_contribution FROM m
  UNION ALL
  SELECT task_id, 'autoencoder', unnest(['planned_minutes', 'actual_minutes', 'snag_count']), unnest([0, 1, 2]),
         unnest([abs(r0), abs(r1), abs(r2)]), unnest([r0, r1, r2]) FROM m),
top AS (
  SELECT *, row_number() OVER (PARTITION BY task_id, model ORDER BY abs(contribution) DESC, i) AS rank FROM cells
  QUALIFY rank <= 2)"""


def oracle() -> dict[str, str]:
    return {
        "fixed_scores": S.with_ctes(S.TASKS, _BASE, body="""
SELECT task_id, round(if_score, 6) + 0.0 AS if_score, CAST(if_score > 0.55 AS INTEGER) AS if_flag,
       round((r0 * r0 + r1 * r1 + r2 * r2) / 3, 6) + 0.0 AS ae_score,
       CAST((r0 * r0 + r1 * r1 + r2 * r2) / 3 > 400 AS INTEGER) AS ae_flag FROM m"""),
        "fixed_explanations": S.with_ctes(S.TASKS, _BASE, _CELLS, body="""
SELECT task_id, model, CAST(rank AS INTEGER) AS rank, feature, round(contribution, 6) + 0.0 AS contribution,
       round(signed_contribution, 6) + 0.0 AS signed_contribution FROM top"""),
        "fixed_contributions": S.with_ctes(S.TASKS, _BASE, _CELLS, body="""
SELECT model, feature, round(mean_abs, 6) + 0.0 AS mean_abs_contribution, n,
       CAST(row_number() OVER (PARTITION BY model ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank
FROM (SELECT model, feature, avg(abs(contribution)) AS mean_abs, count(*) AS n FROM top GROUP BY model, feature)"""),
        "nested_explained": S.with_ctes(S.TASKS, _BASE, _CELLS, """
rs AS (
  SELECT task_id, if_score, (r0 * r0 + r1 * r1 + r2 * r2) / 3 AS ae_score, CAST(if_score > 0.55 AS INTEGER) AS if_flag,
         CAST((r0 * r0 + r1 * r1 + r2 * r2) / 3 > 400 AS INTEGER) AS ae_flag FROM m)""", S.ensemble_cte(
            ranges="SELECT 0.4::DOUBLE AS if_lo, 0.8::DOUBLE AS if_hi, 0.0::DOUBLE AS ae_lo, 5000.0::DOUBLE AS ae_hi"), body="""
SELECT task_id, anomaly_flag, round(anomaly_score, 6) + 0.0 AS anomaly_score, round(if_n, 6) + 0.0 AS if_score,
       round(ae_n, 6) + 0.0 AS ae_score, if_flag, ae_flag, model, CAST(rank AS INTEGER) AS rank, feature,
       round(contribution, 6) + 0.0 AS contribution, round(signed_contribution, 6) + 0.0 AS signed_contribution
FROM scored JOIN top USING (task_id)"""),
        "nested_results": S.with_ctes(S.TASKS, S.ROW_FEATURES, S.RULE_SCORES_CTE, S.ensemble_cte(), body="""
SELECT task_id, anomaly_flag, round(anomaly_score, 6) + 0.0 AS anomaly_score, round(if_n, 6) + 0.0 AS if_score,
       round(ae_n, 6) + 0.0 AS ae_score, if_flag, ae_flag FROM scored"""),
    }
