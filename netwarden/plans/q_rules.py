"""Registered queries: detection rules and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.operators.rules import fuse_verdict
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.registry import register


@register("rule_hits", sql("""
SELECT flow_id, coalesce(rule_id, 0) AS rule_id, rule_name AS name, rule_severity AS severity, rule_score AS score
FROM fl_hits""", "fl_hits"))
def rule_hits(spark, sf_dir):
    """First matching rule per flow (nulls when none)."""
    hits = views.flow_hits(spark, sf_dir)
    return hits.select("flow_id", F.coalesce("rule_id", F.lit(0)).alias("rule_id"), F.col("rule_name").alias("name"),
                       F.col("rule_severity").alias("severity"), F.col("rule_score").alias("score"))


@register("rule_hit_counts", sql("""
SELECT coalesce(rule_id, 0) AS rule_id, count(*) AS n FROM fl_hits GROUP BY 1""", "fl_hits"))
def rule_hit_counts(spark, sf_dir):
    """First-match counts per rule (0 = no rule)."""
    hits = views.flow_hits(spark, sf_dir)
    return hits.groupBy(F.coalesce("rule_id", F.lit(0)).alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


@register("fuse_verdict", sql("""
SELECT flow_id, p_attack, stage, verdict, family, family_conf, final_source, ml_verdict
FROM events_scored""", "events_scored"))
def fuse(spark, sf_dir):
    """C11: verdict fusion of rule hit and routed model."""
    ev = views.events_scored(spark, sf_dir)
    return ev.select("flow_id", "p_attack", "stage", "verdict", "family", "family_conf", "final_source",
                     "ml_verdict")


@register("fuse_rules_only", sql("""
SELECT flow_id,
  CAST(CASE WHEN rule_severity = 'high' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS p_attack,
  CASE WHEN rule_id IS NOT NULL THEN 'rule' ELSE 'none' END AS stage,
  CASE WHEN rule_severity = 'high' THEN 'attack' WHEN rule_id IS NOT NULL THEN 'suspicious' ELSE 'benign' END AS verdict,
  CASE WHEN rule_id IS NOT NULL THEN 'rule-only' ELSE 'none' END AS final_source
FROM fl_hits""", "fl_hits"))
def fuse_rules_only(spark, sf_dir):
    """C11 without a model: suspicious on any rule, attack on a high rule."""
    ev = fuse_verdict(views.flow_hits(spark, sf_dir), model_pred=None)
    return ev.select("flow_id", "p_attack", "stage", "verdict", "final_source")
