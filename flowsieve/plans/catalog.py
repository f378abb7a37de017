"""All registered queries, and the flagship one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.operators import alerts as al, engineer as en, flows as fl
from flowsieve.plans import (  # noqa: F401  (importing registers)
    clean_queries, feature_queries, flow_queries, metric_queries, model_queries, sequence_queries, source_queries, temporal_queries,
)
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import ORACLES, QUERIES, query, st
from flowsieve.session import materialize

__all__ = ["ORACLES", "QUERIES", "flagship"]

# weight of each attack sign in the score
SIGNS = {"portScanSignature": 0.4, "ddosSignature": 0.3, "exfiltrationSignature": 0.2, "bruteForceSignature": 0.1}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Packets to flow features, attack signs, risk and alert rows."""
    features = materialize(fl.flow_profile(v.packets(spark, sf)), "flow-profile")
    flagged = en.apply_flags(features, en.fit_flags(features), ["attack"])
    score = sum((F.col(c) * w for c, w in SIGNS.items()), F.lit(0.0))
    scored = al.with_risk(flagged.withColumn("threat_score", F.round(score, 6)), "threat_score")
    alerts = scored.where(F.col("risk_level") != "low")
    return settle(alerts.select("flow_id", "pktCount", "totalBytes", "threat_score", "risk_level", "recommendation"))


_SIGN_SQL = """round(0.4 * CAST("uniquePorts" > 10 AS INTEGER) + 0.3 * CAST("pktsPerSec" > "pktsPerSec_95" AND "pktCount" > "pktCount_90" AS INTEGER)
 + 0.2 * CAST("totalBytes" > "totalBytes_90" AND "flowDuration" > "flowDuration_80" AS INTEGER) + 0.1 * CAST("fwdBwdRatio" > 2 AND "pktCount" > "pktCount_50" AS INTEGER), 6)"""

query("flow_alerts", f"""WITH {feature_queries.FEAT}, {feature_queries._LIM}, s AS (SELECT flow_id, "pktCount", "totalBytes", {_SIGN_SQL} AS sc FROM feat, lim)
SELECT flow_id, "pktCount", {st('"totalBytes"')} AS "totalBytes", {st('sc')} AS threat_score, CASE WHEN sc >= 0.8 THEN 'critical' WHEN sc >= 0.6 THEN 'high' ELSE 'medium' END AS risk_level,
 CASE WHEN sc < 0.5 THEN 'Monitor traffic' ELSE 'Block connection' END AS recommendation FROM s WHERE sc >= 0.3""")(flagship)
