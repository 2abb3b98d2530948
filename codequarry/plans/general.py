"""Queries of the general problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.operators import heavy_keys, orphans
from codequarry.session import read_table as T


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(T(spark, d, t) for t in ("relationships", "entities", "entity_removals", "external_symbols"))


QUERIES = {
    "p1_found": lambda s, d: orphans.orphan_rows(*_p1(s, d)),
    "p1_orphan_report": lambda s, d: orphans.orphan_report(*_p1(s, d)),
    "p4_found": lambda s, d: heavy_keys.heavy_counts(T(s, d, "relationships")).select("target_id", "type"),
    "p4_pair_stats": lambda s, d: heavy_keys.pair_stats(T(s, d, "relationships")),
}

_CLEAN = "nullif(nfc_normalize(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"
_S, _T, _I, _E = (_CLEAN.format(c) for c in ("source_id", "target_id", "id", "entity_id"))

_ORPHANS = f"""
WITH refs AS (
  SELECT id AS relationship_id, 'source' AS side, {_S} AS ref, created_at AS seen_at FROM relationships
  UNION ALL SELECT id, 'target', {_T}, created_at FROM relationships),
ent AS (SELECT DISTINCT {_I} AS ref, created_at AS born FROM entities),
rem AS (SELECT DISTINCT {_E} AS ref, removed_at AS gone FROM entity_removals),
ext AS (SELECT {_I} AS ref FROM external_symbols),
spans AS (SELECT e.ref, e.born, min(r.gone) AS gone FROM ent e LEFT JOIN rem r ON r.ref = e.ref AND r.gone >= e.born GROUP BY 1, 2),
orphan AS (
  SELECT relationship_id, side, seen_at FROM refs f WHERE ref IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM ext x WHERE x.ref = f.ref)
  AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.ref = f.ref AND (f.seen_at IS NULL OR (s.born <= f.seen_at AND (s.gone IS NULL OR s.gone > f.seen_at)))))
"""

_PAIRS = f"""
WITH r AS (SELECT {_T} AS target_id, type, {_S} AS source_id, confidence FROM relationships),
p AS (SELECT target_id, type, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources,
  round(avg(confidence), 6) AS mean_confidence FROM r WHERE target_id IS NOT NULL GROUP BY 1, 2)
"""

SQL = {
    "p1_found": _ORPHANS + "SELECT DISTINCT relationship_id, side FROM orphan",
    "p1_orphan_report": _ORPHANS + "SELECT side, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans FROM (SELECT DISTINCT * FROM orphan) GROUP BY 1, 2",
    "p4_found": _PAIRS + "SELECT target_id, type FROM p WHERE n_rows >= 0.02 * (SELECT count(*) FROM relationships)",
    "p4_pair_stats": _PAIRS + "SELECT * FROM p",
}
