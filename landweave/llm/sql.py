"""DuckDB SQL of the training-data queries that SQL can express."""

_P1 = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT DISTINCT record_id_a AS u, record_id_b AS v FROM match_pair
  WHERE is_match AND record_id_a <> record_id_b AND record_id_a <> '' AND record_id_b <> ''
  UNION SELECT DISTINCT record_id_b, record_id_a FROM match_pair
  WHERE is_match AND record_id_a <> record_id_b AND record_id_a <> '' AND record_id_b <> ''),
low AS MATERIALIZED (SELECT u AS x, least(u, min(v)) AS m FROM e GROUP BY u),
r(x, y) AS (SELECT m, x FROM low UNION SELECT r.x, e.v FROM r JOIN e ON r.y = e.u),
g AS (SELECT y AS record_id, min(x) AS group_id FROM r GROUP BY y)
"""

ORACLE: dict[str, str] = {
    "p1_found": _P1 + "SELECT record_id, group_id FROM g",
    "p1_group_sizes": _P1 + "SELECT records, count(*) AS groups FROM (SELECT group_id, count(*) AS records FROM g GROUP BY group_id) GROUP BY records",
}
