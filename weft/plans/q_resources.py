"""Catalog entries: resource admission and utilization."""

from weft.operators import resources as rsc
from weft.plans.catalog import query, with_ctes

ADMISSION_SQL = """lg AS (
  SELECT l.seq, l.resource_id, l.agent_id, l.action, r.max_concurrent,
         row_number() OVER (PARTITION BY l.resource_id ORDER BY l.seq) AS rn
  FROM rl l LEFT JOIN rs r ON l.resource_id = r.resource_id),
sim AS (
  SELECT resource_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS holders,
         CAST(NULL AS VARCHAR) AS outcome
  FROM (SELECT DISTINCT resource_id FROM lg)
  UNION ALL
  SELECT g.resource_id, g.rn,
         CASE WHEN g.action = 'request' AND g.max_concurrent IS NOT NULL
                   AND len(s.holders) < g.max_concurrent THEN list_append(s.holders, g.agent_id)
              WHEN g.action = 'release' AND g.max_concurrent IS NOT NULL
                   AND list_contains(s.holders, g.agent_id)
                THEN list_concat(s.holders[1:list_position(s.holders, g.agent_id) - 1],
                                 s.holders[list_position(s.holders, g.agent_id) + 1:])
              ELSE s.holders END,
         CASE WHEN g.action = 'request' THEN
                CASE WHEN g.max_concurrent IS NOT NULL AND len(s.holders) < g.max_concurrent
                     THEN 'granted' ELSE 'denied' END
              ELSE CASE WHEN g.max_concurrent IS NOT NULL AND list_contains(s.holders, g.agent_id)
                        THEN 'released' ELSE 'ignored' END END
  FROM sim s JOIN lg g ON g.resource_id = s.resource_id AND g.rn = s.rn + 1),
adm AS (
  SELECT g.seq, g.resource_id, g.agent_id, g.action, s.outcome,
         CAST(len(s.holders) AS INTEGER) AS holders_after
  FROM sim s JOIN lg g ON g.resource_id = s.resource_id AND g.rn = s.rn WHERE s.rn > 0)"""


def _admission(m):
    return rsc.resource_admission(m.resource_log(), m.resources())


@query("resource_admission", "WITH RECURSIVE " + with_ctes(["rl", "rs"], "SELECT * FROM adm",
                                                          [ADMISSION_SQL])[5:])
def q_resource_admission(m):
    return _admission(m)


@query("resource_utilization", "WITH RECURSIVE " + with_ctes(["rl", "rs"], """
SELECT a.resource_id, CAST(count(*) FILTER (WHERE outcome = 'granted')
                          - count(*) FILTER (WHERE outcome = 'released') AS BIGINT) AS current_users,
       r.max_concurrent,
       CASE WHEN r.max_concurrent = 0 THEN NULL ELSE
         CAST(count(*) FILTER (WHERE outcome = 'granted') - count(*) FILTER (WHERE outcome = 'released') AS DOUBLE)
         / CAST(r.max_concurrent AS DOUBLE) END AS utilization
FROM adm a JOIN rs r ON a.resource_id = r.resource_id
GROUP BY a.resource_id, r.max_concurrent
HAVING count(*) FILTER (WHERE action = 'request') > 0""", [ADMISSION_SQL])[5:])
def q_resource_utilization(m):
    return rsc.resource_utilization(_admission(m), m.resources())
