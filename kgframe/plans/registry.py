"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgframe.sources import bind

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The bound tables as SQL; engines leave out what a query doesn't use.
BASE = ",\n".join(x.strip() for x in (bind.TRIPLES_SQL, bind.EDGES_SQL, bind.NODES_SQL, bind.OBS_SQL, bind.RULES_SQL, bind.FLOWS_SQL, bind.EVENTS_SQL))
BASE += """,
series AS (
  SELECT variable, entity, import_name, provenance_url, measurement_method, observation_period, scaling_factor, unit, provenance,
         count(*) AS obs_count, min(date) AS earliest, max(date) AS latest
  FROM obs GROUP BY ALL
),
scored AS (
  SELECT s.*, coalesce((
    SELECT score FROM rules r
    WHERE r.import_name = s.import_name AND coalesce(r.measurement_method = s.measurement_method, true)
      AND coalesce(r.observation_period = s.observation_period, true) AND coalesce(r.unit = s.unit, true)
    ORDER BY (r.measurement_method IS NOT NULL)::INT + (r.observation_period IS NOT NULL)::INT + (r.unit IS NOT NULL)::INT DESC, score LIMIT 1), 100) AS score
  FROM series s
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY variable, entity ORDER BY score, latest DESC, obs_count DESC, measurement_method, observation_period, scaling_factor, unit, provenance_url, import_name) AS facet_rank
  FROM scored
),
closure AS (
  SELECT subject_id AS child, object_id AS ancestor, 1 AS depth FROM edges WHERE predicate = 'containedInPlace'
  UNION ALL SELECT c.child, e.object_id, c.depth + 1 FROM (
    SELECT subject_id AS child, object_id AS ancestor, 1 AS depth FROM edges WHERE predicate = 'containedInPlace'
  ) c JOIN edges e ON e.subject_id = c.ancestor AND e.predicate = 'containedInPlace'
  UNION ALL SELECT a.subject_id, c.object_id, 3 FROM edges a JOIN edges b ON a.object_id = b.subject_id AND b.predicate = 'containedInPlace' AND a.predicate = 'containedInPlace'
    JOIN edges c ON b.object_id = c.subject_id AND c.predicate = 'containedInPlace'
)"""


def _sparse(base: str) -> str:
    """The bound tables with nulls in the facet's columns, which are equal to each other and come first in order."""
    base = base.replace("'' AS unit, '' AS scaling_factor", "NULL::VARCHAR AS unit, NULL::VARCHAR AS scaling_factor").replace("l_returnflag AS measurement_method", "nullif(l_returnflag, 'N') AS measurement_method")
    for c in ("measurement_method", "observation_period", "unit"):
        base = base.replace(f"coalesce(r.{c} = s.{c}, true)", f"(r.{c} IS NULL OR r.{c} IS NOT DISTINCT FROM s.{c})")
    order = "measurement_method, observation_period, scaling_factor, unit, provenance_url, import_name"
    return base.replace(f"obs_count DESC, {order}", "obs_count DESC, " + ", ".join(f"{c} NULLS FIRST" for c in order.split(", ")))


SPARSE = _sparse(BASE)


def query(name: str, sql: str | None = None, base: bool = True, sparse: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``sql`` continues the bound tables' WITH clause (a CTE list ends in a SELECT), with nulls
    in the facet's columns if ``sparse``."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            SQL[name] = (f"WITH {SPARSE if sparse else BASE}{',' if not text.upper().startswith('SELECT') else ''}\n{text}") if base else text
        return f

    return put


def load_all() -> None:
    from importlib import import_module
    from pkgutil import iter_modules

    import kgframe.plans as plans

    for m in sorted(iter_modules(plans.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            import_module(f"kgframe.plans.{m.name}")
