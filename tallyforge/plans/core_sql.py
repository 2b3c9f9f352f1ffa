"""SQL of the pairwise count model, for other engines to run on the same tables."""

from __future__ import annotations


def with_core(table: str, features: list[str], label: str, resol: int, key: str | None = None) -> str:
    """CTEs r, u, pairs, net, tot, score, pred (row_id, k, y) and post (row_id, k, p), without WITH."""
    row_id = key or "row_number() OVER ()"
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(features))
    ends = ", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in ((i, f"x{i}") for i in range(len(features))))
    unpivot = " UNION ALL ".join(
        f"SELECT row_id, y, {i} AS i, CASE WHEN hi{i} > lo{i} THEN CAST(least({resol}, greatest(0, floor((x{i} - lo{i}) / (hi{i} - lo{i}) * {resol} + 0.5))) AS INT) ELSE 0 END AS b FROM r, bins"
        for i in range(len(features))
    )
    return f"""
classes AS (SELECT {label} AS name, CAST(row_number() OVER (ORDER BY {label}) AS INT) AS k FROM (SELECT DISTINCT {label} FROM {table} WHERE {label} IS NOT NULL)),
r AS (SELECT {row_id} AS row_id, {cols}, c.k AS y FROM {table} t JOIN classes c ON t.{label} = c.name),
bins AS (SELECT {ends} FROM r),
u AS ({unpivot}),
pairs AS (SELECT a.row_id, a.y, a.i, a.b AS bi, b.i AS l, b.b AS bl FROM u a JOIN u b ON a.row_id = b.row_id AND a.i < b.i),
net AS (SELECT i, bi, l, bl, y AS k, count(*) AS cnt FROM pairs GROUP BY ALL),
tot AS (SELECT i, bi, l, bl, sum(cnt) AS n FROM net GROUP BY ALL),
cells AS (
  SELECT t.i, t.bi, t.l, t.bl, c.k, ln((coalesce(n.cnt, 0) + 1) / (t.n + (SELECT count(*) FROM classes))) AS s
  FROM tot t CROSS JOIN classes c LEFT JOIN net n ON n.i = t.i AND n.bi = t.bi AND n.l = t.l AND n.bl = t.bl AND n.k = c.k
),
score AS (
  SELECT p.row_id, p.y, c.k, sum(c.s) AS s FROM pairs p JOIN cells c ON p.i = c.i AND p.bi = c.bi AND p.l = c.l AND p.bl = c.bl GROUP BY ALL
),
pred AS (SELECT row_id, y, k AS p FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(s, 9) DESC, k) AS rn FROM score) WHERE rn = 1),
post AS (SELECT row_id, y, k, exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w AS p FROM (SELECT *, max(s) OVER (PARTITION BY row_id) AS m FROM score) WINDOW w AS (PARTITION BY row_id))
"""
