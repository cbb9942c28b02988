"""DuckDB texts of the views in ``rasterloom.sources.bindings``, for the oracles."""

PX = """px AS (SELECT event_id // 2500 AS img, ((event_id % 2500) // 50)::INT AS y, (event_id % 50)::INT AS x,
  round(value * 100)::INT AS g FROM events)"""
FPX = PX + """,
fpx AS (SELECT *, g >= 7000 AS fiber, y >= 10 AND y < 45 AS zone, CASE WHEN g >= 7000 THEN (g % 180)::DOUBLE END AS theta FROM px)"""
PATCH = """patch AS (SELECT vec_id AS img, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v, label
  FROM embeddings, unnest(range(1, 65)) AS t(i))"""
TILE = """wide AS (SELECT l_suppkey % 9 AS tile, count(*)::DOUBLE AS fiber, count(*) * 3::DOUBLE AS region, sum(l_quantity) AS len,
  avg(l_discount) AS op, max(l_quantity) AS gmax, avg(l_quantity) AS gmean, count(DISTINCT l_partkey)::DOUBLE AS gn,
  count(DISTINCT l_suppkey)::DOUBLE AS win FROM lineitem GROUP BY 1)"""
RECT = """rect AS (SELECT s_suppkey % 4 AS img, s_suppkey AS id, (s_nationkey % 3)::BIGINT AS class, ((s_suppkey * 13) % 40)::INT AS x0,
  ((s_suppkey * 29) % 40)::INT AS y0, ((s_suppkey * 13) % 40 + 5 + s_nationkey % 6)::INT AS x1,
  ((s_suppkey * 29) % 40 + 5 + s_suppkey % 6)::INT AS y1 FROM supplier)"""
TRAIN = """ord AS (SELECT o_custkey, count(*)::DOUBLE AS f1, sum(o_totalprice) AS f2 FROM orders GROUP BY 1),
train AS (SELECT c_custkey AS row, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, c_acctbal AS f3,
  (ascii(c_mktsegment) % 5)::BIGINT AS y, (c_nationkey % 8)::BIGINT AS grp,
  ((c_nationkey * 5 + ascii(c_mktsegment) % 5) * 3 + c_custkey % 3)::BIGINT AS ann
  FROM customer LEFT JOIN ord ON o_custkey = c_custkey)"""
_W = [f"((row * {3 + 2 * k} + {k * k}) % 11 + 1)" for k in range(5)]
PRED = TRAIN + f""",
pred AS (SELECT row, y, grp, ann, (row * 7) % 5 AS pred,
  {", ".join(f"{w} / ({' + '.join(_W)})::DOUBLE AS p{k}" for k, w in enumerate(_W))},
  (row % 997) / 997.0::DOUBLE AS novelty_p FROM train)"""
