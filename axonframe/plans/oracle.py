"""SQL of the test views, and the frame that every oracle shares: keys as they are, values rounded to 6 decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIEWS = """
sig AS (SELECT *, ((i - 1) / 10.0::DOUBLE)::DOUBLE AS t FROM (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  value::DOUBLE AS y, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE AS s FROM events)),
irr AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value::DOUBLE AS y,
  ((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0::DOUBLE)::DOUBLE AS t FROM events),
wav AS (SELECT vec_id AS spike, (vec_id / 50.0::DOUBLE)::DOUBLE AS t, label::INTEGER AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS wave FROM embeddings),
smp AS (SELECT spike, t, cluster, k AS k, wave[k] AS v FROM wav, (SELECT unnest(range(1, 65)) AS k)),
pix AS (SELECT vec_id AS frame, ((k - 1) // 8 + 1)::BIGINT AS row, ((k - 1) % 8 + 1)::BIGINT AS col, embedding[k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
idx AS (SELECT row_number() OVER (ORDER BY channel) AS no, channel, n, (sum(n) OVER (ORDER BY channel))::BIGINT - n + 1 AS st, (sum(n) OVER (ORDER BY channel))::BIGINT AS en,
  CASE WHEN channel % 3 <> 0 THEN 10.0::DOUBLE END AS fs, 'Ch' || channel AS title FROM (SELECT channel, max(i) AS n FROM sig GROUP BY 1)),
edge AS (SELECT channel, i, t FROM (SELECT *, lag(s) OVER (PARTITION BY channel ORDER BY i) AS p FROM sig) WHERE s > 0.5 AND coalesce(p, 0) <= 0.5),
ons AS (SELECT channel, i, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY channel ORDER BY i) AS g FROM edge) WHERE g IS NULL OR g > 0.3),
trl AS (SELECT channel, o AS onset, i, t_rel, y FROM (SELECT s.channel, o.i AS o, s.i - o.i + 3 AS i, ((s.i - o.i) / 10.0::DOUBLE)::DOUBLE AS t_rel, s.y,
  count(*) OVER (PARTITION BY o.channel, o.i) AS n FROM sig s JOIN ons o ON s.channel = o.channel AND s.i BETWEEN o.i - 2 AND o.i + 4) WHERE n = 7)
"""


def oracle(keys: str, values: str, sql: str, extra: str = "") -> str:
    """keys: columns as they are; values: columns to round; sql: a SELECT over the views and `extra` CTEs."""
    rounded = [f"round({v}::DOUBLE, 6) + 0.0::DOUBLE AS {v}" for v in values.replace(",", " ").split()]
    cols = ", ".join([k for k in [keys] if k] + rounded)
    return f"WITH {VIEWS}{',' + extra if extra else ''} SELECT {cols} FROM ({sql}) q"


def rounded(df: DataFrame, keys: str, values: str) -> DataFrame:
    ks = keys.replace(",", " ").split()
    return df.select(*ks, *((F.round(F.col(v).cast("double"), 6) + 0.0).alias(v) for v in values.replace(",", " ").split()))


def pass_sql(name: str, source: str, sos, steady: bool) -> str:
    """CTEs that run sections over `source` (channel, k from 1, x) by recursion; the last is `name` (channel, k, x).
    steady: each section starts as if the first sample had always been there."""
    out, before, level = [], source, 1.0
    for j, section in enumerate(sos):
        b0, b1, b2, _, a1, a2 = (float(v) for v in section)
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * y) * level if steady else 0.0
        z1 = (b1 - a1 * y) * level + z2 if steady else 0.0
        level, this, d = level * y, f"{name}{j}", "::DOUBLE"
        out.append(f"{this}f AS (SELECT channel, x AS f FROM {source} WHERE k = 1)")
        out.append(f"""{this}r AS (WITH RECURSIVE w(channel, k, y, z1, z2) AS (
  SELECT channel, 1::BIGINT, {b0!r}{d} * x + {z1!r}{d} * f, {b1!r}{d} * x - {a1!r}{d} * ({b0!r}{d} * x + {z1!r}{d} * f) + {z2!r}{d} * f, {b2!r}{d} * x - {a2!r}{d} * ({b0!r}{d} * x + {z1!r}{d} * f) FROM {before} JOIN {this}f USING (channel) WHERE k = 1
  UNION ALL SELECT w.channel, s.k, {b0!r}{d} * s.x + w.z1, {b1!r}{d} * s.x - {a1!r}{d} * ({b0!r}{d} * s.x + w.z1) + w.z2, {b2!r}{d} * s.x - {a2!r}{d} * ({b0!r}{d} * s.x + w.z1) FROM w JOIN {before} s ON s.channel = w.channel AND s.k = w.k + 1) SELECT * FROM w)""")
        out.append(f"{this} AS (SELECT channel, k, y AS x FROM {this}r)")
        before = this
    out.append(f"{name} AS (SELECT * FROM {before})")
    return ",\n".join(out)


def zero_phase_sql(name: str, source: str, sos, pad: int) -> str:
    """CTEs from `source` (channel, i, y) to `name` (channel, i, y): odd reflections, forward, backward; series no longer
    than the reflection as they are."""
    return f"""{name}n AS (SELECT channel, max(i) AS n FROM {source} GROUP BY 1),
{name}e AS (SELECT channel, i + {pad} AS k, y AS x FROM {source} JOIN {name}n USING (channel) WHERE n > {pad} UNION ALL
  SELECT a.channel, {pad} + 2 - a.i, 2 * b.y - a.y FROM {source} a JOIN {source} b ON a.channel = b.channel AND b.i = 1 JOIN {name}n m ON m.channel = a.channel WHERE n > {pad} AND a.i BETWEEN 2 AND {pad} + 1 UNION ALL
  SELECT a.channel, {pad} + 2 * n - a.i, 2 * b.y - a.y FROM {source} a JOIN {name}n m ON m.channel = a.channel JOIN {source} b ON a.channel = b.channel AND b.i = n WHERE n > {pad} AND a.i BETWEEN n - {pad} AND n - 1),
{pass_sql(name + "a", name + "e", sos, True)},
{name}b AS (SELECT channel, n + 2 * {pad} + 1 - k AS k, x FROM {name}a JOIN {name}n USING (channel)),
{pass_sql(name + "c", name + "b", sos, True)},
{name} AS (SELECT channel, n + {pad} + 1 - k AS i, x AS y FROM {name}c JOIN {name}n USING (channel) WHERE k BETWEEN {pad} + 1 AND n + {pad} UNION ALL SELECT channel, i, y FROM {source} JOIN {name}n USING (channel) WHERE n <= {pad})"""
