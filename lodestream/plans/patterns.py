"""Row patterns over events, with hand-written SQL of the same matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators.patterns import alt, many, match_rows, row, seq
from lodestream.plans.registry import query
from lodestream.sources.tables import table

_KINDS = ("view", "click", "purchase", "error", "signup")


def _kinds():
    return {k: F.col("event_type") == k for k in _KINDS}


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
k AS (SELECT *, max(CASE WHEN event_type <> 'click' THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT k.user_id, v.ts AS first_ts, k.ts AS last_ts, k.r - k.b - 1 AS clicks, k.value AS paid
FROM k JOIN e v ON v.user_id = k.user_id AND v.r = k.b AND v.event_type = 'view'
WHERE k.event_type = 'purchase' AND k.r - k.b >= 2""")
def pattern_funnel(spark, sf_dir):
    """A view, one or more clicks and a purchase in a row."""
    funnel = seq(row("view"), many(row("click"), 1), row("purchase"))
    found = match_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], _kinds(), funnel)
    return found.groupBy("user_id", "match_first").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("match_symbol") == "click").alias("clicks"),
        F.max(F.when(F.col("match_symbol") == "purchase", F.col("value"))).alias("paid")).drop("match_first")


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS r, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, max(CASE WHEN coalesce(d, 1) >= 0 THEN r END) OVER (PARTITION BY user_id ORDER BY r) AS not_down,
  min(CASE WHEN coalesce(d, 1) >= 0 THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down_ends,
  min(CASE WHEN coalesce(d, -1) <= 0 THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up_ends,
  max(r) OVER (PARTITION BY user_id) AS n FROM e)
SELECT s.event_id AS first_event, coalesce(u.up_ends, u.n + 1) - s.r AS n_rows, t.value AS bottom, z.value AS top
FROM b s JOIN b f ON f.user_id = s.user_id AND f.r = s.r + 1 AND f.d < 0
JOIN b u ON u.user_id = s.user_id AND u.r = f.down_ends AND u.d > 0
JOIN b t ON t.user_id = s.user_id AND t.r = u.r - 1
JOIN b z ON z.user_id = s.user_id AND z.r = coalesce(u.up_ends, u.n + 1) - 1""")
def pattern_dip(spark, sf_dir):
    """From any row: one or more falls of the value, then all rises that follow."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("step", F.col("value") - F.lag("value").over(w))
    dip = seq(row("any"), many(row("down"), 1), many(row("up"), 1))
    found = match_rows(e, ["user_id"], ["ts", "event_id"], {"any": F.lit(True), "down": F.col("step") < 0, "up": F.col("step") > 0}, dip, past_last=False)
    last = lambda symbol: F.max_by("value", F.when(F.col("match_symbol") == symbol, F.struct("ts", "event_id")))
    return found.groupBy("user_id", "match_first").agg(F.count(F.lit(1)).alias("n_rows"), last("down").alias("bottom"), last("up").alias("top")).select(
        F.col("match_first.event_id").alias("first_event"), "n_rows", "bottom", "top")


_HOURS = 48


@query(f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
c AS (SELECT s.user_id, s.r, s.event_id, s.ts, max(z.r) AS last FROM e s JOIN e z ON z.user_id = s.user_id AND z.r BETWEEN s.r + 2 AND s.r + 4
  AND z.event_type IN ('purchase', 'signup') AND z.ts <= s.ts + INTERVAL {_HOURS} HOUR
  WHERE s.event_type IN ('error', 'view') AND NOT EXISTS (SELECT 1 FROM e m WHERE m.user_id = s.user_id AND m.r > s.r AND m.r < z.r AND m.event_type NOT IN ('view', 'click'))
  GROUP BY ALL)
SELECT c.event_id AS first_event, z.event_id AS last_event, last - c.r + 1 AS n_rows FROM c JOIN e z ON z.user_id = c.user_id AND z.r = c.last
WHERE c.r = (SELECT min(h.r) FROM c h WHERE h.user_id = c.user_id AND h.last = c.last)""")
def pattern_recovery(spark, sf_dir):
    """Within two days: an error or a view, one to three views or clicks, then a purchase or signup; the next begins past its end."""
    p = seq(alt(row("error"), row("view")), many(alt(row("view"), row("click")), 1, 3), alt(row("purchase"), row("signup")))
    found = match_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], _kinds(), p, within=_HOURS * 3600)
    return found.groupBy("match_first", "match_last").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.col("match_first.event_id").alias("first_event"), F.col("match_last.event_id").alias("last_event"), "n_rows")
