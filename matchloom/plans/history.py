"""Point-in-time history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import features, history
from matchloom.plans.bindings import A, M, appearances, matches, participants
from matchloom.plans.registry import collector

QUERIES, ORACLES, query = collector()
R = 6
_KY = """ky AS (SELECT player, year, count(*) AS n, sum(qty) AS sq, sum(price) AS sp FROM a GROUP BY ALL),
kh AS (SELECT player, year, coalesce(sum(n) OVER w, 0) AS hn, coalesce(sum(sq) OVER w, 0) AS hq, coalesce(sum(sp) OVER w, 0) AS hp FROM ky
  WINDOW w AS (PARTITION BY player ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gy AS (SELECT year, count(*) AS n, sum(qty) AS sq, sum(price) AS sp FROM a GROUP BY ALL),
gh AS (SELECT year, coalesce(sum(sq) OVER w / sum(n) OVER w, 0) AS gq, coalesce(sum(sp) OVER w / sum(n) OVER w, 0) AS gp FROM gy
  WINDOW w AS (ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sh AS (SELECT player, year, hn, CASE WHEN hn > 0 THEN (hq + 5 * gq) / (hn + 5) ELSE 0 END AS q, CASE WHEN hn > 0 THEN (hp + 5 * gp) / (hn + 5) ELSE 0 END AS pr FROM kh JOIN gh USING (year))"""


@query(f"WITH {A}, {_KY} SELECT match_key, side, CAST(avg(hn) AS DOUBLE) AS games_mean, round(avg(q), 6) AS qty_mean, round(avg(pr), 4) AS price_mean FROM a JOIN sh USING (player, year) GROUP BY ALL")
def prior_history(spark, sf):
    """O-59, O-63, O-64, O-65, O-66, O-68: shrunk strictly-before history, averaged by side."""
    a = appearances(spark, sf).select("match_key", "side", "player", "year", "qty", "price")
    h = history.shrunk_history(a, ["player"], "year", ["qty", "price"])
    side = a.join(h, ["player", "year"]).groupBy("match_key", "side")
    return side.agg(F.avg("prior_n").alias("games_mean"), F.round(F.avg("qty_mean"), R).alias("qty_mean"), F.round(F.avg("price_mean"), 4).alias("price_mean"))


@query(f"WITH {A} SELECT player, year, CAST(count(*) AS BIGINT) AS n, sum(qty) AS sum_qty, sum(price) AS sum_price FROM a GROUP BY ALL")
def o63_running_stats(spark, sf):
    return history.running_stats(appearances(spark, sf), ["player"], "year", ["qty", "price"])


@query(f"WITH {A} SELECT player, CAST(count(*) AS BIGINT) AS n, sum(qty) AS sum_qty FROM a GROUP BY ALL")
def o64_merged_stats(spark, sf):
    return history.merge_stats(history.running_stats(appearances(spark, sf), ["player"], "year", ["qty"]), ["player"])


@query(
    f"WITH {A}, ky AS (SELECT agent, map, year, count(*) AS n, sum(qty) AS sq FROM a GROUP BY ALL) SELECT agent, map, year, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, CAST(coalesce(sum(sq) OVER w, 0) AS DOUBLE) AS prior_sum_qty FROM ky WINDOW w AS (PARTITION BY agent, map ORDER BY year RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING)"
)
def o151_windowed_history(spark, sf):
    """O-151: only the last two earlier years count."""
    return history.prior_stats(appearances(spark, sf), ["agent", "map"], "year", ["qty"], window=2)


@query(f"WITH {A}, {_KY} SELECT year, round(gq, 6) AS global_qty, round(gp, 4) AS global_price FROM gh")
def o66_global_prior(spark, sf):
    g = history.global_prior_mean(appearances(spark, sf), "year", ["qty", "price"])
    return g.select("year", F.round("global_qty", R).alias("global_qty"), F.round("global_price", 4).alias("global_price"))


@query(f"WITH {A}, s AS (SELECT * FROM a WHERE year < 2000), g AS (SELECT avg(qty) AS gq FROM s) SELECT player, CAST(count(*) AS BIGINT) AS prior_n, round((sum(qty) + 5 * any_value(gq)) / (count(*) + 5), 6) AS qty_mean FROM s, g GROUP BY player")
def o60_state_before(spark, sf):
    s = history.state_before(appearances(spark, sf), ["player"], "year", ["qty"], 2000)
    return s.withColumn("qty_mean", F.round("qty_mean", R))


_OUT = "CAST(coalesce(g0, 0) AS BIGINT) AS prior_n, round(CASE WHEN g0 > 0 THEN w0 / g0 ELSE 0.5 END, 6) AS success, round(CASE WHEN g0 > 0 THEN m0 / g0 ELSE 0 END, 4) AS margin"


def _outcome_sql(keys: str) -> str:
    return f"WITH {M}, k AS (SELECT {keys}, year, count(label) AS g, coalesce(sum(label), 0) AS w, sum(CASE WHEN label IS NOT NULL THEN margin ELSE 0 END) AS mm FROM m GROUP BY ALL), h AS (SELECT {keys}, year, sum(g) OVER x AS g0, sum(w) OVER x AS w0, sum(mm) OVER x AS m0 FROM k WINDOW x AS (PARTITION BY {keys} ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT {keys}, year, {_OUT} FROM h"


def _rounded(df):
    return df.withColumns({"success": F.round("success", R), "margin": F.round("margin", 4)})


@query(_outcome_sql("team"))
def o67_team_outcomes(spark, sf):
    return _rounded(history.outcome_history(matches(spark, sf), ["team"], "year", "label"))


@query(_outcome_sql("team, map"))
def o67_team_map_outcomes(spark, sf):
    return _rounded(history.outcome_history(matches(spark, sf), ["team", "map"], "year", "label"))


_SETS = f"""WITH {M}, k AS (SELECT CASE WHEN grouping(map) = 1 THEN 0 ELSE 1 END AS key_set, team, map, year, count(*) AS g, sum(label) AS w, sum(margin) AS mm FROM m
  WHERE label IS NOT NULL GROUP BY GROUPING SETS ((team, year), (team, map, year))),
h AS (SELECT key_set, team, map, year, sum(g) OVER x AS g0, sum(w) OVER x AS w0, sum(mm) OVER x AS m0 FROM k WINDOW x AS (PARTITION BY key_set, team, map ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key_set, team, map, year, {_OUT} FROM h"""


@query(_SETS)
def o67_outcome_sets(spark, sf):
    """O-67 from one scan: team and team x map by grouping sets."""
    return _rounded(history.outcome_history_sets(matches(spark, sf), [["team"], ["team", "map"]], "year", "label"))


@query(
    f"""WITH {M}, y AS (SELECT DISTINCT team, year FROM m), r AS (SELECT y.team, y.year, label, margin, row_number() OVER (PARTITION BY y.team, y.year ORDER BY m.year DESC, match_key DESC) AS k
  FROM y JOIN m ON m.team = y.team AND m.year < y.year AND label IS NOT NULL),
f AS (SELECT team, year, avg(label) FILTER (k <= 5) AS f5, avg(margin) FILTER (k <= 5) AS m5, avg(label) FILTER (k <= 10) AS f10, avg(margin) FILTER (k <= 10) AS m10 FROM r GROUP BY ALL)
SELECT team, year, round(coalesce(f5, 0.5), 6) AS form5, round(coalesce(m5, 0), 4) AS form5_margin, round(coalesce(f10, 0.5), 6) AS form10, round(coalesce(m10, 0), 4) AS form10_margin FROM y LEFT JOIN f USING (team, year)"""
)
def o91_last_n_form(spark, sf):
    f = history.last_n_form(matches(spark, sf), ["team"], "year", ["match_key"], won="label")
    return f.select("team", "year", *(F.round(c, R if "margin" not in c else 4).alias(c) for c in ("form5", "form5_margin", "form10", "form10_margin")))


_ROSTER = f"""WITH {A}, r AS (SELECT team, year, match_key, list_sort(list(DISTINCT player)) AS roster FROM a GROUP BY ALL),
l AS (SELECT team, year, arg_max(roster, match_key) AS roster FROM r GROUP BY ALL),
h AS (SELECT team, year, last_value(roster IGNORE NULLS) OVER (PARTITION BY team ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM l)"""


@query(_ROSTER + " SELECT team, year, array_to_string(pr, ',') AS previous_roster FROM h")
def o62_previous_roster(spark, sf):
    a = appearances(spark, sf).select("team", "year", "match_key", "player")
    return history.last_roster(a, "team", "year", "match_key", "player").withColumn("previous_roster", F.array_join(F.col("previous_roster").cast("array<string>"), ","))


@query(_ROSTER + " SELECT team, year, match_key, round(len(list_intersect(r.roster, coalesce(pr, []))) / greatest(len(r.roster), 1), 6) AS overlap FROM r JOIN h USING (team, year)")
def o105_roster_overlap(spark, sf):
    a = appearances(spark, sf).select("team", "year", "match_key", "player")
    return history.roster_overlap(a, "team", "year", "match_key", "player").withColumn("overlap", F.round("overlap", R))


def _pairs_sql(scope: str) -> str:
    s = f"{scope}, " if scope else ""
    on = f"AND x.{scope} = y.{scope}" if scope else ""
    return f"""WITH {A}, d AS (SELECT DISTINCT {s}year, match_key, side, player FROM a),
q AS (SELECT {'x.' + s if s else ''}x.year, x.match_key, x.side, x.player AS p, y.player AS q FROM d x JOIN d y ON x.match_key = y.match_key AND x.side = y.side {on} AND x.player < y.player),
c AS (SELECT {s}p, q, year, count(*) AS n FROM q GROUP BY ALL),
h AS (SELECT {s}p, q, year, coalesce(sum(n) OVER (PARTITION BY {s}p, q ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM c)
SELECT match_key, side, round(CAST(avg(met) AS DOUBLE), 6) AS synergy, round(avg(CASE WHEN met > 0 THEN 1.0 ELSE 0.0 END), 6) AS known FROM q JOIN h USING ({s}p, q, year) GROUP BY ALL"""


def _pairs(spark, sf, scope):
    a = appearances(spark, sf).select("team", "year", "match_key", "side", "player")
    h = history.pair_history(a, scope, "year", "match_key", "side", "player")
    return h.select("match_key", "side", F.round("synergy", R).alias("synergy"), F.round("known", R).alias("known"))


@query(_pairs_sql(""))
def o70_pair_history(spark, sf):
    return _pairs(spark, sf, [])


@query(_pairs_sql("team"))
def o70_team_pair_history(spark, sf):
    return _pairs(spark, sf, ["team"])


@query(f"WITH {A}, l AS (SELECT player, year, arg_max(agent, CAST(match_key AS BIGINT) * 100000 + part) AS v FROM a GROUP BY ALL) SELECT player, year, last_value(v IGNORE NULLS) OVER (PARTITION BY player ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_agent FROM l")
def o62_latest_before(spark, sf):
    a = appearances(spark, sf).withColumn("at", F.col("match_key") * 100000 + F.col("part"))
    return history.latest_before(a, ["player"], "year", "agent", "at")


@query(f"WITH {A}, {_KY} SELECT match_key, side, round(avg(CASE WHEN hn > 0 THEN 1.0 ELSE 0.0 END), 6) AS history_coverage, round(avg(CASE WHEN hn < 5 THEN 1.0 ELSE 0.0 END), 6) AS low_history_ratio FROM a JOIN sh USING (player, year) GROUP BY ALL")
def o69_coverage(spark, sf):
    a = appearances(spark, sf).select("match_key", "side", "player", "year", "qty")
    h = history.prior_stats(a, ["player"], "year", ["qty"])
    c = features.coverage(a.join(h, ["player", "year"]), "match_key", "side", "prior_n")
    return c.select("match_key", "side", F.round("history_coverage", R).alias("history_coverage"), F.round("low_history_ratio", R).alias("low_history_ratio"))


@query(f"WITH {A} SELECT match_key, side, round(avg(qty), 6) AS mean_qty, max(qty) AS max_qty, round(stddev_pop(qty), 6) AS std_qty FROM a GROUP BY ALL")
def o68_side_spread(spark, sf):
    s = features.side_spread(participants(spark, sf).join(matches(spark, sf).select("match_key"), "match_key"), "match_key", "side", "qty")
    return s.withColumns({"mean_qty": F.round("mean_qty", R), "std_qty": F.round("std_qty", R)})
