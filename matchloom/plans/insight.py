"""Insight and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import conform, insights
from matchloom.plans.bindings import A, M, P, appearances, matches, participants, table
from matchloom.plans.registry import collector

QUERIES, ORACLES, query = collector()


@query(f"WITH {A} SELECT agent, map, CAST(count(*) AS BIGINT) AS n, round(avg(won), 6) AS win_rate FROM a WHERE won IS NOT NULL GROUP BY ALL HAVING count(*) >= 10")
def o73_group_rate(spark, sf):
    g = insights.group_rate(appearances(spark, sf), ["agent", "map"], "won", 10)
    return g.withColumn("win_rate", F.round("win_rate", 6))


_COMP = "s AS (SELECT match_key, side, list_sort(list(DISTINCT role)) AS s FROM a GROUP BY ALL HAVING count(DISTINCT role) >= 2), c AS (SELECT match_key, side, array_to_string(s[1:2], '|') AS comp FROM s), w AS (SELECT DISTINCT match_key, side, map, won FROM a)"


@query(f"WITH {A}, {_COMP}, r AS (SELECT map, comp, count(*) AS n, avg(won) AS wr FROM c JOIN w USING (match_key, side) WHERE won IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT * FROM (SELECT map, comp, CAST(n AS BIGINT) AS n, round(wr, 6) AS win_rate, CAST(row_number() OVER (PARTITION BY map ORDER BY wr DESC, comp) AS INTEGER) AS rank FROM r) WHERE rank <= 10")
def o74_top_compositions(spark, sf):
    a = appearances(spark, sf)
    c = insights.compositions(a, "match_key", "side", "role", 2).join(a.select("match_key", "side", "map", "won").distinct(), ["match_key", "side"])
    t = insights.top_compositions(c, "map", "won", 5, 10)
    return t.select("map", "comp", "n", F.round("win_rate", 6).alias("win_rate"), "rank")


@query(f"WITH {A}, b AS (SELECT year, count(DISTINCT match_key) AS m FROM a GROUP BY ALL) SELECT year, agent, CAST(count(*) AS BIGINT) AS picks, round(count(*) / (any_value(m) * 10E0), 8) AS pick_rate, round(avg(won), 6) AS win_rate FROM a JOIN b USING (year) GROUP BY year, agent")
def o75_pick_rates(spark, sf):
    r = insights.pick_rates(appearances(spark, sf), "year", "agent", "match_key", "won")
    return r.select("year", "agent", "picks", F.round("pick_rate", 8).alias("pick_rate"), F.round("win_rate", 6).alias("win_rate"))


_WIDE = "w AS (SELECT match_key, year, label, CAST(count(*) FILTER (agent = 'Brand#11') AS DOUBLE) AS b11, CAST(count(*) FILTER (agent = 'Brand#12') AS DOUBLE) AS b12 FROM a GROUP BY ALL)"


@query(f"WITH {A}, u AS (SELECT match_key, year, label, agent, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT year, count(DISTINCT match_key) AS m FROM a GROUP BY year), g AS (SELECT DISTINCT p_brand AS agent FROM part) SELECT b.year, replace(lower(g.agent), '#', '') AS agent, CAST(coalesce(sum(n), 0) AS DOUBLE) AS picks, round(coalesce(sum(n), 0) / (any_value(m) * 10), 8) AS pick_rate, round(CASE WHEN sum(n) <> 0 THEN sum(n * label) / CAST(sum(n) AS DOUBLE) END, 6) AS win_rate FROM b CROSS JOIN g LEFT JOIN u ON u.year = b.year AND u.agent = g.agent GROUP BY b.year, g.agent")
def o76_wide_pick_rates(spark, sf):
    brands = [f"brand{i}" for i in range(1, 26)]
    w = appearances(spark, sf).groupBy("match_key", "year", "label").agg(*(F.count_if(F.col("agent") == f"Brand#{b[5:]}").cast("double").alias(b) for b in brands))
    r = insights.wide_pick_rates(w, brands, "year", "label")
    return r.select("year", "agent", "picks", F.round("pick_rate", 8).alias("pick_rate"), F.round("win_rate", 6).alias("win_rate"))


@query(f"WITH {A}, n AS (SELECT year, role, count(*) AS n FROM a GROUP BY ALL) SELECT year, role, CAST(n AS BIGINT) AS n, round(n / CAST(sum(n) OVER (PARTITION BY year) AS DOUBLE), 8) AS share FROM n")
def o77_o79_role_shares(spark, sf):
    return insights.shares(appearances(spark, sf), "year", "role").withColumn("share", F.round("share", 8))


@query(f"WITH {A}, t AS (SELECT agent FROM a GROUP BY agent ORDER BY count(*) DESC, agent LIMIT 10), b AS (SELECT year, count(*) * 2 AS s FROM m GROUP BY ALL) SELECT year, agent, round(count(*) / CAST(any_value(s) AS DOUBLE) * 100, 6) AS pick_pct FROM a JOIN t USING (agent) JOIN b USING (year) GROUP BY year, agent")
def o78_meta_shift(spark, sf):
    s = insights.meta_shift(appearances(spark, sf).select("year", "agent"), "year", "agent", matches(spark, sf))
    return s.withColumn("pick_pct", F.round("pick_pct", 6))


@query(f"WITH {M} SELECT label, map, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL")
def o80_value_counts(spark, sf):
    return matches(spark, sf).groupBy("label", "map").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT 'label' AS column_name, round(avg(CASE WHEN label IS NULL THEN 1E0 ELSE 0E0 END) * 100, 6) AS null_pct FROM m UNION ALL SELECT 'year', round(avg(CASE WHEN year IS NULL THEN 1E0 ELSE 0E0 END) * 100, 6) FROM m UNION ALL SELECT 'team', round(avg(CASE WHEN team IS NULL THEN 1E0 ELSE 0E0 END) * 100, 6) FROM m")
def o81_null_rates(spark, sf):
    return insights.null_rates(matches(spark, sf), ["label", "year", "team"]).withColumn("null_pct", F.round("null_pct", 6))


@query(f"WITH {M} SELECT map, round(avg(CASE WHEN label IS NULL THEN 1E0 ELSE 0E0 END) * 100, 2) AS null_pct FROM m GROUP BY map")
def o82_null_rate_by(spark, sf):
    return insights.null_rate_by(matches(spark, sf), "map", "label").withColumn("null_pct", F.round("null_pct", 2))


_BIN = "1 + " + " + ".join(f"CAST(margin > lo + {i} * ((hi - lo) / 10) AS INTEGER)" for i in range(1, 10))


@query(f"WITH {M}, e AS (SELECT min(margin) AS lo, max(margin) AS hi FROM m) SELECT CAST({_BIN} AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(label), 6) AS rate FROM m, e GROUP BY 1")
def o83_equal_width_rate(spark, sf):
    return insights.equal_width_rate(matches(spark, sf), "margin", "label").withColumn("rate", F.round("rate", 6))


@query(f"WITH {P} SELECT CAST(CASE WHEN qty = 50 THEN 22 WHEN qty < 0 THEN 0 WHEN qty > 50 THEN 23 ELSE floor(qty / 50 * 22) + 1 END AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1")
def o84_histogram(spark, sf):
    return insights.histogram(participants(spark, sf), "qty", 0, 50, 22)


_PROB = f"WITH {M}, s AS (SELECT label AS y, round((match_key * 37 % 1000) / 1000E0, 3) AS prob FROM m WHERE label IS NOT NULL)"


def probabilities(spark, sf):
    m = matches(spark, sf).where("label is not null")
    return m.select("match_key", "year", F.col("label").alias("y"), F.round((F.col("match_key") * 37 % 1000) / 1000.0, 3).alias("prob"))


@query(f"{_PROB} SELECT CAST(least(floor(abs(2 * prob - 1) * 5), 4) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1E0 ELSE 0E0 END), 6) AS accuracy, round(avg(abs(2 * prob - 1)), 6) AS confidence FROM s GROUP BY 1")
def o85_reliability(spark, sf):
    r = insights.reliability(probabilities(spark, sf), "prob", "y")
    return r.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


_TYPE = "t AS (SELECT p_type AS comp, CAST(count(*) AS BIGINT) AS n, round(avg(p_size), 4) AS win_rate, CAST(min(p_size) AS DOUBLE) AS u, CAST(count(DISTINCT p_brand) AS DOUBLE) AS v FROM part GROUP BY ALL), s AS (SELECT *, 1 - (abs(u - 2) + abs(v - 20)) / 10 AS similarity FROM t)"


@query(f"WITH {_TYPE}, b AS (SELECT comp, similarity, n, win_rate FROM s ORDER BY similarity DESC, n DESC, win_rate DESC, comp LIMIT 1) SELECT comp, round(similarity, 6) AS similarity, n, win_rate, (SELECT round(sum(similarity * n) / sum(n), 6) FROM s) AS mean_similarity FROM b")
def o100_nearest(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_type").alias("comp")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 4).alias("win_rate"), F.min("p_size").cast("double").alias("u"), F.count_distinct("p_brand").cast("double").alias("v"))
    r = insights.nearest(t, ["u", "v"], [2, 20])
    return r.select("comp", F.round("similarity", 6).alias("similarity"), "n", "win_rate", F.round("mean_similarity", 6).alias("mean_similarity"))


@query(f"WITH {A}, f AS (SELECT agent, map, avg(won) AS win_rate FROM a WHERE won IS NOT NULL GROUP BY ALL HAVING count(*) >= 40) SELECT d.agent, d.map, CASE WHEN win_rate IS NULL THEN 'ok' WHEN win_rate >= 0.52 THEN 'fit' WHEN win_rate <= 0.48 THEN 'weak' ELSE 'ok' END AS verdict, CASE WHEN win_rate IS NULL THEN 'rule' ELSE 'data' END AS basis FROM (SELECT DISTINCT p_brand AS agent, map FROM part, (SELECT DISTINCT map FROM m)) d LEFT JOIN f ON d.agent = f.agent AND d.map = f.map")
def o30_o134_fit_or_rule(spark, sf):
    fit = insights.group_rate(appearances(spark, sf), ["map", "agent"], "won", 40)
    maps = matches(spark, sf).select("map").distinct()
    dim = table(spark, sf, "part").select(F.col("p_brand").alias("agent")).distinct().crossJoin(F.broadcast(maps))  # the brands by the five maps
    return insights.fit_or_rule(dim, fit, ["map", "agent"], F.lit("ok")).select("map", "agent", "verdict", "basis")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE regexp_full_match(event_type, '[a-z][a-z_]{1,23}') GROUP BY ALL")
def o40_o97_frequent(spark, sf):
    return insights.frequent(table(spark, sf, "events"), "event_type", "^[a-z][a-z_]{1,23}$")


@query("SELECT * FROM (VALUES (0, 'NATION_7'), (1, 'ATLANTIS'), (2, 'NATION_3'), (3, 'NATION_0')) t(ordinal, n_name) WHERE n_name IN (SELECT n_name FROM nation)")
def o97_featured(spark, sf):
    return insights.featured(table(spark, sf, "nation"), "n_name", ["NATION_7", "ATLANTIS", "NATION_3", "NATION_0"]).select("ordinal", "n_name")


@query(f"WITH {P}, c AS (SELECT match_key, agent, sum(qty) AS v FROM p GROUP BY ALL), r AS (SELECT match_key, agent, v * 0.5 AS contribution, row_number() OVER (PARTITION BY match_key ORDER BY v DESC, agent) AS k FROM c) SELECT match_key, agent, CAST(contribution AS DOUBLE) AS contribution, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3")
def o99_top_contributions(spark, sf):
    c = participants(spark, sf).groupBy("match_key", "agent").agg(F.sum("qty").alias("v")).withColumn("w", F.lit(0.5))
    return insights.top_contributions(c, "match_key", "agent", "w", "v", 3).select("match_key", "agent", "contribution", "rank")


@query(f"WITH {M}, y AS (SELECT DISTINCT year FROM m WHERE year BETWEEN 2000 AND 2099) SELECT year FROM y UNION ALL SELECT CAST(max(year) + 1 AS INTEGER) FROM y HAVING max(year) + 1 <= 2026")
def o136_year_options(spark, sf):
    y = matches(spark, sf).where("year between 2000 and 2099").select("year").distinct()
    nxt = y.agg((F.max("year") + 1).cast("int").alias("year")).where("year <= 2026")
    return y.union(nxt)


@query(f"WITH {A} SELECT match_key, side, CAST(max(CASE WHEN side = 'a' THEN label WHEN side = 'b' THEN 1 - label END) AS INTEGER) AS won, max(CASE label WHEN 1 THEN 'A' WHEN 0 THEN 'B' END) AS winner FROM a GROUP BY ALL")
def o138_o139_side_won(spark, sf):
    from matchloom.functions import normalize as n

    a = appearances(spark, sf).select("match_key", "side", "label")
    return a.groupBy("match_key", "side").agg(F.max(n.side_won(F.col("side"), F.col("label"))).alias("won"), F.max(n.winner(F.col("label"))).alias("winner"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def o102_latest_events(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return insights.top_per_group(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


_WARNINGS = "CASE WHEN c_nationkey % 2 = 0 THEN 'no_controller:high' END, CASE WHEN c_nationkey % 5 >= 3 THEN 'too_many_sentinel:high' END, CASE WHEN c_nationkey % 6 = 0 THEN 'no_duelist:medium' END, CASE WHEN c_nationkey % 3 = 0 THEN 'no_initiator:medium' END, CASE WHEN c_nationkey % 6 >= 4 THEN 'too_many_duelist:low' END"


@query(f"SELECT c_custkey, array_to_string([x for x in [{_WARNINGS}] if x IS NOT NULL], ',') AS warnings FROM customer")
def o132_balance_warnings(spark, sf):
    from matchloom.operators.audit import balance_warnings

    k = F.col("c_nationkey")
    w = balance_warnings(duelists=k % 6, initiators=k % 3, controllers=k % 2, sentinels=k % 5)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(w, lambda x: F.concat_ws(":", x["code"], x["severity"])), ",").alias("warnings"))


@query(f"WITH {A}, g AS (SELECT match_key FROM a GROUP BY ALL HAVING count(*) FILTER (side = 'a') >= 2 AND count(*) FILTER (side = 'b') >= 2) SELECT map, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT team) AS BIGINT) AS teams FROM m WHERE match_key IN (SELECT match_key FROM g) GROUP BY map")
def o71_gated_maps(spark, sf):
    ok, _, _ = conform.gate(matches(spark, sf), appearances(spark, sf), "match_key", "side", 2, at_least=True)
    return ok.groupBy("map").agg(F.count("*").alias("n"), F.count_distinct("team").alias("teams"))
