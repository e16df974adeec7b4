"""Splits, metrics, audits and the history store."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.normalize import feature_label
from matchloom.operators import audit, conform, features, metrics, reports, splits
from matchloom.plans.bindings import A, M, P, appearances, matches, participants, table
from matchloom.plans.insight import _PROB, probabilities
from matchloom.plans.registry import collector
from matchloom.sources import tables
from matchloom.sources.shared import shared_dir

QUERIES, ORACLES, query = collector()
_B = "n AS (SELECT year, count(*) AS n FROM (SELECT match_key, min(year) AS year FROM m WHERE year IS NOT NULL GROUP BY match_key) GROUP BY year), c AS (SELECT year, sum(n) OVER (ORDER BY year DESC) AS cum, sum(n) OVER () AS total, min(year) OVER () AS first FROM n), b AS (SELECT year AS test_from_year FROM c WHERE year > first ORDER BY abs(cum - 0.2E0 * total), year DESC LIMIT 1)"


@query(f"WITH {M}, {_B} SELECT test_from_year FROM b")
def o109_boundary_year(spark, sf):
    return splits.boundary_year(matches(spark, sf), "year", "match_key")


@query(f"WITH {M}, {_B} SELECT match_key, CASE WHEN year >= test_from_year THEN 'test' ELSE 'train' END AS split FROM m, b")
def o109_chrono_split(spark, sf):
    return splits.chrono_split(matches(spark, sf), "year").select("match_key", "split")


@query(f"WITH {M} SELECT 'fit' AS part, CAST(count(*) AS BIGINT) AS n FROM m WHERE year < 2000 UNION ALL SELECT 'validation', CAST(count(*) AS BIGINT) FROM m WHERE year = 2000")
def o110_fit_validation(spark, sf):
    a, b = splits.fit_and_validation(matches(spark, sf), "year", 2000)
    return a.agg(F.lit("fit").alias("part"), F.count("*").alias("n")).unionByName(b.agg(F.lit("validation").alias("part"), F.count("*").alias("n")))


@query(f"WITH {M}, {_B} SELECT CAST(count(*) AS BIGINT) AS overlap FROM (SELECT team FROM m, b WHERE year < test_from_year INTERSECT SELECT team FROM m, b WHERE year >= test_from_year)")
def o87_overlap(spark, sf):
    s = splits.chrono_split(matches(spark, sf), "year")
    return splits.overlap(s.where("split = 'train'"), s.where("split = 'test'"), ["team"])


@query(f"WITH {M}, {_B}, s AS (SELECT *, CASE WHEN year >= test_from_year THEN 'test' ELSE 'train' END AS split FROM m, b), y AS (SELECT split, string_agg(year || ':' || n, ',' ORDER BY year) AS rows_by_year FROM (SELECT split, year, count(*) AS n FROM s GROUP BY ALL) GROUP BY split) SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT match_key) AS BIGINT) AS n_keys, min(year) AS first_year, max(year) AS last_year, round(avg(label), 6) AS label_mean, any_value(rows_by_year) AS rows_by_year FROM s JOIN y USING (split) GROUP BY split")
def o88_split_summary(spark, sf):
    s = splits.split_summary(splits.chrono_split(matches(spark, sf), "year"), "split", "match_key", "year", "label")
    entries = F.transform(F.array_sort(F.map_entries("rows_by_year")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return s.withColumns({"label_mean": F.round("label_mean", 6), "rows_by_year": F.array_join(entries, ",")})


def _hash(key: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(sha1(concat(CAST({key} AS VARCHAR), '|{seed}')), 1, 15)) AS BIGINT)"


_UNIT = f"{_hash('match_key')} % {1 << 30} / {float(1 << 30)}E0"


@query(f"WITH {M} SELECT match_key, CASE WHEN {_UNIT} < 0.8 THEN 'train' ELSE 'test' END AS split FROM m")
def o108_hashed_split(spark, sf):
    return splits.hashed_split(matches(spark, sf).select("match_key"), "match_key")


@query(f"WITH {M} SELECT match_key, CASE WHEN year = 1996 THEN 'test' WHEN {_UNIT} < 0.8 THEN 'train' ELSE 'test' END AS split FROM m")
def o108_membership_split(spark, sf):
    """Keys of an earlier membership, here the matches of 1996, keep their split; the others are hashed."""
    m = matches(spark, sf).select("match_key", "year")
    old = m.where("year = 1996").select("match_key", F.lit("test").alias("split"))
    return splits.hashed_split(m, "match_key", membership=old).select("match_key", "split")


@query(f"WITH {M} SELECT match_key, team, CAST({_hash('team')} % 5 AS INTEGER) AS fold FROM m")
def o111_folds(spark, sf):
    return splits.folds(matches(spark, sf).select("match_key", "team"), "team")


@query(f"WITH {M} SELECT match_key, CASE WHEN row_number() OVER (ORDER BY {_hash('match_key')}, match_key) - 1 < (SELECT floor(count(*) * 0.8E0) FROM m) THEN 'train' ELSE 'test' END AS split FROM m")
def o108_exact_split(spark, sf):
    """Exactly int(0.8 n) matches train."""
    return splits.exact_split(matches(spark, sf).select("match_key"), "match_key")


@query(
    f"""WITH RECURSIVE {M}, t AS (SELECT count(*) AS total FROM m),
s AS (SELECT '=' || CAST(team AS VARCHAR) AS g, count(*) AS n FROM m GROUP BY ALL),
h AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS i FROM s, t WHERE n * {splits.HEAVY * 5} > total),
w AS (SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, CAST(NULL AS VARCHAR) AS g, -1 AS fold
  UNION ALL SELECT h.i, [CASE WHEN j = list_position(loads, list_min(loads)) THEN loads[j] + h.n ELSE loads[j] END FOR j IN range(1, 6)], h.g, list_position(loads, list_min(loads)) - 1 FROM w JOIN h ON h.i = w.i + 1),
l AS (SELECT loads FROM w ORDER BY i DESC LIMIT 1),
r AS (SELECT [greatest(0E0, total / 5E0 - x) FOR x IN loads] AS room, total - list_sum(loads) AS rest FROM l, t),
e AS (SELECT [list_sum(list_slice(room, 1, j)) * rest / list_sum(room) FOR j IN range(1, 6)] AS ends FROM r),
c AS (SELECT g, n, coalesce(sum(n) OVER (ORDER BY {_hash('g')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s, t WHERE n * {splits.HEAVY * 5} <= total),
f AS (SELECT g, least(4, len([x FOR x IN ends IF before + n / 2E0 >= x])) AS fold FROM c, e UNION ALL SELECT g, fold FROM w WHERE g IS NOT NULL)
SELECT match_key, team, CAST(fold AS INTEGER) AS fold FROM m JOIN f ON f.g = '=' || CAST(team AS VARCHAR)"""
)
def o111_balanced_folds(spark, sf):
    """Folds of whole teams, of like size."""
    return splits.balanced_folds(matches(spark, sf).select("match_key", "team"), "team")


@query(f"WITH {M} SELECT match_key, label FROM m ORDER BY {_hash('match_key')}, match_key LIMIT 500")
def o112_sample(spark, sf):
    return splits.sample_rows(matches(spark, sf).select("match_key", "label"), "match_key", 500)


_DEAL = "row_number() OVER (ORDER BY {}, match_key, label) AS n"


@query(f"WITH {M}, a AS (SELECT match_key, {_DEAL.format(_hash('match_key'))} FROM m), b AS (SELECT label, {_DEAL.format(_hash('match_key', 43))} FROM m) SELECT match_key, label FROM a JOIN b USING (n)")
def o113_shuffled_labels(spark, sf):
    return splits.shuffled_labels(matches(spark, sf).select("match_key", "label"), "match_key", "label")


_CONF = "CAST(count(*) FILTER (prob < 0.5 AND y = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (prob >= 0.5 AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (prob < 0.5 AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (prob >= 0.5 AND y = 1) AS BIGINT) AS tp"


@query(f"{_PROB}, c AS (SELECT {_CONF} FROM s) SELECT *, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(greatest(tp + fn, tn + fp) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS majority FROM c")
def o119_confusion(spark, sf):
    c = metrics.confusion(probabilities(spark, sf), "prob", "y")
    return c.withColumns({k: F.round(k, 6) for k in ("accuracy", "f1", "majority")})


@query(f"{_PROB}, r AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2E0 AS rk FROM s), g AS (SELECT sum(rk) FILTER (y = 1) AS u, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS np, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS nn FROM r) SELECT round((u - np * (np + 1) / 2) / (np * nn), 8) AS auc FROM g")
def o120_auc(spark, sf):
    return metrics.auc(probabilities(spark, sf), "prob", "y").withColumn("auc", F.round("auc", 8))


@query(f"{_PROB}, t AS (SELECT prob, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL), r AS (SELECT prob AS threshold, CAST(sum(neg) OVER (ORDER BY prob DESC) AS DOUBLE) / sum(neg) OVER () AS fpr, CAST(sum(pos) OVER (ORDER BY prob DESC) AS DOUBLE) / sum(pos) OVER () AS tpr FROM t) SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, round(tpr - fpr, 8) AS j, row_number() OVER (ORDER BY threshold DESC) - 1 AS place FROM r")
def o120_roc_curve(spark, sf):
    return metrics.roc_curve(probabilities(spark, sf), "prob", "y").withColumns({c: F.round(c, 8) for c in ("fpr", "tpr", "j")})


_POINTS = "i AS (SELECT DISTINCT CAST(floor(k * (n - 1) / 259.0E0) AS BIGINT) AS place FROM range(260) t(k), (SELECT count(*) AS n FROM r))"


@query(f"{_PROB}, t AS (SELECT prob, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL), r AS (SELECT prob AS threshold, CAST(sum(neg) OVER (ORDER BY prob DESC) AS DOUBLE) / sum(neg) OVER () AS fpr, CAST(sum(pos) OVER (ORDER BY prob DESC) AS DOUBLE) / sum(pos) OVER () AS tpr, row_number() OVER (ORDER BY prob DESC) - 1 AS place FROM t), {_POINTS} SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, place FROM r WHERE place IN (SELECT place FROM i) OR (SELECT count(*) FROM r) <= 260")
def o101_thinned_curve(spark, sf):
    t = metrics.thinned(metrics.roc_curve(probabilities(spark, sf), "prob", "y"), 260)
    return t.select("threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"), "place")


_AUC = "SELECT '{0}' AS feature, y, CAST({0} AS DOUBLE) AS x FROM d"


@query("WITH d AS (SELECT quality AS y, n_chars, length(text) AS size, documents.doc_id % 10 AS tail FROM documents JOIN labels USING (doc_id)), l AS (" + " UNION ALL ".join(_AUC.format(f) for f in ("n_chars", "size", "tail")) + "), r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2E0 AS rk FROM l), g AS (SELECT feature, sum(rk) FILTER (y = 1) AS u, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS np, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS nn FROM r GROUP BY feature), a AS (SELECT feature, (u - np * (np + 1) / 2) / (np * nn) AS auc FROM g) SELECT feature, round(greatest(auc, 1 - auc), 8) AS auc, CASE WHEN greatest(auc, 1 - auc) > 0.95 THEN 'problem' WHEN greatest(auc, 1 - auc) > 0.85 THEN 'warn' ELSE 'ok' END AS flag FROM a")
def o121_single_feature_auc(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select(F.col("quality").alias("y"), "n_chars", F.length("text").alias("size"), (F.col("doc_id") % 10).alias("tail"), F.lit(1).alias("constant"))
    return metrics.single_feature_auc(d, ["n_chars", "size", "tail", "constant"], "y").withColumn("auc", F.round("auc", 8))


_FOLD = f"{_PROB}, f AS (SELECT label AS y, round((match_key * 37 % 1000) / 1000E0, 3) AS prob, CAST(year % 5 AS INTEGER) AS fold FROM m WHERE label IS NOT NULL), r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY prob) + (count(*) OVER (PARTITION BY fold, prob) - 1) / 2E0 AS rk FROM f), g AS (SELECT fold, sum(rk) FILTER (y = 1) AS u, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS np, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS nn FROM r GROUP BY fold), c AS (SELECT fold, {_CONF} FROM f GROUP BY fold), e AS (SELECT fold, (u - np * (np + 1) / 2) / (np * nn) AS auc, (tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) AS accuracy, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM g JOIN c USING (fold))"


@query(_FOLD + " SELECT fold, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, CAST(NULL AS DOUBLE) AS auc_std, CAST(NULL AS DOUBLE) AS accuracy_std, CAST(NULL AS DOUBLE) AS f1_std FROM e UNION ALL SELECT NULL, round(avg(auc), 6), round(avg(accuracy), 6), round(avg(f1), 6), round(stddev_pop(auc), 6), round(stddev_pop(accuracy), 6), round(stddev_pop(f1), 6) FROM e")
def o143_fold_metrics(spark, sf):
    f = metrics.fold_metrics(probabilities(spark, sf).withColumn("fold", F.col("year") % 5), "fold", "prob", "y")
    return f.select("fold", *(F.round(c, 6).alias(c) for c in f.columns if c != "fold"))


@query("WITH s AS (SELECT c_mktsegment AS k, avg(c_nationkey) AS v FROM customer GROUP BY ALL) SELECT (SELECT k FROM s WHERE k NOT IN ('BUILDING', 'MACHINERY') ORDER BY v DESC LIMIT 1) AS best_single, round((SELECT v FROM s WHERE k = 'BUILDING') - (SELECT max(v) FROM s WHERE k NOT IN ('BUILDING', 'MACHINERY')), 6) AS gain_over_single, round((SELECT v FROM s WHERE k = 'BUILDING') - (SELECT v FROM s WHERE k = 'MACHINERY'), 6) AS gain_over_baseline")
def o142_deltas(spark, sf):
    s = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.avg("c_nationkey").alias("v"))
    d = metrics.deltas(s, "k", "BUILDING", "MACHINERY", "v")
    return d.withColumns({c: F.round(c, 6) for c in ("gain_over_single", "gain_over_baseline")})


@query(
    f"""WITH {M}, v AS (SELECT CASE WHEN year < 1997 THEN 'train' ELSE 'test' END AS s, label AS y, (match_key * 37 % 1000) / 1000E0 AS p FROM m WHERE label IS NOT NULL),
r AS (SELECT s, y, p, rank() OVER (PARTITION BY s ORDER BY p) + (count(*) OVER (PARTITION BY s, p) - 1) / 2E0 AS rk FROM v),
g AS (SELECT s, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2E0) / (sum(y) * sum(1 - y)) AS auc, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1E0 ELSE 0E0 END) AS accuracy,
  2E0 * count(*) FILTER (p >= 0.5 AND y = 1) / (count(*) FILTER (p >= 0.5) + sum(y)) AS f1, greatest(avg(y), 1 - avg(y)) AS majority FROM r GROUP BY s)
SELECT round(a.auc, 8) AS train_auc, round(a.accuracy, 8) AS train_accuracy, round(a.f1, 8) AS train_f1, round(b.auc, 8) AS test_auc, round(b.accuracy, 8) AS test_accuracy, round(b.f1, 8) AS test_f1, round(b.majority, 8) AS test_majority,
  round(a.auc - b.auc, 8) AS auc_gap, round(a.accuracy - b.accuracy, 8) AS accuracy_gap, a.accuracy - b.accuracy > 0.05 AS overfit, round(b.accuracy - b.majority, 8) AS over_majority FROM g a, g b WHERE a.s = 'train' AND b.s = 'test'"""
)
def o142_overfit_report(spark, sf):
    """A score by the key's residue, on the years before 1997 and from then on."""
    m = matches(spark, sf).where("label is not null").withColumn("p", (F.col("match_key") * 37 % 1000) / 1000)
    r = metrics.overfit_report(m.where("year < 1997"), m.where("year >= 1997"), "p", "label")
    return r.select(*(F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


@query(f"WITH {M}, {P}, d AS (SELECT *, match_key % 4 AS sa, match_key % 7 AS sb FROM m UNION ALL SELECT *, match_key % 4, match_key % 7 FROM m WHERE map LIKE '1%'), s AS (SELECT match_key, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM p GROUP BY ALL) SELECT (SELECT CAST(count(*) AS BIGINT) FROM d) AS n_matches, (SELECT CAST(count(*) - count(DISTINCT match_key) AS BIGINT) FROM d) AS duplicate_keys, (SELECT CAST(count(*) - count(DISTINCT team) AS BIGINT) FROM d) AS duplicate_dedup_keys, (SELECT CAST(count(*) FILTER (sa = 0 OR sb = 0) AS BIGINT) FROM d) AS zero_scores, (SELECT CAST(count(*) AS BIGINT) FROM p) AS n_players, (SELECT CAST(count(*) AS BIGINT) FROM p WHERE qty > 40) AS clipped, CAST(count(*) FILTER (a = 2 AND b = 2) AS BIGINT) AS \"full\", CAST(count(*) FILTER (a <> 2 OR b <> 2) AS BIGINT) AS incomplete FROM s")
def o127_quality_report(spark, sf):
    """Urgent matches come twice; scores are residues of the key, so some are zero."""
    m = matches(spark, sf)
    m = m.unionByName(m.where("map like '1%'")).withColumns({"sa": F.col("match_key") % 4, "sb": F.col("match_key") % 7})
    return audit.quality_report(m, participants(spark, sf), "match_key", "team", "side", 2, "sa", "sb", "qty", 40.0)


@query(f"WITH {M} SELECT CAST(count(*) AS BIGINT) AS flips FROM (SELECT team, map FROM m GROUP BY ALL HAVING count(DISTINCT label) > 1)")
def o86_perspective_flips(spark, sf):
    return audit.perspective_flips(matches(spark, sf), ["team", "map"], "label")


@query("SELECT CAST(count(*) AS BIGINT) AS collisions FROM (SELECT lower(n) FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY lower(n) HAVING count(DISTINCT n) > 1)")
def o86_case_collisions(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return audit.case_collisions(s.select(F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n")), "n")


@query("SELECT DISTINCT source FROM documents WHERE NOT (source LIKE 'src1%' OR source LIKE 'src2%')")
def o140_disallowed_sources(spark, sf):
    return audit.disallowed_sources(table(spark, sf, "documents"), ["src1", "src2"])


@query(f"WITH {M} SELECT 0E0 AS largest, min(year) AS first_period FROM m")
def o129_earliest_period(spark, sf):
    from matchloom.operators import history

    h = history.outcome_history(matches(spark, sf), ["team"], "year", "label")
    return audit.earliest_period_leak(h.select("year", F.col("prior_n").cast("double").alias("prior_n"), "margin"), "year", ["prior_n", "margin"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def o93_history_page(spark, sf):
    o = table(spark, sf, "orders")
    return tables.history_page(o, 50, 100, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def o93_history_list(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return tables.history_list(o, 50, 100, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice", "total")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def o93_history_after(spark, sf):
    """The second page, by the position of the first one's last row."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    last = tables.history_after(o, None, 50, "o_orderdate", "o_orderkey").orderBy("o_orderdate", F.desc("o_orderkey")).first()
    return tables.history_after(o, (last.o_orderdate, last.o_orderkey), 50, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def o94_point_lookup(spark, sf):
    return tables.history_get(table(spark, sf, "orders"), 77, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(f"WITH {P}, l AS (SELECT match_key, side, string_agg(CAST(player AS VARCHAR), ',' ORDER BY part, line, player) AS players, string_agg(agent, ',' ORDER BY part, line, player) AS agents FROM p GROUP BY ALL) SELECT match_key, coalesce(max(players) FILTER (side = 'a'), '') AS players_a, coalesce(max(agents) FILTER (side = 'a'), '') AS agents_a, coalesce(max(players) FILTER (side = 'b'), '') AS players_b, coalesce(max(agents) FILTER (side = 'b'), '') AS agents_b FROM l GROUP BY match_key")
def o144_request_lists(spark, sf):
    """Each match's participants as a stored request, and the lists read back from its JSON."""
    slot = F.struct("part", "line", "player", "agent")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, slot))), lambda x: F.struct(x["player"].cast("string").alias("player"), x["agent"])).alias(f"team_{s}") for s in "ab"]  # a match's own participants
    stored = participants(spark, sf).groupBy("match_key").agg(*lists).select("match_key", F.to_json(F.struct("team_a", "team_b")).alias("request_json"))
    r = tables.request_lists(stored)
    return r.select("match_key", *(F.array_join(c, ",").alias(c) for c in ("players_a", "agents_a", "players_b", "agents_b")))


@query("SELECT concat('{\"n_nationkey\":', CAST(n_nationkey AS VARCHAR), ',\"n_name\":\"', n_name, '\",\"n_regionkey\":', CAST(n_regionkey AS VARCHAR), '}') AS json FROM nation")
def o08_json_rows(spark, sf):
    return tables.as_json(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT event_id, value FROM events WHERE isfinite(value)")
def o148_finite(spark, sf):
    from matchloom.functions.normalize import finite

    return table(spark, sf, "events").where(finite(F.col("value"))).select("event_id", "value")


@query(f"WITH {A} SELECT year, CAST(count(*) AS BIGINT) AS n FROM a WHERE side IN ('a', 'b') GROUP BY year")
def o127_rows_by_year(spark, sf):
    return appearances(spark, sf).where(F.col("side").isin("a", "b")).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT source, CASE WHEN n_chars < 300 THEN 'missing' WHEN n_chars < 1000 THEN 'partial' ELSE 'iso' END AS quality, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def o57_date_quality(spark, sf):
    from matchloom.functions.normalize import date_quality

    date = F.when(F.col("n_chars") < 300, "").when(F.col("n_chars") < 1000, "May 2021").otherwise("2021-05-06")
    return table(spark, sf, "documents").groupBy("source", date_quality(date).alias("quality")).agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT match_key, count(*) FILTER (side = 'a') = 2 AND count(*) FILTER (side = 'b') = 2 AND count(DISTINCT player) = 4 AND count(DISTINCT agent) FILTER (side = 'a') = 2 AND count(DISTINCT agent) FILTER (side = 'b') = 2 AS valid FROM p GROUP BY match_key")
def o131_valid_lineups(spark, sf):
    slot = F.struct(F.col("player").cast("string").alias("player"), "agent")
    sides = [F.collect_list(F.when(F.col("side") == s, slot)).alias(f"lineup_{s}") for s in "ab"]  # a match's own participants
    return participants(spark, sf).groupBy("match_key").agg(*sides).select("match_key", audit.valid_lineups(size=2).alias("valid"))


@query(f"WITH {M}, {P}, s AS (SELECT match_key, sum(qty) AS qty FROM p GROUP BY match_key) SELECT match_key, year, map, qty FROM m JOIN s USING (match_key)")
def o56_inner_merge(spark, sf):
    return conform.inner_merge(matches(spark, sf).select("match_key", "year", "map"), participants(spark, sf).select("match_key", "qty"), ["match_key"], ["qty"])


@query(f"WITH {M}, {P}, g AS (SELECT match_key, side, string_agg(CAST(player AS VARCHAR), ',' ORDER BY player, agent) AS players FROM p GROUP BY ALL HAVING count(*) >= 2) SELECT m.match_key, map, x.players AS players_a, y.players AS players_b FROM m JOIN g x ON m.match_key = x.match_key AND x.side = 'a' JOIN g y ON m.match_key = y.match_key AND y.side = 'b'")
def o47_player_groups(spark, sf):
    """Matches with the players of both sides, where both have at least two."""
    scores = matches(spark, sf).select("match_key", "map", F.lit("a").alias("team_a"), F.lit("b").alias("team_b"))
    g = conform.with_player_groups(scores, participants(spark, sf), ["match_key"], "team_a", "team_b", "side", ["player", "agent"], 2)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["player"].cast("string")), ",")
    return g.select("match_key", "map", names("players_a").alias("players_a"), names("players_b").alias("players_b"))


_NAMES = ["a_kills", "h2h_wr", "map_prior_wr", "a_p1_kd", "round_diff", "team_a_id", "recent5_wr", "a_score", "winner", "hs", "acs_mean", "b_is_attacker", "prior_kd", "score", "a_prior_kd_mean", "map_one", "synergy_mean", "team_games", "a_team_b"]
_LEAKS = "regexp_matches(name, '(^|_)score(_|$)|winner|result|round|(^|_)(acs|kills|deaths|assists|hs)($|_)|(^|_)team_[ab]($|_)|h2h|prior_wr|map_wr|recent5_wr|map_prior|agent_prior|recent5|atk_side|is_attacker|^[ab]_p[1-5]_')"


@query(f"SELECT name FROM (SELECT unnest({_NAMES}) AS name UNION ALL SELECT column_name FROM (DESCRIBE orders)) WHERE {_LEAKS}")
def o39_forbidden_names(spark, sf):
    found = features.forbidden_names([*_NAMES, *table(spark, sf, "orders").columns])
    return spark.createDataFrame([(n,) for n in found], "name string")


@query("SELECT user_id, event_id, event_type IS NOT NULL AND user_id % 120 + 1990 BETWEEN 2000 AND 2099 AND user_id % 3 <> 0 AND user_id % 7 <> 0 AS valid FROM events")
def o150_valid_requests(spark, sf):
    """Requests made of events: every third has a short lineup, every seventh an empty player."""
    u = F.col("user_id")
    slot = F.struct(F.when(u % 7 == 0, "").otherwise("p").alias("player"), F.lit("x").alias("agent"))
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("map"), (u % 120 + 1990).alias("cutoff_year"), F.array_repeat(slot, 5).alias("team_a"), F.array_repeat(slot, F.when(u % 3 == 0, 4).otherwise(5)).alias("team_b"))
    return e.select("user_id", "event_id", audit.valid_requests().alias("valid"))


_TRUST = f"WITH {M}, {_B}, s AS (SELECT *, CASE WHEN year >= test_from_year THEN 'test' ELSE 'train' END AS split, CASE WHEN team % 10 = 0 THEN 'other_x' ELSE 'kaggle_x' END AS source FROM m, b)"


@query(f"{_TRUST} SELECT CAST(count(*) FILTER (split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS n_test, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT team FROM s GROUP BY team HAVING count(DISTINCT split) > 1)) AS overlap, 'feature_count,sources_allowed,no_overlap' AS failures, 'feature_count,split_overlap,sources,weights,auc' AS gate_failures, 'untrusted' AS verdict FROM s")
def o128_o130_o152_trust(spark, sf):
    """The trust report over teams, with a foreign source, and the gate that it fails."""
    s = splits.chrono_split(matches(spark, sf), "year")
    s = s.withColumn("source", F.when(F.col("team") % 10 == 0, "other_x").otherwise("kaggle_x"))
    r = audit.trust_report(s, "split", "team", "year", ["prior_kd_mean", "a_role_balance"], 179, ["kaggle_", "vlrgg_"])
    g = audit.advanced_gate(r, {"rf": 179, "gbt": 179}, {"feature_contract": "advanced", "n_features": 179, "weights": [2.0, 0.0, 1.0]}, 0, None, 0.6)
    failed = ",".join(k for k, v in g["checks"].items() if v == "failed")
    row = (r["rows"]["train"], r["rows"]["test"], r["overlap"], ",".join(r["failures"]), failed, g["verdict"])
    return spark.createDataFrame([row], "n_train long, n_test long, overlap long, failures string, gate_failures string, verdict string")


_METRICS = '{"models":{"rf":{"train":{"auc":0.91,"acc":0.8,"f1":0.79},"test":{"auc":0.6965,"acc":0.64,"f1":0.65,"confusion_matrix":[[5,2],[3,6]]}},"gbt":{"test":{"auc":0.7007}},"none":{}},"train_auc":0.9,"test_auc":0.701,"test_acc":0.6454,"test_f1":0.6478}'


def _metrics(spark):
    return spark.sql("select 1").select(F.from_json(F.lit(_METRICS), reports.METRICS).alias("m")).select("m.*")


@query("SELECT * FROM (VALUES ('rf', 0.91E0, 0.6965E0, 0.64E0, 0.65E0, '5,2,3,6'), ('gbt', NULL, 0.7007E0, NULL, NULL, NULL)) t(name, train_auc, test_auc, acc, f1, cells)")
def o146_member_rows(spark, sf):
    r = reports.member_rows(_metrics(spark))
    return r.select("name", "train_auc", "test_auc", "acc", "f1", F.when(F.col("confusion_matrix").isNotNull(), F.array_join(F.flatten("confusion_matrix").cast("array<string>"), ",")).alias("cells"))


@query("SELECT 421 AS baseline_feature_count, 0.5943E0 AS baseline_test_auc, 0.5667E0 AS baseline_test_acc, 0.6072E0 AS baseline_test_f1, 0.701E0 AS advanced_test_auc, 0.6454E0 AS advanced_test_acc, 0.6478E0 AS advanced_test_f1, round(0.701E0 - 0.5943E0, 6) AS delta_test_auc, 0.701E0 AS primary_auc, 0.9E0 AS secondary_auc, 'Train AUC' AS secondary_label")
def o146_o153_against_baseline(spark, sf):
    m = _metrics(spark)
    b = reports.against_baseline(m).withColumn("delta_test_auc", F.round("delta_test_auc", 6))
    return b.crossJoin(reports.headline(m).select("primary_auc", "secondary_auc", "secondary_label"))  # two rows of one


_ROLES = ("ECONOMY", "PROMO", "STANDARD")


@query(f"""WITH {P}, c AS (SELECT match_key, {", ".join(f"count_if(role = '{r}' AND side = 'a') - count_if(role = '{r}' AND side = 'b') AS {r}" for r in _ROLES)} FROM p GROUP BY match_key)
SELECT match_key, concat(CASE WHEN ECONOMY = 0 AND PROMO = 0 AND STANDARD = 0 THEN 'as the composition that wins most' ELSE concat_ws(', ',
  CASE WHEN ECONOMY > 0 THEN concat(ECONOMY, ' more ECONOMY') WHEN ECONOMY < 0 THEN concat(-ECONOMY, ' fewer ECONOMY') END,
  CASE WHEN PROMO > 0 THEN concat(PROMO, ' more PROMO') WHEN PROMO < 0 THEN concat(-PROMO, ' fewer PROMO') END,
  CASE WHEN STANDARD > 0 THEN concat(STANDARD, ' more STANDARD') WHEN STANDARD < 0 THEN concat(-STANDARD, ' fewer STANDARD') END) END,
  ' (nearest composition wins ', match_key % 101, '%)') AS message FROM c""")
def o145_vector_message(spark, sf):
    """What sets one side's part types of an order apart from the other's, told as text."""
    counts = [F.count_if((F.col("role") == r) & (F.col("side") == s)).alias(f"{r}_{s}") for r in _ROLES for s in "ab"]
    rows = participants(spark, sf).groupBy("match_key").agg(*counts)
    message = audit.vector_message(_ROLES, [F.col(f"{r}_a") for r in _ROLES], [F.col(f"{r}_b") for r in _ROLES], F.col("match_key") % 101 / 100)
    return rows.select("match_key", message.alias("message"))


_LABELS = {
    "map_atk_adv": "Map attack advantage", "map_bind": "Map: Bind", "a_role_duelist_count": "Team A: duelist picks", "b_agent_kayo_count": "Team B: KAY/O picks",
    "diff_prior_kd_mean": "A over B: Players' mean K/D of earlier years", "a_synergy_mean": "Team A: Mean games played together", "b_map_agent_adr_mean": "Team B: Mean adr of earlier years by map and agent",
    "player_agent_history_missing": "No player-agent history", "diff_agent_map_fit": "A over B: Fit of agents to the map", "a_has_controller": "Team A: Has a controller", "unknown": "unknown",
}


@query("SELECT unnest(" + repr(list(_LABELS)) + ") AS name, unnest([" + ", ".join("'" + v.replace("'", "''") + "'" for v in _LABELS.values()) + "]) AS label")
def o27_feature_labels(spark, sf):
    words = {"bind": "Bind", "kayo": "KAY/O", "kd": "K/D"}
    return spark.createDataFrame([(n, feature_label(n, words)) for n in _LABELS], "name string, label string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS c_mktsegment FROM customer")
def o02_header_drift(spark, sf):
    """Customers written as CSV files of three headers (other orders, a column absent, one more) and read by each file's own."""
    root, c = shared_dir(spark), table(spark, sf, "customer")
    for i, names in enumerate((["c_custkey", "c_name", "c_nationkey"], ["c_nationkey", "c_custkey"], ["c_mktsegment", "c_name", "c_custkey", "c_nationkey"])):
        c.where(F.col("c_custkey") % 3 == i).select(*names).write.csv(f"{root}/feed_{i}", header=True)
    return tables.read_csv(spark, f"{root}/feed_*/*.csv", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
