"""Conformance queries: normalising, filtering, pairing, dedup and gates."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import normalize as n
from matchloom.operators import conform, features
from matchloom.plans.bindings import A, M, P, appearances, matches, participants, table
from matchloom.plans.registry import collector

QUERIES, ORACLES, query = collector()


@query("SELECT doc_id, substr(sha1(concat(source, '|', CAST(doc_id AS VARCHAR), '|', lang)), 1, 16) AS match_key, substr(sha1(concat(CAST(n_chars % 7 AS VARCHAR), '|', least(lower(trim(source)), lower(trim(lang))), '|', greatest(lower(trim(source)), lower(trim(lang))), '|m|', CAST(least(n_chars, doc_id) AS VARCHAR), '|', CAST(greatest(n_chars, doc_id) AS VARCHAR))), 1, 24) AS dedup_key FROM documents")
def o19_surrogate_keys(spark, sf):
    c = F.col
    key = n.match_dedup_key(c("n_chars") % 7, c("source"), c("lang"), F.lit("m"), c("n_chars"), c("doc_id"))
    return table(spark, sf, "documents").select("doc_id", n.surrogate_key(c("source"), c("doc_id"), c("lang")).alias("match_key"), key.alias("dedup_key"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS alnum, lower(trim(p_name)) AS clean, CASE WHEN lower(trim(p_type)) IN ('', 'nan') THEN NULL ELSE trim(p_type) END AS cleaned FROM part")
def o13_o20_o139_text_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", n.alnum_key(F.col("p_brand")).alias("alnum"), n.clean_key(F.col("p_name")).alias("clean"), n.null_clean(F.col("p_type")).alias("cleaned"))


_RAW = "CASE event_id % 5 WHEN 0 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '%') WHEN 1 THEN '0.25' WHEN 2 THEN 'x' WHEN 3 THEN '' ELSE '1' END"


@query(f"WITH r AS (SELECT event_id, {_RAW} AS raw FROM events), v AS (SELECT event_id, try_cast(rtrim(trim(raw), '%') AS DOUBLE) AS v, try_cast(trim(raw) AS DOUBLE) AS d FROM r) SELECT event_id, CASE WHEN v > 1 THEN v / 100 ELSE v END AS pct, coalesce(d, -1) AS num FROM v")
def o16_o18_o31_lenient_numbers(spark, sf):
    e = F.col("event_id") % 5
    raw = F.when(e == 0, F.concat(F.floor("value").cast("string"), F.lit("%"))).when(e == 1, "0.25").when(e == 2, "x").when(e == 3, "").otherwise("1")
    return table(spark, sf, "events").select("event_id", n.percent(raw).alias("pct"), n.to_double(raw, -1.0).alias("num"))


_EVENT = "CASE o_custkey % 4 WHEN 0 THEN 'Masters ' || CAST(o_orderdate AS VARCHAR) WHEN 1 THEN 'Patch 8.05' ELSE o_orderpriority END"
_DATE = "CASE o_custkey % 3 WHEN 0 THEN 'Patch 7.01' WHEN 1 THEN CAST(o_orderdate AS VARCHAR) WHEN 2 THEN 'Patch 99.1' END"
_FOUND = "coalesce(nullif(regexp_extract(event, '(20[12][0-9])', 1), ''), nullif(regexp_extract(date, '(20[12][0-9])', 1), ''))"


@query(f"WITH e AS (SELECT o_orderkey, {_EVENT} AS event, {_DATE} AS date FROM orders), y AS (SELECT o_orderkey, CAST({_FOUND} AS INTEGER) AS named, CASE regexp_extract(date, 'Patch (\\d+)\\.\\d+', 1) WHEN '7' THEN 2023 WHEN '8' THEN 2024 END AS patch FROM e) SELECT o_orderkey, coalesce(named, patch) AS year, CASE WHEN named IS NOT NULL THEN 'event' WHEN patch IS NOT NULL THEN 'patch' ELSE 'unknown' END AS year_source FROM y")
def o15_year_cascade(spark, sf):
    """A patch counts where the date names it, not where the event does."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_custkey")
    event = F.when(k % 4 == 0, F.concat(F.lit("Masters "), day)).when(k % 4 == 1, "Patch 8.05").otherwise(F.col("o_orderpriority"))
    date = F.when(k % 3 == 0, "Patch 7.01").when(k % 3 == 1, day).otherwise("Patch 99.1")
    y, s = n.year_and_source(event, date, {7: 2023, 8: 2024})
    return table(spark, sf, "orders").select("o_orderkey", y.alias("year"), s.alias("year_source"))


@query(f"WITH {P} SELECT match_key, line, part, player, price, CASE WHEN line = 5 THEN 0E0 ELSE least(qty / greatest(line - 1, 1), 10.0) END AS kd, coalesce(qty / nullif(line - 1, 0), 0.0) AS per_round FROM p")
def o17_o21_o22_ratios(spark, sf):
    deaths = F.when(F.col("line") == 5, "x").when(F.col("line") == 1, "").otherwise((F.col("line") - 1).cast("string"))
    k = n.kill_ratio(F.col("qty"), deaths, cap=10)
    return participants(spark, sf).select("match_key", "line", "part", "player", "price", k.alias("kd"), n.per_round(F.col("qty"), (F.col("line") - 1).cast("double")).alias("per_round"))


@query("SELECT p_partkey, list_aggregate([trim(x) for x in string_split(replace(p_name, ' ', '|'), '|') if trim(x) <> ''], 'string_agg', '/') AS items, array_to_string(list_sort(string_split(replace(p_name, ' ', '|'), '|')), '|') AS comp FROM part")
def o23_o25_lists(spark, sf):
    c = F.regexp_replace("p_name", " ", "|")
    return table(spark, sf, "part").select("p_partkey", F.array_join(n.pipe_list(c), "/").alias("items"), n.composition_key(F.split(c, r"\|")).alias("comp"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(floor(l_quantity) AS INTEGER) END AS sa, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS INTEGER) END AS sb FROM lineitem")
def o24_score_pairs(spark, sf):
    q = F.floor("l_quantity").cast("string")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(" - x"))).otherwise(F.concat(q, F.lit(" - "), F.col("l_linenumber").cast("string")))
    s = n.score_pair(text)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", s["a"].alias("sa"), s["b"].alias("sb"))


_ROLES = ("ECONOMY", "MEDIUM", "PROMO", "SMALL", "STANDARD", "LARGE")
_E = "CASE WHEN {0} > 0 THEN -({0} / t) * log2({0} / t) ELSE 0 END"
_C = [f"c{i}" for i in range(1, 7)]


@query(f"WITH {P}, rc AS (SELECT match_key, side, {', '.join(f"count(*) FILTER (role LIKE '{r}%') AS {c}" for r, c in zip(_ROLES, _C))} FROM p GROUP BY ALL), t AS (SELECT *, CAST({' + '.join(_C)} AS DOUBLE) AS t FROM rc) SELECT match_key, side, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _C)}, round(CASE WHEN t > 0 THEN ({' + '.join(_E.format(c) for c in _C)}) / 2 ELSE 0 END, 6) AS balance, round(1 - ({' + '.join(f'abs({c} - 1)' for c in _C)}) / 10E0, 6) AS similarity FROM t")
def o26_o29_o135_role_vectors(spark, sf):
    """Each side's counts of all six roles, their entropy, and how near they are to one of each."""
    v = participants(spark, sf).groupBy("match_key", "side").agg(*(F.count_if(F.col("role").startswith(r)).alias(c) for r, c in zip(_ROLES, _C)))
    cs = [F.col(c) for c in _C]
    return v.select("match_key", "side", *cs, F.round(n.entropy(cs), 6).alias("balance"), F.round(n.vector_similarity(cs, [F.lit(1)] * 6), 6).alias("similarity"))


@query("SELECT o_orderkey, concat_ws(' | ', strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, concat('c', CAST(o_custkey AS VARCHAR), ' vs ', o_orderstatus), CAST(o_orderkey AS VARCHAR)) AS label FROM orders")
def o28_labels(spark, sf):
    label = n.match_label(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.concat(F.lit("c"), F.col("o_custkey")), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


@query("SELECT s_suppkey, n_name AS nation, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN lower(r_name) END AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def o11_o12_o14_o32_dimensions(spark, sf):
    """Raw names in odd spelling come back as canonical ones; a region outside the list has no role."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    raw = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    raw = raw.select("s_suppkey", F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("nation"), F.col("r_name").alias("role"))
    named = n.with_canonical(raw, "nation", nation, "n_name", "n_name", keep_unknown=True)
    return named.select("s_suppkey", "nation", n.resolved_role(F.lit(None).cast("string"), F.col("role"), ["asia", "europe"]).alias("role"))


@query("SELECT count(*) AS n FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND c_nationkey NOT IN (0, 1, 2, 3, 4)")
def o33_o34_prefilter(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(conform.equals_ignoring_case(F.col("c_mktsegment"), "BUILDING") & ~F.col("c_nationkey").isin(0, 1, 2, 3, 4)).agg(F.count("*").alias("n"))


@query(f"WITH {A}, k AS (SELECT * FROM m WHERE map LIKE '1%' OR map LIKE '2%') SELECT map, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT match_key) AS BIGINT) AS n_matches FROM a WHERE match_key IN (SELECT match_key FROM k) AND (map LIKE '1%' OR map LIKE '2%') GROUP BY map")
def o35_o53_source_contract(spark, sf):
    _, people, _ = conform.source_contract(matches(spark, sf), appearances(spark, sf), ["1", "2"], "match_key", "map")
    return people.groupBy("map").agg(F.count("*").alias("n"), F.count_distinct("match_key").alias("n_matches"))


@query(f"WITH {M} SELECT map, CAST(count(*) AS BIGINT) AS excluded FROM m WHERE NOT (map LIKE '1%' OR map LIKE '2%') GROUP BY map")
def o35_excluded_sources(spark, sf):
    return conform.source_contract(matches(spark, sf), appearances(spark, sf), ["1", "2"], "match_key", "map")[2].withColumnRenamed("source", "map")


_SC = "sc AS (SELECT match_key, count(*) FILTER (side = 'a') AS sa, count(*) FILTER (side = 'b') AS sb, min(CAST(player AS VARCHAR)) AS ta, max(CAST(part AS VARCHAR)) AS tb FROM p GROUP BY ALL)"


def _scores(spark, sf):
    return participants(spark, sf).groupBy("match_key").agg(F.count_if(F.col("side") == "a").alias("sa"), F.count_if(F.col("side") == "b").alias("sb"), F.min(F.col("player").cast("string")).alias("ta"), F.max(F.col("part").cast("string")).alias("tb"))


@query(f"WITH {P}, {_SC} SELECT match_key, CASE WHEN ta <= tb THEN ta ELSE tb END AS ta, CASE WHEN ta <= tb THEN tb ELSE ta END AS tb, CAST(CASE WHEN ta <= tb THEN sa ELSE sb END AS BIGINT) AS sa, CAST(CASE WHEN ta <= tb THEN sb ELSE sa END AS BIGINT) AS sb, CASE WHEN (sa > sb) = (ta <= tb) THEN 1 ELSE 0 END AS label FROM sc WHERE sa <> sb AND sa <> 0 AND sb <> 0")
def o36_o37_o38_canonical(spark, sf):
    d = conform.decisive(conform.without_forfeits(_scores(spark, sf), "sa", "sb"), "sa", "sb")
    return conform.canonical_sides(d, [("ta", "tb"), ("sa", "sb")], "label").select("match_key", "ta", "tb", "sa", "sb", "label")


@query("SELECT DISTINCT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def o96_keep_first(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return conform.keep_first(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source DESC, doc_id) AS r FROM documents) WHERE r = 1")
def o96_source_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha1("text").alias("dedup"))
    # sources are few; their descending order becomes a rank
    names = d.select("source").distinct()
    ranked = d.join(names.withColumn("r", F.row_number().over(Window.orderBy(F.desc("source")))), "source")
    return conform.source_dedup(ranked, "doc_id", "dedup", F.col("r")).select("doc_id", "source")


@query(f"WITH {A}, s AS (SELECT match_key, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b FROM a GROUP BY ALL) SELECT match_key, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b FROM s WHERE n_a >= 2 AND n_b >= 2")
def o71_full_sides(spark, sf):
    return conform.full_sides(appearances(spark, sf), "match_key", "side", 2, at_least=True)


@query(f"WITH {A}, s AS (SELECT match_key FROM a GROUP BY ALL HAVING count(*) FILTER (side = 'a') >= 2 AND count(*) FILTER (side = 'b') >= 2) SELECT match_key, year FROM m WHERE match_key NOT IN (SELECT match_key FROM s)")
def o54_gated_out(spark, sf):
    return conform.gate(matches(spark, sf), appearances(spark, sf), "match_key", "side", 2, at_least=True)[2].select("match_key", "year")


_LINE = "r AS (SELECT match_key, side, player, min(part) AS part FROM p GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY match_key, side ORDER BY player) AS slot FROM r)"


@query(f"WITH {P}, {_LINE} SELECT match_key, side, player, CAST(slot AS INTEGER) AS slot FROM l WHERE slot <= 2")
def o98_lineup(spark, sf):
    p = participants(spark, sf).select("match_key", "side", "player", "part")
    return conform.lineup(p, "match_key", "side", ["player"], 2, ["player"]).select("match_key", "side", "player", "slot")


@query(f"WITH {P}, {_LINE}, f AS (SELECT * FROM l WHERE slot <= 2), ok AS (SELECT match_key FROM f GROUP BY ALL HAVING count(*) FILTER (side = 'a') = 2 AND count(*) FILTER (side = 'b') = 2) SELECT match_key, side, player, CAST(slot AS INTEGER) AS slot FROM f WHERE match_key IN (SELECT match_key FROM ok)")
def o72_assembled(spark, sf):
    p = conform.keep_first(participants(spark, sf).select("match_key", "side", "player", "part"), ["match_key", "side", "player"], [F.col("part")])
    return conform.assembled(p, "match_key", "side", ["player"], 2).select("match_key", "side", "player", "slot")


@query(f"WITH {P}, {_LINE}, g AS (SELECT match_key, string_agg(CAST(player AS VARCHAR), ',' ORDER BY slot) FILTER (side = 'a') AS la, string_agg(CAST(player AS VARCHAR), ',' ORDER BY slot) FILTER (side = 'b') AS lb, count(*) FILTER (side = 'a') AS ca, count(*) FILTER (side = 'b') AS cb FROM l WHERE slot <= 2 GROUP BY ALL) SELECT match_key, CASE WHEN ca = 2 AND cb = 2 THEN la END AS la, CASE WHEN ca = 2 AND cb = 2 THEN lb END AS lb FROM g")
def o137_reassembled(spark, sf):
    p = participants(spark, sf).select("match_key", "side", "player")
    r = conform.reassembled(p, "match_key", "side", ["player"], ["player"], 2)
    return r.select("match_key", *(F.array_join(F.transform(f"lineup_{s}", lambda x: x["player"].cast("string")), ",").alias(f"l{s}") for s in "ab"))


@query("SELECT s_nationkey, s_suppkey, s_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS INTEGER) AS player_slot FROM supplier")
def o92_slots(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name").withColumn("_one", F.lit(1))
    return conform.slots(s, "s_nationkey", "_one", "s_name").select("s_nationkey", "s_suppkey", "s_name", "player_slot")


@query("SELECT o_custkey, min(o_orderkey) AS k_1, max(o_orderkey) AS k_2, min(o_totalprice) FILTER (r = 1) AS price_1, min(o_totalprice) FILTER (r = 2) AS price_2 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey HAVING count(*) = 2")
def o52_paired_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return conform.paired_rows(o, "o_custkey", ["k"], ["k", "price"])


_SIDE = "g AS (SELECT match_key, side, CASE side WHEN 'a' THEN 'b' ELSE 'a' END AS opponent, sum(qty) AS score FROM p GROUP BY ALL)"


@query(f"WITH {P}, {_SIDE} SELECT x.match_key, x.side, x.opponent, x.score, y.score AS opponent_score FROM g x JOIN g y ON x.match_key = y.match_key AND x.opponent = y.side")
def o51_opponents(spark, sf):
    g = participants(spark, sf).groupBy("match_key", "side").agg(F.sum("qty").alias("score"))
    g = g.select("match_key", "side", F.when(F.col("side") == "a", "b").otherwise("a").alias("opponent"), "score")
    return conform.opponents(g, ["match_key"], "side", "opponent", ["score"])


@query("SELECT o_orderkey, n_name AS nation, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def o47_o58_star_join(spark, sf):
    o, c, na = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(na, c.c_nationkey == na.n_nationkey).select("o_orderkey", F.col("n_name").alias("nation"), "o_orderpriority")


@query("WITH x AS (SELECT l_orderkey, min(l_shipdate) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), y AS (SELECT l_orderkey, min(l_shipdate) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) SELECT o_orderkey, CAST(coalesce(year(x.v), year(y.v), 1900) AS INTEGER) AS ship_year FROM orders LEFT JOIN x ON o_orderkey = x.l_orderkey LEFT JOIN y ON o_orderkey = y.l_orderkey")
def o48_o49_o50_lookup(spark, sf):
    """Left lookups with a fallback source and a default."""
    li = table(spark, sf, "lineitem")
    dims = [li.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("ship_year")) for f in "RA"]
    return conform.lookup(table(spark, sf, "orders").select("o_orderkey"), dims, ["o_orderkey"], "ship_year", 1900)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def o55_o57_left_merge(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").drop("o_orderkey")


@query("SELECT k, src, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier UNION ALL SELECT n_nationkey, NULL FROM nation) GROUP BY ALL")
def o103_o104_union(spark, sf):
    feeds = [table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))]
    return conform.union_feeds(feeds).groupBy("k", "src").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def o106_o107_union_distinct(spark, sf):
    t = [table(spark, sf, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return t[0].union(t[1]).union(t[2]).distinct()


_MAPS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _key(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


@query(f"WITH {M} SELECT match_key, {', '.join(f"CASE WHEN map = '{x}' THEN 1E0 ELSE 0E0 END AS map_{_key(x)}" for x in _MAPS)} FROM m")
def o43_one_hot(spark, sf):
    return matches(spark, sf).select("match_key", *features.one_hot(F.col("map"), "map", _MAPS))


_BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))


def _cnt(side: str, brand: str) -> str:
    return f"CAST(count(*) FILTER (side = '{side}' AND agent = '{brand}') AS DOUBLE)"


@query(f"WITH {P} SELECT match_key, " + ", ".join(f"{_cnt('a', b)} AS a_{k}_count, {_cnt('b', b)} AS b_{k}_count, {_cnt('a', b)} - {_cnt('b', b)} AS diff_{k}_count" for b in _BRANDS for k in [_key(b)]) + " FROM p GROUP BY match_key")
def o43_o44_side_counts(spark, sf):
    return features.side_counts(participants(spark, sf), "match_key", "side", "agent", list(_BRANDS))


_W = "w AS (SELECT match_key, coalesce(sum(qty) FILTER (side = 'a'), 0) AS a_q, coalesce(sum(qty) FILTER (side = 'b'), 0) AS b_q, coalesce(CAST(count(*) FILTER (side = 'a') AS DOUBLE), 0) AS a_n, coalesce(CAST(count(*) FILTER (side = 'b') AS DOUBLE), 0) AS b_n FROM p GROUP BY ALL)"


def _wide(spark, sf):
    s = participants(spark, sf).groupBy("match_key", "side").agg(F.sum("qty").alias("q"), F.count("*").cast("double").alias("n"))
    return features.spread_sides(s, "match_key", "side", ["q", "n"])


@query(f"WITH {P}, {_W} SELECT *, a_q - b_q AS diff_q, a_n - b_n AS diff_n, a_q * a_n AS a_qn, b_q * b_n AS b_qn, a_q * a_n - b_q * b_n AS diff_qn, CASE WHEN a_q = 0 AND b_q = 0 THEN 1E0 ELSE 0E0 END AS cold FROM w")
def o44_o45_o46_interactions(spark, sf):
    return features.cold_start(features.interactions(_wide(spark, sf), {"qn": ("q", "n")}), ["q"], "cold")


@query(f"WITH {M}, {P}, {_W}, y AS (SELECT w.*, year FROM w JOIN m USING (match_key)), mn AS (SELECT coalesce(avg(a_q) FILTER (a_q <> 0), 0) AS ma, coalesce(avg(b_q) FILTER (b_q <> 0), 0) AS mb FROM y WHERE year < 1996) SELECT match_key, round(CASE WHEN a_q = 0 THEN ma ELSE a_q END, 6) AS a_q, round(CASE WHEN b_q = 0 THEN mb ELSE b_q END, 6) AS b_q FROM y, mn WHERE year >= 1996")
def o89_o90_o141_impute(spark, sf):
    """The later years' zeros take the means of the years before 1996, never their own."""
    w = _wide(spark, sf).select("match_key", "a_q", "b_q").join(matches(spark, sf).select("match_key", "year"), "match_key")
    means = features.nonzero_means(w.where("year < 1996"), ["a_q", "b_q"])
    i = features.impute_zeros(w.where("year >= 1996").drop("year"), means, ["a_q", "b_q"])
    return i.select("match_key", F.round("a_q", 6).alias("a_q"), F.round("b_q", 6).alias("b_q"))


@query(f"WITH {P}, {_W} SELECT match_key, a_q, 0E0 AS a_missing, b_n FROM w")
def o42_default_fill(spark, sf):
    return features.project(_wide(spark, sf), ["a_q", "a_missing", "b_n"], ["match_key"])


@query(f"WITH {P}, d AS (SELECT agent, role, avg(qty) AS f FROM p WHERE qty > 10 GROUP BY ALL) SELECT match_key, CAST(sum(coalesce(floor(1000 * f), 500)) AS BIGINT) AS fit_thousandths FROM p LEFT JOIN d USING (agent, role) GROUP BY match_key")
def o61_dimension_default(spark, sf):
    p = participants(spark, sf)
    d = p.where("qty > 10").groupBy("agent", "role").agg(F.avg("qty").alias("f"))
    return p.join(d, ["agent", "role"], "left").groupBy("match_key").agg(F.sum(F.coalesce(F.floor(1000 * F.col("f")), F.lit(500))).alias("fit_thousandths"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'missing_text' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' END AS reject_reason FROM documents WHERE text IS NULL OR n_chars < 200 OR lang <> 'en'")
def o06_rejects(spark, sf):
    checks = [("missing_text", F.col("text").isNull()), ("short", F.col("n_chars") < 200), ("language", F.col("lang") != "en")]
    return conform.rejects(table(spark, sf, "documents").select("doc_id", "text", "n_chars", "lang"), checks)[1].select("doc_id", "reject_reason")


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def o41_search_total(spark, sf):
    return table(spark, sf, "documents").where(conform.contains_all(F.col("text"), "The AND")).agg(F.count("*").alias("total"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') ORDER BY doc_id LIMIT 200")
def o41_o102_search_page(spark, sf):
    d = table(spark, sf, "documents").where(conform.contains_all(F.col("text"), "The AND"))
    return d.select("doc_id", "source").orderBy("doc_id").limit(200)
