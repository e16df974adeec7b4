"""Stored requests against their SQL where only the player's number orders two participants."""

import duckdb

from matchloom.plans import catalog


def test_players_of_one_part_and_line_are_ordered_as_numbers(spark, tmp_path):
    lines = "select * from (values (1, 7, 9, 1), (1, 7, 10, 1), (1, 7, 100, 1), (2, 8, 3, 2)) t(l_orderkey, l_partkey, l_suppkey, l_linenumber)"
    duckdb.sql(f"copy (select *, 'F' as l_linestatus, 1e0 as l_quantity, 2e0 as l_extendedprice from ({lines})) to '{tmp_path}/lineitem.parquet' (format parquet)")
    duckdb.sql(f"copy (select * from (values (7, 'Brand#1', 'SMALL'), (8, 'Brand#2', 'LARGE')) t(p_partkey, p_brand, p_type)) to '{tmp_path}/part.parquet' (format parquet)")
    got = {r.match_key: r.asDict() for r in catalog.QUERIES["o144_request_lists"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        for t in ("lineitem", "part"):
            c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        want = c.sql(catalog.ORACLES["o144_request_lists"])
        assert got == {r[want.columns.index("match_key")]: dict(zip(want.columns, r)) for r in want.fetchall()}
    assert got[1]["players_a"] == "9,10,100"
