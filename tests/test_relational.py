from datetime import datetime

import pytest

from millrace.operators import relational as R

D = datetime


def tables(spark):
    li = spark.createDataFrame(
        [
            (1, 1, 1, 1.0, 100.0, 0.1, 0.0, "N", "O", D(1996, 11, 1)),
            (1, 2, 1, 2.0, 10.0, 0.0, 0.1, "N", "O", D(1996, 11, 2)),
            (2, 1, 9, 2.0, 10.0, 0.0, 0.1, None, "O", D(1996, 11, 1)),
            (3, 1, 1, 2.0, 10.0, 0.0, 0.1, "R", "O", None),
        ],
        "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    )
    orders = spark.createDataFrame([(1, 1, D(1996, 10, 1), "1-U"), (2, 1, D(1996, 11, 1), "2-H"), (3, None, None, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string")
    customer = spark.createDataFrame([(1, "C", 3)], "c_custkey long, c_name string, c_nationkey int")
    nation = spark.createDataFrame([(3, "NATION_3"), (4, "NATION_4")], "n_nationkey int, n_name string")
    part = spark.createDataFrame([(1, "P1")], "p_partkey long, p_name string")
    supplier = spark.createDataFrame([(1, "S1")], "s_suppkey long, s_name string")
    return li, orders, customer, nation, part, supplier


def test_all(spark):
    li, orders, customer, nation, part, supplier = tables(spark)
    day = "1996-11-01"
    assert R.shipdate_count(li, day).first()["n"] == 2
    assert [tuple(r) for r in R.clerks(li, orders, day).collect()] == [("1-U", 1), ("2-H", 2)]
    assert [tuple(r) for r in R.parts_and_suppliers(li, part, supplier, day).collect()] == [(1, "P1", "S1")]
    assert [tuple(r) for r in R.shipped_to_nations(li, orders, customer, nation, day).collect()] == [(3, "NATION_3", 2)]
    assert [tuple(r) for r in R.monthly_by_nation(li, orders, customer, nation, ["NATION_3"]).collect()] == [(3, "NATION_3", "1996-11", 3)]
    assert R.monthly_by_nation(li, orders, customer, nation, ["X"]).count() == 0
    summary = {r["l_returnflag"]: r for r in R.pricing_summary(li, day).collect()}
    assert summary["N"]["sum_disc_price"] == 90.0 and summary[None]["count_order"] == 1
    got = R.shipping_priority(customer, orders, li, day).collect()
    assert [(r["c_name"], r["l_orderkey"], r["revenue"]) for r in got] == [("C", 1, 10.0)]
    assert [tuple(r) for r in R.monthly_by_nation(li, orders, customer, nation, ["nation_3"], any_case=True).collect()] == [(3, "NATION_3", "1996-11", 3)]
    known = customer.where("c_custkey = 9")
    assert R.shipping_priority(known, orders, li, day).count() == 0
    assert [(r["c_name"], r["l_orderkey"], r["revenue"]) for r in R.shipping_priority(known, orders, li, day, unknown=True).collect()] == [("", 1, 10.0)]


def test_bad_date_and_pushdown(spark, tmp_path):
    li = tables(spark)[0]
    with pytest.raises(ValueError):
        R.shipdate_count(li, "1996-11")
    li.write.parquet(f"{tmp_path}/l")
    plan = R.shipdate_count(spark.read.parquet(f"{tmp_path}/l"), "1996-11-01")._jdf.queryExecution().toString()
    assert "EqualTo(l_shipdate,1996-11-01T00:00)" in plan and "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan
    assert R.shipdate_count(li.limit(0), "1996-11-01").first()["n"] == 0


def test_tbl_layout(spark, tmp_path):
    """The usual text layout, with dates, a clerk and a ship priority."""
    from millrace.sources import read_tbl

    (tmp_path / "l.tbl").write_text("1|1|1|1|1|100|0.5|0|N|O|1996-11-02|1996-11-02|1996-11-02|x|y|z|\n")
    (tmp_path / "o.tbl").write_text("1|7|O|1|1996-10-01|1-U|Clerk#9|3|c|\n")
    (tmp_path / "c.tbl").write_text("7|Name|a|3|p|1|s|c|\n")
    li, orders, customer = (read_tbl(spark, f"{tmp_path}/{f}.tbl", t) for f, t in (("l", "lineitem"), ("o", "orders"), ("c", "customer")))
    assert [tuple(r) for r in R.clerks(li, orders, "1996-11-02", "o_clerk").collect()] == [("Clerk#9", 1)]
    got = R.shipping_priority(customer, orders, li, "1996-11-01", "o_shippriority").first()
    assert (got["c_name"], got["revenue"], got["o_shippriority"]) == ("Name", 50.0, 3)
