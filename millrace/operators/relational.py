"""The seven relational queries over the order tables.

`day` is a whole date, `yyyy-MM-dd`; anything else raises ValueError. Null dates match nothing. Orderings of limited
results are total over their columns. The tables of this project have no clerk and no ship priority: the order
priority stands for both.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import relational as sql


def _day(day: str | date) -> str:
    return str(date.fromisoformat(day) if isinstance(day, str) else date(day.year, day.month, day.day))


def _run(text: str, args: dict, **tables: DataFrame) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    if "day" in args:
        args = args | {"day": _day(args["day"])}
    return spark.sql(text, args=args, **tables)


def shipdate_count(lineitem: DataFrame, day: str) -> DataFrame:
    """(n): line items shipped on the day."""
    return _run(sql.Q1, {"day": day}, lineitem=lineitem)


def clerks(lineitem: DataFrame, orders: DataFrame, day: str, clerk: str = "o_orderpriority") -> DataFrame:
    """(clerk, o_orderkey): the first 20 by order key, one row per line item shipped on the day."""
    return _run(sql.Q2, {"day": day, "clerk": clerk}, lineitem=lineitem, orders=orders)


def parts_and_suppliers(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, day: str) -> DataFrame:
    """(l_orderkey, p_name, s_name): the first 20 by order key."""
    return _run(sql.Q3, {"day": day}, lineitem=lineitem, part=part, supplier=supplier)


def shipped_to_nations(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, day: str) -> DataFrame:
    """(n_nationkey, n_name, n): line items shipped on the day to each nation that got any."""
    return _run(sql.Q4, {"day": day}, lineitem=lineitem, orders=orders, customer=customer, nation=nation)


def monthly_by_nation(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, nations: list[str], any_case: bool = False) -> DataFrame:
    """(n_nationkey, n_name, month, n): line items shipped per month to the named nations, with `any_case` however the
    table writes them."""
    text, names = (sql.Q5_ANY_CASE, [n.upper() for n in nations]) if any_case else (sql.Q5, nations)
    return _run(text, {"nations": F.lit(names)}, lineitem=lineitem, orders=orders, customer=customer, nation=nation)


def pricing_summary(lineitem: DataFrame, day: str) -> DataFrame:
    """Sums, averages and count by return flag and line status of the items shipped on the day."""
    return _run(sql.Q6, {"day": day}, lineitem=lineitem)


def shipping_priority(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, day: str, priority: str = "o_orderpriority", unknown: bool = False) -> DataFrame:
    """The ten orders of highest revenue placed before and shipped after the day (both strict). With `unknown`, orders
    whose customer has no record count too, under an empty name."""
    return _run(sql.Q7_LEFT if unknown else sql.Q7, {"day": day, "priority": priority}, customer=customer, orders=orders, lineitem=lineitem)
