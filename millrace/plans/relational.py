"""Texts of the relational queries. {name} stands for an input DataFrame, :name for a parameter.

Columns named by a parameter go through IDENTIFIER. Filters are on raw columns, so they reach the Parquet scan; join strategy and order are left to the optimizer.
"""

Q1 = "SELECT count(*) AS n FROM {lineitem} WHERE l_shipdate = CAST(:day AS TIMESTAMP_NTZ)"

Q2 = """
SELECT IDENTIFIER(:clerk) AS clerk, o.o_orderkey
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate = CAST(:day AS TIMESTAMP_NTZ)
ORDER BY o.o_orderkey, clerk LIMIT 20"""

Q3 = """
SELECT l.l_orderkey, p.p_name, s.s_name
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
WHERE l.l_shipdate = CAST(:day AS TIMESTAMP_NTZ)
ORDER BY l.l_orderkey, p.p_name, s.s_name LIMIT 20"""

Q4 = """
SELECT n.n_nationkey, n.n_name, count(*) AS n
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE l.l_shipdate = CAST(:day AS TIMESTAMP_NTZ)
GROUP BY n.n_nationkey, n.n_name ORDER BY n.n_nationkey"""

Q5 = """
SELECT n.n_nationkey, n.n_name, date_format(l.l_shipdate, 'yyyy-MM') AS month, count(*) AS n
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE array_contains(:nations, n.n_name)
GROUP BY n.n_nationkey, n.n_name, month ORDER BY n.n_nationkey, n.n_name, month"""

Q5_ANY_CASE = Q5.replace("n.n_name)\nGROUP", "upper(n.n_name))\nGROUP")

Q6 = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
  sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price,
  sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
  avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate = CAST(:day AS TIMESTAMP_NTZ)
GROUP BY l_returnflag, l_linestatus"""

Q7 = """
SELECT c.c_name, l.l_orderkey, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue, o.o_orderdate, IDENTIFIER(:priority) AS o_shippriority
FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate < CAST(:day AS TIMESTAMP_NTZ) AND l.l_shipdate > CAST(:day AS TIMESTAMP_NTZ)
GROUP BY c.c_name, l.l_orderkey, o.o_orderdate, o_shippriority
ORDER BY revenue DESC, l.l_orderkey, c.c_name LIMIT 10"""

Q7_LEFT = """
SELECT coalesce(c.c_name, '') AS c_name, l.l_orderkey, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue, o.o_orderdate, IDENTIFIER(:priority) AS o_shippriority
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey
WHERE o.o_orderdate < CAST(:day AS TIMESTAMP_NTZ) AND l.l_shipdate > CAST(:day AS TIMESTAMP_NTZ)
GROUP BY coalesce(c.c_name, ''), l.l_orderkey, o.o_orderdate, o_shippriority
ORDER BY revenue DESC, l.l_orderkey, c_name LIMIT 10"""
