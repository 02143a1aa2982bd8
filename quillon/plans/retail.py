"""A sheet of regional revenue with its totals row, and the orders behind a day's figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regional_revenue(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """(month, region, orders, customers, revenue) and one row of totals, whose month and region are null.

    Orders that agree in customer, date, price, status and priority count once. The dimension joins are left to
    the planner, which broadcasts what is small; the total is one more grouping set of the same pass.
    """
    keys = ["o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    clean = orders.where(F.col("o_totalprice") > 0).dropDuplicates(keys)
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    rows = clean.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(where, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate")))
    return rows.groupingSets([("month", "region"), ()], "month", "region").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.sum("o_totalprice").alias("revenue"))


def top_orders(orders: DataFrame, n: int = 10) -> DataFrame:
    """All orders of the customers behind the ``n`` largest orders (ties by key)."""
    top = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(n).select("o_custkey").distinct()
    return orders.join(top, "o_custkey", "left_semi")
