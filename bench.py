"""Headline queries, timed: prints one JSON line.

persisted and warmed up once, and a query's time is the median of three runs of its full result.
"""

import contextlib
import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from snapquery import Snapshot, average, c, count, max_, min_, sum_  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def cases(spark):
    """Name to a function that runs the query to its end."""
    line = Snapshot.from_parquet(spark, f"{SF_DIR}/lineitem.parquet", persist=True)
    orders = Snapshot.from_parquet(spark, f"{SF_DIR}/orders.parquet", ["o_orderkey"], persist=True)
    customers = Snapshot.from_parquet(spark, f"{SF_DIR}/customer.parquet", ["c_custkey"], persist=True)
    q, o = line.query(), orders.query()
    selective = (c.l_quantity > 40) & (c.l_returnflag == "A") & (c.l_linenumber <= 2)
    rows = lambda query: query.to_df(ordered=False).write.format("noop").mode("overwrite").save()
    return {
        "filter_count": lambda: q.count(c.l_quantity > 25),
        "filter_count_selective": lambda: q.count(selective),
        "filter_string_equality": lambda: q.count(c.l_returnflag == "R"),
        "filter_string_contains": lambda: customers.query().count(c.c_name.contains("99")),
        "filter_rows": lambda: rows(q.where(selective)),
        "sum_filtered": lambda: q.where(c.l_quantity > 25).sum("l_linenumber"),
        "aggregate_multi": lambda: q.aggregate(n=count(), total=sum_("l_extendedprice"), mean=average("l_quantity"), least=min_("l_tax"), greatest=max_("l_discount")),
        "group_count": lambda: q.group_by("l_returnflag").to_dict(count()),
        "group_multi": lambda: rows(q.where(c.l_quantity > 5).group_by("l_returnflag").agg(n=count(), total=sum_("l_extendedprice"), mean=average("l_quantity"), least=min_("l_linenumber"))),
        "any": lambda: q.any(c.l_quantity > 49),
        "any_none": lambda: q.any(c.l_quantity > 1000),
        "first": lambda: o.first(c.o_totalprice > 400000),
        "take": lambda: o.take(100).to_list(),
        "page": lambda: o.page(100_000, 100).to_list(),
        "topk": lambda: o.order_by_desc("o_totalprice").take(10).to_list(),
        "distinct": lambda: rows(q.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()),
        "join_group": lambda: rows(customers.query().join(orders, {"c_custkey": "o_custkey"}).group_by("c_mktsegment").agg(n=count(), total=sum_("o_totalprice"))),
        "sql_where_group": lambda: line.sql("SELECT l_linestatus, COUNT(*) AS n, AVG(l_tax) AS tax FROM t WHERE l_quantity > 25 AND l_returnflag = 'N' GROUP BY l_linestatus").collect(),
    }


def timed(run):
    """Median of three runs after one that warms up."""
    run()
    each = []
    for _ in range(3):
        began = time.perf_counter()
        run()
        each.append(time.perf_counter() - began)
    return round(median(each), 4)


def sweep(spark, times=10):
    """Some queries on line items that are repeated, which tells a job's fixed cost from that of its rows."""
    copies = spark.range(times, numPartitions=1).withColumnRenamed("id", "copy")
    line = Snapshot.from_df(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").crossJoin(copies), persist=True)
    q = line.query()
    out = {
        "filter_count": timed(lambda: q.count(c.l_quantity > 25)),
        "sum_filtered": timed(lambda: q.where(c.l_quantity > 25).sum("l_linenumber")),
        "aggregate_multi": timed(lambda: q.aggregate(n=count(), total=sum_("l_extendedprice"), mean=average("l_quantity"), least=min_("l_tax"), greatest=max_("l_discount"))),
        "group_count": timed(lambda: q.group_by("l_returnflag").to_dict(count())),
        "any": timed(lambda: q.any(c.l_quantity > 49)),
    }
    found = {"rows": q.count(), "queries": out}
    line.close()
    return found


def main():
    builder = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
    for key, value in (("spark.ui.enabled", "false"), ("spark.ui.showConsoleProgress", "false"), ("spark.sql.session.timeZone", "UTC")):
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(run) for name, run in cases(spark).items()}
    larger = sweep(spark)
    spark.stop()
    print(json.dumps({"metric": "snapshot_queries_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "ten_times": larger}))


if __name__ == "__main__":
    with contextlib.suppress(BrokenPipeError):
        main()
