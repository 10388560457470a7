"""Registered queries: one for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import datetime as dt
import decimal
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapquery import Snapshot, all_of, any_of, average, c, count, long_count, max_, min_, not_, sum_
from snapquery import types as t
from snapquery.operators.statistics import zones
from snapquery.query import Query
from snapquery.schema import ReadOptions, RecordSchema, fit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": None, "events": ["event_id"],
}

#: Columns for what the tables lack: nulls, booleans, decimals and NaNs; the same text serves Spark and the SQL side.
DERIVED = {
    "line_status": "nullif(l_linestatus, 'F')",
    "quantity": "case when l_returnflag = 'R' then null else l_quantity end",
    "returned_quantity": "case when l_returnflag = 'R' then l_quantity end",
    "returned": "l_returnflag = 'R'",
    "flag": "case when l_returnflag = 'R' then true when l_returnflag = 'A' then false end",
    "price": "cast(l_extendedprice as decimal(29,6))",
    "rate": "case when l_linenumber = 1 then cast('NaN' as double) else l_discount end",
}
LINES = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in DERIVED.items()) + " FROM lineitem)"


def snapshot(spark: SparkSession, sf_dir: str, table: str) -> Snapshot:
    return Snapshot.from_parquet(spark, f"{sf_dir}/{table}.parquet", KEYS[table])


def _folder(spark: SparkSession) -> str:
    """For what a query writes and reads back: the session's shared folder; a local master may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="snapquery-")


def lines(spark: SparkSession, sf_dir: str) -> Query:
    """Line items with the derived columns."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Snapshot.from_df(df.withColumns({n: F.expr(e) for n, e in DERIVED.items()})).query()


def query(name: str, table: str, sql: str | None) -> Callable[[Callable[[Query], Query | DataFrame]], None]:
    """Register a query of one table (``lines``: with derived columns)."""

    def add(build: Callable[[Query], Query | DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(lines(spark, sf_dir) if table == "lines" else snapshot(spark, sf_dir, table).query())
            return out.to_df(ordered=False) if isinstance(out, Query) else out

        register(name, sql)(run)

    return add


def register(name: str, sql: str | None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


# scans and projections

query("scan_all", "nation", "SELECT * FROM nation")(lambda q: q)
query("project_subset", "customer", "SELECT c_custkey, c_name FROM customer")(lambda q: q.select("c_custkey", "c_name"))
query("project_alias", "customer", "SELECT c_custkey, c_name AS customer_name FROM customer")(lambda q: q.select("c_custkey", customer_name="c_name"))
query("project_reorder_all", "region", "SELECT r_name AS name, r_regionkey AS key FROM region")(lambda q: q.select(name="r_name", key="r_regionkey"))
query("project_expression", "part", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part")(lambda q: q.select("p_partkey", twice=F.col("p_retailprice") * 2))

# predicates

PART, LINE = "SELECT p_partkey, p_size FROM part WHERE ", "SELECT l_orderkey, l_linenumber, l_partkey FROM "
_line = ("l_orderkey", "l_linenumber", "l_partkey")
query("filter_int_eq", "part", PART + "p_size = 25")(lambda q: q.where(c.p_size == 25).select("p_partkey", "p_size"))
query("filter_int_ne", "part", PART + "p_size <> 25")(lambda q: q.where(c.p_size != 25).select("p_partkey", "p_size"))
query("filter_int_lt", "part", PART + "p_size < 25")(lambda q: q.where(c.p_size < 25).select("p_partkey", "p_size"))
query("filter_int_le", "part", PART + "p_size <= 25")(lambda q: q.where(c.p_size <= 25).select("p_partkey", "p_size"))
query("filter_int_gt", "part", PART + "p_size > 25")(lambda q: q.where(c.p_size > 25).select("p_partkey", "p_size"))
query("filter_int_ge", "part", PART + "p_size >= 25")(lambda q: q.where(c.p_size >= 25).select("p_partkey", "p_size"))
query("filter_long_eq", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey = 77")(lambda q: q.where(c.o_custkey == 77).select("o_orderkey"))
query("filter_reversed_operands", "part", PART + "40 < p_size")(lambda q: q.where(40 < c.p_size).select("p_partkey", "p_size"))
query("filter_double_range", "lineitem", LINE + "lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07")(lambda q: q.where((c.l_discount >= 0.05) & (c.l_discount <= 0.07)).select(*_line))
query("filter_double_nan", "lines", LINE + LINES + " WHERE rate > 0.05 AND NOT isnan(rate)")(lambda q: q.where(c.rate > 0.05).select(*_line))
query("filter_double_nan_le", "lines", LINE + LINES + " WHERE rate <= 0.05 AND NOT isnan(rate)")(lambda q: q.where(c.rate <= 0.05).select(*_line))
query("filter_double_nan_ne", "lines", LINE + LINES + " WHERE isnan(rate) OR rate <> 0.05")(lambda q: q.where(c.rate != 0.05).select(*_line))
query("filter_decimal", "lines", LINE + LINES + " WHERE price > 50000.5")(lambda q: q.where(c.price > decimal.Decimal("50000.5")).select(*_line))
query("filter_string_eq", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda q: q.where(c.c_mktsegment == "BUILDING").select("c_custkey"))
query("filter_string_ne_fluent_nulls", "lines", LINE + LINES + " WHERE line_status IS DISTINCT FROM 'X'")(lambda q: q.where(c.line_status != "X").select(*_line))
query("filter_string_order", "part", "SELECT p_partkey, p_name FROM part WHERE p_name > 'm'")(lambda q: q.where(c.p_name > "m").select("p_partkey", "p_name"))
query("filter_string_contains", "part", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'dg')")(lambda q: q.where(c.p_name.contains("dg")).select("p_partkey", "p_name"))
query("filter_string_startswith", "part", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")(lambda q: q.where(c.p_name.startswith("red")).select("p_partkey", "p_name"))
query("filter_string_endswith", "part", "SELECT p_partkey, p_name FROM part WHERE suffix(p_name, 'bolt')")(lambda q: q.where(c.p_name.endswith("bolt")).select("p_partkey", "p_name"))
query("filter_string_ignore_case", "part", "SELECT p_partkey, p_name FROM part WHERE upper(p_name) = upper('Red WIDGET')")(lambda q: q.where(c.p_name.equals("Red WIDGET", ignore_case=True)).select("p_partkey", "p_name"))
query("filter_contains_ignore_case", "part", "SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'GEAR')")(lambda q: q.where(c.p_name.contains("gEar", ignore_case=True)).select("p_partkey", "p_name"))
for _kind, _pattern in {"prefix": "red%", "suffix": "%bolt", "contains": "%dg%", "exact": "red widget", "inner": "r_d%t", "all": "%"}.items():
    query(f"filter_like_{_kind}", "part", f"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '{_pattern}'")(
        lambda q, p=_pattern: q.where(c.p_name.like(p)).select("p_partkey", "p_name")
    )
query("filter_bool_true", "lines", LINE + LINES + " WHERE flag")(lambda q: q.where(c.flag).select(*_line))
query("filter_bool_false", "lines", LINE + LINES + " WHERE flag = false")(lambda q: q.where(~c.flag).select(*_line))
query("filter_bool_ne", "lines", LINE + LINES + " WHERE flag <> true")(lambda q: q.where(c.flag != True).select(*_line))  # noqa: E712
query("filter_datetime_range", "lineitem", LINE + "lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'")(
    lambda q: q.where((c.l_shipdate >= dt.datetime(1996, 1, 1)) & (c.l_shipdate < dt.datetime(1997, 1, 1))).select(*_line)
)
query("filter_datetime_eq", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1998-10-03 00:00:00'")(lambda q: q.where(c.o_orderdate == dt.datetime(1998, 10, 3)).select("o_orderkey"))
query("filter_is_null", "lines", LINE + LINES + " WHERE quantity IS NULL")(lambda q: q.where(c.quantity.is_null()).select(*_line))
query("filter_is_not_null", "lines", LINE + LINES + " WHERE line_status IS NOT NULL")(lambda q: q.where(c.line_status != None).select(*_line))  # noqa: E711
query("filter_has_value", "lines", LINE + LINES + " WHERE quantity IS NOT NULL")(lambda q: q.where(c.quantity.has_value()).select(*_line))
query("filter_and", "lineitem", LINE + "lineitem WHERE l_quantity > 40 AND l_returnflag = 'A' AND l_linenumber <= 2")(
    lambda q: q.where(all_of(c.l_quantity > 40, c.l_returnflag == "A", c.l_linenumber <= 2)).select(*_line)
)
query("filter_or", "part", PART + "p_size = 1 OR p_size = 50")(lambda q: q.where((c.p_size == 1) | (c.p_size == 50)).select("p_partkey", "p_size"))
query("filter_or_nary", "part", PART + "p_size = 1 OR p_size = 20 OR p_size = 50")(lambda q: q.where(any_of(c.p_size == 1, c.p_size == 20, c.p_size == 50)).select("p_partkey", "p_size"))
query("filter_not_two_valued", "lines", LINE + LINES + " WHERE NOT coalesce(quantity > 10, false)")(lambda q: q.where(not_(c.quantity > 10)).select(*_line))
query("filter_nested", "lines", LINE + LINES + " WHERE line_status IS NOT NULL AND (quantity > 45 OR l_returnflag = 'R')")(
    lambda q: q.where(c.line_status.has_value() & ((c.quantity > 45) | (c.l_returnflag == "R"))).select(*_line)
)
query("filter_and_in_or", "part", PART + "(p_size < 5 AND p_type = 'SMALL') OR (p_size > 45 AND p_type = 'ECONOMY')")(
    lambda q: q.where(((c.p_size < 5) & (c.p_type == "SMALL")) | ((c.p_size > 45) & (c.p_type == "ECONOMY"))).select("p_partkey", "p_size")
)
query("filter_chain", "lineitem", LINE + "lineitem WHERE l_quantity > 40 AND l_returnflag = 'N'")(lambda q: q.where(c.l_quantity > 40).where(c.l_returnflag == "N").select(*_line))
query("filter_fallback_modulo", "part", PART + "p_partkey % 7 = 0")(lambda q: q.where(F.col("p_partkey") % 7 == 0).select("p_partkey", "p_size"))
query("filter_fallback_function", "part", PART + "p_size % 10 = 3")(lambda q: q.allow_fallback().where(lambda r: r.p_size % 10 == 3).select("p_partkey", "p_size"))
query("filter_null_or_empty", "lines", LINE + LINES + " WHERE line_status IS NULL OR line_status = ''")(lambda q: q.where(c.line_status.is_null_or_empty()).select(*_line))
query("filter_null_or_blank", "lines", LINE + LINES + " WHERE line_status IS NULL OR trim(line_status) = ''")(lambda q: q.where(c.line_status.is_null_or_blank()).select(*_line))
query("filter_in", "part", PART + "p_size IN (3, 5, 8)")(lambda q: q.where(c.p_size.isin(3, 5, 8)).select("p_partkey", "p_size"))
query("filter_between", "part", PART + "p_size BETWEEN 10 AND 12")(lambda q: q.where(c.p_size.between(10, 12)).select("p_partkey", "p_size"))
query("filter_column_compare", "lineitem", LINE + "lineitem WHERE l_tax > l_discount")(lambda q: q.where(c.l_tax > F.col("l_discount")).select(*_line))

query("filter_column_compare_nan", "lines", LINE + LINES + " WHERE NOT isnan(rate) AND rate > l_tax")(lambda q: q.where(c.rate > c.l_tax).select(*_line))
query("filter_column_compare_nan_flipped", "lines", LINE + LINES + " WHERE NOT isnan(rate) AND l_tax < rate")(lambda q: q.where(c.l_tax < F.col("rate")).select(*_line))
query("filter_column_equal_nan", "lines", LINE + LINES + " WHERE NOT isnan(rate)")(lambda q: q.where(c.rate == F.col("rate")).select(*_line))
query("filter_column_ne_nan", "lines", LINE + LINES + " WHERE isnan(rate) OR rate <> l_tax")(lambda q: q.where(c.rate != c.l_tax).select(*_line))
query("filter_column_equal", "lines", LINE + LINES + " WHERE quantity = l_linenumber")(lambda q: q.where(c.quantity == c.l_linenumber).select(*_line))
query("filter_column_string_ne", "lines", LINE + LINES + " WHERE line_status IS DISTINCT FROM l_linestatus")(lambda q: q.where(c.line_status != c.l_linestatus).select(*_line))
query("filter_in_nan", "lines", LINE + LINES + " WHERE rate IN (0.05, 0.07) AND NOT isnan(rate)")(lambda q: q.where(c.rate.isin(0.05, 0.07, float("nan"))).select(*_line))


@register("filter_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-03-15'")
def filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return Snapshot.from_df(df, ["o_orderkey"]).query().where(c.day.between(dt.date(1996, 2, 1), dt.date(1996, 3, 15))).to_df(False)


@register("carried_types", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n FROM embeddings WHERE label = 3")
def carried_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a type that is only carried along."""
    return Snapshot.from_parquet(spark, f"{sf_dir}/embeddings.parquet", ["vec_id"]).query().where(c.label == 3).select("vec_id", "label", n=F.size("embedding")).to_df(False)


# aggregates over all rows; sums of doubles go through decimals, as the order of additions differs

query("agg_count", "lineitem", "SELECT count(*) AS n FROM lineitem")(lambda q: q.aggregate_df(n=count()))
query("agg_long_count", "orders", "SELECT count(*) AS n FROM orders")(lambda q: q.aggregate_df(n=long_count()))
query("agg_count_pred", "lineitem", "SELECT count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem")(lambda q: q.aggregate_df(n=count(c.l_quantity > 25)))
query("agg_sum_int", "part", "SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")(lambda q: q.aggregate_df(total=sum_("p_size")))
query("agg_sum_double", "lineitem", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem")(
    lambda q: q.select(l_price=F.col("l_extendedprice").cast("decimal(18,2)")).aggregate_df(total=sum_("l_price")).select(F.col("total").cast("double"))
)
query("agg_sum_decimal", "lines", f"SELECT CAST(sum(price) AS DECIMAL(38,6)) AS total FROM {LINES}")(lambda q: q.aggregate_df(total=sum_("price")).select(F.col("total").cast("decimal(38,6)")))
query("agg_sum_empty", "orders", "SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0")(lambda q: q.where(c.o_orderkey < 0).aggregate_df(total=sum_("o_custkey")))
query("agg_sum_all_null", "lines", f"SELECT CAST(coalesce(sum(returned_quantity), 0) AS DOUBLE) AS total FROM {LINES} WHERE l_returnflag = 'A'")(lambda q: q.where(c.l_returnflag == "A").aggregate_df(total=sum_("returned_quantity")))
query("agg_avg", "part", "SELECT CAST(avg(p_size) AS DOUBLE) AS mean FROM part")(lambda q: q.aggregate_df(mean=average("p_size")))
query("agg_min", "lineitem", "SELECT min(l_extendedprice) AS least FROM lineitem")(lambda q: q.aggregate_df(least=min_("l_extendedprice")))
query("agg_max", "lineitem", "SELECT max(l_extendedprice) AS greatest FROM lineitem")(lambda q: q.aggregate_df(greatest=max_("l_extendedprice")))
query("agg_min_string", "part", "SELECT min(p_name) AS least, max(p_name) AS greatest FROM part")(lambda q: q.aggregate_df(least=min_("p_name"), greatest=max_("p_name")))
query("agg_min_timestamp", "lineitem", "SELECT min(l_shipdate) AS least, max(l_shipdate) AS greatest FROM lineitem WHERE l_quantity > 30")(
    lambda q: q.where(c.l_quantity > 30).aggregate_df(least=min_("l_shipdate"), greatest=max_("l_shipdate"))
)
query("agg_avg_empty", "orders", "SELECT CAST(avg(o_custkey) AS DOUBLE) AS mean, min(o_custkey) AS least FROM orders WHERE o_orderkey < 0")(
    lambda q: q.where(c.o_orderkey < 0).aggregate_df(mean=average("o_custkey"), least=min_("o_custkey"))
)
query("agg_multi_filtered", "lineitem",
      "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(avg(l_linenumber) AS DOUBLE) AS mean, min(l_tax) AS least, max(l_discount) AS greatest FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N'")(
    lambda q: q.where((c.l_quantity > 25) & (c.l_returnflag == "N")).aggregate_df(n=count(), total=sum_("l_linenumber"), mean=average("l_linenumber"), least=min_("l_tax"), greatest=max_("l_discount"))
)

# groups

query("group_count", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")(lambda q: q.group_by("l_returnflag").agg(n=count()))
query("group_sum", "lineitem", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")(lambda q: q.group_by("l_returnflag").agg(total=sum_("l_linenumber")))
query("group_avg", "part", "SELECT p_brand, CAST(avg(p_size) AS DOUBLE) AS mean FROM part GROUP BY p_brand")(lambda q: q.group_by("p_brand").agg(mean=average("p_size")))
query("group_minmax", "lineitem", "SELECT l_returnflag, min(l_extendedprice) AS least, max(l_shipdate) AS greatest FROM lineitem GROUP BY l_returnflag")(
    lambda q: q.group_by("l_returnflag").agg(least=min_("l_extendedprice"), greatest=max_("l_shipdate"))
)
FLAGSHIP_SQL = (
    "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(avg(l_linenumber) AS DOUBLE) AS mean, "
    "min(l_linenumber) AS least, max(l_shipdate) AS latest FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag"
)


@register("group_multi", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped before a day, summed up by return flag."""
    q = snapshot(spark, sf_dir, "lineitem").query().where(c.l_shipdate < dt.datetime(1998, 9, 2))
    rows = q.select("l_returnflag", "l_linenumber", "l_shipdate", price=F.col("l_extendedprice").cast("decimal(18,2)"))
    grouped = rows.group_by("l_returnflag").agg(n=count(), total=sum_("price"), mean=average("l_linenumber"), least=min_("l_linenumber"), latest=max_("l_shipdate"))
    return grouped.to_df(ordered=False).withColumn("total", F.col("total").cast("double"))


query("group_filtered", "lineitem", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_linestatus")(lambda q: q.where(c.l_quantity > 25).group_by("l_linestatus").agg(n=count()))
query("group_int_key", "part", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size")(lambda q: q.group_by("p_size").agg(n=count()))
query("group_long_key", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")(lambda q: q.group_by("o_custkey").agg(n=count()))
query("group_bool_key", "lines", f"SELECT returned, count(*) AS n FROM {LINES} GROUP BY returned")(lambda q: q.group_by("returned").agg(n=count()))
query("group_double_key", "lineitem", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity")(lambda q: q.group_by("l_quantity").agg(n=count()))
query("group_key_alias", "customer", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")(lambda q: q.group_by(segment="c_mktsegment").agg(n=count()))
query("group_two_keys", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")(lambda q: q.group_by("l_returnflag", "l_linestatus").agg(n=count()))
query("group_count_pred", "lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 30) AS n FROM lineitem GROUP BY l_returnflag")(lambda q: q.group_by("l_returnflag").agg(n=count(c.l_quantity > 30)))
query("group_decimal_sum", "lines", f"SELECT l_returnflag, CAST(sum(price) AS DECIMAL(38,6)) AS total FROM {LINES} GROUP BY l_returnflag")(
    lambda q: q.group_by("l_returnflag").agg(total=sum_("price")).to_df(False).withColumn("total", F.col("total").cast("decimal(38,6)"))
)
query("group_null_keys_dropped", "lines", f"SELECT line_status, count(*) AS n FROM {LINES} WHERE line_status IS NOT NULL GROUP BY line_status")(lambda q: q.group_by("line_status").agg(n=count()))
query("group_avg_all_null", "lines", f"SELECT l_returnflag, CAST(coalesce(avg(returned_quantity), 0) AS DOUBLE) AS mean, min(returned_quantity) AS least FROM {LINES} GROUP BY l_returnflag")(
    lambda q: q.group_by("l_returnflag").agg(mean=average("returned_quantity"), least=min_("returned_quantity"))
)
query("group_to_dict", "customer", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")(lambda q: q.group_by("c_mktsegment").agg(n=count()).select("c_mktsegment", "n"))
query("having_key", "part", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING p_brand > 'Brand#2'")(lambda q: q.group_by("p_brand").agg(n=count()).having(c.p_brand > "Brand#2"))
query("having_count", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")(lambda q: q.group_by("o_custkey").agg(n=count()).having(c.n > 10))
query("having_sum_and_count", "part", "SELECT p_size, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part GROUP BY p_size HAVING count(*) > 35 AND sum(p_partkey) > 30000")(
    lambda q: q.group_by("p_size").agg(n=count(), total=sum_("p_partkey")).having((c.n > 35) & (c.total > 30000))
)
query("having_avg", "part", "SELECT p_brand, CAST(avg(p_size) AS DOUBLE) AS mean FROM part GROUP BY p_brand HAVING avg(p_size) >= 25")(lambda q: q.group_by("p_brand").agg(mean=average("p_size")).having(c["mean"] >= 25))

# order, pages, short-circuit terminals

query("sort_multi_limit", "part", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 50")(lambda q: q.order_by("p_brand").then_by_desc("p_size").take(50).select("p_partkey", "p_brand", "p_size"))
query("sort_nulls", "orders", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) ORDER BY s NULLS FIRST, o_orderkey LIMIT 20")(
    lambda q: q.select("o_orderkey", s=F.expr("nullif(o_orderstatus, 'F')")).order_by("s").take(20)
)
query("sort_nulls_desc", "orders", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) ORDER BY s DESC NULLS LAST, o_orderkey OFFSET 1490")(
    lambda q: q.select("o_orderkey", s=F.expr("nullif(o_orderstatus, 'P')")).order_by_desc("s").skip(1490)
)
query("sort_hidden_key", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")(lambda q: q.order_by_desc("o_totalprice").select("o_orderkey").take(15))
query("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda q: q.order_by_desc("o_totalprice").take(10).select("o_orderkey", "o_totalprice"))
query("page_take", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")(lambda q: q.take(100).select("o_orderkey"))
query("page_skip", "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")(lambda q: q.skip(100).select("c_custkey"))
query("page_skip_take", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000")(lambda q: q.skip(1000).take(50).select("o_orderkey"))
query("page_beyond", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 50 OFFSET 20")(lambda q: q.page(20, 50).select("n_nationkey"))
query("take_then_where", "part", "SELECT p_partkey FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 500) WHERE p_size > 25")(lambda q: q.take(500).where(c.p_size > 25).select("p_partkey"))
query("where_then_take", "part", "SELECT p_partkey FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 100")(lambda q: q.where(c.p_size > 25).take(100).select("p_partkey"))
query("take_where_take", "part", "SELECT p_partkey FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 500) WHERE p_size > 25 ORDER BY p_partkey LIMIT 10")(lambda q: q.take(500).where(c.p_size > 25).take(10).select("p_partkey"))
query("first", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 1")(lambda q: q.where(c.o_totalprice > 400000).take(1).select("o_orderkey"))
query("element_at", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 42")(lambda q: q.page(42, 1).select("o_orderkey"))


@register("any", "SELECT EXISTS (SELECT 1 FROM part WHERE p_size = 50) AS found, EXISTS (SELECT 1 FROM part WHERE p_size > 50) AS none")
def any_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "part").query()
    return spark.createDataFrame([(q.any(c.p_size == 50), q.any(c.p_size > 50))], "found boolean, none boolean")


@register("all", "SELECT count(*) FILTER (WHERE NOT coalesce(p_size > 0, false)) = 0 AS positive, count(*) FILTER (WHERE NOT coalesce(p_size > 1, false)) = 0 AS above FROM part")
def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "part").query()
    return spark.createDataFrame([(q.all(c.p_size > 0), q.all(c.p_size > 1))], "positive boolean, above boolean")


@register("single", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = snapshot(spark, sf_dir, "orders").query().select("o_orderkey", "o_custkey").single(c.o_orderkey == 7)
    return spark.createDataFrame([tuple(r)], "o_orderkey long, o_custkey long")


@register("indices", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation QUALIFY n_regionkey = 1")
def matching_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot(spark, sf_dir, "nation").query().order_by("n_nationkey").to_list()
    again = Snapshot.from_rows(spark, rows, [("n_nationkey", t.Int32), ("n_name", t.String), ("n_regionkey", t.Int32)])
    return spark.createDataFrame([(i,) for i in again.query().where(c.n_regionkey == 1).indices()], "i long")


# distinct rows

query("distinct_cols", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda q: q.select("l_returnflag", "l_linestatus").distinct())
query("distinct_nulls", "lines", f"SELECT DISTINCT line_status FROM {LINES}")(lambda q: q.select("line_status").distinct())
query("distinct_filtered", "part", "SELECT DISTINCT p_brand FROM part WHERE p_size < 3")(lambda q: q.where(c.p_size < 3).select("p_brand").distinct())
query("distinct_count", "part", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part)")(lambda q: q.select("p_brand", "p_type").distinct().aggregate_df(n=count()))

# joins


@register("join_inner", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "customer").query().join(snapshot(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"})
    return q.select("c_custkey", "c_name", "o_orderkey").to_df(False)


@register("join_filtered", "SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = snapshot(spark, sf_dir, "customer").query().where(c.c_mktsegment == "BUILDING")
    q = left.join(snapshot(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}).where(c.o_totalprice > 200000)
    return q.select("c_name", "o_totalprice").to_df(False)


@register("join_three_way", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "customer").query().join(snapshot(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"})
    return q.join(snapshot(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}).group_by("r_name").agg(n=count()).to_df(False)


@register("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = snapshot(spark, sf_dir, "orders").query().where(c.o_totalprice > 400000)
    return snapshot(spark, sf_dir, "customer").query().join(large, {"c_custkey": "o_custkey"}, "left_semi").select("c_custkey").to_df(False)


@register("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir, "customer").query().join(snapshot(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}, "left_anti").select("c_custkey").to_df(False)


@register("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = snapshot(spark, sf_dir, "orders").query().where(c.o_totalprice > 450000)
    return snapshot(spark, sf_dir, "customer").query().join(large, {"c_custkey": "o_custkey"}, "left").select("c_custkey", "o_orderkey").to_df(False)


@register("join_right", "SELECT c_custkey, c_acctbal, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = snapshot(spark, sf_dir, "orders").query().where(c.o_totalprice > 400000)
    rich = snapshot(spark, sf_dir, "customer").query().where(c.c_acctbal > 5000)
    return rich.join(large, {"c_custkey": "o_custkey"}, "right").select("c_custkey", "c_acctbal", "o_orderkey").to_df(False)


@register("join_full", "SELECT c_custkey, c_acctbal, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = snapshot(spark, sf_dir, "orders").query().where(c.o_totalprice > 400000)
    rich = snapshot(spark, sf_dir, "customer").query().where(c.c_acctbal > 5000)
    return rich.join(large, {"c_custkey": "o_custkey"}, "full").select("c_custkey", "c_acctbal", "o_orderkey").to_df(False)


@register("group_join_left", "SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(greatest, NULL) AS greatest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS greatest FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def group_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "customer").query().group_join(snapshot(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}, n=count(), greatest=max_("o_totalprice"))
    return q.select("c_custkey", "n", "greatest").to_df(False)


# SQL


def sql(name: str, table: str, text: str, oracle: str | None = None, parity: bool = False) -> None:
    @register(name, oracle or text)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        snap = lines(spark, sf_dir).snapshot if table == "lines" else snapshot(spark, sf_dir, table)
        return snap.sql(text, parity)


sql("sql_where", "part", "SELECT p_partkey, p_name AS name FROM part WHERE p_size > 25 AND p_type = 'SMALL'")
sql("sql_where_string_ne_nulls", "lines", "SELECT l_orderkey, l_partkey FROM t WHERE line_status <> 'X'", f"SELECT l_orderkey, l_partkey FROM {LINES} WHERE line_status <> 'X'")
sql("sql_like", "part", "SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%bolt'")
sql("sql_bool", "lines", "SELECT l_orderkey, l_partkey FROM t WHERE flag = true", f"SELECT l_orderkey, l_partkey FROM {LINES} WHERE flag = true")
sql("sql_datetime", "orders", "SELECT o_orderkey FROM t WHERE o_orderdate > '2000-01-01' AND o_orderdate <= '2000-02-01 12:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate > '2000-01-01' AND o_orderdate <= '2000-02-01 12:00:00'")
sql("sql_is_null", "lines", "SELECT l_orderkey, l_partkey FROM t WHERE quantity IS NULL AND (l_tax > 0.05 OR line_status IS NOT NULL)", f"SELECT l_orderkey, l_partkey FROM {LINES} WHERE quantity IS NULL AND (l_tax > 0.05 OR line_status IS NOT NULL)")
sql("sql_group_having_order", "part", "SELECT p_brand, COUNT(*) AS n, MAX(p_size) AS greatest FROM part GROUP BY p_brand HAVING COUNT(*) > 5 ORDER BY n DESC, p_brand")
sql("sql_group_default_names", "part", "SELECT p_type, COUNT(*), SUM(p_size), AVG(p_size) FROM t GROUP BY p_type", 'SELECT p_type, count(*) AS "COUNT_*", CAST(sum(p_size) AS BIGINT) AS "SUM_p_size", CAST(avg(p_size) AS DOUBLE) AS "AVG_p_size" FROM part GROUP BY p_type')
sql("sql_group_parity", "lines", "SELECT line_status, COUNT(*) AS n, SUM(returned_quantity) FROM t WHERE l_returnflag = 'A' GROUP BY line_status", f'SELECT line_status, count(*) AS n, CAST(coalesce(sum(returned_quantity), 0) AS DOUBLE) AS "SUM_returned_quantity" FROM {LINES} WHERE l_returnflag = \'A\' AND line_status IS NOT NULL GROUP BY line_status', parity=True)
sql("sql_distinct_order_limit", "part", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5")
sql("sql_offset_limit", "orders", "SELECT o_orderkey FROM t ORDER BY o_orderkey OFFSET 10 LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
sql("sql_multi_agg", "part", "SELECT COUNT(*) AS n, MIN(p_size) AS least, MAX(p_size) AS greatest FROM part WHERE p_size > 10")
sql("sql_count_col", "lines", "SELECT COUNT(quantity) AS n FROM t", f"SELECT count(quantity) AS n FROM {LINES}")
sql("sql_not_or_precedence", "part", "SELECT p_partkey FROM part WHERE p_size > 45 AND NOT p_type = 'SMALL' OR p_size = 1 AND p_type = 'ECONOMY'")
sql("sql_in_between", "part", "SELECT p_partkey FROM part\nWHERE p_size IN (1, 2)\n  OR p_size BETWEEN 40 AND 42")
sql("sql_order_alias", "part", "SELECT p_partkey AS k, p_size FROM part ORDER BY p_size DESC, k LIMIT 7")


sql("sql_extract", "orders", "SELECT o_orderkey FROM t WHERE EXTRACT(YEAR FROM o_orderdate) = 1997 AND EXTRACT(MONTH FROM o_orderdate) <= 3", "SELECT o_orderkey FROM orders WHERE EXTRACT(YEAR FROM o_orderdate) = 1997 AND EXTRACT(MONTH FROM o_orderdate) <= 3")
sql("sql_extract_select", "orders", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, o_orderkey FROM t WHERE o_totalprice > 300000", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, o_orderkey FROM orders WHERE o_totalprice > 300000")
sql("sql_computed", "part", "SELECT p_partkey, p_size * 2 + 1 AS odd, upper(p_name) AS name FROM part WHERE p_size < 30")
sql("sql_star", "nation", "SELECT * FROM nation WHERE n_regionkey > 1")


@register("sql_typed_literal", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-01-01'")
def sql_typed_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal's type beside a column of that name."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return Snapshot.from_df(df, ["o_orderkey"]).sql("SELECT o_orderkey, date FROM t WHERE date >= DATE '2001-01-01'")


@dataclass
class _Brand:
    p_brand: str
    n: int


@register("sql_typed_rows", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def sql_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot(spark, sf_dir, "part").sql_rows("SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand", _Brand)
    return spark.createDataFrame([(b.p_brand, b.n) for b in found], "p_brand string, n long")


@register("sql_scalar", "SELECT CAST(max(p_size) AS INTEGER) AS v FROM part")
def sql_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(snapshot(spark, sf_dir, "part").sql_scalar("SELECT MAX(p_size) FROM t"),)], "v int")


# statistics

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@register("stats_columns", " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS total, count(*) - count(x) AS nulls, count(DISTINCT x) + CAST(count(*) > count(x) AS INTEGER) AS \"distinct\" FROM (SELECT {e} AS x FROM orders)" for n, e in (*((n, n) for n in _ORDERS), ("status", "nullif(o_orderstatus, 'F')"))))
def stats_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "orders").query().select(*_ORDERS, status=F.expr("nullif(o_orderstatus, 'F')"))
    return Snapshot(q._frame()).profile_df()


@register("stats_runs", " UNION ALL ".join(f"SELECT '{n}' AS \"column\", CAST(sum(CASE WHEN r = 1 OR x IS DISTINCT FROM p THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM (SELECT x, lag(x) OVER (ORDER BY o_orderkey) AS p, row_number() OVER (ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey, {e} AS x FROM orders))" for n, e in (*((n, n) for n in _ORDERS), ("status", "nullif(o_orderstatus, 'F')"))))
def stats_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = snapshot(spark, sf_dir, "orders").query().select(*_ORDERS, status=F.expr("nullif(o_orderstatus, 'F')"))
    return Snapshot(q._frame()).runs_df()


@register("stats_zones", "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS chunk, min(o_totalprice) AS least, max(o_totalprice) AS greatest, count(o_totalprice) AS \"values\" FROM orders GROUP BY 1")
def stats_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones(snapshot(spark, sf_dir, "orders").query()._frame(), "o_totalprice", 1000)


# rows, Arrow streams, schema evolution

_NATION = [("n_nationkey", t.Int32), ("n_name", t.String), ("n_regionkey", t.Int32)]


@register("rows_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def rows_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Snapshot.from_rows(spark, snapshot(spark, sf_dir, "nation").query().to_list(), _NATION).df(False)


@register("ipc_roundtrip", "SELECT * FROM customer")
def ipc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Snapshot.from_ipc(spark, snapshot(spark, sf_dir, "customer").to_ipc_bytes("zstd")).df(False)


@register("ipc_evolution", "SELECT n_nationkey, n_name, 0 AS population, CAST(NULL AS VARCHAR) AS motto FROM nation")
def ipc_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = [("n_nationkey", t.Int32), ("n_name", t.String), ("population", t.Int32), ("motto", t.String)]
    return Snapshot.from_ipc(spark, snapshot(spark, sf_dir, "nation").to_ipc_bytes("lz4"), wide, ReadOptions()).df(False)


@register("ipc_path", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def ipc_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by many tasks and read by many."""
    path = f"{_folder(spark)}/ipc-{uuid.uuid4().hex}"
    snapshot(spark, sf_dir, "customer").write_ipc(path, "zstd")
    return Snapshot.from_ipc(spark, path).df(False)


@register("ipc_path_overwritten", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ipc_path_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write replaces the first."""
    path = f"{_folder(spark)}/ipc-{uuid.uuid4().hex}"
    for _ in range(2):
        snapshot(spark, sf_dir, "nation").write_ipc(path, "lz4", "overwrite")
    return Snapshot.from_ipc(spark, path).df(False)


@register("ipc_buffers", "SELECT * FROM nation")
def ipc_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = snapshot(spark, sf_dir, "nation").to_ipc_bytes()
    return Snapshot.from_ipc(spark, [data[:100], data[100:]]).df(False)


@register("copied_snapshot", "SELECT * FROM nation")
def copied_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that a later change of the source leaves alone."""
    return Snapshot.from_parquet(spark, f"{sf_dir}/nation.parquet", ["n_nationkey"], copy_to=f"{_folder(spark)}/copies").df(False)


@register("enumerate_rows", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def enumerate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows one after another."""
    found = snapshot(spark, sf_dir, "nation").query().where(c.n_regionkey != 2).select("n_name", "n_regionkey")
    return spark.createDataFrame(list(found), "n_name string, n_regionkey int")


@register("count_property", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def count_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(len(snapshot(spark, sf_dir, "lineitem")),)], "n long")


@register("to_arrow", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def to_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(snapshot(spark, sf_dir, "nation").query().where(c.n_regionkey == 1).select("n_name").to_arrow())


@register("last", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([snapshot(spark, sf_dir, "orders").query().order_by("o_totalprice").select("o_orderkey", "o_totalprice").last()], "o_orderkey long, o_totalprice double")


@register("reverse", "SELECT CAST(row_number() OVER (ORDER BY n_name DESC) AS INTEGER) AS place, n_name FROM nation")
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot(spark, sf_dir, "nation").query().order_by("n_name").select("n_name").reverse()
    return spark.createDataFrame([(i, r.n_name) for i, r in enumerate(found, 1)], "place int, n_name string")


@register("parallel_options", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def parallel_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir, "part").query().where(c.p_size > 40).select("p_partkey", "p_size").as_sequential().to_df(False)


@register("plan_cache", "SELECT CAST(1 AS BIGINT) AS entries, CAST(1 AS BIGINT) AS misses, CAST(2 AS BIGINT) AS hits")
def plan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query that runs three times leaves in the cache of plans."""
    snap = snapshot(spark, sf_dir, "nation")
    for _ in range(3):
        snap.query().count()
    found = snap.plan_cache_statistics()
    return spark.createDataFrame([(found.entries, found.misses, found.hits)], "entries long, misses long, hits long")


@register("explain", "SELECT * FROM (VALUES ('Query Plan (Optimized: True)'), ('  Columns: p_size'), ('  Predicates: 1 column-level filter(s)'), ('  GroupBy: p_brand'), ('  Aggregations: Count()')) AS v(line)")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = snapshot(spark, sf_dir, "part").query().where(c.p_size > 40).group_by("p_brand").agg(n=count()).explain_text()
    return spark.createDataFrame([(x,) for x in text.splitlines() if "Est." not in x], "line string")


@register("refused", "SELECT * FROM (VALUES ('column', 'ColumnNotFound'), ('function', 'UnsupportedOperation'), ('function in a column', 'UnsupportedOperation'), ('no select', 'ValueError'), ('empty', 'ValueError')) AS v(what, error)")
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of statements and queries that mean nothing."""
    snap = snapshot(spark, sf_dir, "nation")
    tries = {
        "column": lambda: snap.query().select("none"), "function": lambda: snap.query().where(lambda r: True),
        "function in a column": lambda: snap.query().where(F.udf(lambda x: True, "boolean")("n_name")), "no select": lambda: snap.sql("DELETE FROM t"), "empty": lambda: snap.sql(" "),
    }
    found = []
    for what, run in tries.items():
        try:
            run()
        except Exception as e:  # noqa: BLE001
            found.append((what, type(e).__name__))
    return spark.createDataFrame(found, "what string, error string")


@register("parquet_evolution", "SELECT CAST(p_size AS BIGINT) AS p_size, p_name, CAST(0 AS DOUBLE) AS weight FROM part")
def parquet_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = RecordSchema.of([("p_size", t.Int64), ("p_name", t.String), ("weight", t.Double)])
    return fit(spark.read.parquet(f"{sf_dir}/part.parquet"), wanted)
