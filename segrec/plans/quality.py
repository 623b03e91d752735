"""Queries over the data-quality checks and table profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.operators import quality
from segrec.operators.facts import Star
from segrec.plans.registry import ORACLE_SQL, query
from segrec.sources.scan import inventory
from segrec.sources.schema import CUSTOMER, LINEITEM, ORDERS, PART, SUPPLIER, TABLES, Table


def _count_sql(check: str, severity: str, table: str, subject: str, bad: str) -> str:
    return f"SELECT '{check}' AS check_id, '{severity}' AS severity, '{table}' AS table_name, '{subject}' AS subject, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS n FROM {table}"


def _values_sql(table) -> str:
    """SQL for value_findings."""
    parts = []
    for c in table.columns:
        if c.personal:
            continue
        if not c.nullable:
            parts.append(_count_sql("nulls", "error", table.name, c.name, f"{c.name} IS NULL"))
        if c.unique:
            parts.append(f"SELECT 'uniqueness', 'error', '{table.name}', '{c.name}', CAST(count(*) - count(DISTINCT {c.name}) - coalesce(max(CASE WHEN {c.name} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) FROM {table.name}")
        if c.domain:
            listed = ", ".join(f"'{v}'" for v in c.domain)
            parts.append(f"SELECT 'value_domain', 'error', '{table.name}', '{c.name}', CAST(count(DISTINCT CASE WHEN {c.name} NOT IN ({listed}) THEN {c.name} END) AS BIGINT) FROM {table.name}")
        if c.prefix:
            parts.append(_count_sql("id_format", "error", table.name, c.name, f"NOT starts_with({c.name}, '{c.prefix}')"))
        if c.low is not None:
            parts.append(_count_sql("range_below", "error", table.name, c.name, f"{c.name} < {c.low}"))
        if c.high is not None:
            parts.append(_count_sql("range_above", "error", table.name, c.name, f"{c.name} > {c.high}"))
    return " UNION ALL ".join(parts)


for _table in (CUSTOMER, PART, SUPPLIER, ORDERS, LINEITEM):
    query(f"v3_v9_values_{_table.name}", _values_sql(_table), base=False)(lambda s, t=_table: quality.value_findings(s.table(t.name), t))


@query(
    "sc6_inventory",
    " UNION ALL ".join(
        f"SELECT 'customer' AS table_name, '{c}' AS \"column\", '{k}' AS kind, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM customer"
        for c, k in (("c_custkey", "bigint"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))
    ),
    base=False,
)
def sc6(s: Star) -> DataFrame:
    return inventory(s.table("customer"), "customer")


@query(
    "sc7_profile",
    "SELECT 'lineitem' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS BIGINT) AS n_duplicate_keys FROM lineitem",
    base=False,
)
def sc7(s: Star) -> DataFrame:
    keys = s.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(F.count("*").alias("k"))
    return keys.agg(F.sum("k").alias("n_rows"), F.sum(F.col("k") - 1).alias("n_duplicate_keys")).select(F.lit("lineitem").alias("table_name"), "n_rows", "n_duplicate_keys")


@query("p8_scan_without_personal", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer", base=False)
def p8(s: Star) -> DataFrame:
    return s.table("customer")


@query("v1_v2_columns", "SELECT 'columns_missing' AS check_id, 'error' AS severity, 'orders' AS table_name, 'o_totalprice' AS subject, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'columns_unexpected', 'warning', 'orders', 'surprise', 1", base=False)
def v1(s: Star) -> DataFrame:
    damaged = s.table("orders").drop("o_totalprice").withColumn("surprise", F.lit(1))
    return quality.column_findings(damaged, ORDERS)


@query("v4_duplicate_rows", "SELECT 'duplicate_rows' AS check_id, 'error' AS severity, 'orders' AS table_name, '' AS subject, CAST((SELECT count(*) FROM orders) - count(*) AS BIGINT) AS n FROM (SELECT DISTINCT * FROM orders)", base=False)
def v4(s: Star) -> DataFrame:
    return quality.duplicate_rows(s.table("orders"), ORDERS)


@query(
    "v10_v11_referential",
    """SELECT 'orphan_fk' AS check_id, 'error' AS severity, 'orders' AS table_name, 'o_custkey' AS subject, CAST(count(*) AS BIGINT) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
    UNION ALL SELECT 'unreferenced_parent', 'warning', 'customer', 'o_custkey', CAST(count(*) AS BIGINT) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)""",
    base=False,
)
def v10(s: Star) -> DataFrame:
    return quality.orphans(s.table("orders"), "o_custkey", s.table("customer"), "c_custkey", "orders", "customer")


@query("j5_orphan_fk", "SELECT CAST(count(*) AS BIGINT) AS n_orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)", base=False)
def j5(s: Star) -> DataFrame:
    return s.table("lineitem").join(s.table("part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("n_orphans"))


@query("j6_unreferenced_parent", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", base=False)
def j6(s: Star) -> DataFrame:
    return s.table("supplier").join(s.table("lineitem").where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("s_suppkey")


@query(
    "v12_repeat_enrollment",
    "SELECT 'repeat_enrollment' AS check_id, 'info' AS severity, 'interactions' AS table_name, 'user_id,item' AS subject, CAST((SELECT count(*) FROM interactions) - count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, item FROM interactions)",
)
def v12(s: Star) -> DataFrame:
    return quality.repeats(s.interactions, ["user_id", "item"], "interactions")


@query(
    "v13_date_validity",
    "SELECT CAST(count(*) - count(o_orderdate) AS BIGINT) AS n_null, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day, CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS n_days FROM orders",
    base=False,
)
def v13(s: Star) -> DataFrame:
    day = F.to_date("o_orderdate")
    return s.table("orders").agg(F.count(F.when(day.isNull(), 1)).alias("n_null"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"), F.count_distinct(day).alias("n_days"))


@query("v14_amount_validity", "SELECT CAST(count(*) FILTER (WHERE l_extendedprice < 0 OR l_extendedprice IS NULL) AS BIGINT) AS n FROM lineitem", base=False)
def v14(s: Star) -> DataFrame:
    return s.table("lineitem").agg(F.count(F.when((F.col("l_extendedprice") < 0) | F.col("l_extendedprice").isNull(), 1)).alias("n"))


@query(
    "j8_v15_amount_vs_price",
    "SELECT 'amount_vs_price' AS check_id, 'warning' AS severity, 'interactions' AS table_name, 'amount' AS subject, CAST(count(*) FILTER (WHERE NOT coalesce(abs(amount - price) <= 40000.005, false)) AS BIGINT) AS n FROM interactions",
)
def v15(s: Star) -> DataFrame:
    return quality.price_mismatch(s.interactions, "amount", "price", 40000.005, "interactions")


@query(
    "v16_type_vs_price",
    """SELECT 'type_vs_price' AS check_id, 'error' AS severity, 'items' AS table_name, 'free_with_price' AS subject, CAST(count(*) FILTER (WHERE is_free = 1 AND price > 0) AS BIGINT) AS n FROM items
    UNION ALL SELECT 'type_vs_price', 'error', 'items', 'paid_without_price', CAST(count(*) FILTER (WHERE is_free = 0 AND price <= 0) AS BIGINT) FROM items""",
)
def v16(s: Star) -> DataFrame:
    return quality.type_vs_price(s.items, "is_free", "price", "items")


@query("v17_duplicate_names", "SELECT 'duplicate_names' AS check_id, 'warning' AS severity, 'part' AS table_name, 'p_name' AS subject, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)", base=False)
def v17(s: Star) -> DataFrame:
    return quality.duplicate_names(s.table("part"), "p_name", "part")


def _report_sql() -> str:
    """SQL for the report over all tables and their facts."""
    facts = [ORACLE_SQL[n] for n in ("v12_repeat_enrollment", "j8_v15_amount_vs_price", "v16_type_vs_price", "v17_duplicate_names")]
    parts = [f"SELECT * FROM ({sql})" for sql in facts]
    parts += [f"SELECT * FROM ({_values_sql(t)}) v(check_id, severity, table_name, subject, n)" for t in TABLES.values()]
    for t in TABLES.values():
        names = ", ".join(c.name for c in t.columns if not c.personal)
        parts.append(f"SELECT 'duplicate_rows', 'error', '{t.name}', '', CAST((SELECT count(*) FROM {t.name}) - count(*) AS BIGINT) FROM (SELECT DISTINCT {names} FROM {t.name})")
        for c in t.columns:
            if c.refers_to and c.refers_to[0] in TABLES:
                parent, key = c.refers_to
                parts.append(f"SELECT 'orphan_fk', 'error', '{t.name}', '{c.name}', CAST(count(*) AS BIGINT) FROM {t.name} WHERE NOT EXISTS (SELECT 1 FROM {parent} WHERE {key} = {c.name})")
                parts.append(f"SELECT 'unreferenced_parent', 'warning', '{parent}', '{c.name}', CAST(count(*) AS BIGINT) FROM {parent} WHERE NOT EXISTS (SELECT 1 FROM {t.name} WHERE {key} = {c.name})")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) f(check_id, severity, table_name, subject, n) WHERE n > 0"


@query("v19_report", _report_sql(), base=False)
def v19(s: Star) -> DataFrame:
    return star_report(s)


def star_report(s: Star) -> DataFrame:
    """V1-V17 over all tables of the star and their join."""
    further = (quality.fact_findings(s.interactions, 40000.005, "interactions"), quality.type_vs_price(s.items, "is_free", "price", "items"), quality.duplicate_names(s.table("part"), "p_name", "part"))
    return quality.report({n: s.table(n) for n in TABLES}, TABLES, further)


@query("u1_intersection", "SELECT o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", base=False)
def u1(s: Star) -> DataFrame:
    keys = s.table("orders").select(F.col("o_custkey").alias("user_id"), "o_orderstatus")
    return keys.where("o_orderstatus = 'F'").select("user_id").intersect(keys.where("o_orderstatus = 'P'").select("user_id"))


@query("u2_difference", "SELECT c_custkey AS user_id FROM customer EXCEPT SELECT o_custkey FROM orders", base=False)
def u2(s: Star) -> DataFrame:
    return s.table("customer").select(F.col("c_custkey").alias("user_id")).exceptAll(s.table("orders").select("o_custkey").distinct()).distinct()


@query("u3_union", "SELECT 'all' AS part_of, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT o_orderstatus, CAST(count(*) AS BIGINT) FROM orders GROUP BY o_orderstatus", base=False)
def u3(s: Star) -> DataFrame:
    by = s.table("orders").groupBy(F.col("o_orderstatus").alias("part_of")).agg(F.count("*").alias("n"))
    return s.table("orders").agg(F.count("*").alias("n")).select(F.lit("all").alias("part_of"), "n").unionByName(by)


@query(
    "u6_first_of_each",
    "SELECT user_id, item, txn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, txn) AS r FROM interactions) WHERE r = 1",
)
def u6(s: Star) -> DataFrame:
    first = F.min_by("txn", F.struct("ts", "txn")).alias("txn")
    return s.interactions.groupBy("user_id", "item").agg(first)


@query("p4_predicate_counts", "SELECT CAST(count(*) FILTER (WHERE o_totalprice > 250000) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE o_orderpriority LIKE '1-%') AS BIGINT) AS urgent, CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS BIGINT) AS no_user FROM orders", base=False)
def p4(s: Star) -> DataFrame:
    conditions = {"high": F.col("o_totalprice") > 250000, "urgent": F.col("o_orderpriority").startswith("1-"), "no_user": F.col("o_custkey").isNull()}
    return s.table("orders").agg(*[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()])


def _inventory_sql(table: Table) -> str:
    parts = [f"SELECT '{table.name}' AS table_name, '{c.name}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c.name}) AS BIGINT) AS n_null, CAST(count(DISTINCT {c.name}) AS BIGINT) AS n_distinct FROM {table.name}" for c in table.columns if not c.personal]
    return " UNION ALL ".join(parts)


@query("sc6_inventory_all", " UNION ALL ".join(_inventory_sql(t) for t in TABLES.values()), base=False)
def sc6_all(s: Star) -> DataFrame:
    """Rows, nulls and distinct values of every column of every table, each table read once."""
    return reduce(DataFrame.unionByName, [inventory(s.table(n), n) for n in TABLES]).select("table_name", "column", "n_rows", "n_null", "n_distinct")
