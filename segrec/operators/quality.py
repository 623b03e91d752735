"""Data-quality checks: each gives rows (check_id, severity, table_name, subject, n) for what it finds.

The report counts equal rows once; repeated rows and all checks of values come from one aggregation of
these counts, so a table is read once for them. Keys are counted before they are compared with their
parents, and null keys count as orphans. Empty tables give no findings but their row count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrec.sources.schema import Table

SCHEMA = "check_id string, severity string, table_name string, subject string, n bigint"


def _rows(df: DataFrame, entries: list[tuple[str, str, str, str, Column]]) -> DataFrame:
    """Findings from one-row aggregates."""
    structs = [F.struct(F.lit(c).alias("check_id"), F.lit(s).alias("severity"), F.lit(t).alias("table_name"), F.lit(x).alias("subject"), n.cast("bigint").alias("n")) for c, s, t, x, n in entries]
    return df.select(F.explode(F.array(*structs)).alias("f")).select("f.*")


def column_findings(df: DataFrame, table: Table) -> DataFrame:
    """V1, V2: declared columns that are missing (personal ones excused), columns that aren't declared."""
    missing = [c.name for c in table.columns if c.name not in df.columns and not c.personal]
    extra = [c for c in df.columns if c not in table.by_name]
    rows = [("columns_missing", "error", table.name, c, 1) for c in missing] + [("columns_unexpected", "warning", table.name, c, 1) for c in extra]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def value_findings(df: DataFrame, table: Table, times: str | None = None) -> DataFrame:
    """One pass over the table; rows with n = 0 are clean.

    ``times`` names a column that tells how many equal rows a row stands for; then V4 is told too.
    """
    weight = F.lit(1) if times is None else F.col(times)
    aggs: dict[str, Column] = {"rows": F.coalesce(F.sum(weight), F.lit(0))}
    entries: list[tuple[str, str, str, str, Column]] = []

    def count(check: str, severity: str, subject: str, bad: Column) -> None:
        alias = f"x{len(aggs)}"
        aggs[alias] = F.coalesce(F.sum(F.when(bad, weight)), F.lit(0))
        entries.append((check, severity, table.name, subject, F.col(alias)))

    if table.rows is not None:
        entries.append(("row_count", "warning", table.name, "", F.when(F.col("rows") != table.rows, F.col("rows")).otherwise(0)))
    for c in table.columns:
        if c.name not in df.columns:
            continue
        value = F.col(c.name)
        if not c.nullable:
            count("nulls", "error", c.name, value.isNull())
        if c.unique:
            aggs[f"d_{c.name}"] = F.count_distinct(value)
            aggs[f"z_{c.name}"] = F.max(value.isNull().cast("int"))  # null is a value of its own
            entries.append(("uniqueness", "error", table.name, c.name, F.col("rows") - F.col(f"d_{c.name}") - F.coalesce(F.col(f"z_{c.name}"), F.lit(0))))
        if c.domain:
            alias = f"x{len(aggs)}"
            aggs[alias] = F.count_distinct(F.when(~value.isin(*c.domain), value))
            entries.append(("value_domain", "error", table.name, c.name, F.col(alias)))
        if c.prefix:
            count("id_format", "error", c.name, ~value.startswith(c.prefix))
        if c.low is not None:
            count("range_below", "error", c.name, value < c.low)
        if c.high is not None:
            count("range_above", "error", c.name, value > c.high)
    if times is not None:
        aggs["repeated"] = F.coalesce(F.sum(weight - 1), F.lit(0))
        entries.append(("duplicate_rows", "error", table.name, "", F.col("repeated")))
    return _rows(df.agg(*[a.alias(k) for k, a in aggs.items()]), entries)


def table_findings(df: DataFrame, table: Table) -> DataFrame:
    """V3-V9, V13, V14 from one reading of the table."""
    return value_findings(df.groupBy(*df.columns).agg(F.count("*").alias("__times")), table, "__times")


def duplicate_rows(df: DataFrame, table: Table) -> DataFrame:
    """V4: rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("k"))
    return _rows(groups.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")), [("duplicate_rows", "error", table.name, "", F.col("n"))])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, child_name: str, parent_name: str) -> DataFrame:
    """Child rows without a parent (null keys too), parents without a child."""
    held = parent.select(F.col(parent_key).alias("__k")).distinct()
    used = child.groupBy(F.col(key).alias("__c")).agg(F.count("*").alias("__n"))
    both = used.join(held, F.col("__c") == F.col("__k"), "full_outer")
    lost, idle = F.sum(F.when(F.col("__k").isNull(), F.col("__n"))), F.count(F.when(F.col("__n").isNull(), 1))
    told = both.agg(F.coalesce(lost, F.lit(0)).alias("lost"), idle.alias("idle"))
    return _rows(told, [("orphan_fk", "error", child_name, key, F.col("lost")), ("unreferenced_parent", "warning", parent_name, key, F.col("idle"))])


def repeats(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each (user, item)."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("k"))
    return _rows(groups.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")), [("repeat_enrollment", "info", name, ",".join(columns), F.col("n"))])


def price_mismatch(facts: DataFrame, amount: str, price: str, tolerance: float, name: str) -> DataFrame:
    """Rows whose amount isn't the joined price; a missing price is a mismatch."""
    equal = F.coalesce(F.abs(F.col(amount) - F.col(price)) <= tolerance, F.lit(False))
    return _rows(facts.agg(F.count(F.when(~equal, 1)).alias("n")), [("amount_vs_price", "warning", name, amount, F.col("n"))])


def type_vs_price(items: DataFrame, flag: str, price: str, name: str) -> DataFrame:
    """Free items with a price, paid items without one."""
    free, paid = F.count(F.when((F.col(flag) == 1) & (F.col(price) > 0), 1)), F.count(F.when((F.col(flag) == 0) & (F.col(price) <= 0), 1))
    return _rows(items.agg(free.alias("a"), paid.alias("b")), [("type_vs_price", "error", name, "free_with_price", F.col("a")), ("type_vs_price", "error", name, "paid_without_price", F.col("b"))])


def duplicate_names(df: DataFrame, column: str, name: str) -> DataFrame:
    """Names that several rows share."""
    shared = df.groupBy(column).agg(F.count("*").alias("k")).where("k > 1")
    return _rows(shared.agg(F.count("*").alias("n")), [("duplicate_names", "warning", name, column, F.col("n"))])


def fact_findings(facts: DataFrame, tolerance: float, name: str) -> DataFrame:
    """V12 and V15 from one pass over facts (user_id, item, amount, price)."""
    equal = F.coalesce(F.abs(F.col("amount") - F.col("price")) <= tolerance, F.lit(False))
    groups = facts.groupBy("user_id", "item").agg(F.count("*").alias("k"), F.count(F.when(~equal, 1)).alias("bad"))
    told = groups.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("again"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    return _rows(told, [("repeat_enrollment", "info", name, "user_id,item", F.col("again")), ("amount_vs_price", "warning", name, "amount", F.col("bad"))])


def report(tables: dict[str, DataFrame], declared: dict[str, Table], further: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The findings (n > 0) of all tables and ``further`` ones; a check whose columns are missing is skipped and says so."""
    parts: list[DataFrame] = list(further)
    for name, df in tables.items():
        table = declared[name]
        parts += [column_findings(df, table), table_findings(df, table)]
        for c in table.columns:
            if c.refers_to and c.refers_to[0] in tables:
                parent, key = c.refers_to
                if c.name in df.columns and key in tables[parent].columns:
                    parts.append(orphans(df, c.name, tables[parent], key, name, parent))
                else:
                    parts.append(df.sparkSession.createDataFrame([("skipped", "info", name, c.name, 1)], SCHEMA))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def require_clean(findings: DataFrame, known: tuple[str, ...] = ()) -> None:
    """Refuse to go on if a finding is an error, except for checks that are ``known`` to fail on these tables."""
    errors = findings.where((F.col("severity") == "error") & ~F.col("check_id").isin(*known)).limit(20).collect()
    if errors:
        raise ValueError(f"data-quality errors: {[e.asDict() for e in errors]}")
