"""Declared schemas of the star tables: types, keys, domains and personal columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    """A column and its constraints; ``personal`` columns are dropped when a table is read."""

    name: str
    kind: str
    nullable: bool = False
    unique: bool = False
    personal: bool = False
    low: float | None = None
    high: float | None = None
    domain: tuple[str, ...] = ()
    prefix: str | None = None
    refers_to: tuple[str, str] | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    rows: int | None = None
    by_name: dict[str, Column] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {c.name: c for c in self.columns})


CUSTOMER = Table(
    "customer",
    (
        Column("c_custkey", "bigint", unique=True),
        Column("c_name", "string", personal=True, prefix="Customer#"),
        Column("c_nationkey", "int", refers_to=("nation", "n_nationkey"), low=0, high=24),
        Column("c_acctbal", "double", low=-1000, high=10000),
        Column("c_mktsegment", "string", domain=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    ),
)
PART = Table(
    "part",
    (
        Column("p_partkey", "bigint", unique=True),
        Column("p_name", "string"),
        Column("p_brand", "string", prefix="Brand#"),
        Column("p_type", "string"),
        Column("p_size", "int", low=1, high=50),
        Column("p_retailprice", "double", low=0),
    ),
)
SUPPLIER = Table(
    "supplier",
    (
        Column("s_suppkey", "bigint", unique=True),
        Column("s_name", "string", personal=True, prefix="Supplier#"),
        Column("s_nationkey", "int", refers_to=("nation", "n_nationkey")),
        Column("s_acctbal", "double"),
    ),
)
ORDERS = Table(
    "orders",
    (
        Column("o_orderkey", "bigint", unique=True),
        Column("o_custkey", "bigint", refers_to=("customer", "c_custkey")),
        Column("o_orderstatus", "string", domain=("F", "O", "P")),
        Column("o_totalprice", "double", low=0),
        Column("o_orderdate", "timestamp_ntz"),
        Column("o_orderpriority", "string", domain=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    ),
)
LINEITEM = Table(
    "lineitem",
    (
        Column("l_orderkey", "bigint", refers_to=("orders", "o_orderkey")),
        Column("l_partkey", "bigint", refers_to=("part", "p_partkey")),
        Column("l_suppkey", "bigint", refers_to=("supplier", "s_suppkey")),
        Column("l_linenumber", "int", low=1, high=7),
        Column("l_quantity", "double", low=1, high=50),
        Column("l_extendedprice", "double", low=0),
        Column("l_discount", "double", low=0, high=0.1),
        Column("l_tax", "double", low=0, high=0.08),
        Column("l_returnflag", "string", domain=("A", "N", "R")),
        Column("l_linestatus", "string", domain=("F", "O")),
        Column("l_shipdate", "timestamp_ntz"),
    ),
)
TABLES = {t.name: t for t in (CUSTOMER, PART, SUPPLIER, ORDERS, LINEITEM)}
