"""What all registered queries share: tables, fixed rule sets and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.spec import parse_rules


@dataclass(frozen=True)
class Query:
    """A query with the SQL that must give the same rows; ``sql`` is None where none can."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        CATALOG[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules of the registered queries.
BALANCE_LAYERS = ((-1000, 0), (0, 2500), (2500, 5000), (5000, 10000))
PRICE_LAYERS = ((0, 100000), (100000, 200000), (200000, 300000), (300000, 400000), (400000, 600000))
DATE_LAYERS = (("1995-01-01", "1996-12-31"), ("1997-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31"))
K = 5
THRESHOLD = 0.3


def number_rule(layers) -> dict:
    return {"method": "ordering", "layers": [{"min": a, "max": b} for a, b in layers]}


def date_rule(layers) -> dict:
    return {"method": "dates", "layers": [{"min": a, "max": b} for a, b in layers]}


CUSTOMER_RULES = parse_rules({"c_acctbal": number_rule(BALANCE_LAYERS), "c_mktsegment": {"method": "category"}})
CUSTOMER_QIS = ["c_nationkey", "c_mktsegment", "c_acctbal"]
CUSTOMER_KEY = ["c_custkey"]
BALANCE_QIS = ["c_nationkey", "c_acctbal"]
ORDER_RULES = parse_rules({"o_orderdate": date_rule(DATE_LAYERS), "o_totalprice": number_rule(PRICE_LAYERS)})
ORDER_QIS = ["o_orderdate", "o_totalprice", "o_orderpriority"]
FINE_QIS = ["o_custkey", "o_orderdate"]
ORDER_KEY = ["o_orderkey"]


def layer_sql(column: str, layers, otherwise: str) -> str:
    cases = " ".join(
        f"WHEN {column} BETWEEN {float(a)} AND {float(b)} THEN '{float(a)}-{float(b)}'" for a, b in layers
    )
    return f"CASE {cases} ELSE {otherwise} END"


def date_layer_sql(column: str, layers, otherwise: str) -> str:
    cases = " ".join(
        f"WHEN {column} BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' THEN '{a} - {b}'" for a, b in layers
    )
    return f"CASE {cases} ELSE {otherwise} END"


def moment_sql(column: str) -> str:
    """Text of a timestamp, with six decimals only when there is a fraction."""
    return (
        f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN strftime({column}, '%Y-%m-%d %H:%M:%S') "
        f"ELSE strftime({column}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


BALANCE = layer_sql("c_acctbal", BALANCE_LAYERS, "CAST(c_acctbal AS VARCHAR)")
PRICE = layer_sql("o_totalprice", PRICE_LAYERS, "CAST(o_totalprice AS VARCHAR)")
ORDER_DATE = date_layer_sql("o_orderdate", DATE_LAYERS, moment_sql("o_orderdate"))
# customers and orders after their rules, as common table expressions
CUSTOMERS = f"g AS (SELECT c_custkey, c_name, c_nationkey, {BALANCE} AS c_acctbal, c_mktsegment FROM customer)"
ORDERS = (
    f"g AS (SELECT o_orderkey, o_custkey, o_orderstatus, {PRICE} AS o_totalprice, "
    f"{ORDER_DATE} AS o_orderdate, o_orderpriority FROM orders)"
)


def marked_sql(expression: str) -> str:
    """A value's text with its length before it, a dash for NULL."""
    text = f"CAST({expression} AS VARCHAR)"
    return f"CASE WHEN {expression} IS NULL THEN '-' ELSE length({text}) || ':' || {text} END"


def cut_sql(
    source: str, flagged: str, key: str, salt: str, fraction: float, out: str, text: str | None = None
) -> str:
    """CTEs that drop floor(count * fraction) flagged rows of ``source`` in hash order."""
    text = text or marked_sql(key)
    return f"""
    {out}_r AS (SELECT *, row_number() OVER (ORDER BY md5('{salt}|' || {text}), {key}) AS rk,
                count(*) OVER () AS cnt FROM ({flagged}) f),
    {out}_d AS (SELECT {key} AS gone FROM {out}_r
                WHERE rk <= floor(CAST(cnt AS DOUBLE) * CAST({fraction} AS DOUBLE))),
    {out} AS (SELECT s.* FROM {source} s WHERE s.{key} NOT IN (SELECT gone FROM {out}_d))"""


def in_classes_sql(source: str, qis, having: str) -> str:
    """Rows of ``source`` in classes for which ``having`` holds."""
    names = ", ".join(qis)
    return (
        f"SELECT s.* FROM {source} s SEMI JOIN "
        f"(SELECT {names} FROM {source} GROUP BY {names} HAVING {having}) USING ({names})"
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def without(df: DataFrame, **values: str) -> DataFrame:
    """Turn one value of a column into NULL, to have unknown cells in whole tables."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in values.items()})
