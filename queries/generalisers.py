"""Queries for the column generalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    BALANCE_LAYERS,
    DATE_LAYERS,
    PRICE_LAYERS,
    customers,
    date_layer_sql,
    date_rule,
    layer_sql,
    moment_sql,
    number_rule,
    orders,
    query,
    table,
    without,
)
from veilwright.functions.masks import mask_constant, mask_prefix, mask_tail
from veilwright.functions.values import as_moment, as_number, epoch_day
from veilwright.operators import bins
from veilwright.operators.categories import category, map_values, typed, with_column
from veilwright.operators.generalize import generalize, generalize_auto
from veilwright.operators.hierarchy import hierarchy_table, sorted_values
from veilwright.operators.wildcard import only_qis, sentinel_to_null
from veilwright.spec import parse_rules

LOW_LAYERS = ((-1000, 0), (0, 2500), (2500, 5000))  # leaves balances above 5000 as they are
SIZE_LAYERS = ((1, 10), (10, 20), (20, 30))
SPLIT_LAYERS = (("1995-01-01", "1996-06-30"), ("1996-06-30", "1999-12-31"))


@query(
    f"""SELECT c_custkey, {layer_sql('c_acctbal', LOW_LAYERS, 'CAST(c_acctbal AS VARCHAR)')} AS c_acctbal
    FROM customer"""
)
def gen_ordering(spark, sf_dir):
    rules = parse_rules({"c_acctbal": number_rule(LOW_LAYERS)})
    return generalize(customers(spark, sf_dir).select("c_custkey", "c_acctbal"), rules)


@query(f"SELECT p_partkey, {layer_sql('p_size', SIZE_LAYERS, 'CAST(p_size AS VARCHAR)')} AS p_size FROM part")
def gen_ordering_whole(spark, sf_dir):
    rules = parse_rules({"p_size": number_rule(SIZE_LAYERS)})
    return generalize(table(spark, sf_dir, "part").select("p_partkey", "p_size"), rules)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders"""
)
def gen_coerce_number(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    df = orders(spark, sf_dir).select("o_orderkey", text.alias("price"))
    return df.select("o_orderkey", as_number(df, "price").alias("price"))


@query(
    f"""SELECT o_orderkey, {date_layer_sql('o_orderdate', SPLIT_LAYERS, moment_sql('o_orderdate'))} AS o_orderdate
    FROM orders"""
)
def gen_dates(spark, sf_dir):
    rules = parse_rules({"o_orderdate": date_rule(SPLIT_LAYERS)})
    return generalize(orders(spark, sf_dir).select("o_orderkey", "o_orderdate"), rules)


@query(
    f"""SELECT event_id, {date_layer_sql('ts', (('2024-01-01', '2024-01-03'),), moment_sql('ts'))} AS ts FROM events"""
)
def gen_dates_fraction(spark, sf_dir):
    rules = parse_rules({"ts": date_rule((("2024-01-01", "2024-01-03"),))})
    return generalize(table(spark, sf_dir, "events").select("event_id", "ts"), rules)


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE
    {date_layer_sql('o_orderdate', SPLIT_LAYERS, moment_sql('o_orderdate'))} END AS o_orderdate FROM orders"""
)
def gen_dates_text(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "not a date").when(
        F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy/M/d")
    )
    text = text.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = orders(spark, sf_dir).select("o_orderkey", text.alias("o_orderdate"))
    return generalize(df, parse_rules({"o_orderdate": date_rule(SPLIT_LAYERS)}))


@query(
    """SELECT c_custkey, CASE WHEN length(c_name) <= 10 THEN repeat('*', length(c_name))
           ELSE substr(c_name, 1, 10) || '****' END AS c_name,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Masked'
            WHEN length(c_mktsegment) <= 9 THEN repeat('*', length(c_mktsegment))
            ELSE substr(c_mktsegment, 1, 9) || '**' END AS c_mktsegment FROM customer"""
)
def gen_mask_prefix(spark, sf_dir):
    df = without(customers(spark, sf_dir), c_mktsegment="FURNITURE")
    return df.select(
        "c_custkey",
        mask_prefix(F.col("c_name"), "Customer#0****").alias("c_name"),
        mask_prefix(F.col("c_mktsegment"), "*aaaaaaaaa*").alias("c_mktsegment"),
    )


@query(
    """SELECT c_custkey, left(c_name, length(c_name) - 2) || '**' AS c_name,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Masked'
         ELSE left(c_mktsegment, length(c_mktsegment) - 2) || '**' END AS c_mktsegment FROM customer"""
)
def gen_mask_tail(spark, sf_dir):
    df = without(customers(spark, sf_dir), c_mktsegment="FURNITURE")
    return df.select(
        "c_custkey",
        mask_tail(F.col("c_name")).alias("c_name"),
        mask_tail(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag AS short_kept, 'Masked' AS short_masked,
    left(CAST(l_partkey AS VARCHAR), greatest(length(CAST(l_partkey AS VARCHAR)) - 2, 0))
        || CASE WHEN length(CAST(l_partkey AS VARCHAR)) > 2 THEN '**' ELSE CAST(l_partkey AS VARCHAR) END AS l_partkey
    FROM lineitem"""
)
def gen_mask_tail_short(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        mask_tail(F.col("l_returnflag"), short=None).alias("short_kept"),
        mask_tail(F.col("l_returnflag")).alias("short_masked"),
        mask_tail(F.col("l_partkey"), short=None).alias("l_partkey"),
    )


@query("SELECT c_custkey, 'Masked' AS c_name FROM customer")
def gen_mask_constant(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", mask_constant().alias("c_name"))


@query(
    """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'Unknown'
         ELSE c_mktsegment END AS c_mktsegment FROM customer"""
)
def gen_category(spark, sf_dir):
    df = without(customers(spark, sf_dir), c_mktsegment="FURNITURE")
    df = df.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "MACHINERY", "Masked").otherwise(F.col("c_mktsegment")))
    return df.select("c_custkey", category(df, "c_nationkey").alias("c_nationkey"), category(df, "c_mktsegment").alias("c_mktsegment"))


TYPED = """WITH v AS (SELECT nullif({column}, '{hole}') AS v, min({key}) AS f FROM {table} GROUP BY 1),
n AS (SELECT v, '{prefix}' || CAST(row_number() OVER (ORDER BY f) AS VARCHAR) AS label FROM v)
SELECT t.{key}, {value} AS {column} FROM {table} t JOIN n ON nullif(t.{column}, '{hole}') IS NOT DISTINCT FROM n.v"""


@query(
    TYPED.format(
        column="c_mktsegment", hole="FURNITURE", key="c_custkey", table="customer", prefix="type",
        value="CASE WHEN n.v IS NULL THEN NULL ELSE label END",
    )
)
def gen_category_typed(spark, sf_dir):
    df = without(customers(spark, sf_dir).select("c_custkey", "c_mktsegment"), c_mktsegment="FURNITURE")
    return typed(df, "c_mktsegment", "c_custkey")


@query(
    TYPED.format(
        column="o_orderpriority", hole="5-LOW", key="o_orderkey", table="orders", prefix="sensitive_type", value="label"
    )
)
def gen_sensitive_typed(spark, sf_dir):
    df = without(orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), o_orderpriority="5-LOW")
    return typed(df, "o_orderpriority", "o_orderkey", prefix="sensitive_type", number_null=True)


@query(
    """WITH v AS (SELECT c_name AS v, min(c_custkey) AS f FROM customer GROUP BY 1)
    SELECT c_custkey, 'type' || CAST(r AS VARCHAR) AS c_name FROM customer
    JOIN (SELECT v, row_number() OVER (ORDER BY f) AS r FROM v) ON v = c_name"""
)
def gen_category_typed_many(spark, sf_dir):
    """As many values as rows: the numbering itself has to scale."""
    return typed(customers(spark, sf_dir).select("c_custkey", "c_name"), "c_name", "c_custkey")


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS name, o_custkey % 3 AS turn FROM orders),
    v AS (SELECT name, row_number() OVER (ORDER BY min(turn), name) AS r FROM o GROUP BY name)
    SELECT o_orderkey, turn, 'type' || CAST(r AS VARCHAR) AS name FROM o JOIN v USING (name)"""
)
def gen_category_typed_ties(spark, sf_dir):
    """As many values as rows, in an order that knows three places only."""
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS name", "o_custkey % 3 AS turn")
    return typed(df, "name", "turn")


@query("SELECT p_partkey, 'General Category' AS p_type FROM part")
def gen_general(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return with_column(df, "p_type", bins.general())


MAPPING = {"BUILDING": "property", "FURNITURE": "property", "MACHINERY": "industry"}
MAPPED = """CASE c_mktsegment WHEN 'BUILDING' THEN 'property' WHEN 'FURNITURE' THEN 'property'
WHEN 'MACHINERY' THEN 'industry' ELSE {rest} END"""


@query(f"SELECT c_custkey, {MAPPED.format(rest='NULL')} AS c_mktsegment FROM customer")
def gen_map_null(spark, sf_dir):
    df = customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    return map_values(df, "c_mktsegment", MAPPING, keep_unmapped=False)


@query(f"SELECT c_custkey, {MAPPED.format(rest='c_mktsegment')} AS c_mktsegment FROM customer")
def gen_map_keep(spark, sf_dir):
    df = customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    return map_values(df, "c_mktsegment", MAPPING, keep_unmapped=True)


@query(
    """SELECT c_custkey, n_name AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def gen_map_table(spark, sf_dir):
    """The look-up table is itself a table."""
    df = customers(spark, sf_dir).select("c_custkey", "c_nationkey")
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return map_values(df, "c_nationkey", names, keep_unmapped=False)


def width_sql(source: str, key: str, value: str, null_bin: str) -> str:
    """Equal-width bins over ``value`` (a DOUBLE expression) of ``source``."""
    missing = {"null": "NULL", "first": "lab1", "last": "labn"}[null_bin]
    extra = "" if null_bin == "null" else "+ CAST(count(*) > count(v) AS INT)"
    return f"""WITH s AS (SELECT {key}, {value} AS v FROM {source}),
    m AS (SELECT min(v) AS lo, max(v) AS hi, greatest(least(count(DISTINCT v) {extra}, 4) - 1, 1) AS b FROM s),
    e AS (SELECT lo, hi, b, lo + (hi - lo) / b AS e1, lo + (hi - lo) / b * 2 AS e2 FROM m),
    t AS (SELECT *, CAST(CAST(trunc(lo) AS BIGINT) AS VARCHAR) AS tlo, CAST(CAST(trunc(hi) AS BIGINT) AS VARCHAR) AS thi,
          CAST(CAST(trunc(e1) AS BIGINT) AS VARCHAR) AS t1, CAST(CAST(trunc(e2) AS BIGINT) AS VARCHAR) AS t2 FROM e),
    l AS (SELECT *, CASE WHEN b = 1 THEN tlo || '-' || thi ELSE tlo || '-' || t1 END AS lab1,
          CASE WHEN b = 2 THEN t1 || '-' || thi ELSE t1 || '-' || t2 END AS lab2, t2 || '-' || thi AS lab3,
          CASE b WHEN 1 THEN tlo || '-' || thi WHEN 2 THEN t1 || '-' || thi ELSE t2 || '-' || thi END AS labn FROM t)
    SELECT {key}, CASE WHEN v IS NULL THEN {missing} WHEN b = 1 OR v < e1 THEN lab1
                       WHEN b = 2 OR v < e2 THEN lab2 ELSE lab3 END AS label FROM s, l"""


@query(width_sql("customer", "c_custkey", "c_acctbal", "null"))
def gen_equal_width(spark, sf_dir):
    df = customers(spark, sf_dir)
    return df.select("c_custkey", bins.equal_width(df, "c_acctbal").alias("label"))


@query(width_sql("lineitem", "l_orderkey, l_linenumber", "CASE WHEN l_linenumber <= 3 THEN CAST(l_linenumber AS DOUBLE) END", "first"))
def gen_equal_width_first(spark, sf_dir):
    """Three values and NULL: four edges."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    df = df.withColumn("n", F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")))
    return df.select("l_orderkey", "l_linenumber", bins.equal_width(df, "n", "first").alias("label"))


@query(width_sql("part", "p_partkey", "CASE WHEN p_size <= 40 THEN CAST(p_size AS DOUBLE) END", "last"))
def gen_equal_width_last(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("n", F.when(F.col("p_size") <= 40, F.col("p_size")))
    return df.select("p_partkey", bins.equal_width(df, "n", "last").alias("label"))


@query(width_sql("labels", "doc_id", "CAST(quality AS DOUBLE)", "null"))
def gen_equal_width_two(spark, sf_dir):
    """Two values: one bin."""
    df = table(spark, sf_dir, "labels")
    return df.select("doc_id", bins.equal_width(df, "quality").alias("label"))


@query(
    """WITH m AS (SELECT floor(min(c_acctbal) / 10) * 10 AS lo FROM customer),
    t AS (SELECT c_custkey, greatest(ceil(c_acctbal / 10) * 10, lo + 10) AS top FROM customer, m)
    SELECT c_custkey, CAST(CAST(top - 10 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(top AS BIGINT) AS VARCHAR) AS label FROM t"""
)
def gen_decade(spark, sf_dir):
    df = customers(spark, sf_dir)
    return df.select("c_custkey", bins.decade(df, "c_acctbal").alias("label"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Unknown'
    ELSE 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS o_orderdate FROM orders"""
)
def gen_quarter(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return df.select("o_orderkey", bins.quarter(df, "o_orderdate").alias("o_orderdate"))


@query(
    """SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END,
    (SELECT min(year(o_orderdate)) FROM orders WHERE o_orderstatus <> 'P')) AS VARCHAR) AS o_orderdate FROM orders"""
)
def gen_year(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return df.select("o_orderkey", bins.year(df, "o_orderdate").alias("o_orderdate"))


def equal_dates_sql(source: str, key: str, value: str) -> str:
    edge = "make_timestamp(lo + CAST(floor(CAST((hi - lo) * {i} AS DOUBLE) / 5) AS BIGINT))"
    edges = ", ".join(f"{edge.format(i=i)} AS e{i}" for i in range(6))
    cases = " ".join(
        f"WHEN v >= e{i} AND v < e{i + 1} THEN {moment_sql(f'e{i}')} || ' - ' || {moment_sql(f'e{i + 1}')}"
        for i in range(5)
    )
    return f"""WITH s AS (SELECT {key}, {value} AS v FROM {source}),
    m AS (SELECT min(epoch_us(v)) AS lo, max(epoch_us(v)) AS hi FROM s), e AS (SELECT {edges} FROM m)
    SELECT {key}, CASE WHEN v IS NULL THEN 'Unknown' {cases} END AS label FROM s, e"""


@query(equal_dates_sql("orders", "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END"))
def gen_dates_equal(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return df.select("o_orderkey", bins.dates_equal(df, "o_orderdate").alias("label"))


@query(equal_dates_sql("events", "event_id", "ts"))
def gen_dates_equal_fraction(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", bins.dates_equal(df, "ts").alias("label"))


def adaptive_sql(source: str, key: str, value: str) -> str:
    edge = "CAST(floor((lo + floor(CAST((hi - lo) * {i} AS DOUBLE) / b)) / 1000000.0) AS BIGINT)"
    day = f"strftime(make_timestamp({edge} * 1000000), '%Y-%m-%d')"

    def label(i: str, j: str) -> str:
        return f"{day.format(i=i)} || ' - ' || {day.format(i=j)}"

    cases = " ".join(f"WHEN b > {i} AND sec < {edge.format(i=i)} THEN {label(str(i - 1), str(i))}" for i in range(1, 8))
    last = label("(b - 1)", "b")
    return f"""WITH s AS (SELECT {key}, {value} AS v FROM {source}),
    d AS (SELECT DISTINCT epoch_us(v) AS us FROM s WHERE v IS NOT NULL),
    c AS (SELECT avg(us / 1000000.0) AS mu, coalesce(stddev_samp(us / 1000000.0), 0) AS sd FROM d),
    m AS (SELECT min(us) AS lo, max(us) AS hi FROM d, c WHERE us / 1000000.0 BETWEEN mu - 3 * sd AND mu + 3 * sd),
    b AS (SELECT lo, hi, CASE WHEN (hi - lo) // 86400000000 <= 365 THEN 2 WHEN (hi - lo) // 86400000000 <= 1825 THEN 4
          WHEN (hi - lo) // 86400000000 <= 3650 THEN 6 ELSE 8 END AS b FROM m),
    p AS (SELECT {key}, v, CAST(floor(epoch_us(v) / 1000000.0) AS BIGINT) AS sec, lo, hi, b FROM s, b)
    SELECT {key}, CASE WHEN v IS NULL THEN {label('0', '1')} WHEN sec < {edge.format(i=0)} THEN {last}
           {cases} ELSE {last} END AS label FROM p"""


@query(adaptive_sql("orders", "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END"))
def gen_dates_adaptive(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return df.select("o_orderkey", bins.dates_adaptive(df, "o_orderdate").alias("label"))


# a sixtieth of the orders is moved 90 years back: more than three deviations off
FAR = "CASE WHEN o_totalprice > 490000 THEN o_orderdate - INTERVAL 90 YEAR ELSE o_orderdate END"


@query(adaptive_sql("orders", "o_orderkey", FAR))
def gen_dates_adaptive_outliers(spark, sf_dir):
    moved = F.when(F.col("o_totalprice") > 490000, F.col("o_orderdate") - F.expr("INTERVAL '90' YEAR"))
    df = orders(spark, sf_dir).withColumn("o_orderdate", moved.otherwise(F.col("o_orderdate")))
    return df.select("o_orderkey", bins.dates_adaptive(df, "o_orderdate").alias("label"))


@query(
    f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN '*' ELSE '' END || '*' AS o_orderstatus,
    {layer_sql('o_totalprice', PRICE_LAYERS[:3], 'CAST(o_totalprice AS VARCHAR)')} AS o_totalprice,
    {date_layer_sql('o_orderdate', DATE_LAYERS, moment_sql('o_orderdate'))} AS o_orderdate,
    o_orderpriority FROM orders"""
    .replace("CASE WHEN o_orderstatus = 'P' THEN '*' ELSE '' END || '*'", "repeat('*', length(o_orderstatus))")
)
def gen_rules(spark, sf_dir):
    """All layered methods in one projection."""
    rules = parse_rules(
        {
            "o_totalprice": number_rule(PRICE_LAYERS[:3]),
            "o_orderdate": date_rule(DATE_LAYERS),
            "o_orderstatus": {"method": "Masking", "maskingString": "a**"},
            "o_orderpriority": {"method": "category"},
        }
    )
    return generalize(orders(spark, sf_dir), rules)


@query(
    f"""WITH w AS ({width_sql('part', 'p_partkey', 'CAST(p_size AS DOUBLE)', 'null')}),
    r AS ({width_sql('part', 'p_partkey', 'p_retailprice', 'null')})
    SELECT p_partkey, left(p_name, length(p_name) - 2) || '**' AS p_name, 'General Category' AS p_brand, p_type,
    w.label AS p_size, r.label AS p_retailprice FROM part JOIN w USING (p_partkey) JOIN r USING (p_partkey)"""
)
def gen_auto(spark, sf_dir):
    """Flat rules, with the defaults where a column has none."""
    rules = parse_rules({"p_size": "ordering", "p_name": "masking"})
    return generalize_auto(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size", "p_retailprice"], rules)


@query(
    """WITH m AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, (max(p_size) - min(p_size)) / 3.0::DOUBLE AS st FROM part),
    d AS (SELECT DISTINCT p_size AS value FROM part),
    i AS (SELECT value, lo + st * (CAST(value >= lo + st AS INT) + CAST(value >= lo + st * 2 AS INT)) AS a, st FROM d, m),
    t AS (SELECT value, CAST(CAST(trunc(a) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(a + st - 1) AS BIGINT) AS VARCHAR) AS lab FROM i)
    SELECT value, CAST(level AS INT) AS level, CASE level WHEN 0 THEN CAST(value AS VARCHAR) WHEN 4 THEN '*' ELSE lab END AS label
    FROM t, range(5) r(level)"""
)
def gen_hierarchy_numeric(spark, sf_dir):
    return hierarchy_table(table(spark, sf_dir, "part"), "p_size")


@query(
    """SELECT value, CAST(level AS INT) AS level, CASE level WHEN 0 THEN value ELSE '*' END AS label
    FROM (SELECT DISTINCT p_type AS value FROM part), range(2) r(level)"""
)
def gen_hierarchy_categorical(spark, sf_dir):
    return hierarchy_table(table(spark, sf_dir, "part"), "p_type")


@query("SELECT DISTINCT o_orderdate, epoch_us(o_orderdate) // 86400000000 AS day, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders")
def gen_epoch_days(spark, sf_dir):
    df = orders(spark, sf_dir)
    day = epoch_day(as_moment(df, "o_orderdate"))
    days = df.select("o_orderdate", day.cast("bigint").alias("day")).distinct()
    return days.withColumn("text", F.date_from_unix_date(F.col("day").cast("int")).cast("string"))


@query("SELECT DISTINCT nullif(l_linenumber, 3) AS l_linenumber, l_returnflag FROM lineitem")
def clean_sentinel(spark, sf_dir):
    line = F.when(F.col("l_linenumber") == 3, -2147483648).otherwise(F.col("l_linenumber"))
    df = table(spark, sf_dir, "lineitem").select(line.alias("l_linenumber"), "l_returnflag")
    return sentinel_to_null(df, ["l_linenumber"]).distinct()


@query("SELECT c_nationkey, c_mktsegment FROM customer")
def keep_qis(spark, sf_dir):
    return only_qis(customers(spark, sf_dir), ["c_nationkey", "c_mktsegment"])


@query(
    f"""SELECT c_custkey, {layer_sql('c_acctbal', BALANCE_LAYERS, 'CAST(c_acctbal AS VARCHAR)')} AS c_acctbal FROM customer
    WHERE c_acctbal IS NOT NULL"""
)
def gen_ordering_filtered(spark, sf_dir):
    """A filter on the raw column still reaches the scan."""
    df = customers(spark, sf_dir).filter(F.col("c_acctbal").isNotNull()).select("c_custkey", "c_acctbal")
    return generalize(df, parse_rules({"c_acctbal": number_rule(BALANCE_LAYERS)}))


@query("SELECT DISTINCT p_type FROM part")
def gen_sorted_values(spark, sf_dir):
    return sorted_values(table(spark, sf_dir, "part"), "p_type")


@query(
    f"""WITH w AS ({width_sql('part', 'p_partkey', 'CAST(p_size AS DOUBLE)', 'first')})
    SELECT p_partkey, p_name, 'Masked' AS p_brand, 'General Category' AS p_type, w.label AS p_size, p_retailprice
    FROM part JOIN w USING (p_partkey)"""
)
def gen_auto_adaptive(spark, sf_dir):
    rules = parse_rules({"p_size": "ordering", "p_brand": "masking"})
    return generalize_auto(table(spark, sf_dir, "part"), ["p_size", "p_brand", "p_type"], rules, style="adaptive")


@query(
    f"""WITH w AS ({width_sql('customer', 'c_custkey', 'c_acctbal', 'last')})
    SELECT c_custkey, '通用类别' AS c_mktsegment, w.label AS c_acctbal FROM customer JOIN w USING (c_custkey)"""
)
def gen_auto_ranges(spark, sf_dir):
    """The first rule generation: no rules at all."""
    df = customers(spark, sf_dir).select("c_custkey", "c_mktsegment", "c_acctbal")
    return generalize_auto(df, ["c_mktsegment", "c_acctbal"], style="ranges")


@query(
    """WITH v AS (SELECT o_orderpriority AS v, 'type' || CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS VARCHAR) AS label
    FROM orders GROUP BY 1)
    SELECT o_orderkey, label AS o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS o_orderdate, 'Masked' AS o_orderstatus
    FROM orders JOIN v ON v = o_orderpriority"""
)
def gen_auto_yearly(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    rules = parse_rules({"o_orderpriority": "category", "o_orderdate": "dates", "o_orderstatus": "masking"})
    return generalize_auto(df, list(rules), rules, style="yearly", order_col="o_orderkey")
