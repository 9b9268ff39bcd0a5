"""The tables of ``Tables`` over a star schema of orders, and their SQL twin.

An order is a work (year, citations, open access, type), its customer the venue, each line an authorship (the supplier) with
a topic and a reference (the part); a supplier's nation is the institution and the nation's region the country.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.model.tables import Tables
from paperloom.session import table

#: Line columns that make the position of an author in a work unique, up to rows that are equal throughout.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their position in the work and the work's number of lines: one shuffle by work serves both."""
    by_work = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_suppkey", "l_partkey", "l_discount", F.row_number().over(by_work.orderBy(*LINE_ORDER)).alias("apos"), F.count(F.lit(1)).over(by_work).alias("n_lines"))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    works = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").select(
        F.col("o_orderkey").alias("work_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Work "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("").alias("abstract"), F.year("o_orderdate").alias("year"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"), F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "F").alias("is_oa"), F.lit(None).cast("string").alias("doi"),
        F.col("o_custkey").alias("source_id"), F.coalesce("c_name", F.lit("")).alias("source_name"), F.coalesce("c_mktsegment", F.lit("")).alias("source_type"),
    )
    line = lines(spark, sf_dir)
    named = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"], "left")
    authorships = named.select(
        F.col("l_orderkey").alias("work_id"), "apos", F.col("l_suppkey").alias("author_id"), F.coalesce("s_name", F.lit("")).alias("author_name"), (F.col("apos") == 1).alias("is_first"), (F.col("apos") == F.col("n_lines")).alias("is_last"),
        ((F.col("l_partkey") % 7) == 0).alias("is_corresponding"),
    )
    homes = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]).join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # 25 and 5 rows
    homes = homes.select("s_suppkey", F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("institution"), F.col("r_name").alias("country_code"))
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_discount")
    institutions = line.join(homes, line["l_suppkey"] == homes["s_suppkey"]).select(F.col("l_orderkey").alias("work_id"), "apos", F.lit(0).alias("ipos"), "institution_id", "institution", "country_code", F.lit("").alias("institution_type"))
    topics = raw.join(part, raw["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("work_id"), F.lit(0).alias("tpos"), F.col("p_type").alias("topic_id"), F.col("p_type").alias("topic"), F.col("l_discount").alias("score"))
    refs = raw.select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("ref_id"))
    return Tables(works, authorships, institutions, topics, refs)


#: Common table expressions of the same tables, for DuckDB.
SQL = f"""
w AS (SELECT o_orderkey AS work_id, o_orderkey AS pos, 'Work ' || o_orderkey AS title, CAST(year(o_orderdate) AS INT) AS year, CAST(floor(o_totalprice / 1000) AS INT) AS citations,
             o_orderpriority AS type, o_orderstatus = 'F' AS is_oa, o_custkey AS source_id, coalesce(c_name, '') AS source_name, coalesce(c_mktsegment, '') AS source_type
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS INT) AS apos, count(*) OVER (PARTITION BY l_orderkey) AS n_lines FROM lineitem),
a AS (SELECT l_orderkey AS work_id, apos, l_suppkey AS author_id, coalesce(s_name, '') AS author_name, apos = 1 AS is_first, apos = n_lines AS is_last, l_partkey % 7 = 0 AS is_corresponding
      FROM l LEFT JOIN supplier ON l_suppkey = s_suppkey),
i AS (SELECT l_orderkey AS work_id, apos, n_nationkey AS institution_id, n_name AS institution, r_name AS country_code
      FROM l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT l_orderkey AS work_id, p_type AS topic_id, p_type AS topic, l_discount AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT l_orderkey AS work_id, l_partkey AS ref_id FROM lineitem)
"""
