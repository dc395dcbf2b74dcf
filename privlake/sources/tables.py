"""Tables and the views derived from them: form fields, saved values, boxes, requests. Each is defined alike in Spark SQL and DuckDB SQL."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One form of sixteen fields: ord, name, id, type, label, required, max_length, pattern, options.
TEMPLATE = (
    (0, "firstName", "firstName", "text", "Given Name", True, 30, "", ""),
    (1, "lastName", "lastName", "text", "Surname", True, 30, "", ""),
    (2, "dob", "dob", "text", "Date of Birth", True, 10, "", ""),
    (3, "aadhaar", "aadhaar", "text", "Aadhaar Number", True, 14, "", ""),
    (4, "pan", "", "text", "PAN Number", False, 10, "", ""),
    (5, "mobile", "mobile", "tel", "Mobile Number", True, 13, "[6-9][0-9]{9}", ""),
    (6, "email", "email", "email", "Email", False, 60, "", ""),
    (7, "address", "address", "textarea", "Address", True, 200, "", ""),
    (8, "state", "state", "select", "State", True, 0, "", "-- Select State --|Delhi|Kerala|Punjab"),
    (9, "pincode", "pincode", "text", "PIN Code", True, 6, "", ""),
    (10, "ifsc", "ifsc", "text", "IFSC Code (for Aadhaar-Bank linking)", False, 11, "", ""),
    (11, "account", "account", "text", "Account Number", False, 18, "", ""),
    (12, "otp", "otp", "text", "OTP", True, 6, "^[0-9]{6}$", ""),
    (13, "secret", "secret", "password", "Password", True, 30, "", ""),
    (14, "idType", "idA", "radio", "Passport", False, 0, "", ""),
    (15, "idType", "idB", "radio", "Aadhaar card", False, 0, "", ""),
)


def _values() -> str:
    quote = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in TEMPLATE)


#: Runs in both dialects; customer is the page.
FORM_FIELDS = f"""
SELECT c.c_custkey AS page_id, 'f1' AS form_id, t.ord AS ord, t.name AS name, t.id AS id, t.type AS type, t.label AS label, t.required AS required, t.max_length AS max_length, t.pattern AS pattern, t.opts AS opts,
  CASE WHEN (c.c_custkey * 7 + t.ord * 3) % 5 = 0 THEN ''
       WHEN t.ord = 2 THEN CASE WHEN c.c_custkey % 3 = 0 THEN '1998-05-12' ELSE '12/05/1998' END
       WHEN t.ord = 3 THEN CASE WHEN c.c_custkey % 2 = 0 THEN '234123412346' ELSE '2341 2341 2346' END
       WHEN t.ord = 4 THEN CASE WHEN c.c_custkey % 4 = 0 THEN 'ABCDE1234' ELSE 'ABCPE1234F' END
       WHEN t.ord = 5 THEN CASE WHEN c.c_custkey % 3 = 1 THEN '1876543210' ELSE '9876543210' END
       WHEN t.ord = 6 THEN CASE WHEN c.c_custkey % 6 = 0 THEN 'nobody' ELSE concat(c.c_name, '@example.com') END
       WHEN t.ord = 8 THEN CASE WHEN c.c_custkey % 2 = 0 THEN '-- Select State --' ELSE 'Delhi' END
       WHEN t.ord = 9 THEN CASE WHEN c.c_custkey % 5 = 0 THEN '11000' ELSE '110001' END
       WHEN t.ord = 10 THEN 'SBIN0001234'
       WHEN t.ord = 11 THEN CAST(100000000 + c.c_custkey AS STRING)
       WHEN t.ord = 12 THEN CASE WHEN c.c_custkey % 2 = 0 THEN '12345' ELSE '123456' END
       ELSE c.c_name END AS value,
  t.ord = 14 + c.c_custkey % 3 AS checked
FROM customer c CROSS JOIN (VALUES {_values()}) AS t(ord, name, id, type, label, required, max_length, pattern, opts)"""

#: Saved values under keys of varied spelling.
USER_DATA = """
SELECT c.c_custkey AS page_id, t.k AS key, CASE WHEN c.c_custkey % t.m = 0 THEN '' ELSE c.c_name END AS value
FROM customer c CROSS JOIN (VALUES ('First-Name', 2), ('MOBILE NUMBER', 3), ('state', 4), ('Date of birth', 5)) AS t(k, m)"""

#: Elements and texts of the same pages, with values planted.
PAGE_ELEMENTS = """
SELECT c.c_custkey AS page_id, t.ord AS ord, t.id AS id, '' AS label,
  CASE t.ord WHEN 0 THEN 'Sign in' WHEN 1 THEN concat('mail ', c.c_name, '@example.com or born 12/05/1998') WHEN 2 THEN concat('from 10.0.', CAST(c.c_custkey % 250 AS STRING), '.7 by 9876543210@upi') WHEN 3 THEN concat('Aadhaar: ', CASE WHEN c.c_custkey % 3 = 0 THEN '2341 2341 2346' ELSE '1234 5678 9012' END) ELSE c.c_mktsegment END AS text,
  CAST(t.ord * 40 AS DOUBLE) AS x, CAST(c.c_custkey % 700 AS DOUBLE) AS y, CAST(120 AS DOUBLE) AS w, CAST(24 AS DOUBLE) AS h
FROM customer c CROSS JOIN (VALUES (0, 'go'), (1, 'firstName'), (2, 'dob'), (3, 'mobile'), (4, 'dob')) AS t(ord, id)"""
PAGE_TEXTS = """
SELECT c.c_custkey AS page_id, concat('Welcome ', c.c_name, '. ',
  CASE c.c_custkey % 7 WHEN 0 THEN 'Card 4539 5787 6362 1486, again 4539578763621486.' WHEN 1 THEN 'Id 2341 2341 2346 and mail a.b@example.org, a.b@example.org' WHEN 2 THEN 'PAN ABCPE1234F, then SBIN0001234' WHEN 3 THEN 'Call 8765432109 or 8765432109 or 1765432109'
    WHEN 4 THEN concat('Born 12/05/1998 and 01-02-1990, mail ', c.c_name, '@example.com') WHEN 5 THEN 'Host 192.168.1.20 pays user@paytm' ELSE 'Nothing to see' END) AS text
FROM customer c"""

#: Boxes of a page are the lines of an order; integers from keys, so that many overlap. Every arithmetic result is exact.
BOXES = """
SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord,
  CASE WHEN l_partkey % 3 = 0 THEN 'phone' WHEN l_partkey % 3 = 1 THEN 'email' ELSE 'name' END AS category,
  CASE WHEN l_suppkey % 2 = 0 THEN 'dom' ELSE 'vision' END AS source,
  CAST(l_partkey * 13 % 240 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 90 AS DOUBLE) AS y, CAST(100 + l_partkey % 50 AS DOUBLE) AS w, CAST(20 + l_suppkey % 20 AS DOUBLE) AS h,
  CAST((50 + l_partkey % 50) AS DOUBLE) / 100 AS confidence, concat('t', CAST(l_partkey AS STRING)) AS text
FROM lineitem"""

#: Conversation turns as request bodies, some with planted values.
REQUESTS = """
SELECT conv_id * 1000 + turn AS request_id, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS ts, CASE WHEN role = 'user' THEN 'own' ELSE 'page' END AS origin,
  CASE WHEN conv_id % 4 = 0 THEN 'http://localhost:3000/api/plan?x=1' WHEN conv_id % 4 = 1 THEN 'https://Api.Example.com:443/v1/chat?key=1#top' WHEN conv_id % 4 = 2 THEN 'http://192.168.1.5/a' ELSE 'https://example.org:8443' END AS url, 'POST' AS method,
  concat(coalesce(text, ''), CASE WHEN (conv_id + turn) % 7 = 0 THEN ' card 4539578763621486' WHEN (conv_id + turn) % 7 = 1 THEN ' pay user@paytm or ABCPE1234F' WHEN (conv_id + turn) % 7 = 2 THEN ' call +91 9876543210' WHEN (conv_id + turn) % 7 = 3 THEN ' id 1234 1234 1234 1234' ELSE '' END) AS body
FROM conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables whose rows each mean much work (a form of fields, a page to be parsed): their key, and the rows of one task.
SPREAD = {"customer": ("c_custkey", 5000), "pages": ("page_id", 2000)}


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt out by its key over tasks of a bounded number of rows, and over all cores.

    Such a table is a small file, perhaps with all its rows in one group, so that one task would read it and then do all the work that follows. The tasks are as many as its rows, counted
    first (files tell that), ask for; a number that is given is not coalesced by the few bytes that the rows have before they are expanded.
    """
    rows, (key, most) = table(spark, sf_dir, name), SPREAD[name]
    return rows.repartition(tasks_for(rows, most), key)


def tasks_for(rows: DataFrame, most: int) -> int:
    """How many tasks give each some `most` of the rows, or every core one."""
    n = rows.count()
    return max(1, min(n, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most))))


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """`sql` over the named tables of `sf_dir`."""
    for name in names:
        view = f"{name}_{zlib.crc32(sf_dir.encode())}"
        (spread if name in SPREAD else table)(spark, sf_dir, name).createOrReplaceTempView(view)
        sql = re.sub(rf"\bFROM {name}\b", f"FROM {view}", sql)
    return spark.sql(sql)


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FORM_FIELDS with options as an array."""
    fields = derived(spark, sf_dir, FORM_FIELDS, "customer")
    return fields.withColumn("options", F.when(F.col("opts") == "", F.array().cast("array<string>")).otherwise(F.split("opts", r"\|"))).drop("opts")
