"""Bind the given tables to the account-takeover data model.

* transaction = order; account = customer; amount = o_totalprice;
  time = o_orderdate with o_orderkey as tie-break; country = customer
  nation; beneficiary = part of the order's first line (lowest line
  number, then part, then supplier) (null when the
  order has no line); location = nation of that line's supplier;
  failed auth attempts = returned lines; behaviour = 4 × mean discount;
  label = every line returned and at least two lines.
* session event = events row; account = user_id; device = props.k.

Joins to nation use ``broadcast`` because nation has a fixed 25 rows;
every other join is left to AQE, which broadcasts only from measured
runtime sizes (``spark.sql.adaptive.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import hash_uniform
from vigil.plans.sqltext import sround
from vigil.sources.tables import table


def order_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order with at least one line; partial aggregation
    happens map-side, so a hot order costs one row per map task."""
    return lineitem.groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("_first"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        # discounts are whole percents: sum them as integers so the mean
        # does not depend on the order of addition
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount_pct_sum"),
    ).select("l_orderkey", F.col("_first.l_partkey").alias("first_partkey"),
             F.col("_first.l_suppkey").alias("first_suppkey"), "n_lines", "n_returned",
             (F.col("discount_pct_sum") * 4.0 / (F.col("n_lines") * 100.0)).alias("discount_score"))


def transactions_from(orders: DataFrame, customer: DataFrame, nation: DataFrame,
                      lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    nat = F.broadcast(nation.select("n_nationkey", "n_name"))
    snat = F.broadcast(nation.select(F.col("n_nationkey").alias("s_nk"),
                                     F.col("n_name").alias("location_city")))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey")
    lines = order_lines(lineitem)
    sup = supplier.select("s_suppkey", F.col("s_nationkey").alias("s_nk"))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(nat, F.col("c_nationkey") == nat.n_nationkey, "left")
          .join(lines, o.o_orderkey == lines.l_orderkey, "left")
          .join(sup, F.col("first_suppkey") == sup.s_suppkey, "left")
          .join(snat, "s_nk", "left"))
    cust = F.col("o_custkey")
    ip = F.concat(F.lit("10."), F.col("c_nationkey").cast("string"), F.lit("."),
                  ((cust / 256).cast("bigint") % 256).cast("string"), F.lit("."),
                  (cust % 256).cast("string"))
    return j.select(
        F.when(F.col("o_orderkey").isNotNull(), F.format_string("TXN-%010d", F.col("o_orderkey"))).alias("transaction_id"),
        F.concat(F.lit("ACC-"), cust.cast("string")).alias("account_number"),
        F.col("o_orderkey").alias("txn_seq"),
        F.col("o_orderdate").alias("transaction_ts"),
        F.col("o_totalprice").alias("transaction_amount"),
        F.col("n_name").alias("ip_country"),
        ip.alias("ip_address"),
        F.concat(F.lit("DEV-"), cust.cast("string"), F.lit("-"),
                 F.substring("o_orderpriority", 1, 1)).alias("device_id"),
        F.when(F.col("first_partkey").isNotNull(),
               F.concat(F.lit("BEN-"), F.col("first_partkey").cast("string"))).alias("beneficiary_account"),
        F.col("location_city"),
        F.coalesce(F.col("n_returned") * 10, F.lit(0)).cast("int").alias("failed_auth_attempts"),
        F.round(F.col("discount_score"), 4).alias("behavioral_anomaly_score"),
        F.when(F.col("n_lines").isNull(), F.lit(None).cast("int"))
         .when((F.col("n_returned") == F.col("n_lines")) & (F.col("n_lines") >= 2), F.lit(1))
         .otherwise(F.lit(0)).alias("actual_is_ato"),
    ).withColumn("_safe", 1.0 - hash_uniform("ip", F.col("ip_address"))) \
     .withColumn("ip_fraud_score", F.round(1.0 - F.col("_safe") * F.col("_safe"), 4)).drop("_safe")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return transactions_from(t("orders"), t("customer"), t("nation"), t("lineitem"), t("supplier"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → (event_id, account, ts, event_type, amount, device)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("account"),
        "ts",
        "event_type",
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("device"),
    )


# DuckDB text of the same bindings, used by the oracle queries.
TXN_SQL = """
(SELECT
  'TXN-' || printf('%010d', o.o_orderkey) AS transaction_id,
  'ACC-' || CAST(o.o_custkey AS VARCHAR) AS account_number,
  o.o_orderkey AS txn_seq,
  o.o_orderdate AS transaction_ts,
  o.o_totalprice AS transaction_amount,
  n.n_name AS ip_country,
  '10.' || CAST(c.c_nationkey AS VARCHAR) || '.' || CAST(CAST(trunc(o.o_custkey / 256) AS BIGINT) % 256 AS VARCHAR)
        || '.' || CAST(o.o_custkey % 256 AS VARCHAR) AS ip_address,
  'DEV-' || CAST(o.o_custkey AS VARCHAR) || '-' || substr(o.o_orderpriority, 1, 1) AS device_id,
  CASE WHEN l.first_partkey IS NOT NULL THEN 'BEN-' || CAST(l.first_partkey AS VARCHAR) END AS beneficiary_account,
  sn.n_name AS location_city,
  CAST(coalesce(l.n_returned * 10, 0) AS INTEGER) AS failed_auth_attempts,
  {SROUND_B} AS behavioral_anomaly_score,
  CASE WHEN l.n_lines IS NULL THEN NULL WHEN l.n_returned = l.n_lines AND l.n_lines >= 2 THEN 1 ELSE 0 END AS actual_is_ato,
  {SROUND_IP} AS ip_fraud_score
FROM orders o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, min((l_linenumber, l_partkey, l_suppkey))[2] AS first_partkey,
                  min((l_linenumber, l_partkey, l_suppkey))[3] AS first_suppkey, count(*) AS n_lines,
                  count_if(l_returnflag = 'R') AS n_returned,
                  sum(CAST(round(l_discount * 100) AS BIGINT)) * 4.0 / (count(*) * 100.0) AS discount_score
           FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
LEFT JOIN supplier s ON l.first_suppkey = s.s_suppkey
LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey)
"""

_IP_DRAW = """CAST(('0x' || substr(md5('ip:' || ('10.' || CAST(c.c_nationkey AS VARCHAR) || '.' ||
        CAST(CAST(trunc(o.o_custkey / 256) AS BIGINT) % 256 AS VARCHAR) || '.' || CAST(o.o_custkey % 256 AS VARCHAR))), 1, 8)) AS BIGINT)
        / 4294967296.0"""
TXN_SQL = TXN_SQL.replace("{SROUND_B}", sround("l.discount_score", 4)).replace(
    "{SROUND_IP}", sround(f"1.0 - (1.0 - {_IP_DRAW}) * (1.0 - {_IP_DRAW})", 4))

EVENTS_SQL = """
(SELECT event_id, user_id AS account, ts, event_type, value AS amount,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS device
 FROM events)
"""


# --- tabular applications: documents + labels, as raw CSV-like text ---------

# FIXED VALUES: the categorical levels used for derived columns
DEVICE_OS_LEVELS = ["linux", "windows", "macintosh", "x11", "other"]
EMPLOYMENT_LEVELS = ["CA", "CB", "CC", "CD", "CE", "CF", "CG"]
HOUSING_LEVELS = ["BA", "BB", "BC", "BD", "BE", "BF", "BG"]


def _pick(levels, idx):
    return F.element_at(F.array(*[F.lit(x) for x in levels]), (idx % len(levels) + 1).cast("int"))


def applications_from(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One application per document.  ``fraud_bool`` = toxic label (null when
    unlabelled); ``income`` arrives as text with dirt (padding, words, Java
    suffixes, NaN, blanks, nulls); other columns are numeric derivations of
    the document (its full text length and line count) or md5 draws."""
    lab = labels.select("doc_id", "toxic", "quality")
    d = documents.select("doc_id", "text", "lang", "source", "n_chars").join(lab, "doc_id", "left")
    i = F.col("doc_id")
    nc = F.col("n_chars").cast("string")
    income = (F.when(i % 11 == 0, F.lit("abc"))
               .when(i % 13 == 0, F.concat(F.lit(" "), nc, F.lit(" ")))
               .when(i % 17 == 0, F.lit("12d"))
               .when(i % 19 == 0, F.lit("NaN"))
               .when(i % 23 == 0, F.lit(None).cast("string"))
               .when(i % 29 == 0, F.lit(""))
               .otherwise(nc))
    u = lambda s: hash_uniform(s, i)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return d.select(
        i.alias("application_id"),
        F.col("toxic").alias("fraud_bool"),
        income.alias("income"),
        F.round(u("nes"), 6).alias("name_email_similarity"),
        (i % 120).cast("int").alias("prev_address_months_count"),
        (F.col("n_chars") % 240).cast("int").alias("current_address_months_count"),
        (F.lit(18) + i % 60).cast("int").alias("customer_age"),
        F.round(u("dsr") * 30, 4).alias("days_since_request"),
        F.round((u("iba") - 0.5) * 200, 2).alias("intended_balcon_amount"),
        F.length("text").cast("bigint").alias("zip_count_4w"),
        F.round(u("v6") * 10000, 2).alias("velocity_6h"),
        lines.cast("bigint").alias("velocity_24h"),
        F.round(u("v4w") * 6000, 2).alias("velocity_4w"),
        (F.coalesce(F.col("quality"), F.lit(0)) * 100 + i % 100).cast("int").alias("credit_risk_score"),
        (i % 2).cast("int").alias("email_is_free"),
        ((i / 2).cast("bigint") % 2).cast("int").alias("phone_home_valid"),
        F.round(u("pcl") * 2000, 0).alias("proposed_credit_limit"),
        F.round(u("slm") * 60, 4).alias("session_length_in_minutes"),
        (i % 5).cast("int").alias("device_distinct_emails_8w"),
        (i % 8).cast("int").alias("month"),
        F.col("lang").alias("payment_type"),
        _pick(EMPLOYMENT_LEVELS, i).alias("employment_status"),
        F.when(i % 9 == 0, F.lit(None).cast("string")).otherwise(_pick(HOUSING_LEVELS, (i / 3).cast("bigint"))).alias("housing_status"),
        F.col("source"),
        F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise(_pick(DEVICE_OS_LEVELS, i)).alias("device_os"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _u_sql(seed: str, col: str = "d.doc_id") -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


APPS_SQL = f"""
(SELECT d.doc_id AS application_id, l.toxic AS fraud_bool,
  CASE WHEN d.doc_id % 11 = 0 THEN 'abc' WHEN d.doc_id % 13 = 0 THEN ' ' || CAST(d.n_chars AS VARCHAR) || ' '
       WHEN d.doc_id % 17 = 0 THEN '12d' WHEN d.doc_id % 19 = 0 THEN 'NaN' WHEN d.doc_id % 23 = 0 THEN NULL
       WHEN d.doc_id % 29 = 0 THEN '' ELSE CAST(d.n_chars AS VARCHAR) END AS income,
  {sround(_u_sql('nes'), 6)} AS name_email_similarity,
  CAST(d.doc_id % 120 AS INTEGER) AS prev_address_months_count,
  CAST(d.n_chars % 240 AS INTEGER) AS current_address_months_count,
  CAST(18 + d.doc_id % 60 AS INTEGER) AS customer_age,
  {sround(_u_sql('dsr') + ' * 30', 4)} AS days_since_request,
  {sround('(' + _u_sql('iba') + ' - 0.5) * 200', 2)} AS intended_balcon_amount,
  CAST(length(d.text) AS BIGINT) AS zip_count_4w,
  {sround(_u_sql('v6') + ' * 10000', 2)} AS velocity_6h,
  CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS BIGINT) AS velocity_24h,
  {sround(_u_sql('v4w') + ' * 6000', 2)} AS velocity_4w,
  CAST(coalesce(l.quality, 0) * 100 + d.doc_id % 100 AS INTEGER) AS credit_risk_score,
  CAST(d.doc_id % 2 AS INTEGER) AS email_is_free,
  CAST(CAST(trunc(d.doc_id / 2) AS BIGINT) % 2 AS INTEGER) AS phone_home_valid,
  {sround(_u_sql('pcl') + ' * 2000', 0)} AS proposed_credit_limit,
  {sround(_u_sql('slm') + ' * 60', 4)} AS session_length_in_minutes,
  CAST(d.doc_id % 5 AS INTEGER) AS device_distinct_emails_8w,
  CAST(d.doc_id % 8 AS INTEGER) AS month,
  d.lang AS payment_type,
  ['CA', 'CB', 'CC', 'CD', 'CE', 'CF', 'CG'][CAST(d.doc_id % 7 AS INTEGER) + 1] AS employment_status,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE ['BA', 'BB', 'BC', 'BD', 'BE', 'BF', 'BG'][CAST(CAST(trunc(d.doc_id / 3) AS BIGINT) % 7 AS INTEGER) + 1] END AS housing_status,
  d.source,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE ['linux', 'windows', 'macintosh', 'x11', 'other'][CAST(d.doc_id % 5 AS INTEGER) + 1] END AS device_os
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
