"""Queries: entity lists (G) and account / OTP state (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import bindings
from vigil.functions import hash_uniform
from vigil.operators import accounts as A
from vigil.operators import lists
from vigil.plans import detect
from vigil.session import materialize
from vigil.sources.tables import table

TX = f"WITH tx AS {detect.DETECTIONS_SQL}, "
ADDS = """adds AS (
   SELECT 'ip' AS list, ip_address AS key, account_number AS account, transaction_ts AS ts, txn_seq AS seq, CAST(NULL AS VARCHAR) AS reason FROM tx WHERE ato_confirmed
   UNION ALL SELECT 'device', device_id, account_number, transaction_ts, txn_seq, NULL FROM tx WHERE ato_confirmed
   UNION ALL SELECT 'beneficiary', beneficiary_account, account_number, transaction_ts, txn_seq, NULL FROM tx WHERE ato_confirmed),
 vadds AS (SELECT * FROM adds WHERE key IS NOT NULL AND trim(key) <> '')"""


def _fold_sql(rel):
    return f"""SELECT list, key, count(*) AS count, arg_max(account, (ts, seq)) AS account,
  arg_max(reason, (ts, seq)) FILTER (WHERE reason IS NOT NULL) AS reason, true AS fraud_confirmed,
  max(ts) AS last_updated FROM {rel} GROUP BY list, key"""


CUT = "1998-01-01"


def _adds(spark, sf):
    """Every confirmed fraud (F4) lists its ip, device and beneficiary."""
    return lists.fan_out_adds(detect.detections(spark, sf).where("ato_confirmed"))


def q_fan_out(spark, sf):
    return _adds(spark, sf).select("list", "key", "account", "ts", "seq")


SQL_FAN_OUT = TX + ADDS + " SELECT list, key, account, ts, seq FROM vadds"


def q_fold(spark, sf):
    return lists.fold_adds(_adds(spark, sf)).drop("first_listed")


SQL_FOLD = TX + ADDS + " " + _fold_sql("vadds")


def q_upsert(spark, sf):
    adds = _adds(spark, sf)
    stored = lists.fold_adds(adds.where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))).drop("first_listed")
    return lists.upsert(stored, adds.where(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz")))


SQL_UPSERT = TX + ADDS + f""",
 o AS ({_fold_sql(f"(SELECT * FROM vadds WHERE ts < TIMESTAMP '{CUT}')")}),
 n AS ({_fold_sql(f"(SELECT * FROM vadds WHERE ts >= TIMESTAMP '{CUT}')")})
SELECT coalesce(o.list, n.list) AS list, coalesce(o.key, n.key) AS key,
  CAST(coalesce(o.count, 0) + coalesce(n.count, 0) AS BIGINT) AS count,
  coalesce(n.account, o.account) AS account, coalesce(n.reason, o.reason) AS reason,
  coalesce(n.fraud_confirmed, o.fraud_confirmed) AS fraud_confirmed,
  greatest(n.last_updated, o.last_updated) AS last_updated
FROM o FULL OUTER JOIN n ON o.list = n.list AND o.key = n.key"""


def _manual_adds(spark, sf):
    """Analysts list the devices of every order by a customer whose
    balance is negative, with a reason."""
    tx = materialize(bindings.transactions(spark, sf), "transactions")
    cust = table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("account_number"))
    m = tx.join(cust, "account_number", "left_semi")
    return m.select(F.lit("device").alias("list"), F.col("device_id").alias("key"),
                    F.col("account_number").alias("account"), F.col("transaction_ts").alias("ts"),
                    F.col("txn_seq").alias("seq"), F.lit("manual review: negative balance").alias("reason"))


def q_manual_add(spark, sf):
    stored = lists.fold_adds(_adds(spark, sf)).drop("first_listed")
    return lists.upsert(stored, _manual_adds(spark, sf))


SQL_MANUAL_ADD = TX + ADDS + f""",
 m AS (SELECT 'device' AS list, device_id AS key, account_number AS account, transaction_ts AS ts, txn_seq AS seq,
              'manual review: negative balance' AS reason
       FROM tx WHERE account_number IN (SELECT 'ACC-' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)),
 o AS ({_fold_sql("vadds")}),
 n AS ({_fold_sql("m")})
SELECT coalesce(o.list, n.list) AS list, coalesce(o.key, n.key) AS key,
  CAST(coalesce(o.count, 0) + coalesce(n.count, 0) AS BIGINT) AS count,
  coalesce(n.account, o.account) AS account, coalesce(n.reason, o.reason) AS reason,
  coalesce(n.fraud_confirmed, o.fraud_confirmed) AS fraud_confirmed,
  greatest(n.last_updated, o.last_updated) AS last_updated
FROM o FULL OUTER JOIN n ON o.list = n.list AND o.key = n.key"""


def q_membership(spark, sf):
    tx = materialize(detect.detections(spark, sf), "detections")
    ls = lists.fold_adds(lists.fan_out_adds(tx.where("ato_confirmed")))
    t = tx.select("transaction_id", "ip_address", "device_id", "beneficiary_account")
    t = lists.is_listed(t, ls, "ip", "ip_address", "ip_listed")
    t = lists.is_listed(t, ls, "device", "device_id", "device_listed")
    t = lists.is_listed(t, ls, "beneficiary", "beneficiary_account", "beneficiary_listed")
    return t.select("transaction_id", "ip_listed", "device_listed", "beneficiary_listed")


SQL_MEMBERSHIP = TX + ADDS + """, k AS (SELECT DISTINCT list, key FROM vadds)
SELECT transaction_id,
  EXISTS (SELECT 1 FROM k WHERE k.list = 'ip' AND k.key = tx.ip_address) AS ip_listed,
  EXISTS (SELECT 1 FROM k WHERE k.list = 'device' AND k.key = tx.device_id) AS device_listed,
  EXISTS (SELECT 1 FROM k WHERE k.list = 'beneficiary' AND k.key = tx.beneficiary_account) AS beneficiary_listed
FROM tx"""


def _removals(spark, sf):
    """G4 input: analysts ask to remove the IPs of every customer with a
    negative balance (some are listed, some are not)."""
    c = table(spark, sf, "customer").where("c_acctbal < 0")
    c = c.select(F.lit("ip").alias("list"), F.concat(
        F.lit("10."), F.col("c_nationkey").cast("string"), F.lit("."),
        ((F.col("c_custkey") / 256).cast("bigint") % 256).cast("string"), F.lit("."),
        (F.col("c_custkey") % 256).cast("string")).alias("key"))
    return c


REM = """, rem AS (SELECT 'ip' AS list, '10.' || CAST(c_nationkey AS VARCHAR) || '.' || CAST(CAST(trunc(c_custkey / 256) AS BIGINT) % 256 AS VARCHAR)
        || '.' || CAST(c_custkey % 256 AS VARCHAR) AS key FROM customer WHERE c_acctbal < 0),
 st AS (""" + _fold_sql("vadds") + ")"


def q_remove_kept(spark, sf):
    stored = lists.fold_adds(_adds(spark, sf)).drop("first_listed")
    return lists.remove(stored, _removals(spark, sf))[0]


SQL_REMOVE_KEPT = TX + ADDS + REM + " SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM rem WHERE rem.list = st.list AND rem.key = st.key)"


def q_remove_not_found(spark, sf):
    stored = lists.fold_adds(_adds(spark, sf)).drop("first_listed")
    return lists.remove(stored, _removals(spark, sf))[1]


SQL_REMOVE_NOT_FOUND = TX + ADDS + REM + " SELECT list, key FROM rem WHERE NOT EXISTS (SELECT 1 FROM st WHERE rem.list = st.list AND rem.key = st.key)"


def q_counts(spark, sf):
    return lists.counts_per_list(lists.fold_adds(_adds(spark, sf)))


SQL_COUNTS = TX + ADDS + """, st AS (SELECT DISTINCT list, key FROM vadds)
SELECT n.list, CAST(count(st.key) AS BIGINT) AS entries FROM (VALUES ('ip'), ('device'), ('beneficiary')) n(list)
LEFT JOIN st ON st.list = n.list GROUP BY n.list"""


def q_list_flags(spark, sf):
    return detect.detections(spark, sf).select("transaction_id", "ip_blacklisted", "device_blacklisted",
                                               "beneficiary_blacklisted")


SQL_LIST_FLAGS = f"WITH d AS {detect.DETECTIONS_SQL} SELECT transaction_id, ip_blacklisted, device_blacklisted, beneficiary_blacklisted FROM d"


# --- H: OTP and suspensions ------------------------------------------------------

def _det(spark, sf):
    """The detection log as a written table (reliable checkpoint in the
    shared folder, written once): every OTP and suspension query reads it
    several times."""
    return materialize(detect.detections(spark, sf), "detections")


def _challenges(spark, sf, det=None):
    if det is None:  # only what challenges are made of is written
        flagged = detect.detections(spark, sf).where("otp_required")
        det = materialize(flagged.select("account_number", "transaction_id", "transaction_ts", "txn_seq", "otp_required"), "flagged")
    return materialize(A.challenges(det), "challenges")


def q_challenges(spark, sf):
    return _challenges(spark, sf)


D = f"WITH d AS {detect.DETECTIONS_SQL}, "
OTP_SQL = "lpad(CAST(CAST(('0x' || substr(md5('otp:' || transaction_id), 1, 8)) AS BIGINT) % 1000000 AS VARCHAR), 6, '0')"
CH = f"""ch AS (SELECT account_number, transaction_id, transaction_ts AS issued_ts, txn_seq AS cseq, {OTP_SQL} AS otp,
   lead(transaction_ts) OVER (PARTITION BY account_number ORDER BY transaction_ts, txn_seq) AS replaced_ts
   FROM d WHERE otp_required)"""
SQL_CHALLENGES = D + CH + " SELECT * FROM ch"


def attempts_from(chal):
    """Attempts derived from the challenges: an early try 1 h after issue
    (wrong code 30 % of the time), a retry 2 days later with the issued
    code for 60 %, and a malformed try for 10 %."""
    u = hash_uniform("try", F.col("transaction_id"))
    v = hash_uniform("shape", F.col("transaction_id"))
    first = chal.select(F.concat("transaction_id", F.lit("-a")).alias("attempt_id"), "account_number",
                        (F.col("issued_ts") + F.expr("INTERVAL 1 HOUR")).alias("attempt_ts"),
                        (F.col("cseq") * 3).alias("attempt_seq"),
                        F.when(u < 0.1, F.lit("abc123")).when(u < 0.3, F.lit("000000")).otherwise(F.col("otp")).alias("otp"))
    second = chal.where(hash_uniform("retry", F.col("transaction_id")) < 0.6).select(
                         F.concat("transaction_id", F.lit("-b")).alias("attempt_id"), "account_number",
                         (F.col("issued_ts") + F.expr("INTERVAL 2 DAYS")).alias("attempt_ts"),
                         (F.col("cseq") * 3 + 1).alias("attempt_seq"), "otp")
    bad = chal.where(v < 0.1).select(F.concat("transaction_id", F.lit("-c")).alias("attempt_id"), "account_number",
                                     (F.col("issued_ts") + F.expr("INTERVAL 30 MINUTES")).alias("attempt_ts"),
                                     (F.col("cseq") * 3 + 2).alias("attempt_seq"), F.lit("x1").alias("otp"))
    return first.unionByName(second).unionByName(bad)


def _u_sql(seed):
    return f"CAST(('0x' || substr(md5('{seed}:' || transaction_id), 1, 8)) AS BIGINT) / 4294967296.0"


AT = f""", atm AS (
  SELECT transaction_id || '-a' AS attempt_id, account_number, issued_ts + INTERVAL 1 HOUR AS attempt_ts, cseq * 3 AS attempt_seq,
         CASE WHEN {_u_sql('try')} < 0.1 THEN 'abc123' WHEN {_u_sql('try')} < 0.3 THEN '000000' ELSE otp END AS otp FROM ch
  UNION ALL SELECT transaction_id || '-b', account_number, issued_ts + INTERVAL 2 DAY, cseq * 3 + 1, otp FROM ch
            WHERE {_u_sql('retry')} < 0.6
  UNION ALL SELECT transaction_id || '-c', account_number, issued_ts + INTERVAL 30 MINUTE, cseq * 3 + 2, 'x1' FROM ch
            WHERE {_u_sql('shape')} < 0.1)"""


def q_attempts(spark, sf):
    a = attempts_from(_challenges(spark, sf))
    return a.select("attempt_id", "account_number", "otp", A.otp_shape_ok("otp").alias("shape_ok"))


SQL_ATTEMPTS = D + CH + AT + """ SELECT attempt_id, account_number, otp,
  coalesce(length(otp) BETWEEN 4 AND 8, false) AS shape_ok FROM atm"""


def verified(spark, sf):
    ch = _challenges(spark, sf)
    return A.verify(ch, attempts_from(ch))


VER = """, wf AS (SELECT * FROM atm WHERE length(otp) BETWEEN 4 AND 8),
 tl AS (SELECT account_number, issued_ts AS ts, cseq AS ord, otp, cseq AS c_id, NULL AS attempt_id FROM ch
        UNION ALL SELECT account_number, attempt_ts, 1099511627776 + attempt_seq, otp, NULL, attempt_id FROM wf),
 lv AS (SELECT *, last_value(c_id IGNORE NULLS) OVER (PARTITION BY account_number ORDER BY ts, ord
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live_c FROM tl),
 av AS (SELECT lv.attempt_id, lv.account_number, lv.ts AS attempt_ts, lv.ord, lv.live_c AS challenge_seq,
               coalesce(lv.otp = ch.otp, false) AS correct
        FROM lv LEFT JOIN ch ON ch.cseq = lv.live_c WHERE lv.attempt_id IS NOT NULL),
 ver AS (SELECT attempt_id, account_number, attempt_ts, challenge_seq,
   coalesce(correct AND row_number() OVER (PARTITION BY challenge_seq, correct ORDER BY attempt_ts, ord) = 1, false) AS otp_valid FROM av)"""
SQL_VERIFY = D + CH + AT + VER + " SELECT * FROM ver"


def q_outcome(spark, sf):
    return A.outcome(verified(spark, sf)).select("attempt_id", "otp_valid", "action", "message")


SQL_OUTCOME = D + CH + AT + VER + """ SELECT attempt_id, otp_valid,
  CASE WHEN otp_valid THEN 'ACCOUNT_UNLOCKED' ELSE 'ACCOUNT_BLOCKED' END AS action,
  CASE WHEN otp_valid THEN 'Identity verified. Account unlocked. Transaction can proceed.'
       ELSE 'OTP verification failed. Account fully blocked. KYC re-check required.' END AS message FROM ver"""


def q_suspended(spark, sf):
    det = _det(spark, sf)
    ch = _challenges(spark, sf, det)
    return A.suspended_now(det, A.verify(ch, attempts_from(ch)))


LAST_SUSPENSION = """ls AS (
  SELECT account_number, max(transaction_ts) AS mts,
         arg_max(transaction_id, (transaction_ts, txn_seq)) AS transaction_id,
         arg_max(ato_probability, (transaction_ts, txn_seq)) AS ato_probability,
         arg_max(behavioral_anomaly_score, (transaction_ts, txn_seq)) AS behavioral_anomaly_score
  FROM d WHERE action = 'SUSPEND' GROUP BY account_number),
 ul AS (SELECT account_number, max(attempt_ts) AS last_unlock FROM ver WHERE otp_valid GROUP BY account_number)"""
SUSPENDED_SELECT = f"""WITH {LAST_SUSPENSION}
SELECT ls.account_number, ls.mts AS suspension_time, ls.transaction_id, ls.ato_probability, ls.behavioral_anomaly_score,
  'SUSPENDED' AS status
FROM ls LEFT JOIN ul ON ls.account_number = ul.account_number
WHERE ul.last_unlock IS NULL OR ul.last_unlock < ls.mts"""
SQL_SUSPENDED = D + CH + AT + VER + f" SELECT * FROM ({SUSPENDED_SELECT}) sus"


REGISTRY = {
    "g1_list_fold": (q_fold, SQL_FOLD),
    "g1_list_upsert": (q_upsert, SQL_UPSERT),
    "g2_fan_out": (q_fan_out, SQL_FAN_OUT),
    "g3_membership": (q_membership, SQL_MEMBERSHIP),
    "g4_remove_kept": (q_remove_kept, SQL_REMOVE_KEPT),
    "g4_remove_not_found": (q_remove_not_found, SQL_REMOVE_NOT_FOUND),
    "g5_manual_add": (q_manual_add, SQL_MANUAL_ADD),
    "g6_counts_per_list": (q_counts, SQL_COUNTS),
    "g8_list_flags": (q_list_flags, SQL_LIST_FLAGS),
    "h2_otp_challenges": (q_challenges, SQL_CHALLENGES),
    "h5_otp_shape": (q_attempts, SQL_ATTEMPTS),
    "h3_otp_verify": (verified, SQL_VERIFY),
    "h4_otp_outcome": (q_outcome, SQL_OUTCOME),
    "h1_suspended_accounts": (q_suspended, SQL_SUSPENDED),
}
