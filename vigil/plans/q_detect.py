"""Queries over the detection table: decisions (F), reports (I) and
evaluation of the rule scorer against labels (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import accounts, decide, evaluate, lists, reports
from vigil.plans import detect
from vigil.plans import q_accounts as QA
from vigil.plans.sqltext import sround
from vigil.session import materialize
from vigil.sources.tables import table

D = f"WITH d AS {detect.DETECTIONS_SQL} "
LOGC = ("transaction_id, account_number, ato_probability, behavioral_anomaly_score, action, "
        "otp_required, actual_is_ato, transaction_ts, txn_seq, ip_country")


def _det(spark, sf):
    return detect.detections(spark, sf)


# --- F: decisions -----------------------------------------------------------

def q_rule_score(spark, sf):
    return _det(spark, sf).select("transaction_id", "ato_probability", "behavioral_anomaly_score")


def q_actions(spark, sf):
    return _det(spark, sf).groupBy("action", "otp_required", "contact_mobile", "suspension_mode").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


SQL_ACTIONS = D + """SELECT action, otp_required, contact_mobile, suspension_mode, count(*) AS n
FROM d GROUP BY ALL"""


def q_bands(spark, sf):
    d = _det(spark, sf).select("transaction_id", "ato_probability")
    return decide.band_and_action(d)


SQL_BANDS = D + f"""SELECT transaction_id, {sround('ato_probability', 4)} AS ato_probability,
  CASE WHEN ato_probability > -0.001 AND ato_probability <= 0.499 THEN 'LOW'
       WHEN ato_probability > 0.499 AND ato_probability <= 0.799 THEN 'MEDIUM'
       WHEN ato_probability > 0.799 AND ato_probability <= 1.001 THEN 'HIGH' END AS risk_level,
  CASE WHEN ato_probability > -0.001 AND ato_probability <= 0.499 THEN 'ALLOW'
       WHEN ato_probability > 0.499 AND ato_probability <= 0.799 THEN 'OTP REQUIRED'
       WHEN ato_probability > 0.799 AND ato_probability <= 1.001 THEN 'SUSPEND' END AS recommended_action
FROM d"""


def q_response(spark, sf):
    r = decide.response_record(detect.detections(spark, sf, raw=True))
    return r.select(
        "transaction_id", "action", "suspension_mode", "otp_required", "contact_mobile",
        "behavioral_warning",
        F.col("user_capabilities")["transfer_money"].alias("can_transfer_money"),
        F.col("user_capabilities")["view_balance"].alias("can_view_balance"),
        F.size("user_actions").alias("n_user_actions"),
        F.get(F.col("user_actions"), 0)["action"].alias("first_user_action"),
        F.get(F.col("user_actions"), F.size("user_actions") - 1)["mobile"].alias("last_action_mobile"),
        F.col("blacklist_result.reason").alias("blacklist_reason"),
        F.col("blacklist_result.ip_blacklisted").alias("blacklist_ip"))


SQL_RESPONSE = D + f"""SELECT transaction_id, action, suspension_mode, otp_required, contact_mobile,
  CASE WHEN action = 'SUSPEND' THEN printf('High behavioral anomaly: %s (threshold: 0.3)', printf('%.3f', {sround('raw_b', 3)}))
       WHEN action = 'OTP_REQUIRED' THEN printf('Unusual behavioral pattern: %s', printf('%.3f', {sround('raw_b', 3)})) END AS behavioral_warning,
  CASE WHEN action = 'SUSPEND' THEN false END AS can_transfer_money,
  CASE WHEN action = 'SUSPEND' THEN true END AS can_view_balance,
  CASE action WHEN 'SUSPEND' THEN 3 WHEN 'OTP_REQUIRED' THEN 2 ELSE 0 END AS n_user_actions,
  CASE action WHEN 'SUSPEND' THEN 'SUSPEND_ACCOUNT' WHEN 'OTP_REQUIRED' THEN 'TRIGGER_OTP' END AS first_user_action,
  CASE WHEN action <> 'ALLOW' THEN 'REGISTERED_MOBILE' END AS last_action_mobile,
  CASE WHEN ato_confirmed THEN 'ATO fraud confirmed' ELSE 'Not confirmed as fraud' END AS blacklist_reason,
  ato_confirmed AS blacklist_ip
FROM d"""


def q_confirmed(spark, sf):
    return _det(spark, sf).where("ato_confirmed").select("transaction_id", "account_number", "ato_probability")


SQL_CONFIRMED = D + "SELECT transaction_id, account_number, ato_probability FROM d WHERE ato_confirmed"


def q_behavior_level(spark, sf):
    d = _det(spark, sf)
    return decide.risk_level(d, "behavioral_anomaly_score", "behavior_level").groupBy("behavior_level").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


SQL_BEHAVIOR_LEVEL = D + """SELECT CASE WHEN behavioral_anomaly_score > 0.3 THEN 'HIGH'
  WHEN behavioral_anomaly_score > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS behavior_level, count(*) AS n
FROM d GROUP BY 1"""


# --- I: reports ---------------------------------------------------------------

def q_fraud_log(spark, sf):
    return reports.fraud_log(_det(spark, sf))


SQL_FRAUD_LOG = D + f"SELECT {LOGC} FROM d WHERE otp_required ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 50"


def q_recent(spark, sf):
    return reports.recent_detections(_det(spark, sf))


SQL_RECENT = D + f"SELECT {LOGC} FROM d ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 100"


def q_action_counts(spark, sf):
    return reports.action_counts(reports.recent_detections(_det(spark, sf)))


SQL_ACTION_COUNTS = D + """SELECT action, count(*) AS n FROM
 (SELECT * FROM d ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 100) r GROUP BY action"""


def q_ops(spark, sf):
    d = _det(spark, sf)
    return reports.ops_indicators(reports.recent_detections(d), reports.fraud_log(d))


SQL_OPS = D + """, r AS (SELECT * FROM d ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 100),
 f AS (SELECT * FROM d WHERE otp_required ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 50)
SELECT count(*) AS decisions, count_if(action IN ('SUSPEND', 'BLOCK')) AS blocked,
  count_if(action = 'OTP_REQUIRED') AS otp_triggered, (SELECT count(*) FROM f) AS flagged_txns,
  count_if(action IN ('SUSPEND', 'BLOCK')) + count_if(action = 'OTP_REQUIRED') AS flagged_for_review
FROM r"""


def q_country(spark, sf):
    return reports.flagged_per_country(_det(spark, sf).where("otp_required"))


SQL_COUNTRY = D + "SELECT ip_country AS country, count(*) AS count FROM d WHERE otp_required GROUP BY 1"


def q_country_recent(spark, sf):
    return reports.flagged_per_country(reports.fraud_log(_det(spark, sf)))


SQL_COUNTRY_RECENT = D + """SELECT ip_country AS country, count(*) AS count FROM
 (SELECT * FROM d WHERE otp_required ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 50) f GROUP BY 1"""


def q_risk_summary(spark, sf):
    return reports.risk_summary(_det(spark, sf))


SQL_RISK_SUMMARY = D + f"""SELECT count(*) AS events, {sround('avg(ato_probability)', 3)} AS avg_risk,
  count_if(ato_probability > 0.8) AS high_risk FROM d"""


def q_histogram(spark, sf):
    return reports.risk_histogram(_det(spark, sf), bins=30)


SQL_HISTOGRAM = D + f"""SELECT action, CAST(least(floor(ato_probability * 30), 29) AS INTEGER) AS bin, count(*) AS n,
  {sround('CAST(least(floor(ato_probability * 30), 29) AS INTEGER) / 30.0', 6)} AS bin_lo,
  {sround('(CAST(least(floor(ato_probability * 30), 29) AS INTEGER) + 1) / 30.0', 6)} AS bin_hi
FROM d WHERE ato_probability IS NOT NULL GROUP BY ALL"""


def q_histogram_bands(spark, sf):
    s = decide.band_and_action(_det(spark, sf).select("transaction_id", "ato_probability"))
    return reports.risk_histogram(s, by="recommended_action", bins=40)


SQL_HISTOGRAM_BANDS = f"WITH s AS ({SQL_BANDS}) " + f"""SELECT recommended_action,
  CAST(least(floor(ato_probability * 40), 39) AS INTEGER) AS bin, count(*) AS n,
  {sround('CAST(least(floor(ato_probability * 40), 39) AS INTEGER) / 40.0', 6)} AS bin_lo,
  {sround('(CAST(least(floor(ato_probability * 40), 39) AS INTEGER) + 1) / 40.0', 6)} AS bin_hi
FROM s WHERE ato_probability IS NOT NULL GROUP BY ALL"""


def q_parse_sort(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 7 == 0, F.lit("not a time")) \
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    d = e.select("event_id", txt.alias("timestamp_text"))
    out = reports.parse_and_sort(d, "timestamp_text")
    return out.withColumn("parsed_ts", F.col("parsed_ts").cast("timestamp_ntz"))


SQL_PARSE_SORT = """SELECT event_id, timestamp_text, TRY_CAST(timestamp_text AS TIMESTAMP) AS parsed_ts FROM
 (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp_text
  FROM events) ORDER BY parsed_ts DESC NULLS LAST"""


def q_level_counts(spark, sf):
    s = decide.band_and_action(_det(spark, sf).select("transaction_id", "ato_probability"))
    return reports.level_counts(s)


SQL_LEVEL_COUNTS = f"WITH s AS ({SQL_BANDS}) " + f"""SELECT count(*) AS scored,
  count_if(risk_level = 'HIGH') AS high, count_if(risk_level = 'MEDIUM') AS medium,
  count_if(risk_level = 'LOW') AS low, {sround('avg(ato_probability)', 4)} AS avg_probability FROM s"""


def q_lookup(spark, sf):
    """I11 for every flagged account: its first flagged transaction
    (earliest by time then id) — the lookup applied to the whole log."""
    d = _det(spark, sf).where("otp_required")
    firsts = d.groupBy("account_number").agg(F.min(F.struct("transaction_ts", "txn_seq", "transaction_id")).alias("m"))
    return firsts.select("account_number", F.col("m.transaction_id").alias("transaction_id"),
                         F.col("m.transaction_ts").alias("transaction_ts"))


def q_lookup_account(spark, sf):
    """The first flagged transaction of one account, the one with the most flagged."""
    flagged = materialize(_det(spark, sf).where("otp_required"), "flagged")
    most = flagged.groupBy("account_number").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "account_number").first()
    found = reports.lookup_first(flagged, "account_number", most["account_number"] if most else None, ["transaction_ts", "txn_seq"])
    return found.select("account_number", "transaction_id", "transaction_ts", "action")


SQL_LOOKUP_ACCOUNT = D + """SELECT account_number, transaction_id, transaction_ts, action FROM d
WHERE otp_required AND account_number = (SELECT account_number FROM d WHERE otp_required GROUP BY 1 ORDER BY count(*) DESC, account_number LIMIT 1)
ORDER BY transaction_ts, txn_seq LIMIT 1"""


SQL_LOOKUP = D + """SELECT account_number, arg_min(transaction_id, (transaction_ts, txn_seq)) AS transaction_id,
  min(transaction_ts) AS transaction_ts FROM d WHERE otp_required GROUP BY account_number"""


def q_review_rows(spark, sf):
    """I12 for every transaction of the log, all of its columns that the review shows."""
    return reports.review_rows(_det(spark, sf).select(
        "transaction_id", "account_number", "ip_address", "device_id", "ip_country",
        "ato_probability", "action", "transaction_amount", "failed_auth_attempts"))


SQL_REVIEW_ROWS = D + """, s AS (SELECT * FROM d)
SELECT transaction_id, "group", field, value FROM (
  SELECT transaction_id, 'core' AS "group", 'account_number' AS field, account_number AS value FROM s
  UNION ALL SELECT transaction_id, 'core', 'ip_address', ip_address FROM s
  UNION ALL SELECT transaction_id, 'core', 'device_id', device_id FROM s
  UNION ALL SELECT transaction_id, 'core', 'ip_country', ip_country FROM s
  UNION ALL SELECT transaction_id, 'core', 'ato_probability', CAST(ato_probability AS VARCHAR) FROM s
  UNION ALL SELECT transaction_id, 'core', 'action', action FROM s
  UNION ALL SELECT transaction_id, 'velocity', 'transaction_amount', CAST(transaction_amount AS VARCHAR) FROM s
  UNION ALL SELECT transaction_id, 'raw', 'failed_auth_attempts', CAST(failed_auth_attempts AS VARCHAR) FROM s
  UNION ALL SELECT transaction_id, 'core', 'transaction_id', transaction_id FROM s)"""


def q_action_vs_actual(spark, sf):
    return reports.action_vs_actual(_det(spark, sf))


SQL_ACTION_VS_ACTUAL = D + "SELECT action, actual_is_ato, count(*) AS n FROM d GROUP BY ALL"


def q_summary(spark, sf):
    d = materialize(detect.detections(spark, sf, raw=True), "detections")
    lab = d.where(F.col("actual_is_ato").isNotNull()).select(
        F.col("actual_is_ato").alias("label"), F.col("raw_p").alias("score"), (F.col("raw_p") > 0.5).cast("int").alias("prediction"))
    m = evaluate.rates(evaluate.confusion(lab)).crossJoin(evaluate.auc(lab))
    flagged = reports.fraud_log(d).agg(F.count(F.lit(1)).cast("bigint").alias("fraud_transactions_count"))
    challenges = materialize(accounts.challenges(d), "challenges")
    standing = accounts.suspended_now(d, accounts.verify(challenges, QA.attempts_from(challenges)))  # unlocked accounts are out (H1)
    susp = standing.agg(F.count(F.lit(1)).cast("bigint").alias("suspended_accounts_count"))
    recent = reports.recent_detections(d).agg(F.count(F.lit(1)).cast("bigint").alias("recent_detections_count"))
    sizes = lists.counts_per_list(lists.fold_adds(lists.fan_out_adds(d.where("ato_confirmed"))))  # as G6
    return reports.service_summary(m, flagged, susp, recent, sizes)


def _summary_sql():
    return f"WITH d AS {detect.DETECTIONS_SQL}, tx AS (SELECT * FROM d), {QA.ADDS}, {QA.CH}{QA.AT}{QA.VER}" + L[len(D):] + f""",
 sus AS ({QA.SUSPENDED_SELECT}),
 rt AS ({_rates_sql(_cm_sql('lab'))}), au AS ({auc_sql('lab')}),
 ls AS (SELECT list, count(DISTINCT key) AS n FROM vadds GROUP BY list)
SELECT 'ATO Detection System' AS service, 'Online' AS status,
  printf('%.1f%%', {sround('rt.accuracy * 100', 1)}) AS model_accuracy,
  printf('%.4f', {sround('au.auc_roc', 4)}) AS model_auc,
  printf('%.4f', {sround('rt.f1_score', 4)}) AS model_f1,
  printf('%.2f%%', {sround('rt.false_positive_rate * 100', 2)}) AS false_positive_rate,
  (SELECT count(*) FROM (SELECT 1 FROM d WHERE otp_required ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 50)) AS fraud_transactions_count,
  (SELECT count(*) FROM sus) AS suspended_accounts_count,
  (SELECT count(*) FROM (SELECT 1 FROM d ORDER BY transaction_ts DESC, txn_seq DESC LIMIT 100)) AS recent_detections_count,
  CAST(coalesce((SELECT n FROM ls WHERE list = 'ip'), 0) AS BIGINT) AS blacklisted_ips,
  CAST(coalesce((SELECT n FROM ls WHERE list = 'device'), 0) AS BIGINT) AS blacklisted_devices,
  CAST(coalesce((SELECT n FROM ls WHERE list = 'beneficiary'), 0) AS BIGINT) AS blacklisted_beneficiaries
FROM rt, au"""


# --- J: evaluation of the rule scorer against the labels ------------------------

def _labelled(spark, sf):
    return detect.detections(spark, sf, raw=True).where(F.col("actual_is_ato").isNotNull()).select(
        "transaction_id", F.col("actual_is_ato").alias("label"),
        F.col("raw_p").alias("score"), (F.col("raw_p") > 0.5).cast("int").alias("prediction"))


L = D + """, lab AS (SELECT transaction_id, actual_is_ato AS label, raw_p AS score,
  CAST(raw_p > 0.5 AS INTEGER) AS prediction FROM d WHERE actual_is_ato IS NOT NULL) """


def q_confusion(spark, sf):
    return evaluate.confusion(_labelled(spark, sf))


SQL_CONFUSION = L + """SELECT count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
  count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp FROM lab"""


def q_rates(spark, sf):
    return evaluate.rates(evaluate.confusion(_labelled(spark, sf)))


def _rates_sql(src):
    return f"""SELECT tn, fp, fn, tp,
  {sround('CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END', 6)} AS accuracy,
  {sround('prec', 6)} AS precision, {sround('rec', 6)} AS recall,
  {sround('CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END', 6)} AS f1_score,
  {sround('fp / greatest(fp + tn, 1.0)', 6)} AS false_positive_rate,
  {sround('tp / greatest(tp + fn, 1.0)', 6)} AS true_positive_rate
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec, tn + fp + fn + tp AS n
      FROM (SELECT CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
                   CAST(tp AS DOUBLE) AS tp FROM ({src}) c0) c1) c2"""


def _cm_sql(rel):
    return f"""SELECT count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
  count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp FROM {rel}"""


SQL_RATES = L + _rates_sql(_cm_sql("lab")).replace("SELECT tn, fp, fn, tp,", "SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,", 1)


def q_auc(spark, sf):
    return evaluate.auc(_labelled(spark, sf))


def auc_sql(rel):
    return f"""SELECT CASE WHEN P > 0 AND N > 0 THEN {sround('num / (P * N)', 6)} END AS auc_roc FROM (
  SELECT sum(pos * (neg_before + neg / 2.0)) AS num, CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM (
    SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
    FROM (SELECT CAST(score AS DOUBLE) AS s, count_if(label = 1) AS pos, count_if(label <> 1) AS neg
          FROM {rel} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY 1) g) w) t"""


SQL_AUC = L + auc_sql("lab")


def q_class_report(spark, sf):
    return evaluate.class_report(_labelled(spark, sf))


def class_report_sql(rel):
    return f"""SELECT class_label, {sround('p', 6)} AS precision, {sround('r', 6)} AS recall,
  {sround('f', 6)} AS f1_score, CAST(support AS BIGINT) AS support FROM (
  WITH c AS (SELECT CAST(count_if(label = 0 AND prediction = 0) AS DOUBLE) AS c00, CAST(count_if(label = 0 AND prediction = 1) AS DOUBLE) AS c01,
                    CAST(count_if(label = 1 AND prediction = 0) AS DOUBLE) AS c10, CAST(count_if(label = 1 AND prediction = 1) AS DOUBLE) AS c11
             FROM {rel} WHERE label IS NOT NULL),
  k AS (SELECT '0' AS class_label, CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS p,
               CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS r, c00 + c01 AS support, c00+c01+c10+c11 AS total FROM c
        UNION ALL
        SELECT '1', CASE WHEN c01 + c11 > 0 THEN c11 / (c01 + c11) ELSE 0.0 END,
               CASE WHEN c10 + c11 > 0 THEN c11 / (c10 + c11) ELSE 0.0 END, c10 + c11, c00+c01+c10+c11 FROM c),
  kf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM k)
  SELECT class_label, p, r, f, support FROM kf
  UNION ALL SELECT 'accuracy', a, a, a, t FROM (SELECT CASE WHEN c00+c01+c10+c11 > 0 THEN (c00 + c11) / (c00+c01+c10+c11) ELSE 0.0 END AS a, c00+c01+c10+c11 AS t FROM c) x
  UNION ALL SELECT 'macro avg', (max(p) FILTER (class_label = '0') + max(p) FILTER (class_label = '1')) / 2,
     (max(r) FILTER (class_label = '0') + max(r) FILTER (class_label = '1')) / 2,
     (max(f) FILTER (class_label = '0') + max(f) FILTER (class_label = '1')) / 2, max(total) FROM kf
  UNION ALL SELECT 'weighted avg',
     CASE WHEN max(total) > 0 THEN (max(p * support) FILTER (class_label = '0') + max(p * support) FILTER (class_label = '1')) / max(total) ELSE 0.0 END,
     CASE WHEN max(total) > 0 THEN (max(r * support) FILTER (class_label = '0') + max(r * support) FILTER (class_label = '1')) / max(total) ELSE 0.0 END,
     CASE WHEN max(total) > 0 THEN (max(f * support) FILTER (class_label = '0') + max(f * support) FILTER (class_label = '1')) / max(total) ELSE 0.0 END,
     max(total) FROM kf) z"""


SQL_CLASS_REPORT = L + class_report_sql("lab")


def q_log_loss(spark, sf):
    lab = _labelled(spark, sf)
    return evaluate.log_loss(lab, prob="score")


def log_loss_sql(rel, prob="score"):
    return f"""SELECT {sround(f'avg(-(CAST(label AS DOUBLE) * ln(least(greatest(CAST({prob} AS DOUBLE), 1e-15), 1 - 1e-15)) + (1 - CAST(label AS DOUBLE)) * ln(1 - least(greatest(CAST({prob} AS DOUBLE), 1e-15), 1 - 1e-15))))', 6)} AS log_loss,
  count(*) AS n FROM {rel} WHERE label IS NOT NULL AND {prob} IS NOT NULL"""


SQL_LOG_LOSS = L + log_loss_sql("lab")


REGISTRY = {
    "detect_transactions": (detect.detections, f"SELECT * EXCLUDE (raw_p, raw_b) FROM {detect.DETECTIONS_SQL} d"),
    "e8_rule_score": (q_rule_score, D + "SELECT transaction_id, ato_probability, behavioral_anomaly_score FROM d"),
    "f1_actions": (q_actions, SQL_ACTIONS),
    "f2_bands": (q_bands, SQL_BANDS),
    "f3_response_record": (q_response, SQL_RESPONSE),
    "f4_confirmed": (q_confirmed, SQL_CONFIRMED),
    "f6_behavior_level": (q_behavior_level, SQL_BEHAVIOR_LEVEL),
    "i1_fraud_log": (q_fraud_log, SQL_FRAUD_LOG),
    "i2_recent_detections": (q_recent, SQL_RECENT),
    "i3_action_counts": (q_action_counts, SQL_ACTION_COUNTS),
    "i4_ops_indicators": (q_ops, SQL_OPS),
    "i5_flagged_per_country": (q_country, SQL_COUNTRY),
    "i5_flagged_per_country_recent": (q_country_recent, SQL_COUNTRY_RECENT),
    "i6_risk_summary": (q_risk_summary, SQL_RISK_SUMMARY),
    "i7_histogram_actions": (q_histogram, SQL_HISTOGRAM),
    "i7_histogram_bands": (q_histogram_bands, SQL_HISTOGRAM_BANDS),
    "i9_parse_sort": (q_parse_sort, SQL_PARSE_SORT),
    "i10_level_counts": (q_level_counts, SQL_LEVEL_COUNTS),
    "i11_first_flagged": (q_lookup, SQL_LOOKUP),
    "i11_lookup_account": (q_lookup_account, SQL_LOOKUP_ACCOUNT),
    "i12_review_rows": (q_review_rows, SQL_REVIEW_ROWS),
    "i13_action_vs_actual": (q_action_vs_actual, SQL_ACTION_VS_ACTUAL),
    "j1_confusion": (q_confusion, SQL_CONFUSION),
    "j2_rates": (q_rates, SQL_RATES),
    "j4_auc": (q_auc, SQL_AUC),
    "j5_class_report": (q_class_report, SQL_CLASS_REPORT),
    "j6_log_loss": (q_log_loss, SQL_LOG_LOSS),
}

REGISTRY["i8_service_summary"] = (q_summary, _summary_sql())
