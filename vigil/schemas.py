"""Fixed values that must equal the reference's for right results.

FIXED VALUES (feature lists, thresholds, weights, texts) are stated here
once, plainly and in their natural order.
"""

# --- FIXED VALUES: tabular model features (26 numeric, then 5 categorical) ---
NUMERIC_FEATURES = [
    "income", "name_email_similarity", "prev_address_months_count",
    "current_address_months_count", "customer_age", "days_since_request",
    "intended_balcon_amount", "zip_count_4w", "velocity_6h", "velocity_24h", "velocity_4w",
    "bank_branch_count_8w", "date_of_birth_distinct_emails_4w", "credit_risk_score",
    "email_is_free", "phone_home_valid", "phone_mobile_valid", "bank_months_count",
    "has_other_cards", "proposed_credit_limit", "foreign_request",
    "session_length_in_minutes", "keep_alive_session", "device_distinct_emails_8w",
    "device_fraud_count", "month",
]
CATEGORICAL_FEATURES = ["payment_type", "employment_status", "housing_status", "source", "device_os"]
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
MODEL_FEATURES = ALL_FEATURES  # same 31 names, same order

# --- FIXED VALUES: behavioural model features (44, model order) ---
BEHAVIORAL_FEATURES = [
    "ip_address_asn", "is_known_vpn_or_proxy", "ip_distance_from_last_login_km",
    "speed_of_travel_kmh", "is_new_device_uid", "is_foreign_ip",
    "country_mismatch_with_profile", "distinct_ip_zip_count_1w_4w",
    "login_hour_of_day_local", "login_hour_anomaly_score",
    "mouse_movement_velocity", "touch_event_radius", "typing_speed_wpm",
    "keystroke_dwell_time", "failed_login_attempts_session", "password_pasted",
    "page_navigation_velocity", "session_length_in_minutes", "keep_alive_session",
    "device_distinct_emails_8w", "device_distinct_accounts_attempted_24h",
    "device_fraud_count", "customer_age", "account_age_months",
    "days_since_last_login", "days_since_password_reset", "email_is_free",
    "name_email_similarity", "phone_home_valid", "phone_mobile_valid",
    "failed_mfa_attempts_count", "mfa_type_changed", "profile_details_changed_flag",
    "time_to_profile_change_seconds", "velocity_6h", "velocity_24h", "velocity_4w",
    "failed_tx_count_1h", "tx_amount_vs_historical_avg_ratio", "new_payee_added",
    "time_from_payee_addition_to_payout_minutes",
    "sequential_failed_promocode_attempts", "saved_payment_methods_count", "month",
]

# --- FIXED VALUES: columns never used as model inputs ---
NON_MODEL_COLUMNS = [
    "fraud_bool", "is_ato", "actual_is_ato", "transaction_id", "account_number",
    "transaction_timestamp", "transaction_amount", "transaction_type", "ip_address",
    "ip_country", "device_id", "beneficiary_account", "channel", "streamed_at",
]

# --- FIXED VALUES: decision thresholds (strict >) ---
THRESH_HIGH_PROB = 0.80
THRESH_MED_PROB = 0.50
THRESH_HIGH_BEHAVIORAL = 0.30
THRESH_MED_BEHAVIORAL = 0.20
THRESH_CONFIRMED = 0.90
DEFAULT_BEHAVIORAL = 0.05

# --- FIXED VALUES: rule-score weights, in formula order, and its cap ---
RULE_WEIGHTS = [
    ("ip_fraud_score", 0.30),
    ("ip_blacklisted", 0.15),
    ("new_device", 0.10),
    ("new_location", 0.10),
    ("beneficiary_blacklisted", 0.15),
    ("failed_auth_attempts", 0.10),   # used as min(failed / 10, 1)
    ("behavioral_anomaly_score", 0.10),
]
RULE_CAP = 0.99

# --- FIXED VALUES: CSV-scoring bands (right-closed) and their actions ---
BAND_EDGES = [-0.001, 0.499, 0.799, 1.001]
BAND_LABELS = ["LOW", "MEDIUM", "HIGH"]
BAND_ACTIONS = {"HIGH": "SUSPEND", "MEDIUM": "OTP REQUIRED", "LOW": "ALLOW"}
MODEL_PICK_MIN_BEHAVIORAL = 10
MODEL_PICK_MIN_TABULAR = 8
ROW_PICK_MIN_BEHAVIORAL = 8

# --- FIXED VALUES: texts of the response record ---
HIGH_WARNING = "High behavioral anomaly: %.3f (threshold: 0.3)"
MED_WARNING = "Unusual behavioral pattern: %.3f"
SUSPEND_DESC = "Account suspended for security review (24-48 hrs)"
SUSPEND_DURATION = "24-48 hours"
OTP_DESC_HIGH = "OTP sent to registered mobile to verify identity"
CONTACT_DESC = "SMS: 'Suspicious activity detected on your account. Verify if this is you.'"
OTP_DESC_MED = "OTP verification required before transaction proceeds"
WARN_SMS_DESC = "SMS: 'Unusual activity detected. OTP required to continue.'"
DEFAULT_MOBILE = "REGISTERED_MOBILE"
NOT_CONFIRMED_REASON = "Not confirmed as fraud"
CONFIRMED_REASON = "ATO fraud confirmed"
UNLOCKED_MSG = "Identity verified. Account unlocked. Transaction can proceed."
BLOCKED_MSG = "OTP verification failed. Account fully blocked. KYC re-check required."
# capabilities while suspended, in the reference's key order
SUSPENDED_CAPABILITIES = [
    ("view_balance", True), ("view_history", True), ("call_bank", True),
    ("transfer_money", False), ("add_beneficiary", False), ("change_data", False),
]

# --- FIXED VALUES: entity lists and bounded logs ---
LIST_NAMES = ["ip", "device", "beneficiary"]
FRAUD_LOG_KEEP = 200
FRAUD_LOG_SHOW = 50
DETECTION_LOG_KEEP = 500
DETECTION_LOG_SHOW = 100
STREAM_BUFFER_KEEP = 10000

# --- FIXED VALUES: default boosted-tree settings (tabular, behavioural) ---
TABULAR_GBT = dict(trees=400, depth=7, rate=0.05, subsample=0.85, colsample=0.85,
                   min_child=3, gamma=0.1, l1=0.1, l2=1.5)
BEHAVIORAL_GBT = dict(trees=350, depth=6)
SEARCH_TRIALS = 30
SEARCH_FOLDS = 5

# --- FIXED VALUES: baseline signals (seven per session) ---
BASELINE_SIGNALS = [
    "typing_speed_mobile", "typing_rhythm_mobile", "phone_angle_pitch",
    "phone_angle_roll", "swipe_speed_mobile", "mouse_path_complexity", "session_duration",
]
BASELINE_MIN_SESSIONS = 3
