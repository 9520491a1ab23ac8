"""Fixed values shared by the operators.

They define the product (funnel, screens, limits) and the answer format, so results only
agree with other tools when they are exactly these.  Operators take them as defaults.
"""

from __future__ import annotations

import datetime as dt

BASE_DATE = dt.date(2026, 6, 1)

# Ordered funnel: (logical event, screen).
FUNNEL = (
    ("app_open", "app"),
    ("home_view", "home"),
    ("product_browse", "browse"),
    ("product_detail_view", "product_detail"),
    ("add_to_cart", "product_detail"),
    ("cart_view", "cart"),
    ("checkout_start", "checkout"),
    ("payment_submit", "payment"),
    ("order_confirmed", "confirmation"),
)
STAGES = tuple(name for name, _ in FUNNEL)
STEPS = tuple(zip(STAGES, STAGES[1:]))

PAYMENT_METHODS = ("card", "upi", "wallet", "cod")

# 95th percentile latency limits in milliseconds.
SLO_LIMITS_MS = {"cold_start": 2000, "checkout_screen": 2000, "screen_load": 1500}

# Optional screens whose drop-off is by design.
DECOY_SCREENS = ("upsell", "tutorial")

USER_ATTRIBUTES = ("os", "device_type", "device_age_months", "geo", "channel", "is_returning")
TEXT_ATTRIBUTES = ("os", "device_type", "geo", "channel")
FORBIDDEN_COLUMNS = ("persona", "canonical", "_persona", "_acq_day")

# Substrings that make a cohort predicate unacceptable.
REFUSED_SUBSTRINGS = (
    ";", "--", "select", "insert", "update", "delete", "drop", "persona", "canonical",
)

MECHANISMS = (
    "dead_screen", "checkout_latency", "cold_start",
    "crash_concentration", "payment_failure", "innocent_dropoff",
)
INNOCENT = "innocent_dropoff"

# Fault -> the step whose conversion drop measures it (crashes are measured as a rate).
STEP_OF_FAULT = {
    "dead_screen": ("product_browse", "product_detail_view"),
    "checkout_latency": ("checkout_start", "payment_submit"),
    "cold_start": ("app_open", "home_view"),
    "payment_failure": ("payment_submit", "order_confirmed"),
}

# Fault -> default cohort.  The payment cohort holds for sessions, not for users.
DEFAULT_COHORTS = {
    "dead_screen": "os = 'Android 12'",
    "checkout_latency": "os = 'iOS 17'",
    "cold_start": "os IN ('Android 10', 'Android 11')",
    "crash_concentration": "os = 'Android 12' AND device_age_months > 24",
    "payment_failure": "payment_method = 'upi'",
}

F1_FLOOR = 0.5

# Case-folded LIKE patterns of the naive stage match ("_" is a wildcard, as LIKE has it).
NAIVE_PATTERNS = {
    "app_open": ("%open%", "%session_start%", "%launch%"),
    "home_view": ("%home%",),
    "product_detail_view": ("%pdp%", "%product_page%", "%item_detail%", "%product_detail%"),
    "add_to_cart": ("%cart_add%", "%add_to_cart%", "%atc%", "%add_item%"),
    "checkout_start": ("%checkout%", "%chkout%", "%begin_checkout%"),
    "payment_submit": ("%payment%", "%pay%"),
    "order_confirmed": ("%order%", "%purchase%", "%txn_success%"),
}

# Detector thresholds (all comparisons are strict).
CRASH_MIN_ROWS, CRASH_MIN_RATE, CRASH_MEDIAN_FACTOR = 200, 0.01, 2.5
LATENCY_MIN_ROWS, LATENCY_MIN_P95, LATENCY_MEDIAN_FACTOR = 50, 3000.0, 1.6
CONFIDENCE_CRASH, CONFIDENCE_LATENCY, CONFIDENCE_INNOCENT = 0.55, 0.5, 0.4
