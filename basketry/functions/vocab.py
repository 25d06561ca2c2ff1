"""Fixed values of the retail rules.

These lists and patterns decide results, so they are kept verbatim, in the
order the business rules state them.  Everything else in the library is
derived from them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the rule book; do not reorder)
# ---------------------------------------------------------------------------

# Name sentinels that mean "no name".
NAME_SENTINELS = ["UNKNOWN", "N/A", "TBD", "TEST USER"]
# Honorifics stripped from the start of a name.
NAME_TITLE_PATTERN = r"^(Mr\.|Ms\.|Mrs\.|Dr\.)\s*"

# Email validity pattern and sentinels.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_SENTINELS = ["N/A", "TBD", "UNKNOWN", "NOTANEMAIL"]

# Accepted date layouts, tried in this order (ISO, US, European, compact, long).
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd", "MMMM dd, yyyy"]

# Order status synonym groups, tested in this order; blank/null -> "unknown".
STATUS_GROUPS = [
    ("completed", ["COMPLETED", "COMPLETE"]),
    ("cancelled", ["CANCELLED", "CANCELED"]),
    ("pending", ["PENDING", "PROCESSING"]),
    ("shipped", ["SHIPPED", "DELIVERED"]),
    ("refunded", ["REFUNDED", "RETURNED"]),
    ("failed", ["FAILED", "ERROR"]),
    ("unknown", ["UNKNWON"]),
]

# Customer segment groups; blank/null/sentinel -> "Unknown".
SEGMENT_SENTINELS = ["UNKNOWN", "N/A", "TBD"]
SEGMENT_GROUPS = [
    ("Premium", ["PREMIUM", "VIP", "GOLD"]),
    ("Regular", ["REGULAR", "STANDARD", "BASIC", "SILVER"]),
    ("Bronze", ["BRONZE", "NEW"]),
]

# Boolean spellings.
TRUE_TOKENS = ["TRUE", "T", "YES", "Y", "1", "ACTIVE"]
FALSE_TOKENS = ["FALSE", "F", "NO", "N", "0", "INACTIVE"]

# Phone sentinels and the known fake number.
PHONE_SENTINELS = ["N/A", "UNKNOWN", "TBD"]
PHONE_FAKE_PATTERN = r"^123-456-7890$"

# Product name / category sentinels and replacements.
PRODUCT_SENTINELS = ["UNKNOWN", "N/A", "TBD"]
UNKNOWN_PRODUCT = "Unknown Product"
OTHER_CATEGORY = "Other"
# Category by substring of the upper-cased value, first match wins.
CATEGORY_RULES = [
    ("ELECTRONIC", "Electronics"),
    ("HOME", "Home & Kitchen"),
    ("KITCHEN", "Home & Kitchen"),
    ("SPORT", "Sports & Outdoors"),
    ("BOOK", "Books"),
]

# Fraud-alert reason labels (message-log alerts).
REASON_HIGH_AMOUNT = "High transaction amount"
REASON_SUSPICIOUS_STATUS = "Suspicious order status"
REASON_FALLBACK = "Suspicious pattern"

# Batch fraud type labels, tested in this order.
FRAUD_TYPE_VELOCITY_VALUE = "Velocity + High Value"
FRAUD_TYPE_VELOCITY = "Velocity Fraud"
FRAUD_TYPE_HIGH_VALUE = "High Value Fraud"
FRAUD_TYPE_BULK = "Bulk Purchase Fraud"
FRAUD_TYPE_QUANTITY = "Suspicious Quantity"
FRAUD_TYPE_MIXED = "Mixed Pattern"
# Alert risk labels.
RISK_HIGH = "HIGH"
RISK_MEDIUM = "MEDIUM"
