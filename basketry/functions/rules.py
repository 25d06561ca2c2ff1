"""Business-rule parameters.

Defaults are the rule book's values.  Monetary thresholds are expressed in
the data's currency unit; ``scaled(f)`` multiplies every monetary threshold
(the driver's TPC-H-like amounts are about 100x the rule book's orders).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# FIXED VALUES: the dataclass defaults below are the rule book's thresholds,
# points and labels, kept verbatim and in the order the rules test them.


@dataclass(frozen=True)
class CleaningRules:
    """Validity ranges of the composite cleaners (inclusive bounds)."""
    order_amount: tuple = (0, 50000)
    item_quantity: tuple = (1, 100)
    item_price: tuple = (0, 10000)
    item_discount: tuple = (0, 100)
    product_price: tuple = (0, 100000)
    product_weight: tuple = (0, 1000)
    age: tuple = (18, 120)

    def scaled(self, f: float) -> "CleaningRules":
        return replace(self, order_amount=(self.order_amount[0], self.order_amount[1] * f),
                       item_price=(self.item_price[0], self.item_price[1] * f),
                       product_price=(self.product_price[0], self.product_price[1] * f))


@dataclass(frozen=True)
class RfmRules:
    """L1: value segment = high if monetary >= high_monetary and recency <= high_recency_days, ..."""
    high_monetary: float = 500
    high_recency_days: int = 60
    medium_monetary: float = 250
    medium_recency_days: int = 90

    def scaled(self, f: float) -> "RfmRules":
        return replace(self, high_monetary=self.high_monetary * f, medium_monetary=self.medium_monetary * f)


@dataclass(frozen=True)
class FraudRules:
    """L3: batch fraud scoring ladders; each ladder is ((threshold, points), ...) tested in order."""
    amount: tuple = ((5000, 4), (3000, 3), (2000, 2), (1000, 1))          # amount > t
    velocity_days: tuple = ((1, 4), (3, 2), (7, 1))                        # days since last < t
    total_quantity: tuple = ((30, 3), (20, 2), (15, 1))                    # sum qty > t
    max_item_quantity: tuple = ((25, 3), (15, 2), (10, 1))                 # max qty > t
    risk_levels: tuple = ((8, "Critical"), (6, "High"), (4, "Medium"))     # score >= t
    low_label: str = "Low"
    flag_at: int = 3

    def scaled(self, f: float) -> "FraudRules":
        return replace(self, amount=tuple((round(t * f, 6), p) for t, p in self.amount))


@dataclass(frozen=True)
class StreamFraudRules:
    """Per-order stream scoring: amount ladder + suspicious status."""
    amount: tuple = ((5000, 4), (3000, 3), (2000, 2))
    # alert ladder with reason labels (amount > t -> points, reason)
    alert_amount: tuple = ((5000, 4, "High transaction amount"), (2000, 2, "Elevated transaction amount"))
    status_points: int = 1
    suspicious_statuses: tuple = ("cancelled", "refunded")
    flag_at: int = 3
    high_risk_at: int = 5            # alert risk HIGH / requires review
    alt_high_at: int = 4             # alternative alert score: HIGH at >= 4
    alt_unit: float = 1000           # alternative score: amount / unit, clamped 3..5

    def scaled(self, f: float) -> "StreamFraudRules":
        return replace(self, amount=tuple((round(t * f, 6), p) for t, p in self.amount),
                       alert_amount=tuple((round(t * f, 6), p, r) for t, p, r in self.alert_amount),
                       alt_unit=round(self.alt_unit * f, 6))


# Rules for the driver's TPC-H-like data (order totals ~1k-500k, event values 0-500).
TPCH_MONEY_SCALE = 100
EVENT_MONEY_SCALE = 0.04


@dataclass(frozen=True)
class RuleSet:
    cleaning: CleaningRules = field(default_factory=CleaningRules)
    rfm: RfmRules = field(default_factory=RfmRules)
    fraud: FraudRules = field(default_factory=FraudRules)
    stream_fraud: StreamFraudRules = field(default_factory=StreamFraudRules)


def tpch_rules() -> RuleSet:
    return RuleSet(cleaning=CleaningRules().scaled(TPCH_MONEY_SCALE),
                   rfm=RfmRules().scaled(TPCH_MONEY_SCALE),
                   fraud=replace(FraudRules().scaled(TPCH_MONEY_SCALE), total_quantity=((180, 3), (140, 2), (110, 1)),
                                 max_item_quantity=((48, 3), (45, 2), (40, 1))),      # lines have up to 50 pieces
                   stream_fraud=StreamFraudRules().scaled(EVENT_MONEY_SCALE))
