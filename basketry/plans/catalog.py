"""Imports every query module so that each registers its queries."""

from basketry.plans import q_batch, q_clean, q_flows, q_fraud, q_io, q_live, q_merge, q_quality, q_stateful, q_stream  # noqa: F401
