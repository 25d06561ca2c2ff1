"""Shared building blocks of the registered queries.

A ``RetailContext`` wires the driver tables to the retail model and exposes
the cleaned Silver frames.  Frames are lazy DataFrames: nothing runs until a
query's result is consumed, and each query is a single plan that Catalyst
optimises end to end (pruning the raw columns a query does not use).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from basketry.functions.rules import RuleSet, tpch_rules
from basketry.operators import cleaning as CL
from basketry.operators.model import dedup_keep_first
from basketry.plans import feed
from basketry.sources.tables import read_table


@dataclass
class RetailContext:
    spark: SparkSession
    sf_dir: str
    rules: RuleSet = field(default_factory=tpch_rules)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---------------------------------------------------------- raw (Bronze)
    @cached_property
    def raw_orders(self) -> DataFrame:
        return feed.orders_from(self.table("orders"))

    @cached_property
    def raw_customers(self) -> DataFrame:
        return feed.customers_from(self.table("customer"))

    @cached_property
    def raw_items(self) -> DataFrame:
        return feed.items_from(self.table("lineitem"))

    @cached_property
    def raw_products(self) -> DataFrame:
        return feed.products_from(self.table("part"))

    @cached_property
    def order_events(self) -> DataFrame:
        return feed.order_events_from(self.table("events"))

    @cached_property
    def message_log(self) -> DataFrame:
        return feed.message_log_from(self.table("events"))

    # ---------------------------------------------------------- cleaned (Silver)
    @cached_property
    def orders_clean(self) -> DataFrame:
        """Orders de-duplicated by id (re-deliveries), then cleaned and enriched."""
        return CL.clean_orders(dedup_keep_first(self.raw_orders, ["order_id"]), self.rules.cleaning)

    @cached_property
    def as_of(self) -> Column:
        return CL.orders_as_of(self.raw_orders, self.rules.cleaning)

    @cached_property
    def customers_clean(self) -> DataFrame:
        return CL.clean_customers(self.raw_customers, self.as_of, self.rules.cleaning)

    @cached_property
    def items_clean(self) -> DataFrame:
        return CL.clean_items(self.raw_items, self.rules.cleaning)

    @cached_property
    def products_clean(self) -> DataFrame:
        return CL.clean_products(self.raw_products, self.rules.cleaning)


def context(spark: SparkSession, sf_dir: str) -> RetailContext:
    """The RetailContext of a data directory.

    Built anew for every query: a frame holds its file listing, so keeping one
    would miss files that were added to the directory since.
    """
    return RetailContext(spark, sf_dir)
