"""basketry: Spark-native retail analytics.

Cleaning rules (``functions``), table operators (``operators``), sources and
sinks, Structured Streaming (``streaming``) and the registered queries with
their SQL oracles (``plans``).  Everything runs as DataFrame plans; see the
README for the design and the scale notes.
"""

__version__ = "0.1.0"
