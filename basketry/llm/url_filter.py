"""URL filters as a sort-merge range join.

A host becomes its labels in reverse order, each closed by a dot, and a URL's
key is its reversed host, a dot-closed string, followed by its path.  The URLs
of a rule's host and all its subdomains are then the keys with one prefix: one
interval of the key order, and intervals of different hosts are nested or
apart.  URLs and rules are dealt out by the same boundaries; a rule goes to
every range that its interval touches (all ranges inside a nested chain of
hosts need the chain, no more).  Each range is sorted once and swept with a stack of
the hosts whose interval is open; a URL asks the open hosts' path rules for the
prefixes of its path.

Boundaries are order statistics of a bounded sample (the rows of smallest
hash) and only balance the work.  A URL's hash is part of its place, so a
host, or one URL, that a third of all rows share is cut into several ranges.

A URL's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or
the end, A-Z lower-cased; its path goes on from there to ``?``, ``#`` or the
end; both are empty for a null or a URL without ``://``.  The longest fitting
rule (host and path together, then the host, then the text) decides, else
``default``.  Defined results: a null rule host or path is an empty one; a
rule with an empty host fits every host, of the same rule given twice with
different verdicts ``block`` wins; repeated rows are judged one by one.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import LOWER, UPPER, shuffle_partitions, written

RANGES, PER_RANGE = 4, 16       # ranges per partition, sampled rows per range


def url_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path and key."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path}).withColumn("key", F.concat(_reversed(F.col("host")), "path"))


def _reversed(host):
    """a.b.c as c.b.a. and an empty host as nothing."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """The open hosts of one range, outermost first, each with its path rules."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]]]] = []

    def open(self, prefix: str, host: str, path: str, verdict: str) -> None:
        self.close(prefix)
        if not self.stack or self.stack[-1][0] != prefix:
            self.stack.append((prefix, {}))
        rules = self.stack[-1][1]
        if rules.get(path, ("", ""))[1] != "block":
            rules[path] = (host + path, verdict)

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        best, rule, verdict = (-1, -1, ""), None, None
        for prefix, rules in self.stack:
            if len(rules) <= len(path) + 1:
                fits = [q for q in rules if path.startswith(q)]
            else:
                fits = [path[:n] for n in range(len(path) + 1) if path[:n] in rules]
            for q in fits:
                text, v = rules[q]
                if (rank := (len(text), len(prefix), text)) > best:
                    best, rule, verdict = rank, text, v
        return rule, verdict


def _sweep(default: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sweep = None, Sweep()
        for p in parts:
            rows, rules, verdicts = [], [], []
            for i, (n, key, kind, host, path, verdict) in enumerate(
                    zip(p["range"], p["key"], p["kind"], p["host"], p["path"], p["verdict"], strict=True)):
                if n != now:
                    now, sweep = n, Sweep()
                if kind == 0:
                    sweep.open(key, host, path, verdict)
                else:
                    rule, v = sweep.judge(key, path)
                    rows.append(i)
                    rules.append(rule)
                    verdicts.append(v or default)
            out = p.iloc[rows][["id", "host", "path"]].copy()
            out["rule"], out["verdict"] = pd.Series(rules, out.index, object), pd.Series(verdicts, out.index, object)
            yield out
    return run


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; ``rules`` has host, path and verdict (allow or block)."""
    spark = urls.sparkSession
    rows = url_parts(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))).drop("url")
    rows = written(rows.withColumn("h", F.xxhash64("id", "key")), "urls")
    parts = shuffle_partitions(spark)
    n = RANGES * parts
    sample = sorted(map(tuple, rows.select("key", "h").orderBy("h", "key").limit(PER_RANGE * n).collect()))
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    starts = [key for key, _ in bounds]
    kind = rows.schema["id"].dataType.simpleString()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            p["range"] = [bisect_right(bounds, at) for at in zip(p["key"], p["h"], strict=True)]
            yield p

    def touched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            p["range"] = [list(range(bisect_left(starts, k),
                                     bisect_right(starts, False, key=lambda s, k=k: s > k and not s.startswith(k)) + 1))
                          for k in p["key"]]
            yield p

    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    ours = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    ours = ours.withColumn("key", _reversed(F.col("host")))

    ours = ours.mapInPandas(touched, "host string, path string, verdict string, key string, range array<int>")
    ours = ours.withColumns({"range": F.explode("range"), "kind": F.lit(0), "id": F.lit(None).cast(kind),
                             "h": F.lit(None).cast("long")})
    dealt = rows.mapInPandas(place, f"id {kind}, host string, path string, key string, h long, range int")
    both = ours.unionByName(dealt.withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")}))
    out = (both.repartition(parts, "range").sortWithinPartitions("range", "key", "kind", "h")
           .mapInPandas(_sweep(default), f"id {kind}, host string, path string, rule string, verdict string"))
    return out.withColumnRenamed("id", id_col)
