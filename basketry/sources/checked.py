"""Input that is not what it should be (A1-A3, A7, K11): kept with its text and a cause, never lost.

Files and streams land whole first: the typed columns, the original text of a
record that does not fit them, and the ``cause``.  Then every record goes to one
route: its own, ``other`` (a type nobody knows) or ``quarantine``.  Rows in are
rows routed.

Landing before splitting matters: a CSV reader that is asked for some columns
only parses those, so a record's verdict would depend on the query; the landed
table has judged every field once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

TEXT, CAUSE, ROUTE = "record_text", "cause", "route"
QUARANTINE, OTHER = "quarantine", "other"
BROKEN, VALUE, SURPLUS, MISSING = "broken record", "value of another type", "surplus fields", "missing fields"
NO_TYPE, UNKNOWN_TYPE = "no event type", "unknown event type"


def with_text(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(TEXT, T.StringType())])


# ------------------------------------------------------------------ files
def csv_cause(text: Column, schema: T.StructType, options: dict[str, str]) -> Column:
    """Why a CSV record is none of ``schema``: too many fields, too few, or a value of another type.

    The record is read again as text fields, which only a wrong number of fields can make corrupt.
    """
    def fields(n: int) -> Column:
        columns = ", ".join([*[f"c{i} string" for i in range(n)], "corrupt string"])
        return F.from_csv(text, columns, {**options, "nullValue": "\x00", "header": "false", "columnNameOfCorruptRecord": "corrupt"})
    n = len(schema)
    more = fields(n + 1)
    return (F.when(fields(n)["corrupt"].isNull(), VALUE).when(more["corrupt"].isNull() | more[f"c{n}"].isNotNull(), SURPLUS)
            .otherwise(MISSING))


def json_cause(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNull(), BROKEN).otherwise(VALUE)


def land_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str], out: str) -> DataFrame:
    """A1, A3: a CSV directory as a landed table of the typed columns, ``record_text`` and ``cause`` (null if sound)."""
    rows = (spark.read.schema(with_text(schema)).options(**options).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", TEXT).option("enforceSchema", "true").csv(path))
    text = F.col(TEXT)
    return _landed(rows.withColumn(CAUSE, F.when(text.isNotNull(), csv_cause(text, schema, options))), out)


def land_json(spark: SparkSession, path: str, schema: T.StructType, out: str) -> DataFrame:
    """A2: JSON lines as a landed table; keys outside the schema are a cause, too."""
    rows = parsed_lines(spark.read.text(path), schema)
    return _landed(rows.withColumn(TEXT, F.when(F.col(CAUSE).isNotNull(), F.col(TEXT))), out)


def _landed(rows: DataFrame, out: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def parsed_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """JSON texts to (typed columns, record_text, cause); the cause is null for a sound record."""
    line, corrupt = F.col(column), "_corrupt"
    target = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(line, target, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = lines.select(line.alias(TEXT), parsed.alias("_p"), F.json_object_keys(line).alias("_keys"))
    known = F.array(*[F.lit(n) for n in schema.fieldNames()])
    cause = (F.when(F.col(f"_p.{corrupt}").isNotNull() | F.col("_keys").isNull(), json_cause(F.col(TEXT)))
             .when(F.size(F.array_except("_keys", known)) > 0, SURPLUS))
    return rows.select(*[F.col(f"_p.{n}").alias(n) for n in schema.fieldNames()], TEXT, cause.alias(CAUSE))


def sound(landed: DataFrame) -> DataFrame:
    """The records that fit, in the declared columns only."""
    return landed.filter(F.col(CAUSE).isNull()).drop(TEXT, CAUSE, ROUTE)


def rejected(landed: DataFrame) -> DataFrame:
    """(record_text, cause) of the others."""
    return landed.filter(F.col(CAUSE).isNotNull()).select(TEXT, CAUSE)


# ------------------------------------------------------------------ the stream
def routed(events: DataFrame, types: list[str], kind: str = "event_type") -> DataFrame:
    """Every record with its ``route``: its type, ``other`` or ``quarantine``; ``record_text`` of the last two."""
    fits = F.col(CAUSE).isNull()
    route = (F.when(~fits, QUARANTINE).when(F.col(kind).isin(types), F.col(kind)).otherwise(OTHER))
    cause = F.when(~fits, F.col(CAUSE)).when(F.col(kind).isNull(), NO_TYPE).when(~F.col(kind).isin(types), UNKNOWN_TYPE)
    return events.withColumns({ROUTE: route, CAUSE: cause})


def read_event_lines(spark: SparkSession, path: str, schema: T.StructType, types: list[str],
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A landing directory of JSON lines as a stream of routed records; each keeps its line until it is routed."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return route_lines(reader.text(path), schema, types)


def route_lines(lines: DataFrame, schema: T.StructType, types: list[str]) -> DataFrame:
    """Lines (column ``value``) to routed records; only those without a route of their own keep their text."""
    out = routed(parsed_lines(lines, schema), types)
    return out.withColumn(TEXT, F.when(F.col(ROUTE).isin(QUARANTINE, OTHER), F.col(TEXT)))


def to_routes(records: DataFrame, path: str, checkpoint: str, available_now: bool = True,
              interval: str = "30 seconds") -> StreamingQuery:
    """All routes in one exactly-once file sink, a directory per route, so no record is written twice or between them."""
    w = (records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy(ROUTE).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def read_route(spark: SparkSession, path: str, schema: T.StructType, route: str) -> DataFrame:
    """One route's records: the declared columns, and text and cause for ``other`` and ``quarantine``."""
    full = T.StructType([*with_text(schema).fields, T.StructField(CAUSE, T.StringType()), T.StructField(ROUTE, T.StringType())])
    rows = spark.read.schema(full).parquet(path).filter(F.col(ROUTE) == route)
    return rows.select(TEXT, CAUSE, *schema.fieldNames()) if route in (QUARANTINE, OTHER) else rows.select(*schema.fieldNames())
