"""OTLP JSON documents: reading a folder, kinds, and flat spans, logs and metric points.

Attribute values become text in a map; of a key given twice the last value stays.
Times stay whole nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRS}>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,attributes:{_ATTRS},events:array<struct<name:string,timeUnixNano:string,attributes:{_ATTRS}>>>"
_LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,traceId:string,spanId:string,body:{_VALUE},attributes:{_ATTRS}>"
_POINT = f"array<struct<asDouble:string,asInt:string,startTimeUnixNano:string,timeUnixNano:string,attributes:{_ATTRS}>>"
KINDS = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
_METRIC = "struct<name:string,description:string,unit:string," + ",".join(f"{k}:struct<aggregationTemporality:string,isMonotonic:boolean,dataPoints:{_POINT}>" for k in KINDS) + ">"
_DOCUMENT = {
    "resourceSpans": f"struct<resourceSpans:array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<{_SPAN}>>>>>>",
    "resourceLogs": f"struct<resourceLogs:array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<{_LOG}>>>>>>",
    "resourceMetrics": f"struct<resourceMetrics:array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>>",
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, text, is_trace, is_log, is_metrics) of the JSON files of a folder, not of its subfolders.

    A file that isn't JSON is an error; JSON of another kind has all flags false.
    """
    docs = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return with_kinds(docs)


def with_kinds(docs: DataFrame) -> DataFrame:
    parsed = F.coalesce(F.try_parse_json("text"), F.raise_error(F.concat(F.lit("not JSON: "), "file")))
    has = lambda key: F.expr(f"variant_get(_v, '$.{key}') is not null")
    docs = docs.withColumn("_v", parsed)
    return docs.select(*[c for c in docs.columns if c != "_v"], has("resourceSpans").alias("is_trace"), has("resourceLogs").alias("is_log"), has("resourceMetrics").alias("is_metrics"))


def value_text(value: Column) -> Column:
    return F.coalesce(*[value[k] for k in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue")])


def attribute_map(attributes: Column) -> Column:
    """A map of text from a list of attributes; sorted by key, the last one given of each key is next to another key."""
    given = F.filter(F.coalesce(attributes, F.array().cast(_ATTRS)), lambda a: a["key"].isNotNull() & a["value"].isNotNull())
    placed = F.transform(given, lambda a, i: F.named_struct(F.lit("key"), a["key"], F.lit("place"), i, F.lit("text"), value_text(a["value"])))
    # The sorted list is bound to a name, or it would be made again for each of its elements.
    last = F.transform(F.array(F.array_sort(placed)), lambda every: F.filter(every, lambda a, i: ~F.get(every, i + 1)["key"].eqNullSafe(a["key"])))[0]
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], a["text"])))


def _flat(docs: DataFrame, top: str, scope: str, leaf: str) -> DataFrame:
    """One row for each leaf, with its resource's attributes and its place in reading order."""
    flag = {"resourceSpans": "is_trace", "resourceLogs": "is_log", "resourceMetrics": "is_metrics"}[top]
    rows = docs.where(flag).select("file", F.from_json("text", _DOCUMENT[top])[top].alias("r"))
    rows = rows.select("file", F.posexplode("r").alias("p1", "r")).select("file", "p1", attribute_map(F.col("r.resource.attributes")).alias("resource"), F.posexplode(f"r.{scope}").alias("p2", "s"))
    return rows.select("file", "p1", "p2", "resource", F.posexplode(f"s.{leaf}").alias("p3", "x"))


_NANOS = "bigint"


def spans(docs: DataFrame) -> DataFrame:
    """Rows of spans; one without a trace id, span id or start is an error."""
    rows = _flat(docs, "resourceSpans", "scopeSpans", "spans")
    need = lambda c: F.coalesce(F.nullif(F.col(f"x.{c}"), F.lit("")), F.raise_error(F.concat(F.lit(f"a span without {c} in "), "file")))
    code = F.col("x.status.code")
    return rows.select(
        F.struct("file", "p1", "p2", "p3").alias("ordinal"),
        need("traceId").alias("trace_id"),
        need("spanId").alias("span_id"),
        F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_id"),
        F.coalesce("x.name", F.lit("")).alias("name"),
        need("startTimeUnixNano").cast(_NANOS).alias("start"),
        F.nullif(F.col("x.endTimeUnixNano"), F.lit("")).cast(_NANOS).alias("end"),
        F.when(code.isin("2", "STATUS_CODE_ERROR"), "error").when(code.isin("1", "STATUS_CODE_OK"), "ok").alias("outcome"),
        attribute_map(F.col("x.attributes")).alias("attributes"),
        F.transform(F.coalesce("x.events", F.array()), lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].cast(_NANOS).alias("at"), attribute_map(e["attributes"]).alias("attributes"))).alias("events"),
        "resource",
    )


def logs(docs: DataFrame) -> DataFrame:
    rows = _flat(docs, "resourceLogs", "scopeLogs", "logRecords")
    given = lambda c: F.when(~F.col(c).isin("", "0"), F.col(c))
    return rows.select(
        F.struct("file", "p1", "p2", "p3").alias("ordinal"),
        F.coalesce(given("x.timeUnixNano"), given("x.observedTimeUnixNano"), F.lit("0")).cast(_NANOS).alias("at"),
        F.nullif(F.col("x.traceId"), F.lit("")).alias("trace_id"),
        F.nullif(F.col("x.spanId"), F.lit("")).alias("span_id"),
        value_text(F.col("x.body")).alias("body"),
        attribute_map(F.col("x.attributes")).alias("attributes"),
        "resource",
    )


def metric_points(docs: DataFrame) -> DataFrame:
    rows = _flat(docs, "resourceMetrics", "scopeMetrics", "metrics")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"x.{k}").alias("data")) for k in KINDS])
    rows = rows.withColumn("k", F.explode(F.filter(kinds, lambda k: k["data"].isNotNull())))
    rows = rows.select("file", "p1", "p2", "p3", "resource", "x.name", "x.unit", "k.kind", "k.data", F.posexplode("k.data.dataPoints").alias("p4", "d"))
    only_sum = lambda c: F.when(F.col("kind") == "sum", F.col(c))
    return rows.select(
        F.struct("file", "p1", "p2", "p3", "p4").alias("ordinal"),
        F.coalesce("name", F.lit("")).alias("name"),
        "kind",
        F.coalesce("d.asDouble", "d.asInt").cast("double").alias("value"),
        F.coalesce(F.col("d.startTimeUnixNano").cast(_NANOS), F.lit(0)).alias("start"),
        F.coalesce(F.col("d.timeUnixNano").cast(_NANOS), F.lit(0)).alias("at"),
        F.when(only_sum("data.aggregationTemporality").isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), "cumulative").when(only_sum("data.aggregationTemporality").isin("1", "AGGREGATION_TEMPORALITY_DELTA"), "delta").alias("temporality"),
        only_sum("data.isMonotonic").alias("monotonic"),
        attribute_map(F.col("d.attributes")).alias("attributes"),
        "resource",
    )
