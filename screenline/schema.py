"""Schemas shared by the batch and streaming jobs."""

from pyspark.sql import types as T

SIGNAL = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])
ENTITY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("severity", T.IntegerType()),
])
SIGNALS = T.ArrayType(SIGNAL)
ENTITIES = T.ArrayType(ENTITY)
STRINGS = T.ArrayType(T.StringType())

SCAN = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("original_prompt", T.StringType()),
    T.StructField("sanitized_prompt", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("decision", T.StringType()),
    T.StructField("threats", STRINGS),
    T.StructField("signals", SIGNALS),
    T.StructField("pii", ENTITIES),
    T.StructField("timestamp", T.TimestampType()),
])
EVENT_LOG = T.StructType(SCAN.fields + [T.StructField("event_date", T.DateType())])

LABELLED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_rank", T.IntegerType()),
    T.StructField("pos", T.LongType()),
])
SPLIT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("split", T.StringType()),
])
METRICS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
