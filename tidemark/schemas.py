"""Explicit schemas of the rows that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField

LABEL = T.StructType([_f("instrument", T.StringType(), False), _f("observed_day", T.LongType(), False), _f("released_day", T.LongType(), False), _f("value", T.DoubleType(), False)])
CELL = T.StructType([_f("date_id", T.LongType(), False), _f("target", T.StringType(), False), _f("target_pos", T.IntegerType(), False), _f("value", T.DoubleType(), True)])
OBSERVATION = T.StructType([_f("series_id", T.StringType(), False), _f("series_pos", T.IntegerType(), False), _f("t", T.IntegerType(), False), _f("value", T.DoubleType(), False)])
DAILY = T.StructType([_f("variant", T.StringType(), False), _f("pos", T.LongType(), False), _f("rho", T.DoubleType(), True)])
SERIES = T.StructType([_f("id", T.StringType()), _f("name", T.StringType()), _f("values", T.ArrayType(T.DoubleType()))])
PANEL = T.StructType([_f("schema", T.StringType()), _f("scope", T.StringType()), _f("seed", T.LongType()), _f("scenario", T.StringType()), _f("days", T.IntegerType()), _f("series", T.ArrayType(SERIES)), _f("description", T.StringType())])
LEDGER = T.StructType([_f("project", T.StringType()), _f("status", T.StringType()), _f("families", T.ArrayType(T.StructType([_f("family", T.StringType()), _f("outcome", T.StringType()), _f("capability", T.StringType())])))])
NOTEBOOK = T.StructType(
    [
        _f("nbformat", T.LongType()),
        _f("cells", T.ArrayType(T.StructType([_f("id", T.StringType()), _f("cell_type", T.StringType()), _f("execution_count", T.LongType()), _f("source", T.ArrayType(T.StringType())), _f("outputs", T.ArrayType(T.StructType([_f("output_type", T.StringType()), _f("text", T.ArrayType(T.StringType()))])))]))),
    ]
)
