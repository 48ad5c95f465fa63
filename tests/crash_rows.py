"""Hand-made crash tables: each row names only the columns that matter, the rest are NULL."""

from crashlens.sources import SCHEMAS


def make(spark, table, *given, **common):
    schema = SCHEMAS[table]
    data = [tuple({**common, **row}.get(field.name) for field in schema.fields) for row in given]
    return spark.createDataFrame(data, schema)


def units(spark, *given, **common):
    return make(spark, "units", *given, **{"CRASH_ID": 1, "UNIT_NBR": 1, "VIN": "V", **common})


def persons(spark, *given, **common):
    return make(spark, "primary_person", *given, **{"CRASH_ID": 1, "UNIT_NBR": 1, "PRSN_NBR": 1, **common})


def charges(spark, *given, **common):
    return make(spark, "charges", *given, **{"CRASH_ID": 1, "UNIT_NBR": 1, "PRSN_NBR": 1, **common})


def damages(spark, *given, **common):
    return make(spark, "damages", *given, **{"CRASH_ID": 1, **common})
