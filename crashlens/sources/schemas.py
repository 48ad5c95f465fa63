"""Fixed column types of the six input tables.

Types are never inferred from the data: inference costs a pass over every file, turns zip codes into
numbers (losing leading zeros) and lets one stray text value change the type of a whole column.
"""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _table(ids: dict, texts: list[str], counts: tuple[str, ...] = ()) -> StructType:
    fields = [StructField(name, kind) for name, kind in ids.items()]
    fields += [StructField(name, StringType()) for name in texts]
    fields += [StructField(name, IntegerType()) for name in counts]
    return StructType(fields)


_CRASH = {"CRASH_ID": LongType()}
_CRASH_UNIT = {"CRASH_ID": LongType(), "UNIT_NBR": IntegerType()}
_CRASH_UNIT_PERSON = {**_CRASH_UNIT, "PRSN_NBR": IntegerType()}

UNITS = _table(
    _CRASH_UNIT,
    [
        "VIN",
        "VEH_MAKE_ID",
        "VEH_BODY_STYL_ID",
        "VEH_COLOR_ID",
        "VEH_LIC_STATE_ID",
        "VEH_HNR_FL",
        "CONTRIB_FACTR_1_ID",
        "CONTRIB_FACTR_2_ID",
        "CONTRIB_FACTR_P1_ID",
        "VEH_DMAG_AREA_1_ID",
        "VEH_DMAG_SCL_1_ID",
        "VEH_DMAG_AREA_2_ID",
        "VEH_DMAG_SCL_2_ID",
        "FIN_RESP_TYPE_ID",
    ],
    ("TOT_INJRY_CNT", "DEATH_CNT"),
)

PRIMARY_PERSON = _table(
    _CRASH_UNIT_PERSON,
    [
        "PRSN_TYPE_ID",
        "PRSN_INJRY_SEV_ID",
        "PRSN_GNDR_ID",
        "PRSN_ETHNICITY_ID",
        "PRSN_AIRBAG_ID",
        "PRSN_DEATH_TIME",
        "DRVR_LIC_TYPE_ID",
        "DRVR_LIC_CLS_ID",
        "DRVR_LIC_STATE_ID",
        "DRVR_ZIP",
    ],
)

CHARGES = _table(_CRASH_UNIT_PERSON, ["CHARGE"])
DAMAGES = _table(_CRASH, ["DAMAGED_PROPERTY"])
ENDORSE = _table(_CRASH_UNIT, [])
RESTRICT = _table(_CRASH_UNIT, [])

SCHEMAS: dict[str, StructType] = {
    "charges": CHARGES,
    "damages": DAMAGES,
    "endorse": ENDORSE,
    "primary_person": PRIMARY_PERSON,
    "units": UNITS,
    "restrict": RESTRICT,
}
