"""Category values the analyses test for."""

# They have to equal the spelling in the data.
KILLED = "KILLED"
MALE = "MALE"
FEMALE = "FEMALE"
NOT_AVAILABLE = "NA"
MOTORCYCLE = "MOTORCYCLE"
DRIVER = "DRIVER"
AIRBAG_NOT_DEPLOYED = "NOT DEPLOYED"
HIT_AND_RUN = "Y"
ALCOHOL = "alcohol"
INVALID_LICENCE_CLASSES = ["UNKNOWN", "NA", "UNLICENSED"]
LICENCE_TYPES = ["DRIVER LICENSE", "COMMERCIAL DRIVER LIC."]
NO_STATE = ["na", "unknown", "other"]
NO_BODY_STYLE = ["NOT REPORTED", "OTHER  (EXPLAIN IN NARRATIVE)", "UNKNOWN", "NA"]
NO_ETHNICITY = ["NA", "UNKNOWN", "OTHER"]
NO_PROPERTY_DAMAGE = ["NONE", "NONE1"]
NO_DAMAGE_LEVEL = ["NA", "NO DAMAGE", "INVALID VALUE"]
DAMAGE_FLOOR = "DAMAGED 5"
INSURED = ["INSURANCE BINDER", "LIABILITY INSURANCE POLICY", "PROOF OF LIABILITY INSURANCE"]
SPEED_CHARGES = ["SPEED", "FAST"]

CRASH = ["CRASH_ID"]
CRASH_UNIT = ["CRASH_ID", "UNIT_NBR"]
VEHICLE = ["CRASH_ID", "UNIT_NBR", "VIN"]
CONTRIBUTING_FACTORS = ["CONTRIB_FACTR_1_ID", "CONTRIB_FACTR_2_ID", "CONTRIB_FACTR_P1_ID"]
DAMAGE_SCALES = ["VEH_DMAG_SCL_1_ID", "VEH_DMAG_SCL_2_ID"]

# Columns of stored results.
MEN_KILLED = "MALE_DEATH_COUNT"
DRIVER_DEATHS = "COUNT_OF_DRIVER_DEATH_AND_AB_FAILURE"
WITHOUT_WOMEN = "NO_FEMALE_ACCIDENT_COUNT"
INJURIES, DEATHS, CASUALTIES = "AGG_INJURIES", "AGG_DEATHS", "AGG_COUNT"
ALCOHOL_CRASHES = "ALCOHOL_CRASH_COUNT"
# End of fixed values.
