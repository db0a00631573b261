"""The two public tables that the engine is made for, by schema and role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The names and order of the files' columns.
ADULT_NUMERIC = ["age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week"]
ADULT_COLUMNS = [
    "age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation", "relationship", "race", "sex",
    "capital-gain", "capital-loss", "hours-per-week", "native-country", "income"
]
COVERTYPE_NUMERIC = [
    "Elevation", "Aspect", "Slope", "Horizontal_Distance_To_Hydrology", "Vertical_Distance_To_Hydrology",
    "Horizontal_Distance_To_Roadways", "Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm", "Horizontal_Distance_To_Fire_Points",
]
COVERTYPE_BINARY = [f"Wilderness_Area_{i}" for i in range(1, 5)] + [f"Soil_Type_{i}" for i in range(1, 41)]
COVERTYPE_COLUMNS = [*COVERTYPE_NUMERIC, *COVERTYPE_BINARY, "Cover_Type"]


@dataclass(frozen=True)
class FrameMeta:
    """What a recipe knows about the frame that it made."""

    synthesizer_type: str
    all_categorical: bool = False
    discrete_columns: tuple[str, ...] = field(default_factory=tuple)


def adult_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType() if c in ADULT_NUMERIC else T.StringType()) for c in ADULT_COLUMNS])


def covertype_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in COVERTYPE_COLUMNS])
