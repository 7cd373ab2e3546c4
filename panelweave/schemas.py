"""Declared table schemas and the check made on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "timestamp": T.TimestampType(), "date": T.DateType(),
}


def _struct(spec: str) -> T.StructType:
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


POSTS = _struct(
    "tweet_ids bigint, tweet_text string, locations string, dates timestamp, "
    "scree_name string, user_id bigint, user_description string, place string, "
    "polygon string, profile_url string, is_org string, sentiment double, "
    "emotion string, gender string, age string, regions string, topic string"
)
LINKS = _struct("url string, location string")
DOMAIN_LABELS = _struct(
    "domain string, polarity_cat string, polarity_cont double, type string"
)
CORPUS = _struct("scree_name string, week_start date, tweet_text string")
REGIONAL_DAILY = _struct(
    "data timestamp, stato string, codice_regione int, "
    "denominazione_regione string, lat double, long double, "
    "terapia_intensiva bigint, totale_positivi bigint, "
    "nuovi_positivi bigint, deceduti bigint"
)
POPULATION = _struct("regions string, pop bigint")
EDGES = _struct("FromNodeId int, ToNodeId int")
METRICS = _struct("method string, model string, MAE double, MSE double, R2 double")


class SchemaMismatch(ValueError):
    pass


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Raise if a declared column is absent or has another type."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {found[f.name].simpleString() if f.name in found else 'nothing'}"
        for f in expected
        if f.name not in found or found[f.name] != f.dataType
    ]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df
