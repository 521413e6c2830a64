"""File scans: CSV with GeoJSON text, zone FeatureCollections, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G

FEATURE_DDL = "type string, properties map<string,string>, geometry string"
#: How a feature begins when its type comes first.
_BEGINS = r'^\s*"type"\s*:\s*"Feature"\s*,'
_ANYWHERE = r'"type"\s*:\s*"Feature"'


# Columns of the three tables that stages hand to each other as CSV.
SAMPLES_DDL = ("`system:index` string, flood int, ndwi_post double, mndwi_post double, awei_post double, VV double, "
               "elevation double, slope double, Map int, jrc_seasonality int, `.geo` string")
PREDICTORS_DDL = ("row int, col int, ndwi_post float, mndwi_post float, awei_post float, VV float, elevation float, "
                  "slope float, Map float, jrc_seasonality float, `.geo` string")
PREDICTIONS_DDL = PREDICTORS_DDL + ", flood_probability double, flood_predicted int"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV with an explicit schema; ``escape='"'`` keeps quoted GeoJSON whole."""
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def feature_mark(spark: SparkSession, path: str) -> str | None:
    """The exact text with which every feature of the FeatureCollections at ``path`` begins, if it is one and the same.

    Found by one scan in pieces between opening braces, which splits like any text.
    """
    pieces = spark.read.text(path, lineSep="{").select(
        F.nullif(F.regexp_extract("value", _BEGINS, 0), F.lit("")).alias("mark"),
        F.regexp_count("value", F.lit(_ANYWHERE)).alias("n"))
    r = pieces.agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.count("mark").alias("marked"), F.sum("n").alias("n")).first()
    return "{" + r.a if r.a is not None and r.a == r.b and r.marked == r.n else None


def read_zone_features(spark: SparkSession, path: str, zone_field: str = "FLD_ZONE",
                       collection: bool = False) -> DataFrame:
    """Zone features -> (zone_id, <zone_field>, geom).

    One Feature per line splits across tasks at any size.  ``collection=True`` reads FeatureCollection
    documents: they are cut where features begin, so one large document is read by many tasks, too.  Only
    where features begin in different ways (type not first, other white space) a document is
    one task.  Features that cannot be parsed are dropped.
    """
    mark = feature_mark(spark, path) if collection else None
    if mark is not None:
        # A record is what follows a mark: a feature and, ignored by the parser, the comma or end after it.
        parts = spark.read.text(path, lineSep=mark).select(F.from_json(F.concat(F.lit(mark), F.col("value")), FEATURE_DDL).alias("f"))
        feats = parts.where("f.type = 'Feature'").select("f.*")
    elif collection:
        ddl = f"features array<struct<{FEATURE_DDL.replace(' string', ':string').replace(' map', ':map')}>>"
        fc = spark.read.schema(ddl).json(path, multiLine=True)
        feats = fc.select(F.explode("features").alias("f")).select("f.*")
    else:
        feats = spark.read.schema(FEATURE_DDL).json(path)
    parsed = G.with_geometry(feats.select("geometry", "properties"), F.col("geometry"), "geom")
    # The id follows from what the feature says, not from how it is written.
    return parsed.select(F.xxhash64("geom", F.to_json("properties")).alias("zone_id"),
                         F.col("properties")[zone_field].alias(zone_field), "geom")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
