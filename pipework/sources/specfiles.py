"""Bulk loading of flow specs (C14) from JSON / YAML text.

Each file (or row) is one spec. JSON decodes with ``from_json`` on the
JVM; YAML is converted to JSON per partition with PyYAML inside
``mapInPandas`` (Arrow batches), then takes the same path. Unknown
top-level fields are reported, like the strict loaders do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC_DDL = (
    "name STRING, version BIGINT, execution STRUCT<mode: STRING>, "
    "stages ARRAY<STRUCT<name: STRING, type: STRING, threads: BIGINT, input_queue: STRING, "
    "output_queue: STRING, config: STRING, plugin: STRING, realtime_priority: BIGINT>>, "
    "queues ARRAY<STRUCT<name: STRING, capacity: BIGINT, "
    "schema: STRUCT<format: STRING, schema_id: STRING, version: BIGINT, registry_url: STRING>, type: STRING>>, "
    "labels MAP<STRING, STRING>, env MAP<STRING, STRING>, observability STRING, kubernetes STRING"
)
STAGE_FIELDS = ["name", "type", "threads", "input_queue", "output_queue", "config", "plugin", "realtime_priority"]
QUEUE_FIELDS = ["name", "capacity", "schema", "type"]
SCHEMA_FIELDS = ["format", "schema_id", "version", "registry_url"]
KNOWN_FIELDS = ["name", "version", "execution", "stages", "queues", "labels", "env", "observability", "kubernetes"]


def _unknown(objects, known: list[str]):
    """Keys of the objects (an array of maps, null entries left out) that are not known."""
    keys = F.flatten(F.transform(F.filter(objects, lambda m: m.isNotNull()), lambda m: F.map_keys(m)))
    return F.coalesce(F.array_except(keys, F.array(*[F.lit(k) for k in known])), F.array().cast("array<string>"))


def parse_specs(df: DataFrame, col: str = "json") -> DataFrame:
    """Decode JSON spec text, strictly; adds ``spec``, ``unknown_fields`` (of the
    spec, its stages, queues and queue schemas) and ``error`` (null when the
    spec loads): invalid JSON (a key given twice counts as such), an unknown
    field, or a value of a wrong type. The text is parsed twice: once to a
    variant for its keys, once to the spec."""
    obj = lambda v, path="$": F.try_variant_get(v, path, "map<string,variant>")
    items = lambda path: F.transform(F.try_variant_get("_v", path, "array<variant>"), lambda v: obj(v))
    out = df.withColumn("_v", F.try_parse_json(F.col(col)))
    # a value that its type can't hold makes the whole text a corrupt record
    whole = F.from_json(F.col(col), SPEC_DDL + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    out = out.withColumns({"_top": obj("_v"), "_queues": items("$.queues"), "spec": whole})
    schemas = F.transform("_queues", lambda q: obj(F.try_element_at(q, F.lit("schema"))))
    unknown = F.array_sort(F.array_distinct(F.concat(
        _unknown(F.array("_top"), KNOWN_FIELDS), _unknown(F.array(obj("_v", "$.execution")), ["mode"]),
        _unknown(items("$.stages"), STAGE_FIELDS), _unknown(F.col("_queues"), QUEUE_FIELDS), _unknown(schemas, SCHEMA_FIELDS))))
    out = out.withColumn("unknown_fields", unknown)
    err = (F.when(F.col("_top").isNull(), F.lit("invalid JSON"))
            .when(F.size("unknown_fields") > 0,
                  F.concat(F.lit("unknown field "), F.concat_ws(", ", F.transform("unknown_fields", lambda k: F.concat(F.lit('"'), k, F.lit('"'))))))
            .when(F.col("spec._corrupt").isNotNull(), F.lit("invalid value")))
    out = out.withColumn("error", err).withColumn("spec", F.col("spec").dropFields("_corrupt"))
    return out.select(*df.columns, "spec", "unknown_fields", "error")


def _yaml_to_json(batches):
    import pandas as pd
    import yaml
    for pdf in batches:
        out = []
        for text in pdf["value"]:
            try:
                out.append(json.dumps(yaml.safe_load(text), default=str))   # dates as text
            except (yaml.YAMLError, TypeError, ValueError):
                out.append(None)
        yield pd.DataFrame({"path": pdf["path"], "json": out})


def read_spec_files(spark: SparkSession, path: str) -> DataFrame:
    """Load every ``*.json`` / ``*.yaml`` / ``*.yml`` file under ``path``."""
    raw = (spark.read.text(path, wholetext=True)
                .withColumn("path", F.input_file_name()))
    is_yaml = F.lower(F.col("path")).rlike(r"\.ya?ml$")
    js = raw.where(~is_yaml).select("path", F.col("value").alias("json"))
    ym = raw.where(is_yaml).select("value", "path").mapInPandas(_yaml_to_json, "path string, json string")
    return parse_specs(js.unionByName(ym))
