"""Saved answers and call traces: one file per model and item, loose in a folder or in a pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.sources import files

_NAME = r"^(.*?)__(.*)\.json$"
_SINGLE = "response"


def _pattern(models: list[str] | None) -> str:
    """The names of the files of ``models``, as a pattern for the listing."""
    marked = ["".join(f"\\{c}" if c in "*?[]{},\\" else c for c in m) for m in models or []]
    return "*.json" if models is None else "{" + ",".join(f"{m}__*.json" for m in marked) + "}"


def _named_files(spark: SparkSession, path: str, models: list[str] | None) -> DataFrame:
    """Whole files with the model and item their names carry.

    The name is split at the first double underscore. Files of other models
    are left out of the listing and never opened; in a pack, parts without
    such names are skipped.
    """
    if files.is_packed(spark, path):
        named = files.read_packed(spark, path).withColumnRenamed("name", "__name")
        if models is not None:
            of_model = [F.startswith("__name", F.lit(f"{m}__")) for m in models]
            named = named.filter(reduce(lambda a, b: a | b, of_model, F.lit(False)))
    else:
        listed = spark.read.option("pathGlobFilter", _pattern(models)).text(path, wholetext=True)
        named = listed.select("value", F.url_decode("_metadata.file_name").alias("__name"))
    return (
        named.filter(F.col("__name").rlike(_NAME))
        .select(
            F.regexp_extract("__name", _NAME, 1).alias("model"),
            F.regexp_extract("__name", _NAME, 2).alias("item"),
            F.try_parse_json("value").alias("__entries"),
        )
    )


def _generations(whole: DataFrame) -> DataFrame:
    entries = F.try_variant_get("__entries", "$", "array<variant>")
    return whole.select("model", "item", F.posexplode(entries).alias("generation", "entry")).withColumn(
        "generation", F.col("generation").cast("bigint")
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def read_responses(spark: SparkSession, path: str, run_id: str, models: list[str] | None = None) -> DataFrame:
    """Answers as one row per generation and turn, of all models or the named ones."""
    entry = F.col("entry")
    single = F.create_map(F.lit(_SINGLE), F.try_variant_get(entry, "$", "string"))
    turns = F.when(_kind(entry) == "STRING", single).otherwise(
        F.try_variant_get(entry, "$", "map<string,string>")
    )
    rows = _generations(_named_files(spark, path, models)).select(
        F.lit(run_id).alias("run_id"), "model", "item", "generation", F.explode(turns).alias("turn_id", "text")
    )
    return rows.select(*schemas.RESPONSES)


def read_traces(spark: SparkSession, path: str, run_id: str, models: list[str] | None = None) -> DataFrame:
    """Call traces as one row per call; an entry is a trace or a map of them."""
    entry = F.col("entry")
    flat = F.variant_get(entry, "$.text", "variant").isNotNull()
    named = F.when(flat, F.create_map(F.lit(_SINGLE), entry)).otherwise(
        F.try_variant_get(entry, "$", "map<string,variant>")
    )
    rows = _generations(_named_files(spark, path, models)).select(
        "model", "item", "generation", F.explode(named).alias("turn_id", "__trace")
    )
    fields = [
        F.try_variant_get("__trace", f"$.{name}", kind).alias("served_model" if name == "model" else name)
        for name, kind in schemas.TRACE.items()
    ]
    return rows.select(F.lit(run_id).alias("run_id"), "model", "item", "generation", "turn_id", *fields)


def write_entries(entries: DataFrame, path: str, packed: bool = False) -> None:
    """Answers or traces as files, one per model and item, in a pack if ``packed``.

    ``entries`` has ``model``, ``item``, ``generation`` and ``entry``, the JSON
    text of a generation's answer, trace, or map of turns. A file is the list
    of its entries by generation; a gap is an empty answer.
    """
    listed = F.collect_list(F.struct(F.col("generation").cast("int").alias("g"), "entry"))
    by_place = F.map_from_entries(F.transform(F.col("__listed"), lambda e: F.struct(e["g"], e["entry"])))
    last = F.array_max(F.map_keys("__at"))
    filled = F.transform(F.sequence(F.lit(0), last), lambda g: F.coalesce(F.element_at("__at", g), F.lit('""')))
    text = F.concat(F.lit("["), F.array_join(filled, ","), F.lit("]"))
    whole = entries.groupBy("model", "item").agg(listed.alias("__listed")).withColumn("__at", by_place)
    named = whole.select(F.concat("model", F.lit("__"), "item", F.lit(".json")).alias("name"), text.alias("value"))
    (files.write_packed if packed else files.write_named)(named, path)
