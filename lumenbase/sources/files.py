"""Readers: CSV with required columns, name lists, progress logs, API logs, staged JSON, pair lists, canvas exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CANVAS_BLOB


def csv_with(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header; all columns are text. A missing required column raises."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """name|status|time[|message], lines with # skipped."""
    return spark.read.schema("name string, status string, at string, message string").csv(path, sep="|", comment="#")


def append_progress(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("|", "name", "status", "at", "message").alias("value")).write.mode("append").text(path)


def api_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, method, url, body, query, params) of API call lines."""
    pattern = r"^\[([^\]]+)\] API Call: (\S+) (\S+) \| Body: (.*?) \| Query: (.*?) \| Params: (.*)$"
    parts = {name: F.regexp_extract(column, pattern, i) for i, name in enumerate(["at", "method", "url", "body", "query", "params"], 1)}
    return lines.where(F.col(column).rlike(pattern)).select(*[c.alias(n) for n, c in parts.items()])


def staged(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """Staged JSON documents with their file; unreadable ones are dropped."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    rows = reader.schema(schema).json(glob) if schema else reader.json(glob)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("file_time"))


def newest_file(rows: DataFrame) -> DataFrame:
    """The newest of the files of ``staged``."""
    return rows.agg(F.max_by("file_name", F.struct("file_time", "file_name")).alias("file_name"))


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(a, b), a < b, of lines id1,id2."""
    rows = spark.read.schema("x string, y string").csv(path)
    return rows.where("x is not null and y is not null").select(F.least(F.trim("x"), F.trim("y")).alias("a"), F.greatest(F.trim("x"), F.trim("y")).alias("b")).distinct()


def canvas_nodes(versions: DataFrame, blob: str = "jsonBlob") -> DataFrame:
    """(canvasId, timestamp, id, type, content, x, y) of each version's nodes."""
    node = versions.withColumn("_b", F.from_json(blob, CANVAS_BLOB)).select("canvasId", "timestamp", F.explode("_b.nodes").alias("n"))
    return node.select("canvasId", "timestamp", "n.id", "n.type", F.col("n.data.content").alias("content"), "n.position.x", "n.position.y")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, length) of a folder's files, without their bytes."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "length")


def exported_version(export: DataFrame, column: str, version: str | None = None) -> DataFrame:
    """The named version of an exported canvas (JSON map from time to content), else the last."""
    m = F.from_json(column, "map<string,string>", {"allowSingleQuotes": "false"})
    key = F.lit(version) if version else F.array_max(F.map_keys(m))
    return export.select(key.alias("version"), F.try_element_at(m, key).alias("content"))


def one_staged(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """One staged document of a folder; only the last part of the name counts, so no name leads out of the folder."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    if not base.endswith(".json") or base.startswith("."):
        raise ValueError(f"no staged document: {name!r}")
    return staged(spark, f"{folder.rstrip('/')}/{base}", schema)


_AI_NODES = "nodes array<struct<id:string,type:string,data:struct<content:string,provenance:string,prompt:string>>>"


def ai_images(export: DataFrame, column: str, version: str | None = None) -> DataFrame:
    """(version, pos, id, url, prompt): the generated images of an exported canvas's version (the given one if it is there, else the last)."""
    m = F.from_json(column, "map<string,string>")
    last = F.array_max(F.map_keys(m))
    key = F.when(F.map_contains_key(m, F.lit(version)), F.lit(version)).otherwise(last) if version else last
    nodes = F.from_json(F.try_element_at(m, key), _AI_NODES)["nodes"]
    rows = export.select(key.alias("version"), F.posexplode(nodes).alias("pos", "n")).where("n.type = 'image' and n.data.provenance = 'ai'")
    return rows.select("version", "pos", "n.id", F.col("n.data.content").alias("url"), F.coalesce("n.data.prompt", F.lit("")).alias("prompt"))


def run_summary(documents: DataFrame, metadata: str = "metadata") -> DataFrame:
    """A staging run's figures (a map of text), with defaults for what it lacks."""
    value = lambda k: F.try_element_at(F.col(metadata), F.lit(k))
    numbers = [F.coalesce(value(k).try_cast("long"), F.lit(0)).alias(k) for k in ("total_processed", "total_artists", "total_artworks", "new_artists_count", "new_artworks_count", "limit")]
    return documents.select(value("timestamp").alias("timestamp"), *numbers, F.coalesce(value("download_enabled").try_cast("boolean"), F.lit(False)).alias("download_enabled"))
