"""Staged documents applied as they arrive: a file stream, tables in versions, one commit for all of them.

Each micro-batch rewrites the tables of artists, artworks and applied actions below a folder named by the batch, and then commits by writing
one small state file, so readers see all three tables of a batch or none. A batch that broke anywhere is run again under its number by
the stream's checkpoint, overwrites what it had written and gives the same tables; one that was committed is skipped. Files that
the stream has finished are moved to the archive folder by the source itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.upsert import upsert

_ARTWORK = (
    "struct<image_id:string,existing_id:string,is_existing:boolean,value:string,artist_names:array<string>,image_urls:map<string,string>,filename:string,rights:string,"
    "descriptions:map<string,map<string,string>>,relatedKeywordIds:array<string>,relatedKeywordStrings:array<string>>"
)
DOCUMENT = (
    "artist struct<name:string,existing_id:string,generated_entry_id:string,is_existing:boolean,artist_aliases:array<map<string,string>>,descriptions:map<string,map<string,string>>,"
    f"RelatedKeywordIds:array<string>,RelatedKeywordStrings:array<string>,artworks:array<{_ARTWORK}>>"
)
TABLES = {
    "text_entries": "entry_id string, value string, images string, isArtist int, type string, artist_aliases string, descriptions string, relatedKeywordIds string, relatedKeywordStrings string",
    "image_entries": "image_id string, value string, artist_names string, image_urls string, filename string, rights string, descriptions string, relatedKeywordIds string, relatedKeywordStrings string",
    "applied": "file_name string, table_name string, id string, sql_action string, batch long",
}
KEYS = {"text_entries": "entry_id", "image_entries": "image_id"}


def documents(lines: DataFrame) -> DataFrame:
    """(file_name, artist) of whole JSON texts (value, file_name); what is no document or names no artist is left out."""
    read = lines.select("file_name", F.from_json("value", DOCUMENT)["artist"].alias("artist"))
    return read.where("artist is not null and coalesce(artist.name, artist.existing_id, artist.generated_entry_id) is not null")


def _id(*given: str) -> Column:
    """The first id that is given, else one made of the document, so a second run makes the same."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in given], F.substring(F.md5(F.concat_ws("|", "file_name", F.col("value"), F.col("pos").cast("string"))), 1, 24))


def _json(column: str, empty: str) -> Column:
    return F.coalesce(F.to_json(column), F.lit(empty)).alias(column[0].lower() + column[1:])


def entries(docs: DataFrame) -> dict[str, DataFrame]:
    """Rows of the two tables with file_name and sql_action; an update resets ``images``. Of rows with one id the last file's last counts."""
    artists = docs.select("file_name", F.lit(0).alias("pos"), F.coalesce("artist.name", F.lit("")).alias("value"), "artist.*")
    texts = artists.select(
        "file_name", "pos", _id("existing_id", "generated_entry_id").alias("entry_id"), "value", F.lit("[]").alias("images"), F.lit(1).alias("isArtist"), F.lit("artist").alias("type"),
        _json("artist_aliases", "[]"), _json("descriptions", "{}"), _json("RelatedKeywordIds", "[]"), _json("RelatedKeywordStrings", "[]"), _action(),
    )
    works = docs.select("file_name", F.posexplode("artist.artworks").alias("pos", "w")).select("file_name", "pos", "w.*").withColumn("value", F.coalesce("value", F.lit("")))
    images = works.select(
        "file_name", "pos", _id("image_id", "existing_id").alias("image_id"), "value", _json("artist_names", "[]"), _json("image_urls", "{}"), F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce("rights", F.lit("")).alias("rights"), _json("descriptions", "{}"), _json("relatedKeywordIds", "[]"), _json("relatedKeywordStrings", "[]"), _action(),
    )
    last = lambda rows, key: rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("file_name"), F.desc("pos")))).where("_r = 1").drop("_r", "pos")
    return {"text_entries": last(texts, "entry_id"), "image_entries": last(images, "image_id")}


def _action() -> Column:
    return F.when(F.col("is_existing"), "UPDATE").otherwise("INSERT").alias("sql_action")


class Store:
    """Versions of the tables below ``folder``; the last state file names the version that holds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _states(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().toString() for s in system.listStatus(where)] if system.exists(where) else []
        return sorted(s for s in found if "/state-" in s and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s + "/_SUCCESS")))

    def state(self) -> dict:
        states = self._states()
        return json.loads(self.spark.read.text(states[-1]).first()[0]) if states else {"batch": -1, "versions": {}}

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        path = (state or self.state())["versions"].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(path) if path else self.spark.createDataFrame([], TABLES[name])

    def apply(self, docs: DataFrame, batch: int) -> None:
        """One batch of documents: three tables, then the commit."""
        state = self.state()
        if batch <= state["batch"]:
            return
        docs = docs.persist()
        try:
            versions, made, log = dict(state["versions"]), entries(docs), self.table("applied", state)
            for name, rows in made.items():
                versions[name] = f"{self.folder}/{name}/batch-{batch:08d}"
                new = upsert(self.table(name, state), rows.drop("file_name", "sql_action"), KEYS[name])
                new.write.mode("overwrite").parquet(versions[name])
                log = log.unionByName(rows.select("file_name", F.lit(name).alias("table_name"), F.col(KEYS[name]).alias("id"), "sql_action", F.lit(batch).cast("long").alias("batch")))
            versions["applied"] = f"{self.folder}/applied/batch-{batch:08d}"
            log.write.mode("overwrite").parquet(versions["applied"])
            commit = self.spark.createDataFrame([(json.dumps({"batch": batch, "versions": versions}),)], "value string").coalesce(1)
            commit.write.mode("overwrite").text(f"{self.folder}/state-{batch:08d}")
        finally:
            docs.unpersist()


def stream(spark: SparkSession, staged: str, completed: str, store: str, checkpoint: str):
    """Apply the JSON files that have come to ``staged`` since the last run and stop; those of earlier batches go to ``completed``."""
    lines = spark.readStream.format("text").schema("value string").option("wholetext", True).option("cleanSource", "archive").option("sourceArchiveDir", completed).load(staged)
    lines = lines.select("value", F.col("_metadata.file_name").alias("file_name"))
    tables = Store(spark, store)
    return lines.writeStream.foreachBatch(lambda batch, n: tables.apply(documents(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export(store: Store, path: str) -> DataFrame:
    """All entries as JSON below ``path`` with one row of totals; returns that row."""
    state = store.state()
    for name in KEYS:
        store.table(name, state).write.mode("overwrite").json(f"{path}/{name}")
    files = store.table("applied", state).agg(F.count_distinct("file_name").alias("source_files"))
    totals = files.join(store.table("text_entries", state).agg(F.count("*").alias("total_artists"))).join(store.table("image_entries", state).agg(F.count("*").alias("total_artworks")))
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return store.spark.read.json(f"{path}/metadata")


def write_by_slug(rows: DataFrame, name: str, path: str) -> None:
    """One folder of JSON for each row's slug, and all of them together beside."""
    slugged = rows.withColumn("slug", X.slug(F.col(name)))
    slugged.repartition("slug").write.mode("overwrite").partitionBy("slug").json(f"{path}/by_slug")
    slugged.write.mode("overwrite").json(f"{path}/combined")
