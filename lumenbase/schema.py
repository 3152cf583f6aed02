"""Schemas of the knowledge base: bronze keeps JSON columns as text (invalid JSON is queried), silver is typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_ENTRIES = "entry_id string, value string, images string, isArtist int, type string, artist_aliases string, descriptions string, relatedKeywordIds string, relatedKeywordStrings string"
IMAGE_ENTRIES = "image_id string, value string, artist_names string, image_urls string, filename string, rights string, descriptions string, relatedKeywordIds string, relatedKeywordStrings string"
VECTORS = "id string, embedding array<float>"
COORDINATES = "id string, umap struct<x:double,y:double>, pca struct<x:double,y:double>, tsne struct<x:double,y:double>, created_at timestamp, updated_at timestamp"
USERS = "userId string, clippings string"
CANVASES = "canvasId string, userId string, canvasName string"
VERSIONS = "versionId string, canvasId string, timestamp string, jsonBlob string"
CANVAS_BLOB = (
    "struct<nodes:array<struct<id:string,type:string,position:struct<x:double,y:double>,data:struct<content:string>>>,"
    "edges:array<struct<id:string,source:string,target:string>>,viewport:struct<x:double,y:double,zoom:double>>"
)

_STRICT = {"allowSingleQuotes": "false"}
_TYPES = {
    "images": "array<string>", "artist_names": "array<string>", "relatedKeywordIds": "array<string>", "relatedKeywordStrings": "array<string>",
    "image_urls": "map<string,string>", "descriptions": "map<string,map<string,string>>", "artist_aliases": "array<map<string,string>>",
}


def silver(entries: DataFrame) -> DataFrame:
    """Typed columns; text that is not valid JSON of the column's type becomes null."""
    typed = {c: F.from_json(F.col(c), t, _STRICT) for c, t in _TYPES.items() if c in entries.columns}
    return entries.withColumns(typed)
