"""REST-like sources as Python data sources: pages that link to the next, and the sub-resources that their items link to.

Locations are paths of JSON files or http(s) URLs; links may be relative to the page that holds them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import batched
from pathlib import Path
from urllib.parse import urljoin
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition


def load(location: str, options: dict) -> dict:
    """The JSON object at a path or URL; a ``token`` goes into the header that ``token_header`` names."""
    if not location.startswith(("http://", "https://")):
        return json.loads(Path(location).read_text())
    headers = {options.get("token_header", "Authorization"): options["token"]} if options.get("token") else {}
    with urlopen(Request(location, headers=headers), timeout=float(options.get("timeout", 30))) as answer:
        return json.load(answer)


def target(page: str, link: str) -> str:
    return urljoin(page, link) if page.startswith(("http://", "https://")) or "://" in link else str(Path(page).parent / link)


def pages(options: dict) -> Iterator[tuple[str, dict]]:
    """(location, content) of the chain of pages, at most ``max_depth`` (0: all); one that was met already ends it."""
    at, depth, met = options["path"], int(options.get("max_depth", 0)), set()
    while at and at not in met and (not depth or len(met) < depth):
        met.add(at)
        page = load(at, options)
        yield at, page
        link = page.get("_links", {}).get("next", {}).get("href")
        at = target(at, link) if link else None


class Page(InputPartition):
    def __init__(self, location: str):
        self.location = location


class PagedReader(DataSourceReader):
    """Follows ``_links.next.href`` from the first page, at most ``max_depth`` pages (0: all); a partition a page."""

    def __init__(self, options: dict):
        self.options, self.items = options, options.get("items", "items")

    def partitions(self):
        return [Page(at) for at, _ in pages(self.options)]

    def read(self, partition):
        for item in load(partition.location, self.options).get(self.items, []):
            yield (partition.location, str(item.get("id")), json.dumps(item))


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged_json").option("path", ...)``."""

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "page string, id string, item string"

    def reader(self, schema):
        return PagedReader(dict(self.options))


class Parents(InputPartition):
    def __init__(self, links: list[tuple[str, str | None]]):
        self.links = links


class LinkedReader(DataSourceReader):
    """Follows the link ``rel`` of each item of the pages; a partition holds the links of some items. Ids that are asked for
    (``parent_id`` = or in) are pushed down, so only their links are followed. A link that fails is a row with the error."""

    def __init__(self, options: dict):
        self.options, self.items, self.rel, self.wanted = options, options.get("items", "items"), options["rel"], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            ids = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if ids is None or f.attribute != ("parent_id",):
                yield f
            else:
                self.wanted = ids if self.wanted is None else self.wanted & ids

    def partitions(self):
        links = []
        for at, page in pages(self.options):
            for item in page.get(self.items, []):
                parent = str(item.get("id"))
                if self.wanted is None or parent in self.wanted:
                    link = item.get("_links", {}).get(self.rel, {}).get("href")
                    links.append((parent, target(at, link) if link else None))
        return [Parents(list(part)) for part in batched(links, int(self.options.get("parents", 16)))] or [Parents([])]

    def read(self, partition):
        for parent, link in partition.links:
            if link is None:
                yield (parent, None, None, "no link")
                continue
            try:
                found = load(link, self.options)
                children = found["_embedded"][self.rel] if "_embedded" in found else found.get(self.rel, [])
            except (OSError, ValueError, KeyError, TypeError) as e:
                yield (parent, None, None, f"{type(e).__name__}: {e}")
                continue
            for child in children:
                yield (parent, str(child.get("id")), json.dumps(child), None)


class LinkedSource(DataSource):
    """After ``register``: ``spark.read.format("linked_json").option("path", first page).option("rel", "artists")``: (parent_id, id, item, error)."""

    @classmethod
    def name(cls):
        return "linked_json"

    def schema(self):
        return "parent_id string, id string, item string, error string"

    def reader(self, schema):
        return LinkedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let ids be pushed down to them."""
    for source in (PagedSource, LinkedSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
