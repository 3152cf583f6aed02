"""Records of web pages from an element tree: artists, artworks and links, one parse a page.

``Element`` is a small tree over the standard parser, with the selectors that records need; ``records`` maps pages to one row and
``rows`` to many, in Arrow batches. A page that is null or empty gives a record of nulls and no links.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .staging import SPAM

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_YEAR = re.compile(r"\b(1\d{3}|20\d{2})\b")
# Names of microdata on artists' pages and of their columns.
MICRODATA = {
    "birthDate": "birth", "birthPlace": "birthPlace", "deathDate": "death", "deathPlace": "deathPlace", "nationality": "nationality", "artMovement": "art_movement",
    "paintingSchool": "painting_school", "field": "field", "influencedBy": "influenced_by", "influencedOn": "influenced_on", "artInstitution": "art_institution",
    "friendsAndCoWorkers": "friends_and_co_workers", "activeYears": "active_years",
}
# Labels of artworks that get another name.
LABELS = {"media": "medium", "location": "collecting_institution", "created": "date"}


class Element:
    """A tag with its attributes and what it holds: strings and elements."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.content: list[str | Element] = []

    def walk(self) -> Iterator[Element]:
        """All elements below, in the order of the page; without recursion, as pages nest without bound."""
        stack = [iter(self.content)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.content))
                    break
            else:
                stack.pop()

    def all(self, tags: str, where: Callable[[Element], bool] | None = None, **attrs: str) -> Iterator[Element]:
        """Elements below with one of the tags (blank-separated), these attribute values, and ``where``."""
        names = tags.split()
        for e in self.walk():
            if e.tag in names and all(e.attrs.get(k) == v for k, v in attrs.items()) and (where is None or where(e)):
                yield e

    def first(self, tags: str, where: Callable[[Element], bool] | None = None, **attrs: str) -> Element | None:
        return next(self.all(tags, where, **attrs), None)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def class_like(self, pattern: str) -> bool:
        own = self.attrs.get("class", "")
        return any(re.search(pattern, c) for c in [*own.split(), own])

    def text(self) -> str:
        """The text below, less that of scripts and styles."""
        out, stack = [], [iter(self.content)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    out.append(child)
                elif child.tag not in ("script", "style"):
                    stack.append(iter(child.content))
                    break
            else:
                stack.pop()
        return "".join(out)

    def lead(self, *stops: str) -> str:
        """The text up to the first child with one of the tags."""
        out = []
        for child in self.content:
            if isinstance(child, Element) and child.tag in stops:
                break
            out.append(child if isinstance(child, str) else child.text())
        return "".join(out).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        e = Element(tag, found, self.here)
        self.here.content.append(e)
        if tag not in _VOID:
            self.here = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        e = self.here
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.here = e.parent

    def handle_data(self, data):
        self.here.content.append(data)


def parsed(html: str | None) -> Element:
    """The tree of a page; an unclosed element ends with the one around it."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _labelled(page: Element, values: Callable[[Element], Element | None], like: bool) -> Iterator[tuple[str, str]]:
    """(label, values) of list items: the struck label, and the texts of the links where the values stand."""
    for item in page.all("li", lambda e: e.class_like("dictionary-values") if like else e.has_class("dictionary-values")):
        label, place = item.first("s"), values(item)
        if label is None or place is None:
            continue
        parts = [t for a in place.all("a") if (t := a.text().strip()) and (t != "," or not like)]
        if parts:
            yield label.text().strip().rstrip(":").lower().replace(" ", "_").replace(":", ""), ", ".join(parts)


def _thumbnails(page: Element) -> dict[str, str]:
    """Small, medium and large images by their number of pixels, from the JSON that starts the page's controller."""
    main = page.first("main", **{"ng-controller": "ArtworkViewCtrl"})
    found = re.search(r"thumbnailSizesModel\s*=\s*({.*})", main.attrs.get("ng-init", "")) if main else None
    try:
        images = json.loads(unescape(found[1]))["ImageThumbnailsModel"] if found else None
        sizes = sorted(images[0]["Thumbnails"], key=lambda t: t["Width"] * t["Height"]) if images else []
        urls = [t["Url"] for t in sizes]
    except (ValueError, KeyError, TypeError, IndexError):
        return {}
    if not urls:
        return {}
    found = {"small": urls[0]}
    if len(urls) > 1:
        found["large"] = urls[-1]
    if len(urls) > 2:
        found["medium"] = urls[len(urls) // 2]
    return found


ARTWORK = "artist string, rights string, details map<string,string>, description string, wikipedia string, wikipedia_link string, small string, medium string, large string, extension string"


def artwork(page: Element) -> dict:
    """One artwork's page. A Wikipedia text is its description where the page has none of its own."""
    out: dict = {}
    name = page.first("span", itemprop="name")
    if name and (link := name.first("a")):
        out["artist"] = link.text().strip()
    if link := page.first("a", lambda e: e.has_class("copyright")):
        out["rights"] = link.text().strip()
    details = {}
    if date := page.first("span", itemprop="dateCreated"):
        details["date"] = date.text().strip()
    for label, value in _labelled(page, lambda item: item.first("span"), True):
        label = label.replace("-", "_")
        details[LABELS.get(label, label)] = value
    out["details"] = details
    tab = page.first("div", id="info-tab-description")
    if tab and (p := tab.first("p", itemprop="description")):
        out["description"] = p.lead("br", "p") or None
    if tab := page.first("div", id="info-tab-wikipediadescription"):
        if p := tab.first("p"):
            out["wikipedia" if out.get("description") else "description"] = p.lead("br", "p") or None
        if link := tab.first("a", lambda e: e.has_class("wiki-link")):
            out["wikipedia_link"] = link.attrs.get("href", "").strip() or None
    out |= _thumbnails(page)
    if out.get("small"):
        last = re.split("[?#]", out["small"])[0].rpartition("/")[2].lstrip(".")
        out["extension"] = "." + last.rpartition(".")[2] if "." in last else ".jpg"
    return out


ARTIST = "description string, wikipedia_link string, name string, data map<string,string>"


def artist(page: Element) -> dict:
    """One artist's page: the lead of its article, its link, microdata, and labelled lists, which win over microdata."""
    out: dict = {}
    if (tab := page.first("div", id="info-tab-wikipediaArticle")) and (p := tab.first("p")):
        out["description"] = p.lead("br")
    if link := page.first("a", lambda e: e.has_class("wiki-link")):
        out["wikipedia_link"] = link.attrs.get("href") or None
    data = {column: e.text().strip() for prop, column in MICRODATA.items() if (e := page.first("span", itemprop=prop))}
    out["data"] = data | dict(_labelled(page, lambda item: item, False))
    if (meta := page.first("meta", itemprop="name")) and meta.attrs.get("content"):
        out["name"] = meta.attrs["content"].strip()
    return out


def artwork_links(page: Element, base: str | None, slug: str | None, depth: int) -> list[dict]:
    """An artist's artworks on an overview page, by three strategies: links that end in the artist's slug and a name; links with the slug
    in lists whose class names works; and, where these find none, links that are nothing but the slug and a name.

    Equal links count once. Links to all works, titles shorter than 2 or longer than 60 characters and spam go; ``depth`` counts what is left."""
    name = re.escape(slug or "")
    found = list(page.all("a", lambda e: re.search(f"/{name}/[^/]+$", e.attrs.get("href", "")) is not None))
    for box in page.all("ul div", lambda e: e.class_like("artwork|painting|work|list")):
        found += box.all("a", lambda e: f"/{slug or ''}/" in e.attrs.get("href", ""))
    if not found:
        found = list(page.all("a", lambda e: re.match(f"/{name}/[^/]+/?$", e.attrs.get("href", "")) is not None))
    out: dict[str, dict | None] = {}
    kept = 0
    for link in found:
        href, title = link.attrs.get("href", ""), link.text().strip()
        if not href or href in out or kept >= depth:
            continue
        out[href] = None
        if "/all-works" in href or not 2 <= len(title) <= 60 or any(word in title.lower() for word in SPAM):
            continue
        year = _YEAR.search(title) or _YEAR.search(link.parent.text())
        out[href] = {"pos": kept, "title": title, "date": year and year[1], "path": href, "url": urljoin(base or "", href)}
        kept += 1
    return [a for a in out.values() if a]


def _mapped(pages: DataFrame, key: str, columns: list[str], html: str, schema: str, make: Callable[..., list[dict]]) -> DataFrame:
    """Rows (key and ``schema``) that ``make`` gives of each page's tree and columns."""
    kind = f"{key} {pages.schema[key].dataType.simpleString()}, {schema}"
    arrow = to_arrow_schema(T.StructType.fromDDL(kind))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, texts, *rest = (c.to_pylist() for c in part.columns)
                found = [{key: ids[i]} | row for i, text in enumerate(texts) for row in make(parsed(text), *(c[i] for c in rest))]
                if found:
                    yield pa.RecordBatch.from_pylist(found, arrow)

    return pages.select(key, html, *columns).mapInArrow(read, kind)


def artwork_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ARTWORK): one record a page."""
    return _mapped(pages, key, [], html, ARTWORK, lambda page: [artwork(page)])


def artist_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ARTIST): one record a page."""
    return _mapped(pages, key, [], html, ARTIST, lambda page: [artist(page)])


def overview_links(pages: DataFrame, key: str, url: str, slug: str, html: str, depth: int) -> DataFrame:
    """(key, pos, title, date, path, url): the artworks that overview pages link to, given the artist's slug."""
    return _mapped(pages, key, [url, slug], html, "pos int, title string, date string, path string, url string", lambda page, base, name: artwork_links(page, base, name, depth))
