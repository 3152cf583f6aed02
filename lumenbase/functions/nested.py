"""Arrays, maps and JSON text in columns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders in which callers prefer image sizes.
SIZES = {
    "lookup": ["large", "medium", "larger", "small", "square", "tall"],
    "map": ["large", "larger", "medium", "small"],
    "index": ["small", "medium", "medium_rectangle", "normalized", "large", "larger"],
    "build": ["small", "square", "medium", "normalized", "medium_rectangle", "large"],
    "proxy": ["medium", "small", "square", "medium_rectangle", "normalized", "large", "large_rectangle"],
    "titles": ["medium", "small", "normalized", "large"],
    "vectors": ["medium", "small", "normalized", "large", "larger"],
    "download": ["small", "medium", "medium_rectangle", "normalized", "square", "large"],
    "browse": ["medium", "small", "square", "normalized"],
    "node": ["medium", "large", "image_url"],
}
OR_ANY = {"titles", "vectors", "download", "browse", "node"}


def preferred(urls: Column, caller: str) -> Column:
    """The first URL of the caller's preferred sizes; for some callers else any."""
    found = [F.try_element_at(urls, F.lit(size)) for size in SIZES[caller]]
    return F.coalesce(*found, F.get(F.map_values(urls), F.lit(0))) if caller in OR_ANY else F.coalesce(*found)


def non_empty(text: Column) -> Column:
    """Neither null nor '' nor '[]'."""
    return text.isNotNull() & ~text.isin("", "[]")


def parsed(text: Column, kind: str, default: Column | None = None) -> Column:
    """Strict JSON of a type, or the default."""
    out = F.from_json(text, kind, {"allowSingleQuotes": "false"})
    return out if default is None else F.coalesce(out, default)


def cleaned(text: Column, default: str = "{}") -> Column:
    """JSON text rewritten by a parser; the default if it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.lit(default))


def appended(array: Column, item: Column) -> Column:
    return F.when(F.array_contains(array, item), array).otherwise(F.array_append(array, item))


def first_put(array: Column, item: Column) -> Column:
    return F.when(F.array_contains(array, item), array).otherwise(F.array_prepend(array, item))


def replaced(array: Column, old: Column, new: Column) -> Column:
    return F.array_distinct(F.transform(array, lambda x: F.when(x == old, new).otherwise(x)))


def union_sorted(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def merged(primary: Column, secondary: Column) -> Column:
    """Both maps' entries; the primary's value where they clash."""
    return F.map_concat(primary, F.map_filter(secondary, lambda k, _: ~F.map_contains_key(primary, k)))


def updated(stored: Column, found: Column) -> Column:
    """Stored entries, overwritten by what was found."""
    return F.map_zip_with(stored, found, lambda _, old, new: F.coalesce(new, old))


def capped(keywords: Column, n: Column) -> Column:
    """The first 3 to 7 keywords."""
    return F.slice(keywords, 1, F.least(F.lit(7), F.greatest(F.lit(3), n)))


def description_list(descriptions: Column, first: str = "synth") -> Column:
    """Map entries as a list, the named source before the others."""
    entries = F.map_entries(descriptions)
    return F.concat(F.filter(entries, lambda e: e["key"] == first), F.filter(entries, lambda e: e["key"] != first))


def _kind(text: str | None, is_array: bool) -> tuple[str | None, str | None]:
    if text is None or text == "":
        return None, None
    try:
        json.loads(text)
        return None, None
    except ValueError:
        pass
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        bare = is_array and text.strip() and not any(c in text for c in "[]{}\"'")
        return ("bare_string", json.dumps([text.strip()])) if bare else ("truly_malformed", None)
    if isinstance(value, list):
        return "python_list", json.dumps(value)
    if isinstance(value, dict):
        return "python_dict", json.dumps(value)
    if isinstance(value, str) and is_array:
        return "bare_string", json.dumps([value])
    return "unknown_python_object", None


def json_issue(text: Column, is_array: Column) -> Column:
    """struct(kind, converted): what is wrong with JSON text and its repair; null kind if nothing is."""

    @F.pandas_udf("kind string, converted string")
    def issue(texts: pd.Series, arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_kind(t, bool(a)) for t, a in zip(texts, arrays)], columns=["kind", "converted"])

    return issue(text, is_array)
