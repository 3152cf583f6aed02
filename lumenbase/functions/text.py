"""Text functions on columns: slugs, title keys, names, dates, colours, captions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table(letters: range) -> tuple[str, str]:
    """Accented letters and their base letters, as Unicode decomposes them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in letters]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_ACCENTED, _BASE = _fold_table(range(0xC0, 0x250))
# Letters that do not decompose.
_WHOLE = {"þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"}
_QUOTES, _PLAIN_QUOTES = "‘’“”–—", "''\"\"--"


def fold(text: Column) -> Column:
    """Lower case, trimmed, without accents, with plain quotes and dashes."""
    out = F.translate(F.lower(F.trim(text)), _ACCENTED + _QUOTES, _BASE + _PLAIN_QUOTES)
    for letter, plain in _WHOLE.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(fold(text), r"\s+", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def url_slug(text: Column) -> Column:
    """A slug in which separators, not only blanks, become dashes."""
    out = F.regexp_replace(fold(text), "[\\s &/`'.:]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9-]", ""), "-+", "-"), "^-|-$", "")


def title_key(text: Column) -> Column:
    """Key of equal titles: accents removed, letters that do not decompose dropped, blanks squeezed."""
    out = F.lower(F.translate(text, _ACCENTED, _BASE))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-zA-Z0-9\s]", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def first_and_last(name: Column) -> Column:
    words = tokens(name)
    return F.struct(F.get(words, F.lit(0)).alias("first"), F.when(F.size(words) > 0, F.element_at(words, -1)).alias("last"))


def truncated(text: Column, most: int = 200, keep: int | None = None) -> Column:
    """Text cut at ``keep`` (default ``most``) characters with an ellipsis where it is longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep or most), F.lit("..."))).otherwise(text)


def extension(url: Column, default: str = ".jpg") -> Column:
    found = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"/[^/]*(\.[A-Za-z0-9]+)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(F.lower(found))


def is_image_url(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(jpeg|jpg|gif|png|webp)$")


def year(*texts: Column) -> Column:
    """The first year 1000-2099 in the first text that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, r"\b(1\d{3}|20\d{2})\b", 1), F.lit("")) for t in texts])


# Labels that are renamed.
LABELS = {"media": "medium", "location": "collecting_institution", "created": "date"}


def label(text: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit(":"), F.lit("")), "[ -]", "_")
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, plain), plain)


# Keyword synonyms that a lower-cased keyword can reach.
SYNONYMS = {
    "marina": ["nautical"], "nude painting (nu)": ["Nude"], "rococo": ["rococo art and design"], "lithography": ["lithograph"],
    "etching": ["etching/engraving"], "sketch and study": ["Study", "Drawing"], "battle painting": ["Conflict", "War"],
    "religious painting": ["Related to Religion"], "animal painting": ["animals"], "allegorical painting": ["Allegory"],
}


def synonyms(keyword: Column) -> Column:
    """The keywords that stand for this one; empty if none."""
    known = F.create_map(*[x for k, vs in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(keyword))), F.array().cast("array<string>"))


def listed(names: Column) -> Column:
    """'A', 'A and B', 'A, B, and C'."""
    n = F.size(names)
    most = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.when(n > 0, F.element_at(names, -1))
    return F.when(n == 0, F.lit("")).when(n == 1, last).when(n == 2, F.concat_ws(" and ", names)).otherwise(F.concat(most, F.lit(", and "), last))


def display_key(key: Column) -> Column:
    return F.replace(F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 20)), F.lit("_"), F.lit(" "))


def darkened(colour: Column, share: float = 0.6) -> Column:
    """'#rrggbb' with each part scaled down."""
    parts = [F.lpad(F.lower(F.hex(F.floor(F.conv(F.substring(colour, at, 2), 16, 10).cast("int") * share))), 2, "0") for at in (2, 4, 6)]
    return F.concat(F.lit("#"), *parts)


def description_text(kind: Column, value: Column, aliases: Column, descriptions: Column) -> Column:
    """What a text entry's description vector is made from; a missing part reads None."""
    return F.concat_ws(", ", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (kind, value, aliases, descriptions)])


def caption(title: Column, artists: Column, details: Column, keywords: Column) -> Column:
    """Title, 'by' up to three artists, 'key: value' pairs, up to five keywords; at most 200 characters."""
    pairs = F.transform(F.map_entries(details), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    by = F.when(F.size(artists) > 0, F.concat(F.lit("by "), F.array_join(F.slice(artists, 1, 3), ", ")))
    text = F.concat_ws(" ", title, by, F.array_join(pairs, " "), F.array_join(F.slice(keywords, 1, 5), " "))
    return truncated(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("Untitled artwork")), 200, 197)


def caption_values(title: Column, details: Column, keywords: Column) -> Column:
    """Values only and all keywords, joined by commas; at most 300 characters."""
    return F.substring(F.array_join(F.flatten(F.array(F.array(title), F.map_values(details), keywords)), ", "), 1, 300)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def caption_parts(text: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.split(text, ","), 1, n), ",")


def new_id(prefix: str, digits: int, *seed: Column) -> Column:
    """A stable id of hexadecimal digits from the seed columns."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *seed), 256), 1, digits))
