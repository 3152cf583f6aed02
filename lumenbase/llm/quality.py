"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Spark SQL expression over the words and lines of one row, so the whole
operator is a scan and a projection: no shuffle, no Python. Rules are data: a table of
``(name, expression, least, most)``; a document is kept if it passes the base rules and every rule.

Defined results: null or empty text has no words, so it fails the base rule ``n_words < 20``;
all other columns are ignored, and output holds only the columns named here, so clashing extra
columns of the input cannot interfere. Repeated rows give repeated results. Repeated 8-word
windows are found by their 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Common function words of the four languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "this", "or", "from", "at", "an", "a",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von", "sich", "des", "auf", "für", "im", "dem", "auch", "als", "es",
    "le", "la", "les", "de", "et", "un", "une", "est", "dans", "que", "pour", "qui", "sur", "pas", "du", "par", "au", "en", "il", "ne", "se", "ce",
    "el", "los", "las", "y", "del", "una", "por", "con", "no", "para", "su", "al", "lo", "como", "más", "o", "pero", "sus",
]

#: name, ratio (over the measures below), least, most. ``None`` leaves that side open.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.2),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.4),
    ("shouting_ratio", "n_marks / n_words", None, 0.5),
]
#: WINDOW is what three doublings span.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

_BLANK = r"[\\x20\\x09-\\x0D]"


def _measures(text: str) -> list[list[tuple[str, str]]]:
    """Layers of SQL expressions; each layer may use the names of the ones before it."""
    stop = ", ".join(f"'{form}'" for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize())))
    # doubling: a hash of words i..i+2k-1 from those of i..i+k-1 and i+k..i+2k-1
    doubled = [[("hashes", f"transform(hashes, (h, i) -> xxhash64(h, get(hashes, i + {k})))")] for k in (1, 2, 4)]
    # sorted (hash, position) pairs; positions whose hash has an equal neighbour; words that their windows cover
    covered = f"""transform(array(sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i)))), s ->
        aggregate(sort_array(transform(filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h)), x -> x.i)),
            named_struct('n', 0, 'end', 0),
            (a, p) -> named_struct('n', a.n + {WINDOW} - greatest(0, a.end - p), 'end', p + {WINDOW}), a -> a.n))[0]"""
    return [
        [("text", f"coalesce({text}, '')")],
        [
            ("words", rf"array_remove(split(text, '{_BLANK}+'), '')"),
            ("lines", rf"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
            ("n_symbols", "cast(regexp_count(text, '[#*$%&|<>]') as long)"),
            ("n_marks", "cast(regexp_count(text, '[!?]') as long)"),
        ],
        [
            ("n_words", "size(words)"),
            ("n_lines", "size(lines)"),
            ("word_chars", "cast(length(array_join(words, '')) as long)"),
            ("n_dup_lines", "cast(size(lines) - size(array_distinct(lines)) as long)"),
            ("n_stop_words", f"size(filter(words, w -> w in ({stop})))"),
        ],
        [("hashes", "transform(words, w -> xxhash64(w))")],
        *doubled,
        [("hashes", f"slice(hashes, 1, greatest(0, n_words - {WINDOW - 1}))")],
        [("n_repeat_words", f"case when size(array_distinct(hashes)) = size(hashes) then 0L else cast({covered} as long) end")],
    ]


def _passes(ratio: str, least: float | None, most: float | None) -> str:
    bounds = [f"{ratio} >= {least}D" for _ in [0] if least is not None] + [f"{ratio} <= {most}D" for _ in [0] if most is not None]
    return " and ".join(bounds)


def judged(docs: DataFrame, rules: list = RULES, text: str = "text") -> DataFrame:
    """(row, measures, ok_<rule>, base_failed, kept): the whole input row as a struct (c0, c1, ...) beside its verdict."""
    df = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # by position: any name will do
    df = df.select(F.struct(*df.columns).alias("row"), F.col(f"c{docs.columns.index(text)}").alias("text"))
    for layer in _measures("text"):
        names = [name for name, _ in layer]
        df = df.select(*[c for c in df.columns if c not in names], *[F.expr(sql).alias(name) for name, sql in layer])
    df = df.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    checks = [F.coalesce(F.expr(f"case when base_failed then false else {_passes(ratio, least, most)} end"), F.lit(False)).alias(f"ok_{name}") for name, ratio, least, most in rules]
    df = df.select("row", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *checks)
    kept = F.expr(" and ".join(["not base_failed", *[f"ok_{name}" for name, *_ in rules]]))
    # The row number is not deterministic, so Catalyst neither merges nor pushes filters through this projection; a
    # filter below it would write out each layer once for each use in the next.
    whole = F.when(F.monotonically_increasing_id() >= 0, F.struct(*df.columns, kept.alias("kept")))
    return df.select(whole.alias("judged")).select("judged.*")


def quality_rules(docs: DataFrame, rules: list = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, measures, ``base_failed``, a boolean per rule, ``kept``."""
    df = judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rules)
    return df.select(F.col("row.c0").alias("doc_id"), *df.columns[1:])


def kept_documents(docs: DataFrame, rules: list = RULES, text: str = "text") -> DataFrame:
    """The input rows, all columns, that the rules keep."""
    return judged(docs, rules, text).where("kept").select("row.*").toDF(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op3_quality_rules": op3_quality_rules}
_FORMS = ", ".join(f"'{form}'" for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize())))
_CHECKS = {f"ok_{name}": _passes(ratio, least, most).replace("D", "") for name, ratio, least, most in RULES}
ORACLE_SQL = {
    "op3_quality_rules": rf"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
    SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS h FROM split, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i)
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS met FROM windows), range({WINDOW}) AS o(k) WHERE met > 1 GROUP BY doc_id
), measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
           len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(list_filter(w, lambda x: x IN ({_FORMS}))) AS n_stop_words,
           coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (doc_id)
), based AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured
), ruled AS (
    SELECT *, {", ".join(f"CASE WHEN base_failed THEN false ELSE {sql} END AS {name}" for name, sql in _CHECKS.items())} FROM based
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {", ".join(_CHECKS)}, NOT base_failed AND {" AND ".join(_CHECKS)} AS kept FROM ruled
"""
}
