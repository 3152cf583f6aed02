"""Text, JSON, HTML and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import text as X
from ..operators import html as H
from ..operators import integrity as I
from ..operators import keywords as K
from ..operators import staging as S
from .registry import Tables, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark)
    SELECT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, CAST(i - 1 AS INTEGER) AS start, CAST(i + n - 2 AS INTEGER) AS stop
    FROM w, range(1, 4) r(n), range(1, 1000) s(i) WHERE i + n - 1 <= len(w)""")
def ngrams(t: Tables):
    return K.ngrams(t.benchmark, "item_id", "text")


@query("""WITH RECURSIVE words AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
    grams AS (SELECT item_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, i - 1 AS start, i + n - 2 AS stop FROM words, range(1, 4) r(n), range(1, 1000) s(i) WHERE i + n - 1 <= len(w)),
    said AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
    counted AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS phrase, count(*) AS n_said FROM said, range(1, 4) r(n), unnest(range(1, len(w) + 1)) AS s(i) WHERE i + n - 1 <= len(w) GROUP BY 1),
    spans AS (SELECT item_id, stop, list({'start': start, 'phrase': phrase, 'score': length(phrase)::DOUBLE / 20} ORDER BY start) AS l FROM grams JOIN counted USING (phrase)
              WHERE n_said >= 3 AND length(phrase) >= 4 AND length(phrase)::DOUBLE / 20 >= 0.25 GROUP BY item_id, stop),
    sizes AS (SELECT item_id, max(stop) + 1 AS n FROM spans GROUP BY item_id),
    best(item_id, n, pos, totals, choices) AS (
        SELECT item_id, n, 0, [0.0::DOUBLE], []::STRUCT(start BIGINT, phrase VARCHAR, score DOUBLE)[] FROM sizes
        UNION ALL SELECT b.item_id, n, pos + 1,
            list_append(totals, greatest(totals[pos + 1], coalesce(list_max(list_transform(l, lambda c: totals[c.start + 1] + c.score)), 0))),
            list_append(choices, CASE WHEN list_max(list_transform(l, lambda c: totals[c.start + 1] + c.score)) > totals[pos + 1]
                THEN list_filter(l, lambda c: totals[c.start + 1] + c.score = list_max(list_transform(l, lambda d: totals[d.start + 1] + d.score)))[1] END)
        FROM best b LEFT JOIN spans s ON b.item_id = s.item_id AND s.stop = pos WHERE pos < n),
    chosen AS (SELECT item_id, n, choices FROM best WHERE pos = n),
    walk(item_id, choices, here) AS (SELECT item_id, choices, n FROM chosen
        UNION ALL SELECT item_id, choices, CASE WHEN choices[here] IS NULL THEN here - 1 ELSE choices[here].start END FROM walk WHERE here > 0)
    SELECT item_id, CAST(choices[here].start AS INTEGER) AS start, CAST(here - 1 AS INTEGER) AS stop, choices[here].phrase AS id, choices[here].score AS similarity FROM walk WHERE here > 0 AND choices[here] IS NOT NULL""")
def keyword_spans(t: Tables):
    """The lexicon holds the benchmark's phrases of one to three words that documents use at least three times, so spans overlap
    and the schedule decides. One scan of the documents, in which only these phrases are looked up; a longer phrase weighs more."""
    grams = K.ngrams(t.benchmark, "item_id", "text")
    counted = K.counted(t.documents, "text", grams)
    lexicon = counted.where("n >= 3 and length(phrase) >= 4").select("phrase", F.col("phrase").alias("id"), (F.length("phrase") / 20.0).alias("similarity"))
    return K.best_spans(K.candidates(grams, lexicon, None, 0.25), "item_id")


@query("""SELECT event_id, CASE event_id % 50 WHEN 1 THEN 'python_list' WHEN 2 THEN 'truly_malformed' WHEN 3 THEN 'bare_string' WHEN 4 THEN 'python_dict' END AS kind,
    CASE event_id % 50 WHEN 1 THEN '["a", "b"]' WHEN 3 THEN '["plain"]' WHEN 4 THEN '{"k": 1}' END AS converted FROM events WHERE event_id % 50 BETWEEN 1 AND 4""")
def json_validity(t: Tables):
    text = F.expr("case event_id % 50 when 1 then \"['a', 'b']\" when 2 then '[\"a\", ' when 3 then 'plain' when 4 then \"{'k': 1}\" else props end")
    found = t.events.select("event_id", N.json_issue(text, F.expr("event_id % 50 <> 2")).alias("i"))
    return found.where("i.kind is not null").select("event_id", "i.kind", "i.converted")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 5 = 1 THEN 'missing_scheme_or_host' WHEN page_id % 5 = 2 THEN 'status_404' END AS issue FROM pages WHERE page_id % 5 < 3""")
def url_parts_valid(t: Tables):
    url = F.expr("case page_id % 5 when 0 then '' when 1 then regexp_replace(url, '^[a-z]+://', '') else url end")
    rows = t.pages.select("page_id", F.create_map(F.lit("small"), url).alias("urls"))
    status = t.pages.select("page_id", "url", F.expr("case when page_id % 5 = 2 then 404 else 200 end").alias("code"))
    return I.url_issues(rows, "page_id", "urls", status).select("page_id", "issue")


@query("""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower(trim(text)), 'ß', 'ss')), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug,
    length(text) > 30 AS long, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS short FROM benchmark""")
def slug(t: Tables):
    return t.benchmark.select("item_id", X.slug(F.col("text")).alias("slug"), (F.length("text") > 30).alias("long"), X.truncated(F.col("text"), 30).alias("short"))


def _plain(text: str) -> str:
    """SQL that decodes the entities of a text and joins its words by single spaces."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _tag(tag: str) -> str:
    return f"""nullif({_plain(f"regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)")}, '') AS {tag}"""


@query(f"SELECT page_id, {_tag('title')}, {_tag('h1')} FROM pages")
def html_fields(t: Tables):
    return H.fields(t.pages, "page_id", "html").select("page_id", "title", "h1")


@query(f"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS link,
        unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS words, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS i FROM pages),
    d AS (SELECT page_id, CASE WHEN link LIKE '/%' THEN site || link ELSE link END AS href, min(i) AS first_i, arg_min(words, i) AS words FROM l GROUP BY ALL),
    p AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_i) - 1 AS pos, href, {_plain('words')} AS anchor FROM d)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, href, anchor FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM p WHERE NOT contains(href, '/all-works')) WHERE n <= 5""")
def html_links(t: Tables):
    return H.first_links(H.links(t.pages, "page_id", "url", "html"), "page_id", ~F.contains("href", F.lit("/all-works")), 5)


@query(r"SELECT doc_id, nullif(regexp_extract(text, '\b(1\d{3}|20\d{2})\b', 1), '') AS year FROM documents")
def year_extract(t: Tables):
    return t.documents.select("doc_id", X.year(F.col("text")).alias("year"))


_SPAM = "|".join(S.SPAM)


@query(f"SELECT page_id, length(trim(title)) BETWEEN 2 AND 60 AND NOT regexp_matches(lower(title), '{_SPAM}') AS good FROM (SELECT page_id, {_tag('title')} FROM pages)")
def spam_filter(t: Tables):
    return H.fields(t.pages, "page_id", "html").select("page_id", S.good_title(F.col("title")).alias("good"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'public|commons|cc|domain|open')")
def rights_filter(t: Tables):
    return t.documents.where(S.open_rights(F.col("text"))).select("doc_id")


@query(r"""SELECT doc_id, CASE WHEN NOT coalesce(length(split_part(text, chr(10), 1)) <= 60, false) THEN 'title_length' WHEN NOT regexp_matches(text, '\b(1\d{3}|20\d{2})\b') THEN 'date'
    WHEN coalesce(source, '') = '' THEN 'rights' WHEN coalesce(lang, '') = '' THEN 'metadata' END AS failure FROM documents""")
def artwork_rules(t: Tables):
    details = F.create_map(F.lit("date"), X.year(F.col("text")), F.lit("style"), F.col("lang"))
    rules = S.artwork_rules(F.expr("split_part(text, '\n', 1)"), details, F.col("source"))
    return t.documents.select("doc_id", I.first_failure(rules).alias("failure"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 IN (1, 3) THEN NULL ELSE n_name END AS artist FROM nation""")
def artist_names(t: Tables):
    raw = F.expr("case n_nationkey % 4 when 0 then 'Artist: ' || n_name when 1 then 'After ' || n_name when 2 then ' ' || n_name || ' ' else '12345' end")
    return t.nation.select("n_nationkey", S.artist_name(raw).alias("artist"))


@query("""SELECT n_regionkey, CASE count(*) WHEN 1 THEN min(n_name) WHEN 2 THEN string_agg(n_name, ' and ' ORDER BY n_name)
    ELSE array_to_string(list(n_name ORDER BY n_name)[:-2], ', ') || ', and ' || max(n_name) END AS listed FROM nation GROUP BY n_regionkey""")
def name_lists(t: Tables):
    names = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", X.listed(F.col("names")).alias("listed"))


@query("""SELECT page_id, CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*(\\.[A-Za-z0-9]+)$', 1) = '' THEN '.jpg' ELSE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*(\\.[A-Za-z0-9]+)$', 1)) END AS extension FROM pages""")
def url_extension(t: Tables):
    return t.pages.select("page_id", X.extension(F.col("url")).alias("extension"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'L' WHEN event_id % 3 = 1 THEN 'M' ELSE 'T' END AS url FROM events""")
def image_preference(t: Tables):
    urls = F.expr("case event_id % 3 when 0 then map('small', 'S', 'large', 'L') when 1 then map('tall', 'T', 'medium', 'M') else map('tall', 'T') end")
    return t.events.select("event_id", N.preferred(urls, "lookup").alias("url"))


@query("SELECT n_nationkey, list_sort(list_distinct(list_concat([n_nationkey, n_regionkey], [n_regionkey, 99]))) AS ids, CASE WHEN n_nationkey IN (1, 2, 3) THEN [1, 2, 3] ELSE [1, 2, 3, n_nationkey] END AS appended FROM nation")
def set_operations(t: Tables):
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    ids = N.union_sorted(F.array("n_nationkey", "n_regionkey"), F.array("n_regionkey", F.lit(99)))
    return t.nation.select("n_nationkey", ids.alias("ids"), N.appended(three, F.col("n_nationkey")).alias("appended"))
