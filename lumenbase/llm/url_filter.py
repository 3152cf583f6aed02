"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Host, path, rule and features are Spark SQL expressions. Labelled URLs are those that a rule decides, or any table with
a ``label``. Beside the lexical features stand smoothed suffix statistics: how often labelled URLs with the same last one,
two or three labels of the host, or the same first part of the path, are blocked, and how many there are. They count all
labelled rows in ``SLOTS`` hashed slots a kind, so their size is fixed. Rows that the trees are fitted on get them from the
other ``FOLDS`` only, and one fold each sees none of the host's statistics, only the last label's, or none of the
path's, so that the trees also learn what to do with hosts and paths that nobody has labelled. The trees (second-order
boosting on feature histograms) are fitted in numpy on at most ``SAMPLE`` labelled rows, those with the smallest hashes,
and compiled to CASE expressions, so that scoring is a projection without user functions or shuffles.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged by the trees
like any other; repeated rows are judged alike; without labelled rows of both kinds every verdict is that of the kind
there is (allow if none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_code

#: action, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SAMPLE, SLOTS, FOLDS, PRIOR = 20_000, 4096, 5, 8
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT = 30, 4, 32, 0.3, 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.expr(f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def _ruled(rules: list[tuple[str, str, str]], what: str) -> str:
    """SQL for the longest fitting rule's text or action; rules are a short list, tried longest first."""
    cases = []
    for action, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        value = host + path if what == "rule" else action
        cases.append(f"when (host = '{host}' or endswith(host, '.{host}')) and startswith(path, '{path}') then '{value}'")
    return f"case {' '.join(cases)} end" if cases else "cast(null as string)"


FEATURES = {
    "url_length": "length(address)",
    "host_length": "length(host)",
    "path_length": "length(path)",
    "host_labels": "size(split(host, '[.]'))",
    "depth": "length(path) - length(replace(path, '/', ''))",
    "digit_ratio": "length(regexp_replace(address, '[^0-9]', '')) / greatest(1, length(address))",
    "path_digit_ratio": "length(regexp_replace(path, '[^0-9]', '')) / greatest(1, length(path))",
    "hyphens": "length(address) - length(replace(address, '-', ''))",
    # Shannon entropy of the address's characters, from the code points sorted into runs
    "entropy": """transform(array(array_sort(split(address, ''))), s -> aggregate(transform(array_distinct(s), c -> size(s) - size(array_remove(s, c))), 0D,
        (e, n) -> e - (n / size(s)) * log2(n / size(s))))[0]""",
    "parameters": "case when instr(address, '?') > 0 then 1 + length(address) - length(replace(address, '&', '')) else 0 end",
    "parameter_length": "case when instr(address, '?') > 0 then length(address) - instr(address, '?') else 0 end",
    "fragment": "cast(instr(address, '#') > 0 as int)",
    "secure": "cast(startswith(address, 'https') as int)",
    "first_segment_length": "length(regexp_extract(path, '^/([^/]*)', 1))",
}
#: What statistics are kept of, and the folds that see none of them in the fit.
KINDS = {
    "label1": ("substring_index(host, '.', -1)", {0}),
    "label2": ("substring_index(host, '.', -2)", {0, 1}),
    "label3": ("substring_index(host, '.', -3)", {0, 1}),
    "segment": ("regexp_extract(path, '^/([^/]*)', 1)", {2}),
}
FOLD, ALL = f"cast(pmod(xxhash64(url), {FOLDS}) as int)", -1
N_FEATURES = len(FEATURES) + 2 * len(KINDS)


def _slot(kind: str) -> str:
    return f"cast(pmod(xxhash64({KINDS[kind][0]}), {SLOTS}) as int)"


def statistics(known: DataFrame) -> tuple[DataFrame | None, float | None]:
    """(kind, slot, fold, share, seen) of labelled rows, where a fold's figures leave its own rows out and ALL has every
    row; and the share of blocked rows overall. At most SLOTS * FOLDS counts a kind come to the driver."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(_slot(k)).alias("slot")) for k in KINDS])).alias("k")
    counts = known.select(each, F.expr(FOLD).alias("fold"), "label").groupBy("k.kind", "k.slot", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).collect()
    one = [r for r in counts if r["kind"] == "label1"]
    total, blocked = sum(r["n"] for r in one), sum(r["blocked"] for r in one)
    if not 0 < blocked < total:
        return None, float(total > 0 and blocked > 0)
    prior, sums = blocked / total, {}
    for r in counts:
        for fold in [ALL, *(f for f in range(FOLDS) if f != r["fold"] and f not in KINDS[r["kind"]][1])]:
            n, b = sums.get((r["kind"], r["slot"], fold), (0, 0))
            sums[r["kind"], r["slot"], fold] = n + r["n"], b + r["blocked"]
    rows = [(*key, (b + PRIOR * prior) / (n + PRIOR), float(np.log1p(n))) for key, (n, b) in sums.items()]
    return known.sparkSession.createDataFrame(rows, "kind string, slot int, fold int, share double, seen double"), prior


def features(pages: DataFrame, shares: DataFrame, prior: float, fold: str = str(ALL)) -> DataFrame:
    """Adds the feature columns f0.. (doubles) to rows with url, host and path. ``shares`` comes from ``statistics``, a
    bounded number of rows, so it is broadcast; what it does not know has the prior share and is seen zero times."""
    df = pages.withColumn("address", F.coalesce("url", F.lit("")))
    df = df.select("*", *[F.expr(f"cast({sql} as double)").alias(f"f{i}") for i, sql in enumerate(FEATURES.values())], F.expr(fold).alias("_fold"))
    for i, kind in enumerate(KINDS):
        own = shares.where(F.col("kind") == kind).select(F.col("slot").alias("_slot"), F.col("fold").alias("_of"), F.col("share").alias("_share"), F.col("seen").alias("_seen"))
        df = df.join(F.broadcast(own), (F.expr(_slot(kind)) == F.col("_slot")) & (F.col("_fold") == F.col("_of")), "left")
        at = len(FEATURES) + 2 * i
        df = df.withColumn(f"f{at}", F.coalesce("_share", F.lit(prior))).withColumn(f"f{at + 1}", F.coalesce("_seen", F.lit(0.0))).drop("_slot", "_of", "_share", "_seen")
    return df.drop("address", "_fold")


class Trees:
    """Second-order boosting for the logistic loss on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree, values = self._grow(bins, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            raw += values
            self.trees.append(tree)

    def _grow(self, bins, g, h, rows, depth):
        total, weight = g[rows].sum(), h[rows].sum()
        values = np.zeros(len(g))
        best = (1e-6, None, None)
        for j, edges in enumerate(self.edges if depth else []):
            if len(edges):
                left_g = np.bincount(bins[rows, j], g[rows], len(edges) + 1).cumsum()[:-1]
                left_h = np.bincount(bins[rows, j], h[rows], len(edges) + 1).cumsum()[:-1]
                right_g, right_h = total - left_g, weight - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total**2 / (weight + 1)
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        _, j, k = best
        if j is None:
            leaf = float(-RATE * total / (weight + 1))
            values[rows] = leaf
            return leaf, values
        left = bins[rows, j] <= k
        a, va = self._grow(bins, g, h, rows[left], depth - 1)
        b, vb = self._grow(bins, g, h, rows[~left], depth - 1)
        return (j, float(self.edges[j][k]), a, b), va + vb

    def sql(self) -> str:
        """The probability of a block as a SQL expression over f0.."""

        def case(node) -> str:
            if isinstance(node, float):
                return f"{node!r}D"
            j, edge, a, b = node
            return f"case when f{j} <= {edge!r}D then {case(a)} else {case(b)} end"

        return f"1 / (1 + exp(-({' + '.join([f'{self.base!r}D', *map(case, self.trees)])})))"


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score). ``labelled`` (url, label 0/1) defaults to the rules' verdicts."""
    rows = parsed(pages.select("page_id", "url")).withColumn("rule", F.expr(_ruled(rules, "rule"))).withColumn("ruled", F.expr(_ruled(rules, "action")))
    if labelled is None:
        known = rows.where("ruled is not null").select("url", "host", "path", F.expr("cast(ruled = 'block' as int)").alias("label"))
    else:
        known = parsed(labelled.select("url", "label").where("label is not null"))
    shares, prior = statistics(known)
    if shares is None:
        scored = rows.withColumn("block_score", F.lit(prior))
    else:
        sample = known.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE)
        fit = features(sample, shares, prior, FOLD).select("label", *[f"f{i}" for i in range(N_FEATURES)]).collect()
        data = np.array([tuple(r) for r in fit], np.float64)
        scored = features(rows, shares, prior).withColumn("block_score", F.expr(Trees(data[:, 1:], data[:, 0]).sql()))
    verdict = F.coalesce("ruled", F.expr("case when block_score >= 0.5 then 'block' else 'allow' end"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE_SQL: dict[str, str] = {}
