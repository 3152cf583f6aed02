"""Embedding near-dedup by product quantisation.

Equal vectors are first folded into one representative with a count. A coarse k-means gives inverted lists; the
residual of each vector to its list's centroid is quantised in ``PARTS`` subspaces of ``WORDS`` codewords. A query
vector probes every list whose border with its own list it lies near to: two vectors at distance ``d`` in different
lists lie on either side of the plane between the two centroids, so one of them is within ``d / 2`` of it. With that reach
no link is lost, however near copies differ. In a probed list, table look-ups sum the asymmetric distance of the query to
each code; codes within the radius plus the code's own recorded error are reranked by exact cosine in double precision.

``spreads`` buys speed with recall, and is not used by the query: between lists whose centroids are not close (``NEAR`` times the
radius) the reach is then so many standard deviations of a share of 1 / sqrt(dimension) along the border's normal, with the
dimension measured from the sample's residuals. That finds near copies that differ evenly in all directions, and loses some
that differ along one common direction.

The number of lists grows with the table, by one for ``PER_LIST`` vectors and beyond ``FULL`` lists with the square
root, so a vector meets a number of others that grows at most with the square root. Tasks get a block of queries against
a block of a list, each of about ``BLOCK`` vectors, whatever the list and its visitors. Tasks return link counts and a
spanning forest of what they matched, not pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, and vectors of
different lengths do not link with each other; repeated rows and equal vectors link with each other, rows without a
vec_id as well; a component's id is its smallest vec_id that is not null, and a component without any keeps its rows; an
empty table gives no rows; other columns, labels included, are ignored. The coarse lists and codewords are fitted on at
most ``SAMPLE`` representatives and ``SAMPLE_BYTES``, those with the smallest hashes; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, share_code, written
from .components import components

PARTS, WORDS, PER_LIST, FULL, SAMPLE, BLOCK = 8, 64, 50, 1024, 1 << 18, 1024
NEAR, SAMPLE_BYTES = 1.75, 128 << 20
SLACK = 1e-4  # for rounding of single-precision tables


def lists_for(n: int) -> int:
    """Lists for n vectors."""
    full = FULL * PER_LIST
    return max(1, n // PER_LIST if n <= full else int(FULL * (n / full) ** 0.5))


def _kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    return _moved(points, points[np.random.default_rng(seed).permutation(len(points))[:k]].copy(), rounds)


def _moved(points: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        near = _nearest(points, centres)
        order = np.argsort(near, kind="stable")
        full, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(points[order], starts, axis=0)
        centres[full] = sums / np.diff(np.append(starts, len(points)))[:, None]
    return centres


def _coarse(points: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; many are fitted in two levels, each cell of the first getting its share, and then moved together."""
    if k <= 256:
        return _kmeans(points, k, 10, 1)
    top = _kmeans(points, int(k**0.5), 10, 1)
    cell = _nearest(points, top)
    own = [points[cell == c] for c in range(len(top))]
    return _moved(points, np.concatenate([_kmeans(p, max(1, round(k * len(p) / len(points))), 3, 3) for p in own if len(p)]), 4)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(points[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids, the reach between each two of them, and residual codebooks."""

    def __init__(self, sample: np.ndarray, n: int, radius: float, spreads: float | None):
        self.centres = _coarse(sample, min(lists_for(n), len(sample)))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        edges = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(edges, edges[1:])]
        self.books = [_kmeans(rest[:, s], min(WORDS, len(rest)), 8, 2 + i) for i, s in enumerate(self.slices)]
        values = np.linalg.eigvalsh(rest.T @ rest / len(rest))
        dimension = max(1.0, values.sum() ** 2 / max((values**2).sum(), 1e-300))
        self.near, self.whole = NEAR * radius, radius / 2
        self.far = radius / 2 if spreads is None else radius / 2 * min(1.0, spreads / dimension**0.5)

    def encode(self, units: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance between each residual and its code."""
        rest = units - self.centres[lists]
        codes = np.stack([_nearest(rest[:, s], book) for s, book in zip(self.slices, self.books)], axis=1).astype(np.uint8)
        errors = np.sqrt(sum(((rest[:, s] - book[codes[:, i]]) ** 2).sum(1) for i, (s, book) in enumerate(zip(self.slices, self.books))))
        return codes, errors

    def distances(self, units: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of every query to every code of one list, from look-up tables."""
        rest = units - self.centres[where]
        total = np.zeros((len(units), len(codes)), np.float32)
        for i, (s, book) in enumerate(zip(self.slices, self.books)):
            # the table by a matrix product; what it rounds is far below SLACK
            table = (rest[:, s] ** 2).sum(1)[:, None] + (book**2).sum(1) - 2 * rest[:, s] @ book.T
            total += table.astype(np.float32).take(codes[:, i], axis=1)
        return np.sqrt(np.maximum(total, 0))

    def offsets(self, units: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distance of each vector of list ``own`` to the plane that separates it from list ``other``."""
        a, b = self.centres[own], self.centres[other]
        gap = np.sqrt(((a - b) ** 2).sum(1))
        return (((units - b) ** 2).sum(1) - ((units - a) ** 2).sum(1)) / np.maximum(2 * gap, 1e-12)

    def admits(self, units: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether each vector of list ``own`` probes list ``other``; summed row by row, so the answer is the same whatever the rows beside it."""
        a, b = self.centres[own], self.centres[other]
        gap = np.sqrt(((a - b) ** 2).sum(1))
        return ((units - b) ** 2).sum(1) - ((units - a) ** 2).sum(1) <= 2 * np.where(gap <= self.near, self.whole, self.far) * gap + SLACK

    def probes(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every other list that a row probes, in order of rows."""
        square = (self.centres**2).sum(1)
        thin, thin_square = self.centres.astype(np.float32), square.astype(np.float32)
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), 512):
            d = thin_square - 2 * units[at : at + 512].astype(np.float32) @ thin.T
            mine = own[at : at + 512]
            each, back = np.unique(mine, return_inverse=True)
            gaps = np.sqrt(np.maximum(square[each][:, None] + square - 2 * self.centres[each] @ self.centres.T, 0))
            # single precision and a little wider than ``admits``, which decides
            reach = (2 * np.where(gaps <= self.near + 1e-6, self.whole, self.far) * gaps + 10 * SLACK).astype(np.float32)
            near = d - d[np.arange(len(d)), mine][:, None] <= reach[back]
            near[np.arange(len(d)), mine] = False
            r, c = np.nonzero(near)
            for i in range(0, len(r), 1 << 16):
                x, y = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
                sure = self.admits(units[x + at], mine[x], y)
                rows.append(x[sure] + at)
                lists.append(y[sure])
        return np.concatenate(rows), np.concatenate(lists)


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)


def _units(values: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square over- or underflows."""
    values = values / np.abs(values).max(1)[:, None]
    return values / np.sqrt((values**2).sum(1))[:, None]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the links a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        fresh = label.copy()
        np.minimum.at(fresh, x, least)
        np.minimum.at(fresh, y, least)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            return nodes, nodes[label]
        label = fresh


_PLACED = "rep long, n long, vector binary, home int, codes binary, error double, probes array<int>"
_ROWS = "place int, list_block int, query_block int, is_query boolean, rep long, n long, home int, vector binary, codes binary, error double"
_FOUND = "a long, b long, n long"


def linked(reps: DataFrame, kind: str, least: float = 0.95, spreads: float | None = None) -> DataFrame:
    """(a, b, n): partial link counts of representative a (b null), and edges a-b (n null).

    ``reps`` has rep long, n long and vector binary (components of type ``kind``), all of one length, none zero.
    """
    spark = reps.sparkSession
    total = reps.count()
    width = reps.select(F.max(F.length("vector"))).first()[0] or 1
    wanted = max(1, min(SAMPLE, 32 * lists_for(total) + 2048, SAMPLE_BYTES // width))
    sample = [r["vector"] for r in reps.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()]
    if not sample:
        return spark.createDataFrame([], _FOUND)
    radius = float(np.sqrt(2 - 2 * least))
    quantiser = Quantiser(_units(_matrix(sample, kind)), total, radius, spreads)
    shared = spark.sparkContext.broadcast(quantiser)

    def place(batches):
        q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                units = _units(_matrix(part.column(2).to_pylist(), kind))
                home = _nearest(units, q.centres)
                codes, errors = q.encode(units, home)
                row, where = q.probes(units, home)
                probes = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(units) + 1)).astype(np.int32)), pa.array(where.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), probes], ["rep", "n", "vector", "home", "codes", "error", "probes"])

    placed = written(reps.select("rep", "n", "vector").mapInArrow(place, _PLACED))
    # one row for each list: its own vectors and those that visit it
    homes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    visits = {r["home"]: r["n"] for r in placed.select(F.explode("probes").alias("home")).groupBy("home").agg(F.count("*").alias("n")).collect()}

    def deal(batches):
        lists = range(len(shared.value.centres))
        own_blocks = np.array([-(-homes.get(i, 0) // BLOCK) for i in lists], np.int64)
        ask_blocks = np.array([-(-(homes.get(i, 0) + visits.get(i, 0)) // BLOCK) for i in lists], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rep, home = np.asarray(part.column(0)), np.asarray(part.column(3)).astype(np.int64)
                probes = part.column(6)
                row = np.concatenate([np.arange(len(rep)), np.repeat(np.arange(len(rep)), np.asarray(probes.value_lengths()))])
                where = np.concatenate([home, np.asarray(probes.flatten()).astype(np.int64)])
                mix = (rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                # a query meets every block of the list in the query block that its own hash names
                lots = own_blocks[where]
                query_row, query_place = np.repeat(row, lots), np.repeat(where, lots)
                query_list = ragged(np.zeros(len(lots), np.int64), lots)
                query_block = mix[query_row] % np.maximum(ask_blocks[query_place], 1)
                # a list's vectors stand in each query block
                asks = ask_blocks[home]
                list_row = np.repeat(np.arange(len(rep)), asks)
                list_query = ragged(np.zeros(len(asks), np.int64), asks)
                list_block = mix[list_row] % own_blocks[home[list_row]]
                for is_query, r, p, lb, qb in ((True, query_row, query_place, query_list, query_block), (False, list_row, home[list_row], list_block, list_query)):
                    for i in range(0, len(r), 1 << 14):
                        take, stop = pa.array(r[i : i + (1 << 14)]), i + (1 << 14)
                        columns = [*(pa.array(x[i:stop].astype(np.int32)) for x in (p, lb, qb)), pa.array(np.full(len(take), is_query)), *(part.column(j).take(take) for j in (0, 1, 3, 2, 4, 5))]
                        yield pa.RecordBatch.from_arrays(columns, ["place", "list_block", "query_block", "is_query", "rep", "n", "home", "vector", "codes", "error"])

    def match(key, table):
        q, where = shared.value, key[0].as_py()
        is_query = np.asarray(table.column("is_query"))
        rep, n, home = (np.asarray(table.column(c)).astype(np.int64) for c in ("rep", "n", "home"))
        values = _matrix(table.column("vector").to_pylist(), kind)
        units, asks, has = _units(values), np.flatnonzero(is_query), np.flatnonzero(~is_query)
        counts, edges = np.zeros(len(rep), np.int64), [np.zeros((0, 2), np.int64)]
        if len(has):
            codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(has)).to_pylist()), np.uint8).reshape(len(has), -1)
            within = radius + np.asarray(table.column("error"))[has] + SLACK
            for at in range(0, len(asks), 512):
                ask = asks[at : at + 512]
                i, j = np.nonzero(q.distances(units[ask], where, codes) <= within)
                i, j = ask[i], has[j]
                for s in range(0, len(i), 1 << 16):
                    x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    keep = (rep[x] != rep[y]) & ((units[x] * units[y]).sum(1) >= least)
                    x, y = x[keep], y[keep]
                    # a pair is counted once: in one list by its smaller member, else by the one nearer to the border
                    inside = home[x] == where
                    dx, dy = q.offsets(units[x], home[x], home[y]), q.offsets(units[y], home[y], home[x])
                    both = q.admits(units[x], home[x], home[y]) & q.admits(units[y], home[y], home[x])
                    first = np.where(inside, rep[x] < rep[y], ~both | (dx < dy) | ((dx == dy) & (rep[x] < rep[y])))
                    x, y = x[first], y[first]
                    np.add.at(counts, x, n[y])
                    np.add.at(counts, y, n[x])
                    if len(x):
                        edges.append(np.stack(_forest(rep[x], rep[y]), axis=1))
        edge = np.concatenate(edges)
        if len(edge):
            edge = np.stack(_forest(edge[:, 0], edge[:, 1]), axis=1)
        edge = edge[edge[:, 0] != edge[:, 1]]
        some = np.flatnonzero(counts)
        a = pa.array(np.concatenate([rep[some], edge[:, 0]]))
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(edge[:, 1])])
        return pa.Table.from_arrays([a, b, pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(edge), pa.int64())])], ["a", "b", "n"])

    dealt = placed.mapInArrow(deal, _ROWS)
    return dealt.groupBy("place", "list_block", "query_block").applyInArrow(match, _FOUND)


def packed(table: DataFrame, kind: str) -> DataFrame:
    """(vec_id, vector): the components as bytes, null where a vector can link with nothing; -0.0 becomes 0.0."""
    width = int(kind[-1])

    def pack(batches):
        for batch in batches:
            column = batch.column(1)
            edges = np.asarray(column.offsets).astype(np.int64)
            x = np.asarray(column.values.fill_null(float("nan"))).astype(kind) + np.zeros(1, kind)
            bad, some = (np.concatenate([[0], np.cumsum(flags)]) for flags in (~np.isfinite(x), x != 0))
            good = np.asarray(column.is_valid()) & (bad[edges[1:]] == bad[edges[:-1]]) & (some[edges[1:]] > some[edges[:-1]])
            raw = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(edges * width), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(good), raw, None).cast(pa.binary())], ["vec_id", "vector"])

    return table.mapInArrow(pack, "vec_id long, vector binary")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95, spreads: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    table = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    single = isinstance(table.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = written(packed(table if single else table.withColumn("embedding", F.col("embedding").cast("array<double>")), kind))
    folded = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    reps = written(folded.withColumn("rep", F.monotonically_increasing_id()))
    # vectors of one length are compared with each other; a row for each length that occurs
    sizes = [r["size"] for r in reps.groupBy(F.length("vector").alias("size")).count().where("count > 1").collect()]
    found = _found(reps, [linked(reps.where(F.length("vector") == size), kind, least, spreads) for size in sizes])
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    members = written(reps.join(counts, "rep", "left").join(roots, "rep", "left").select("vector", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    firsts = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(members.join(firsts, "root").select(F.col("vector").alias("class_vector"), "n_links", "component_id"))
    joined = rows.join(classes, F.col("vector") == F.col("class_vector"), "left")
    component = F.when(F.col("class_vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _found(reps: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = reps.sparkSession.createDataFrame([], _FOUND)
    for part in parts:
        out = out.union(part)
    return written(out)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLE_SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE good AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r, a.vec_id, b.vec_id AS other FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(vec_id, other) AS (
    SELECT vec_id, other FROM links UNION SELECT reach.vec_id, links.other FROM reach JOIN links ON reach.other = links.vec_id
), counts AS (
    SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id
), roots AS (
    SELECT vec_id, min(other) AS root FROM reach GROUP BY vec_id
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(root, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(root, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""
}
