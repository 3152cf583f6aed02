"""Nearest neighbours by L2 distance, similarity = 1 - distance, placement of new points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V

#: Query vectors, and bytes of these (or of centroids), that are broadcast; more are dealt in blocks of BLOCK_ROWS on the executors.
MOST_QUERIES, MOST_BYTES, BLOCK_ROWS = 20_000, 32 << 20, 4096
#: Vectors of one owner that a task compares with as many others.
PAIR_BLOCK = 2048


def knn(index: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, distance): the k nearest; ties by key. One projection and a TakeOrdered."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.select(key, V.l2(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _near(q: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows and what ties with them, among those within its limit.

    A matrix product screens, with room for its rounding; distances that are kept are summed from differences."""
    out = []
    xx = (x**2).sum(1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        qq = (part**2).sum(1)
        square = xx + qq[:, None] - 2 * part @ x.T
        kth = np.partition(square, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        room = 1e-12 * (qq + xx.max()) * x.shape[1]
        i, j = np.nonzero(square <= np.minimum(kth, limit[at : at + 256] ** 2 + room)[:, None] + room[:, None])
        out.append((i + at, j, np.sqrt(((part[i] - x[j]) ** 2).sum(1))))
    return tuple(np.concatenate(c) for c in zip(*out))


def _pruned(found: pa.Table, k: int) -> pa.Table:
    """The k first rows (position, distance, key) of each position."""
    found = found.take(pa.compute.sort_indices(found, [("position", "ascending"), ("distance", "ascending"), ("key", "ascending")]))
    at = np.asarray(found.column("position"))
    first = np.searchsorted(at, at)
    return found.filter(pa.array(np.arange(len(at)) - first < k))


def _candidates(keys: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"position": found[0], "distance": found[2], "key": keys.take(pa.array(found[1]))})


def _named(found: pa.Table, ids: pa.Array, query_key: str, key: str) -> pa.Table:
    return pa.table([ids.take(found.column("position").combine_chunks()), found.column("key"), found.column("distance")], [query_key, key, "distance"])


def knn_join(index: DataFrame, queries: DataFrame, k: int, key: str = "id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_key, key, distance, rank): the k nearest of each query; ties by key; null vectors are left out.

    Queries are counted. Up to ``MOST_QUERIES`` and ``MOST_BYTES`` of them are broadcast, and each scan partition keeps the k best of each query, so k rows
    a query and partition are shuffled, whatever the index holds. More queries are dealt to the executors: blocks of queries meet
    blocks of the index, and no group holds more than two blocks. Only counts and the broadcast queries pass the driver."""
    asks = queries.select(query_key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = index.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, distance double"
    count, size = asks.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    near = _broadcast_best if count <= MOST_QUERIES and count * size * 8 <= MOST_BYTES else _block_best
    order = Window.partitionBy(query_key).orderBy("distance", key)
    return near(rows, asks, k, key, query_key, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _broadcast_best(rows: DataFrame, asks: DataFrame, k: int, key: str, query_key: str, schema: str) -> DataFrame:
    held = asks.toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((held.column(0).combine_chunks(), _matrix(held.column(1)) if held.num_rows else None))

    def best(batches):
        ids, q = shared.value
        found, limit = None, np.full(len(ids), np.inf)
        for batch in batches:
            if not batch.num_rows or q is None:
                continue
            new = _candidates(batch.column(0), _near(q, _matrix(batch.column(1)), k, limit))
            found = new if found is None else pa.concat_tables([found, new])
            if len(found) > 2 * k * len(ids):
                found = _pruned(found, k)
                at, counts = np.unique(np.asarray(found.column("position")), return_counts=True)
                last = np.asarray(found.column("distance"))[np.cumsum(counts) - 1]
                limit[at[counts == k]] = last[counts == k]
        if found is not None:
            yield from _named(_pruned(found, k), ids, query_key, key).combine_chunks().to_batches(max_chunksize=10_000)

    return rows.mapInArrow(best, schema)


def _block_best(rows: DataFrame, asks: DataFrame, k: int, key: str, query_key: str, schema: str) -> DataFrame:
    def cut(df: DataFrame, by: str, own: str, other: str, own_blocks: int, other_blocks: int) -> DataFrame:
        placed = df.withColumn(own, F.expr(f"cast(pmod(xxhash64(`{by}`), {own_blocks}) as int)"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    ask_blocks, row_blocks = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (asks, rows))
    left = cut(asks, query_key, "_q", "_i", ask_blocks, row_blocks).groupBy("_q", "_i")
    right = cut(rows, key, "_i", "_q", row_blocks, ask_blocks).groupBy("_q", "_i")

    def meet(group, some, others):
        ids, keys = some.column(query_key).combine_chunks(), others.column(key).combine_chunks()
        if not len(ids) or not len(keys):
            return _named(_candidates(keys[:0], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))), ids, query_key, key)
        found = _near(_matrix(some.column("v")), _matrix(others.column("v")), k, np.full(len(ids), np.inf))
        return _named(_pruned(_candidates(keys, found), k), ids, query_key, key)

    return left.cogroup(right).applyInArrow(meet, schema)


def best_per_id(found: DataFrame, k: int, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """The nearest row of each id, then the k nearest."""
    by = by or []
    best = found.groupBy(*by, key).agg(F.min("distance").alias("distance"))
    if not by:
        return best.orderBy("distance", key).limit(k)
    order = Window.partitionBy(*by).orderBy("distance", key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_of(description: DataFrame, value: DataFrame, query: list[float], k: int, search_in: str = "both", key: str = "id", vector: str = "embedding") -> DataFrame:
    """Search the description index, the value index, or both with the best distance of each id."""
    if search_in not in ("description", "value", "both"):
        raise ValueError("search_in is description, value or both")
    parts = [knn(t, query, k, key, vector) for name, t in (("description", description), ("value", value)) if search_in in (name, "both")]
    return best_per_id(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), k, key)


def with_details(found: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Neighbours that have details, nearest first; the few neighbours are the broadcast side, since top-k bounds them."""
    return details.join(F.broadcast(found), key).orderBy("distance", key)


def similar_above(index: DataFrame, query: list[float], least: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.select(key, V.similarity(V.l2(F.col(vector), q)).alias("similarity")).where(F.col("similarity") >= least)


def similar_pairs(rows: DataFrame, owner: str, key: str, vector: str, above: float, block: int = PAIR_BLOCK) -> DataFrame:
    """Pairs of one owner's vectors with cosine over ``above`` (strict).

    An owner's rows are cut into blocks by their keys' hashes and each two of its blocks meet in a group, so no group
    holds more than two blocks, whatever the owner. A group's cosines are one matrix product over unit vectors."""
    sizes = rows.groupBy(owner).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    cut = rows.select(owner, F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").join(sizes, owner)
    cut = cut.withColumn("own", F.expr("cast(pmod(xxhash64(key), _n) as int)")).withColumn("other", F.explode(F.expr("sequence(0, _n - 1)")))
    dealt = cut.select(owner, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "v")
    kinds = rows.select(owner, key).schema
    schema = f"{owner} {kinds[owner].dataType.simpleString()}, a {kinds[key].dataType.simpleString()}, b {kinds[key].dataType.simpleString()}, similarity double"

    def compare(group, table):
        keys, own = table.column("key"), np.asarray(table.column("own"))
        order = pa.compute.array_sort_indices(keys.combine_chunks())
        rank = np.empty(len(keys), np.int64)
        rank[np.asarray(order)] = np.arange(len(keys))
        v = np.array(table.column("v").to_pylist(), np.float64)
        length = np.sqrt((v**2).sum(1))
        v /= np.where(length > 0, length, 1)[:, None]
        first = np.flatnonzero(own == group[1].as_py())
        second = first if group[1] == group[2] else np.flatnonzero(own == group[2].as_py())
        cosine = v[first] @ v[second].T
        x, y = np.nonzero(cosine > above)
        similarity, x, y = cosine[x, y], first[x], second[y]
        keep = rank[x] < rank[y] if group[1] == group[2] else rank[x] != rank[y]
        x, y, similarity = x[keep], y[keep], similarity[keep]
        a, b = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
        return pa.Table.from_arrays([pa.array([group[0].as_py()] * len(a), table.schema.field(owner).type), keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(similarity)], [owner, "a", "b", "similarity"])

    pairs = dealt.groupBy(owner, "i", "j").applyInArrow(compare, schema)
    return pairs.withColumn("distance", 1 - F.col("similarity"))


def capped_pairs(pairs: DataFrame, sizes: DataFrame, owner: str, most: int = 500) -> DataFrame:
    """The first ``most`` pairs of a review, owners with most items first."""
    order = [F.desc("items"), F.col(owner), F.col("a"), F.col("b")]
    return pairs.join(sizes, owner).orderBy(*order).limit(most)


def minmax(points: DataFrame, columns: list[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Each column scaled to [low, high]; a constant column becomes ``low``. The extremes are one broadcast row."""
    stats = points.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])

    def scaled(c: str) -> Column:
        least, most = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(most > least, (F.col(c) - least) / (most - least) * (high - low) + low).otherwise(F.lit(low))

    return points.join(F.broadcast(stats)).select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in points.columns])


def placed(neighbours: DataFrame, coordinates: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(by, x, y): mean of the neighbours' coordinates weighted by 1 / (1 + distance)."""
    w = 1 / (1 + F.col("distance"))
    joined = neighbours.join(coordinates, key)
    total = F.sum(w)
    return joined.groupBy(*by).agg((F.sum(w * F.col("x")) / total).alias("x"), (F.sum(w * F.col("y")) / total).alias("y"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, vector: str, centroid: str = "centroid_id", most: int = 10_000) -> DataFrame:
    """(key, centroid, distance): the nearest; ties by centroid. Up to ``most`` centroids and ``MOST_BYTES`` are broadcast and points are not
    shuffled; more meet the points in blocks, as in ``knn_join``."""
    rows = points.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    middle = centroids.select(centroid, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    schema = f"{key} {points.schema[key].dataType.simpleString()}, {centroid} {centroids.schema[centroid].dataType.simpleString()}, distance double"
    count, size = middle.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if count > most or count * size * 8 > MOST_BYTES:
        best = _block_best(middle, rows, 1, centroid, key, schema).groupBy(key).agg(F.min(F.struct("distance", centroid)).alias("near"))
        return best.select(key, f"near.{centroid}", "near.distance")
    held = middle.toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((held.column(0).combine_chunks(), _matrix(held.column(1)) if held.num_rows else None))

    def find(batches):
        ids, c = shared.value
        for batch in batches:
            if batch.num_rows and c is not None:
                x = _matrix(batch.column(1))
                found = _near(x, c, 1, np.full(len(x), np.inf))
                yield from _named(_pruned(_candidates(ids, found), 1), batch.column(0), key, centroid).combine_chunks().to_batches()

    return rows.mapInArrow(find, schema)


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): component means by exploding positions, so partial aggregation sees rows of numbers only."""
    parts = rows.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def not_yet(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key has not been handled yet."""
    return rows.join(done.select(key), key, "left_anti")
