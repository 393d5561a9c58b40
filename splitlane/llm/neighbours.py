"""Approximate nearest neighbours: inverted lists, scanned with adaptive dimensions.

Vectors are put into the list of their nearest centre. A query looks through its
nearest lists. Within a list, rotated vectors are compared block of columns by block of
columns, and a hypothesis test on the distance so far abandons candidates that are
unlikely to come among the best; those left are measured exactly, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlane.llm.tables import id_order
from splitlane.session import settle

LISTS = 64
PROBES = 44  # lists that a query looks through at least
SAMPLE = 20_000  # vectors that the centres may be fitted to
BLOCK = 16_384  # vectors, and queries, that meet in one task
COLUMNS = 16  # dimensions added between two tests
EPSILON = 2.1  # of the test: larger abandons later and loses fewer neighbours
CHUNK = 1024
ROUNDS = 10

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>): ids and vectors that take part.

    Left out are null ids, and vectors that are null, zero, hold null or non-finite
    components, or have another number of dimensions than most (ties: than the fewest).
    Of rows sharing an id, the vector with the smallest hash counts.
    """
    v = F.col("embedding").cast("array<double>")
    sound = vectors.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    common = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = common.n if common else 0
    return sound.filter(F.size("v") == width).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def fit_centres(points: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's algorithm from distinct starting points; as many centres as there are, if fewer."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(5)
    centres = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(ROUNDS):
        nearest = nearest_centres(points, centres)[:, 0]
        number = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of all centres for each point, nearest first."""
    gap = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
    return np.argsort(gap, axis=1, kind="stable")


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(3).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scan_list(query: np.ndarray, vectors: np.ndarray, turned_query, turned, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of candidates for the ``k`` nearest; ties at the edge are all kept."""
    width = vectors.shape[1]
    places, scores, limit = np.zeros(0, np.int64), np.zeros(0), np.inf
    # The first few are measured in full, to have a bar for the others.
    for at, to in [(0, 4 * k), *((i, i + CHUNK) for i in range(4 * k, len(vectors), CHUNK))]:
        left = np.arange(at, min(to, len(vectors)))
        so_far = np.zeros(len(left))
        for lo in range(0, width - COLUMNS if np.isfinite(limit) else 0, COLUMNS):
            hi = lo + COLUMNS
            so_far += ((turned[left, lo:hi] - turned_query[lo:hi]) ** 2).sum(axis=1)
            bar = limit**2 * (hi / width) * (1 + EPSILON / np.sqrt(hi)) ** 2
            stays = so_far <= bar * (1 + 1e-9) + 1e-9
            left, so_far = left[stays], so_far[stays]
        exact = np.sqrt(((vectors[left] - query) ** 2).sum(axis=1))
        places, scores = np.append(places, left), np.append(scores, exact)
        if len(scores) >= k:
            limit = np.partition(scores, k - 1)[k - 1]
            best = scores <= limit
            places, scores = places[best], scores[best]
    return places, scores


def _list_rows(centres: np.ndarray, lists: int):
    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                near = nearest_centres(_matrix(batch.column(1)), centres)[:, :lists].astype(np.int32)
                near = pa.array(list(near), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, near], [*batch.schema.names, "lists"])

    return rows


def _scan(turn: np.ndarray, k: int):
    def scan(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ask, ask_id = _matrix(queries["v"]), queries["query_id"].to_numpy()
        own, own_id = _matrix(vectors["v"]), vectors["vec_id"].to_numpy()
        found = []
        if len(ask) and len(own):
            turned_ask, turned = ask @ turn, own @ turn
            for i in range(len(ask)):
                # One more than asked for: the query itself is among them, if it is here.
                at, score = scan_list(ask[i], own, turned_ask[i], turned, k + 1)
                other = own_id[at] != ask_id[i]
                at, score = at[other], score[other]
                best = np.lexsort((own_id[at], score))[:k]
                found.append((np.full(len(best), ask_id[i]), own_id[at[best]], score[best]))
        columns = zip(*found) if found else ((np.zeros(0, t),) for t in (np.int64, np.int64, np.float64))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns))))

    return scan


def nearest_neighbours(
    vectors: DataFrame, every: int, k: int = 10, lists: int = LISTS, probes: int = PROBES, sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    ``vectors`` holds vec_id and embedding; usable() says which take part. Distances are
    Euclidean, in double precision; ties go to the smaller vec_id. Centres are fitted to at
    most ``sample`` vectors, first in the order of the md5 of their ids; every vector is put
    into a list. A query looks through ``probes`` lists, and through more while these hold
    fewer than ``k`` others, so with fewer candidates than ``k`` it finds them all. Large
    lists, and queries that meet in one list, are split into blocks.
    """
    spark = vectors.sparkSession
    sound = settle(usable(vectors), "vectors")
    first = sound.join(F.broadcast(sound.select("vec_id").orderBy(id_order(F.col("vec_id")), "vec_id").limit(sample)), "vec_id")
    points = _matrix(first.orderBy("vec_id").select("v").toArrow()["v"])
    if not len(points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centres = fit_centres(points, lists)
    n = len(centres)
    nearest = "vec_id long, v array<double>, lists array<int>"
    listed = settle(
        sound.mapInArrow(_list_rows(centres, 1), nearest).select("vec_id", "v", F.col("lists")[0].alias("list")), "lists"
    )
    sizes = {r.list: r["count"] for r in listed.groupBy("list").count().collect()}  # one row per list
    by_list = F.array(*[F.lit(sizes.get(i, 0)).cast("long") for i in range(n)])
    wanted = sound.filter(F.col("vec_id") % every == 0).mapInArrow(_list_rows(centres, n), nearest)
    # How many vectors the lists before each one hold.
    held = F.expr("transform(sequence(1, size(lists)), i -> aggregate(slice(lists, 1, i - 1), 0L, (a, l) -> a + sizes[l]))")
    asked = settle(
        wanted.withColumn("sizes", by_list)
        .withColumn("held", held)
        .select(
            F.col("vec_id").alias("query_id"),
            "v",
            F.expr(f"filter(lists, (l, i) -> i < {probes} or held[i] <= {k})").alias("lists"),
        )
        .select("query_id", "v", F.explode("lists").alias("list")),
        "queries",
    )
    per_list = {r.list: r["count"] for r in asked.groupBy("list").count().collect()}
    pieces = lambda counts: F.array(*[F.lit(counts.get(i, 0) // BLOCK + 1) for i in range(n)])
    vector_blocks, query_blocks = pieces(sizes), pieces(per_list)
    block = lambda key, blocks: F.pmod(F.xxhash64(key), blocks[F.col("list")]).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), (blocks[F.col("list")] - 1).cast("int")))
    left = asked.withColumn("qb", block("query_id", query_blocks)).withColumn("vb", every_block(vector_blocks))
    right = listed.withColumn("vb", block("vec_id", vector_blocks)).withColumn("qb", every_block(query_blocks))
    keys = ["list", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(rotation(points.shape[1]), k), FOUND)
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
