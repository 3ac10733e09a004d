"""Nearest neighbours by an adaptive dimension scan inside the probed lists of an index.

Vectors are brought to unit length and turned by one random rotation, so that the first
columns of a difference estimate its whole length. A list's vectors are scanned in column
blocks; after each block a hypothesis test abandons the candidates whose partial distance is
too large to end below the distance of the k-th best so far. Survivors get the exact measure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored

#: Vectors that the lists' centres are fitted on, at most (lowest hash first).
SAMPLE = 16_384
LIST_ROWS = 256
MOST_LISTS = 1024
#: Share of true neighbours that the probed lists are to hold, and the queries that measure it.
RECALL, PILOT = 0.97, 128
#: Rows of a list, and queries, that meet in one task call.
BLOCK = 128
COLUMNS = 16
#: Strength of the test: a candidate is abandoned if its estimated distance exceeds the
#: bound by (1 + EPSILON / sqrt(columns seen)).
EPSILON = 2.1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: neither null nor zero, no
    component null or not finite, and of the most frequent length (the smaller one on a tie)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("vec_id is not null and embedding is not null").where(fine & F.exists("embedding", lambda x: x != 0))
    top = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return v.where(F.size("embedding") == (top.d if top else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of huge components would overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_lists(vectors: DataFrame, n: int, lists: int | None = None) -> np.ndarray:
    """Centres of the lists by k-means over a sample of `SAMPLE` vectors on the driver."""
    lists = lists or max(1, min(MOST_LISTS, n // LIST_ROWS))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = _unit(np.array([r.embedding for r in rows]))
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(11)
    centres = x[rng.permutation(len(x))[:lists]]
    for _ in range(8):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        some = (sums**2).sum(1) > 1e-12
        centres[some] = _unit(sums[some])
    return centres


def scan(
    q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, epsilon: float = EPSILON, columns: int = COLUMNS,
    most: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among the k nearest; `q` and `x` rotated, of unit length,
    `own` marks pairs that take no part. The first rows give every query its bound, or `most`,
    a squared distance that k rows elsewhere keep, if that is less; for the others, partial
    distances grow by column blocks until the test abandons them."""
    m, (n, d) = len(q), x.shape
    start = min(n, max(k, 32))
    known = np.where(own[:, :start], np.inf, ((q * q).sum(1)[:, None] + (x[:start] ** 2).sum(1)) - 2 * q @ x[:start].T)
    bound = np.partition(known, k - 1, axis=1)[:, k - 1] if start >= k else np.full(m, np.inf)
    if most is not None:
        bound = np.minimum(bound, most)
    first = np.nonzero(np.isfinite(known) & (known <= bound[:, None] + 1e-9))
    rest, part, active = x[start:], np.zeros((m, n - start)), ~own[:, start:]
    for c in range(0, d, columns):
        a, b = q[:, c:c + columns], rest[:, c:c + columns]
        if active.mean() > 0.2 if active.size else False:
            part += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
        else:
            i, j = np.nonzero(active)
            if not len(i):
                break
            part[i, j] += ((a[i] - b[j]) ** 2).sum(1)
        seen = min(d, c + columns)
        scale = 1.0 if seen == d else (1 + epsilon / np.sqrt(seen)) ** 2 * seen / d
        active &= part <= bound[:, None] * scale + 1e-9
    i, j = np.nonzero(active)
    return np.concatenate([first[0], i]), np.concatenate([first[1], j + start])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosine of each row pair, summed in the same order for equal rows. Rows are first
    divided by a power of two, which changes no digit, so that squares stay in range."""
    x = x / 2.0 ** np.frexp(np.abs(x).max(1, keepdims=True))[1]
    q = q / 2.0 ** np.frexp(np.abs(q).max(1, keepdims=True))[1]
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int):
    """The k best rows of every query: order, and which of it to keep."""
    order = np.lexsort((vec, -score, query))
    sorted_q = query[order]
    first = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - first < k]


def probes_needed(listed: DataFrame, centres: np.ndarray, is_query, k: int, recall: float) -> int:
    """Lists to look into for `recall`, measured against brute force: `PILOT` queries (lowest
    hash first) are compared with every vector, and the ranks of the lists that hold their
    true neighbours, as the queries order them, say how far to go."""
    pilots = listed.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(PILOT).collect()
    if not pilots:
        return 1
    ids = np.array([r.vec_id for r in pilots])
    q = _unit(np.array([r.embedding for r in pilots]))

    def compare(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = np.asarray(batch.column("vec_id"))
            score = q @ _unit(_matrix(batch.column("embedding"))).T
            score[ids[:, None] == vec[None, :]] = -np.inf
            near = np.asarray(batch.column("list"))
            m = min(k, len(vec))
            top = np.argpartition(-score, m - 1, axis=1)[:, :m]
            new = (np.repeat(np.arange(len(q)), m), near[top].reshape(-1), np.take_along_axis(score, top, 1).reshape(-1))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            pick = _best(held[0], held[1], held[2], k)
            held = tuple(x[pick] for x in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0].astype(np.int64)), pa.array(held[1].astype(np.int32)), pa.array(held[2])], ["i", "list", "score"])

    hits = listed.mapInArrow(compare, "i long, list int, score double")
    top = Window.partitionBy("i").orderBy(F.desc("score"), "list")
    rows = hits.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).collect()  # PILOT * k at most
    ranks = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    far = np.sort([ranks[r.i, r.list] for r in rows if np.isfinite(r.score)])
    return int(far[min(len(far) - 1, int(np.ceil(recall * len(far))))]) + 1 if len(far) else 1


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every vector whose vec_id is
    divisible by `every`, among all vectors but its own, ties to the smaller vec_id.

    All usable vectors (see `usable`) are indexed. A query looks into as many of its nearest
    lists as `probes_needed` measures, and further ones until these hold k other rows. Lists and their queries are cut
    into blocks of about `BLOCK` rows by hash, so neither a hot list nor its queries meet in
    one task. A query starts with the bound that the `SAMPLE` vectors of its lists give, so a
    block answers only with rows that are nearer. Rows that repeat a vec_id never find their own vec_id; as
    queries they are one (the k best that any of them finds). An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    v = stored(usable(vectors), "vectors")
    n = v.count()
    if not n:
        return spark.createDataFrame([], empty)
    centres = fit_lists(v, n, lists)
    count = len(centres)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                near = (_unit(x) @ centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["vec_id", "embedding", "list"])

    listed = stored(v.mapInArrow(assign, "vec_id long, embedding array<double>, list int"), "vector-lists")
    is_query = F.col("vec_id") % every == 0
    probes = probes_needed(listed, centres, is_query, k, recall)
    held = np.zeros(count, np.int64)
    for r in listed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        held[r["list"]] = r["count"]
    sample = listed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    s_ids, s_list = np.asarray(sample.column("vec_id")), np.asarray(sample.column("list"))
    s_unit = _unit(_matrix(sample.column("embedding").combine_chunks()))

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(_unit(_matrix(batch.column("embedding"))) @ centres.T), axis=1, kind="stable")
            total = np.cumsum(held[order], axis=1)
            need = np.maximum(probes, (total < min(n, k + 1)).sum(1) + 1)
            need = np.minimum(need, count)
            rows = np.repeat(np.arange(batch.num_rows), need)
            picked = np.concatenate([order[i, :m] for i, m in enumerate(need)]).astype(np.int32)
            most = sample_bounds(batch.column("vec_id"), _unit(_matrix(batch.column("embedding"))), order, need)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), batch.column("embedding").take(pa.array(rows)), pa.array(picked), pa.array(most[rows])],
                ["vec_id", "embedding", "list", "most"],
            )

    def sample_bounds(own, q, order, need):
        """The squared distance that k sampled rows of the lists a query looks into keep; they
        are met again in these lists, so the bound loses nothing."""
        most, own, place = np.full(len(q), np.inf), np.asarray(own), np.argsort(order, axis=1)
        for lo in range(0, len(q) if len(s_ids) >= k else 0, 64):
            part = slice(lo, lo + 64)
            score = q[part] @ s_unit.T
            score[(place[part][:, s_list] >= need[part][:, None]) | (own[part][:, None] == s_ids[None, :])] = -np.inf
            most[part] = 2 - 2 * np.partition(score, -k, axis=1)[:, -k] + 1e-9
        return most

    asked = stored(
        listed.where(is_query).select("vec_id", "embedding").mapInArrow(probe, "vec_id long, embedding array<double>, list int, most double"),
        "vector-probes",
    )
    wanted = np.zeros(count, np.int64)
    for r in asked.groupBy("list").count().collect():
        wanted[r["list"]] = r["count"]
    parts = F.array(*(F.lit(int(-(-x // BLOCK)) or 1) for x in held))
    asks = F.array(*(F.lit(int(-(-x // BLOCK)) or 1) for x in wanted))
    own = F.xxhash64("vec_id", F.lit(3))
    block_of = F.pmod(own, parts[F.col("list")]).cast("int")
    ask_of = F.pmod(own, asks[F.col("list")]).cast("int")
    every_ask = F.explode(F.sequence(F.lit(0), asks[F.col("list")] - 1))
    every_block = F.explode(F.sequence(F.lit(0), parts[F.col("list")] - 1))
    useful = F.array(*(F.lit(bool(x)) for x in wanted))[F.col("list")]
    rows = listed.where(useful).select("list", block_of.alias("block"), every_ask.alias("ask"), "vec_id", "embedding")
    looks = asked.select("list", every_block.alias("block"), ask_of.alias("ask"), "vec_id", "embedding", "most")

    d = centres.shape[1]
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(d, d)))[0]

    def nearest(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = np.asarray(left.column("vec_id"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(left.column("embedding").combine_chunks())[order]
            rotated = _unit(x) @ turn
            asked_ids = np.asarray(right.column("vec_id"))
            q = _matrix(right.column("embedding").combine_chunks())
            pair_q, pair_x = scan(_unit(q) @ turn, rotated, asked_ids[:, None] == ids[None, :], k, most=np.asarray(right.column("most")))
            score = cosines(q[pair_q], x[pair_x])
            # rows that repeat a query's vec_id are told apart by their place
            pick = _best(pair_q, ids[pair_x], score, k)
            found = (asked_ids[pair_q[pick]], ids[pair_x[pick]], score[pick])
        cols = [np.asarray(f) for f in found]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})

    keys = ["list", "block", "ask"]
    hits = rows.groupBy(*keys).cogroup(looks.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=float)
    return flat.reshape(len(column), -1)
