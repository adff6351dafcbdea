"""Exact top-k by inner product with a pivot-distance index (vectors keyed by nearest pivot and distance).

Vectors are made integers (floor of SCALE times each component). Of a query q and a vector x, 2 q.x = |q|^2 + |x|^2 - |q - x|^2,
and by the triangle inequality |q - x| is at least what the distances of q and of x to a pivot differ by. So of the vectors
of a pivot within a range of distances, an annulus, none scores above (|q|^2 + N - gap^2) / 2, where N is the annulus' largest
norm squared and gap how far the query's distance to the pivot lies outside the range; nor above |q| sqrt(N).

Index: the distinct vectors, each with its nearest pivot and its distance to it, sorted by both. Pivots are spread-out
vectors of a bounded sample; their number grows with the root of the number of vectors, and so does an annulus until there are
MOST_ANNULI. Vectors are kept in blocks of up to BLOCK, a row each, which hold whole annuli; a catalogue of all annuli is broadcast.

Search: each query takes the annuli in order of their bounds, best first: FIRST, then WIDEN times as many in each further round.
It stops at the first whose bound is below the score that the worst of its answers has so far. Nothing beyond can hold an answer, so the result is exact.

Equal vectors are one entry with the ids that can matter, and equal queries are asked once. Ties go to the smaller id. Vectors that are null, empty, of another length
than the most frequent one, or with null or non-finite components take no part. Scores are exact, in doubles, 64-bit integers or Python's integers as the
norms ask; an answer of 2^63 or more does not fit its column and is an error, whatever else the table holds. Fewer than k candidates: all
are returned. A query row whose id is null takes no part; repeated ids are candidates as often as they come.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import extended, map_batches, only, written

SCALE = 1024
#: Pivots, at least and for each root of the number of vectors; how many sampled vectors they are chosen from, each; and bytes of that sample.
PIVOTS, PIVOT_RATE, SAMPLED, SAMPLE_BYTES = 16, 0.5, 8, 32 << 20
#: Vectors in an annulus at least, and for each root of the number of vectors; annuli in all, about.
ANNULUS, ANNULUS_RATE, MOST_ANNULI = 16, 0.25, 65_536
BLOCK, QUERY_BLOCK = 2048, 256
#: Annuli that a query opens in the first round, and by how much each further round is wider.
FIRST, WIDEN = 16, 16
#: Rows of blocks in an Arrow batch.
LARGE_ROWS = 16
#: Slack for distances and bounds, which are rounded; scores are whole numbers and aren't.
SLACK = 1e-6
#: Stands for scores that don't fit: an error where it is an answer.
LEAST, TOO_LARGE = -(1 << 63), "an answer's score doesn't fit 64 bits"


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): components as whole numbers in doubles; only rows that take part."""
    rows = only(vectors, id_col, vec_col).toDF("id", "x").where(F.col("id").isNotNull() & (F.size("x") > 0))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    # scaled as doubles: floor() gives a 64-bit integer, which large components leave
    whole = F.transform("x", lambda c: F.when(F.abs(c.cast("double")) < 2.0**52, F.floor(c.cast("double") * SCALE).cast("double")).otherwise(c.cast("double") * SCALE))
    return rows.where(~bad).select("id", whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Spread-out rows of the sample: each the farthest from those before."""
    picked = [0]
    with np.errstate(over="ignore", invalid="ignore"):
        near = ((sample - sample[0]) ** 2).sum(axis=1)
        while len(picked) < min(count, len(sample)):
            far = int(near.argmax())
            if not near[far] > 0:
                break
            picked.append(far)
            near = np.minimum(near, ((sample - sample[far]) ** 2).sum(axis=1))
    return sample[picked]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; not a number where they can't be told."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2.0 * (x @ pivots.T), 0.0))


class Index:
    """blocks: (block, vectors, sizes, ids): rows of whole annuli of the distinct vectors, written to the shared folder; annuli: how many there are."""

    def __init__(self, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding"):
        spark = vectors.sparkSession
        whole = integers(vectors, id_col, vec_col)
        sizes = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.k, self.dim = k, sizes[0].n if sizes else 0
        self.rows = written(whole.where(F.size("v") == self.dim), "vectors")
        self.blocks, self.annuli = None, 0
        if not self.dim:
            return
        norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
        total = self.rows.agg(F.max(norm).alias("top"), F.count("*").alias("n")).first()
        self.top, root = float(total.top), math.sqrt(total.n)
        most = SAMPLE_BYTES // (8 * self.dim) + 1
        count = min(max(PIVOTS, math.ceil(PIVOT_RATE * root)), max(1, most // SAMPLED))
        self.annulus = max(ANNULUS, math.ceil(ANNULUS_RATE * root), -(-total.n // MOST_ANNULI))
        sample = self.rows.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(min(most, SAMPLED * count)).toArrow()
        self.pivots = spark.sparkContext.broadcast(_pivots(_matrix(sample.column("v").combine_chunks()), count))
        built = written(self._built(), "annuli")
        self.blocks = built.select("block", "vectors", "sizes", "ids")
        found = built.select("block", "pivot", "lows", "highs", "norms").toArrow().combine_chunks()  # MOST_ANNULI entries, and one or two a pivot and task
        each = found.column("lows").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        flat = [found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("lows", "highs", "norms")] if len(found) else [np.zeros(0)] * 3
        block, pivot = (np.repeat(found.column(c).to_numpy(), each) for c in ("block", "pivot"))
        place = np.arange(len(block)) - np.repeat(np.cumsum(each) - each, each)
        self.annuli = len(block)
        self.catalogue = spark.sparkContext.broadcast((block, place, pivot, *flat))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows (v, ...) with the nearest pivot and the distance to it."""
        shared, names = self.pivots, rows.columns
        at = names.index("v")

        def run(batches):
            for b in batches:
                x = _matrix(b.column(at))
                d = _distances(x, shared.value) if len(x) else np.zeros((0, 1))
                d[np.isnan(d)] = np.inf
                p = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(d)), p])], names=[*names, "pivot", "distance"])

        return map_batches(rows, run, extended(rows.schema, ("pivot", "int"), ("distance", "double")))

    def _built(self) -> DataFrame:
        # Of each distinct vector the 2 k smallest ids, one id k times at most: whichever id a query leaves out, its k best are there. Each task drops the others before the shuffle.
        same = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
        place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        few = self.rows.withColumn("m", same).where(F.col("m") <= self.k).withColumn("n", place).where(F.col("n") <= 2 * self.k)
        few = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        placed = written(self._placed(few), "placed")
        # ranges of pivot and distance: as many tasks share a pivot with many vectors as its rows ask for
        ordered = placed.select("pivot", "distance", "v", "ids").repartitionByRange("pivot", "distance", F.xxhash64("v")).sortWithinPartitions("pivot", "distance")
        ordered = ordered.withColumn("part", F.spark_partition_id())
        names = ["block", "pivot", "lows", "highs", "norms", "sizes", "vectors", "ids"]
        size, rows_in = self.annulus, max(1, BLOCK // self.annulus) * self.annulus

        def run(batches):
            held: list[tuple] = []
            made = 0

            def block():
                nonlocal made
                x, d = np.array([r[2] for r in held], np.float64), np.array([r[1] for r in held])
                starts = np.arange(0, len(held), size)
                with np.errstate(over="ignore"):
                    norms = np.maximum.reduceat((x * x).sum(axis=1), starts)
                sizes = np.diff(np.append(starts, len(held)))
                kinds = (pa.int64(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int64())))
                row = ((held[0][4] << 32) + made, held[0][0], d[starts], d[starts + sizes - 1], norms, sizes, x.tobytes(), [r[3] for r in held])
                made += 1
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (len(held) >= rows_in or held[-1][0] != row[0]):
                        yield block()
                        held = []
                    held.append(row)
            if held:
                yield block()

        return map_batches(ordered, run, "block long, pivot int, lows array<double>, highs array<double>, norms array<double>, sizes array<long>, vectors binary, ids array<array<long>>")


def _bounds(q: np.ndarray, pivots: np.ndarray, catalogue: tuple) -> np.ndarray:
    """For each query the most that a vector of each annulus can score."""
    _, _, pivot, low, high, norm = catalogue
    with np.errstate(over="ignore", invalid="ignore"):
        square, d = (q * q).sum(axis=1)[:, None], _distances(q, pivots)[:, pivot]
        length = np.sqrt(square)
        slack = SLACK * (length + 2 * np.sqrt(norm) + high)
        gap = np.maximum(np.maximum(d - high, low - d) - slack, 0.0)
        most = np.minimum((square + norm - gap * gap) / 2, length * np.sqrt(norm))
        most += SLACK * SLACK * (square + norm) + 1
    return np.where(np.isnan(most), np.inf, most)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    with np.errstate(over="ignore"):
        largest = math.sqrt((q * q).sum(axis=1).max(initial=0.0)) * math.sqrt((x * x).sum(axis=1).max(initial=0.0))  # of sums of some terms, too
    if largest < 2.0**52:
        return (q @ x.T).astype(np.int64)
    if largest < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    return whole(q) @ whole(x).T


def _best(score: np.ndarray, asked: np.ndarray, ids: list[list[int]], most: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(query, score, id) of each query's `most` best of the entries that it asked for, best first."""
    rows, scores, found = [], [], []
    for r in range(len(score)):
        cols = np.flatnonzero(asked[r])
        s = score[r, cols]
        if len(s) > most:
            edge = np.partition(s, len(s) - most)[len(s) - most] if s.dtype != object else sorted(s)[len(s) - most]
            near = s >= edge  # all that reach it, so that ties are settled by id
            cols, s = cols[near], s[near]
        pairs = sorted((-v, i) for v, c in zip(s.tolist(), cols.tolist(), strict=True) for i in ids[c])[:most]
        rows += [r] * len(pairs)
        scores += [-v for v, _ in pairs]
        found += [i for _, i in pairs]
    if any(v >= 1 << 63 for v in scores):  # nothing is above it, so it is an answer
        raise OverflowError(TOO_LARGE)
    return np.array(rows, np.int64), [max(v, LEAST) for v in scores], np.array(found, np.int64)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(qid, all, worst): of (qid, score, vec_id) what can still be an answer, best first, and the score below which nothing can."""
    near = found.repartition("qid")
    same = F.row_number().over(Window.partitionBy("qid", "vec_id").orderBy(F.desc("score")))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    kept = near.withColumn("m", same).where(F.col("m") <= k).withColumn("n", order).where(F.col("n") <= 2 * k)
    lists = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "score", "vec_id"))).alias("all"))
    # a query may leave out one id, however often it comes
    times = F.array_max(F.transform("all", lambda x: F.size(F.filter("all", lambda y: y.vec_id == x.vec_id))))
    enough = F.size("all") >= k + times
    return lists.withColumn("worst", F.when(enough, F.expr(f"all[{k - 1} + array_max(transform(all, x -> size(filter(all, y -> y.vec_id = x.vec_id))))].score")))


def search_nothing(spark: SparkSession, opened: bool) -> DataFrame:
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint" + (", opened bigint" if opened else ""))


def search(index: Index, queries: DataFrame, opened: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (id, v) of `queries`, against all rows of the index but the query's own.

    opened: also `opened`, the number of annuli (of index.annuli) that the query opened.
    """
    spark, k = queries.sparkSession, index.k
    if index.blocks is None:
        return search_nothing(spark, opened)
    pivots, catalogue, blocks = index.pivots, index.catalogue, index.blocks
    asked = written(queries.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")  # one asks for all equal queries

    def aim(width, first):
        """Of each query the next annuli that may hold an answer, by block."""

        def run(batches):
            block, place = catalogue.value[:2]
            for b in batches:
                for at in range(0, b.num_rows, 32):
                    part = b.slice(at, 32)
                    q, qids = _matrix(part.column(0)), part.column(1).to_pylist()
                    bounds = _bounds(q, pivots.value, catalogue.value)
                    out = [[], [], [], []]
                    for r, qid in enumerate(qids):
                        order = np.argsort(-bounds[r], kind="stable")
                        done, worst = (0, None) if first else (part.column(2)[r].as_py(), part.column(3)[r].as_py())
                        take = order[done : done + width]
                        if worst is not None:
                            take = take[bounds[r][take] >= worst]
                        for one in np.unique(block[take]):
                            for column, value in zip(out, (int(one), qid, q[r], np.sort(place[take[block[take] == one]])), strict=True):
                                column.append(value)
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["block", "qid", "v", "wants"])

        return run

    def pack(batches):
        """Rows of one block are put together, QUERY_BLOCK at a time."""
        held: list[tuple] = []

        def one():
            q = np.array([r[2] for r in held], np.float64)
            columns = ([held[0][0]], [[r[1] for r in held]], [q.tobytes()], [[r[3] for r in held]])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["asked", "qids", "q", "wants"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= QUERY_BLOCK or held[-1][0] != row[0]):
                    yield one()
                    held = []
                held.append(row)
        if held:
            yield one()

    def scan(batches):
        for b in batches:
            for qids, q, wants, vectors, sizes, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, q = np.frombuffer(vectors).reshape(len(ids), -1), np.frombuffer(q).reshape(len(qids), -1)
                ends = np.cumsum(sizes)
                wanted = np.zeros((len(qids), len(sizes)), bool)
                for r, w in enumerate(wants):
                    wanted[r, w] = True
                parts = []
                for a in np.flatnonzero(wanted.any(axis=0)):  # only who asked for an annulus is compared with it
                    who, entries = np.flatnonzero(wanted[:, a]), np.arange(ends[a] - sizes[a], ends[a])
                    parts.append((who, entries, _products(q[who], x[entries])))
                large = any(p.dtype == object for _, _, p in parts)
                score, mask = np.zeros((len(qids), len(ids)), object if large else np.int64), np.zeros((len(qids), len(ids)), bool)
                for who, entries, products in parts:
                    score[np.ix_(who, entries)] = products
                    mask[np.ix_(who, entries)] = True
                rows, scores, found = _best(score, mask, ids, 2 * k)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(qids)[rows]), pa.array(scores, pa.int64()), pa.array(found)], names=["qid", "score", "vec_id"])

    live, best, counts, width, first = asked, None, [], FIRST, True
    done, many = 0, live.count()
    while many:
        asks = written(map_batches(live, aim(width, first), "block long, qid long, v array<double>, wants array<long>"), "asks")
        # all queries may ask for one block: it is dealt to as many tasks as they fill with some query blocks each
        salt = F.pmod(F.xxhash64("qid"), F.lit(-(-many // (4 * QUERY_BLOCK))))
        dealt = asks.repartition("block", salt).sortWithinPartitions("block")
        packed = map_batches(dealt, pack, "asked long, qids array<long>, q binary, wants array<array<long>>")
        # never a broadcast: both sides grow with the tables, and rows of binaries are larger than their estimates
        pairs = packed.join(blocks.hint("merge"), F.col("asked") == F.col("block")).select("qids", "q", "wants", "vectors", "sizes", "ids")
        found = map_batches(pairs, scan, "qid long, score long, vec_id long", rows=LARGE_ROWS)
        if best is not None:
            found = found.unionAll(best.select("qid", F.explode("all").alias("x")).select("qid", "x.score", "x.vec_id"))
        best = written(_merged(found, k), "best")
        taken = asks.groupBy("qid").agg(F.sum(F.size("wants")).alias("taken"))
        counts.append(taken)
        done += width
        if done >= index.annuli:
            break
        # who took all that the round allowed may need more
        full = taken.where(F.col("taken") == width).select(F.col("qid").alias("fqid"))
        on = live.select("v", "qid").join(full, F.col("qid") == F.col("fqid"), "left_semi").join(best.select(F.col("qid").alias("bqid"), "worst"), F.col("qid") == F.col("bqid"), "left")
        live, first, width = written(on.select("v", "qid", F.lit(done).alias("done"), "worst"), "live"), False, width * WIDEN
        many = live.count()
    if best is None:
        return search_nothing(spark, opened)
    # to every query row of the class, its own id left out
    classes = queries.select("id", "v").join(asked.select(F.col("v").alias("w"), "qid"), F.col("v") == F.col("w")).select("id", "qid")
    each = classes.join(best.select(F.col("qid").alias("lqid"), "all"), F.col("qid") == F.col("lqid"))
    others = F.slice(F.filter("all", lambda x: x.vec_id != F.col("id")), 1, k)
    out = each.select("qid", F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x")).select(
        "qid", "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
    out = out.withColumn("score", F.when(F.col("score") == LEAST, F.raise_error(F.lit(TOO_LARGE)).cast("long")).otherwise(F.col("score")))
    if not opened:
        return out.drop("qid")
    taken = counts[0]
    for more in counts[1:]:
        taken = taken.unionAll(more)
    return out.join(taken.groupBy("qid").agg(F.sum("taken").alias("opened")), "qid").drop("qid")
