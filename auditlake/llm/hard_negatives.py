"""Operator 12: hard negatives by exact search in rotated vectors.

Vectors are integers. A block of anchors is turned, with every row held against it, into the anchors' own principal
axes, an orthogonal rotation that moves most of their length into the leading components. Products are accumulated over
leading components; what is left is at most the product of the residual norms, plus slack for rounding. Pairs whose
bound falls short of the anchor's present results, or that lie wholly outside its windows, are discarded; survivors are
scored by integer products, so the result doesn't depend on the rotation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import parallelism, read_table, stored

ANCHORS = 1024  # of a block, on average
LANE_ROWS = (512, 1 << 22)  # least and most rows that a task holds against a block, a strip at a time
STRIP, FIRST_STRIP = 2048, 256
SURVIVORS = 0.02  # share of pairs alive at which products are finished for these alone
VERIFIED = 1 << 15  # pairs scored at once
NORM = float(1 << 31)
NONE = np.iinfo(np.int64).min
SCALE = 256


def usable_rows(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """(row, id, label, q, dims) of the rows that take part: key, label and all components there and finite."""
    v = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].alias("label"), vectors[embedding].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = v.withColumn("q", F.transform("x", lambda x: F.floor(x * SCALE)))
    squares = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = v.where(F.sqrt(squares) < NORM)
    return v.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.col("q").cast("array<int>").alias("q"), F.size("q").alias("dims"))


class Block:
    """Anchors in their own principal axes, and what discards pairs with them."""

    def __init__(self, q: np.ndarray):
        self.q = q.astype(np.int64)
        self.dims = q.shape[1]
        x = self.q.astype(np.float64)
        self.axes = np.linalg.eigh(x.T @ x)[1][:, ::-1] if self.dims else np.zeros((0, 0))
        self.stages = sorted({max(1, self.dims * k // 4) for k in (1, 2, 3, 4)} if self.dims else {0})
        self.lead, self.rest, self.norm = self.turned(x)
        self.slack = np.float32((2 * self.dims + 16) * 2.0**-24)

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors, their residual norms after each stage, and their norms; norms are rounded up."""
        y = x @ self.axes
        squares = np.concatenate([np.cumsum((y**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], axis=1)
        up = 1 + 2.0**-20
        return y.astype(np.float32), (np.sqrt(squares[:, self.stages]) * up).astype(np.float32), (np.sqrt(squares[:, 0]) * up).astype(np.float32)

    def survivors(self, q: np.ndarray, low: np.ndarray, high: np.ndarray | None, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs of ``alive`` (not others) whose score may lie between their anchor's bounds."""
        lead, rest, norm = self.turned(q.astype(np.float64))
        total = np.zeros(alive.shape, np.float32)
        low = low.astype(np.float32)[:, None]
        at = 0
        for s, stage in enumerate(self.stages):
            total += self.lead[:, at:stage] @ lead[:, at:stage].T
            bound = np.stack([self.rest[:, s], self.slack * self.norm], 1) @ np.stack([rest[:, s], norm], 1).T
            alive &= total + bound >= low
            if high is not None:
                alive &= total - bound <= high.astype(np.float32)[:, None]
            at = stage
            if np.count_nonzero(alive) < SURVIVORS * alive.size:
                break
        a, x = np.nonzero(alive)
        score = np.empty(len(a), np.int64)
        for i in range(0, len(a), VERIFIED):
            part = slice(i, i + VERIFIED)
            score[part] = np.einsum("ij,ij->i", self.q[a[part]], q[x[part]].astype(np.int64))
        return a, x, score


class Best:
    """For each of n owners the first k of what it was offered: higher score, then smaller id, then smaller row."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.row = (np.full((n, k), v, np.int64) for v in (NONE, 0, 0))

    def least(self) -> np.ndarray:
        """The score that an offer must reach to matter."""
        return self.score[:, -1]

    def offer(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(owner):
            return
        n, k = self.score.shape
        has = np.unique(owner)
        old = np.repeat(has, k)
        owner, score = np.concatenate([owner, old]), np.concatenate([score, self.score[has].ravel()])
        ids, rows = np.concatenate([ids, self.id[has].ravel()]), np.concatenate([rows, self.row[has].ravel()])
        order = np.lexsort((rows, ids, -1 - score, owner))  # -1 - score: the least integer has no negative
        owner = owner[order]
        begins = np.concatenate([[True], np.diff(owner) != 0])
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(begins, np.arange(len(owner)), 0))
        first = place < k
        at, order = (owner[first], place[first]), order[first]
        self.score[at], self.id[at], self.row[at] = score[order], ids[order], rows[order]


class Positives:
    """A block's nearest rows of its label."""

    def __init__(self, anchors: dict, k: int):
        self.block, self.anchors = Block(anchors["q"]), anchors
        self.best = Best(len(anchors["row"]), k)

    def meet(self, rows: dict) -> None:
        alive = self.anchors["row"][:, None] != rows["row"][None, :]
        a, x, score = self.block.survivors(rows["q"], self.best.least(), None, alive)
        self.best.offer(a, score, rows["id"][x], rows["row"][x])

    def result(self) -> pa.RecordBatch:
        a, k = np.nonzero(self.best.score != NONE)
        cols = [self.anchors["row"][a], self.best.id[a, k], self.best.row[a, k], self.best.score[a, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "positive_id", "positive_row", "positive_score"])


class Negatives:
    """For each positive of a block's anchors, the first rows of another label within the window that the positive's score sets."""

    def __init__(self, anchors: dict, k: int, window: tuple[int, int, int]):
        self.block, self.anchors = Block(anchors["q"]), anchors
        least, most, of = window
        n, self.slots = len(anchors["row"]), max(map(len, anchors["positives"]))
        self.low, self.high = np.full((n, self.slots), np.iinfo(np.int64).max), np.full((n, self.slots), NONE)
        for a, positives in enumerate(anchors["positives"]):
            for s, p in enumerate(positives):  # whole numbers without a limit: -(-x // y) rounds up
                self.low[a, s], self.high[a, s] = max(NONE, -(-least * p["score"] // of)), min(-NONE - 1, most * p["score"] // of)
        self.best = [Best(n, k) for _ in range(self.slots)]
        names = {label: i for i, label in enumerate(sorted(set(anchors["label"]), key=repr))}
        self.names, self.labels = names, np.array([names[x] for x in anchors["label"]])

    def meet(self, rows: dict) -> None:
        labels = np.array([self.names.get(x, -1) for x in rows["label"]])
        floors = [np.maximum(self.low[:, s], self.best[s].least()) for s in range(self.slots)]
        a, x, score = self.block.survivors(rows["q"], np.min(floors, axis=0), self.high.max(axis=1), self.labels[:, None] != labels[None, :])
        for s in range(self.slots):
            fits = (score >= floors[s][a]) & (score <= self.high[a, s])
            self.best[s].offer(a[fits], score[fits], rows["id"][x[fits]], rows["row"][x[fits]])

    def result(self) -> pa.RecordBatch:
        out: list[tuple] = []
        for s, best in enumerate(self.best):
            for a, k in zip(*(i.tolist() for i in np.nonzero(best.score != NONE))):
                p = self.anchors["positives"][a][s]
                out.append((self.anchors["id"][a], self.anchors["row"][a], p["id"], p["row"], p["score"], best.id[a, k], best.row[a, k], best.score[a, k]))
        names = ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names)


def columns(b: pa.RecordBatch, start: int, stop: int) -> dict:
    part = b.slice(start, stop - start)
    d = part.column("dims")[0].as_py()
    out = {"q": part.column("q").flatten().to_numpy().reshape(len(part), d), "label": part.column("label").to_pylist(), "positives": part.column("positives").to_pylist()}
    return out | {n: part.column(n).to_numpy() for n in ("id", "row")}


def joined(parts: list[dict]) -> dict:
    return {n: np.concatenate([p[n] for p in parts]) if isinstance(parts[0][n], np.ndarray) else [x for p in parts for x in p[n]] for n in parts[0]}


def search(begin: Callable[[dict], Positives | Negatives], keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs over batches sorted by ``keys`` and kind: a block's anchors (kind 0) first, then its rows in strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchors, work, strip = None, [], None, FIRST_STRIP
        for b in batches:
            marks = list(zip(*(b.column(k).to_pylist() for k in [*keys, "kind"])))
            at = 0
            for (*key, kind), same in groupby(marks):
                stop = at + sum(1 for _ in same)
                if key != last:
                    if work is not None:
                        yield work.result()
                    last, anchors, work, strip = key, [], None, FIRST_STRIP
                if kind == 0:
                    anchors.append(columns(b, at, stop))
                elif anchors or work is not None:
                    if work is None:
                        work, anchors = begin(joined(anchors)), []
                    while at < stop:
                        work.meet(columns(b, at, min(stop, at + strip)))
                        at, strip = at + strip, STRIP
                at = stop
        if work is not None:
            yield work.result()

    return run


def dealt(rows: DataFrame, anchors: DataFrame, groups: list[str], sizes: DataFrame, tasks: int) -> DataFrame:
    """Blocks of anchors with the rows of their group: (groups, tile, lane, kind, ...), each tile and lane in one task, in order.

    A group's anchors lie in tiles by their hash and are written to each lane, its rows lie in lanes and are written to each
    tile. Tiles hold ANCHORS anchors on average; lanes are made so that there are a few for each task, within LANE_ROWS.
    """
    sizes = sizes.withColumn("tiles", F.ceil(F.col("anchors") / ANCHORS).cast("int"))
    work = sizes.agg(F.sum(F.col("rows") * F.col("tiles"))).first()[0] or 0
    lane_rows = min(max(work // (4 * tasks), LANE_ROWS[0]), LANE_ROWS[1])
    sizes = sizes.select(*groups, "tiles", F.ceil(F.col("rows") / lane_rows).cast("int").alias("lanes"))
    by = [*groups, "tile", "lane"]
    kept = [*by, "kind", *(c for c in ("row", "id", "label", "q", "dims", "positives") if c not in groups)]

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")

    held = anchors.join(sizes, groups).select("*", own("tiles", 3).alias("tile"), F.lit(0).alias("kind")).withColumn("lane", numbers("lanes"))
    others = rows.join(sizes, groups).select("*", own("lanes", 5).alias("lane"), F.lit(1).alias("kind")).withColumn("tile", numbers("tiles"))
    both = held.select(*kept).unionByName(others.select(*kept))
    return both.repartition(4 * tasks, *by).sortWithinPartitions(*by, "kind", "row")


def mine_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100),
    key: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, by whole-number products.

    Components become floor(256 * x). An anchor's positives are the first other rows of its label, by score and then by smaller key;
    a positive's negatives are the first rows of other labels whose score times window[2] lies between window[0] and window[1] times
    the positive's. Rows without key or label, or with a null vector or a null or non-finite component, take no part, and neither do
    those whose whole-number vector is 2**31 long or longer, as scores wouldn't fit in a long. Rows of different dimensions
    are not compared; empty vectors score 0 with each other. Rows that repeat a key are rows of their own: each is an anchor, a
    positive or a negative as often as it is there, so that result rows can repeat. An anchor without positives, or a positive
    without negatives, gives no row; an empty table gives none.

    A stated set of anchors is held against all rows, in blocks: no pair is written out, a task holds one block and one strip of
    rows, and gives a few rows an anchor. Hot labels are cut into lanes.
    """
    spark = vectors.sparkSession
    tasks = parallelism(spark)
    rows = stored(usable_rows(vectors, key, embedding, label))
    rows = rows.withColumn("positives", F.lit(None).cast("array<struct<id: long, row: long, score: long>>"))
    anchors = rows.where(is_anchor(F.col("id")))
    count = [F.count("*").alias("rows"), F.count_if(is_anchor(F.col("id"))).alias("anchors")]
    sizes = stored(rows.groupBy("label", "dims").agg(*count).where("anchors > 0"))
    near = dealt(rows, anchors, ["label", "dims"], sizes, tasks)
    near = near.mapInArrow(search(lambda a: Positives(a, positives), ["label", "dims", "tile", "lane"]), "row long, positive_id long, positive_row long, positive_score long")
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_row").alias("row"), F.col("positive_score").alias("score"))))
    near = near.groupBy("row").agg(F.transform(listed, lambda p: F.struct(p["id"].alias("id"), p["row"].alias("row"), p["score"].alias("score"))).alias("positives"))
    anchors = stored(anchors.drop("positives").join(near, "row"))
    kept = anchors.groupBy("dims").agg(F.count("*").alias("anchors"))
    sizes = stored(rows.groupBy("dims").agg(F.count("*").alias("rows")).join(kept, "dims"))
    far = dealt(rows, anchors, ["dims"], sizes, tasks)
    schema = ", ".join(f"{n} long" for n in ("anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"))
    far = far.mapInArrow(search(lambda a: Negatives(a, negatives, window), ["dims", "tile", "lane"]), schema)
    first = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    far = far.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector of ``embeddings`` (see ``mine_negatives`` for nulls, ties and repeats)."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), lambda key: key % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id,
    positive_score, score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
