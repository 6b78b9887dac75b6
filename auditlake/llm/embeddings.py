"""Operator 4: embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to blocks of eight dimensions and decoded to the nearest point of the E8
lattice; a table's key hashes its blocks' points. A vector enters its own cell and neighbouring cells (the nearest
point of the lattice's other coset). Vectors that meet in a table's cell are compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.buckets import RESULT, Union, cells, dealt, groups, result
from auditlake.llm.common import connected_components, mix64, read_table, stored

COSINE = 0.93
TABLES = 12
BLOCKS = 2  # E8 blocks in a key
CELL = 0.7  # lattice unit in units of the unit sphere
SEED = 11


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers of even sum): round, and where the sum is odd move the worst coordinate."""
    r = np.rint(x)
    odd = (r.sum(axis=-1) % 2).astype(bool)
    gap = x - r
    worst = np.abs(gap).argmax(axis=-1)
    step = np.where(np.take_along_axis(gap, worst[..., None], -1)[..., 0] >= 0, 1.0, -1.0)
    moved = np.take_along_axis(r, worst[..., None], -1)[..., 0] + step
    np.put_along_axis(r, worst[..., None], np.where(odd, moved, moved - step)[..., None], -1)
    return r


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest E8 point and the nearest one of the other coset (D8, and D8 shifted by a half), both doubled."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    first = np.where(closer[..., None], a, b)
    return (2 * first).astype(np.int64), (2 * (a + b - first)).astype(np.int64)


def projections(dims: int) -> np.ndarray:
    """TABLES x BLOCKS orthonormal frames in lattice units: of more than eight dimensions eight are drawn and scaled up to
    keep distances on average, fewer are turned into eight and keep them exactly."""
    rng = np.random.default_rng([SEED, dims])
    if dims >= 8:
        out = np.linalg.qr(rng.standard_normal((TABLES, BLOCKS, dims, 8)))[0] * np.sqrt(dims / 8)
    else:
        out = np.swapaxes(np.linalg.qr(rng.standard_normal((TABLES, BLOCKS, 8, dims)))[0], -1, -2)
    return out / CELL


def lattice_keys(unit: np.ndarray) -> np.ndarray:
    """n x TABLES x 2**BLOCKS keys of unit vectors: own cell first, then its neighbours."""
    n, dims = unit.shape
    points = nearest_e8(np.einsum("nd,tbde->ntbe", unit, projections(dims)))
    weights = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashed = [mix64((p.astype(np.uint64) * weights).sum(-1, dtype=np.uint64)) for p in points]  # n x T x B each
    keys = np.empty((n, TABLES, 2**BLOCKS), np.uint64)
    for c in range(2**BLOCKS):
        key = np.zeros((n, TABLES), np.uint64)
        for b in range(BLOCKS):
            key = mix64(key * np.uint64(31) + hashed[c >> b & 1][:, :, b] + np.uint64(b + 1))
        keys[:, :, c] = key
    return keys.view(np.int64)


def units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dims, table, key, member) of each class of equal vectors."""
    for b in batches:
        members, vectors = b.column("member").to_pylist(), b.column("embedding").to_pylist()
        for dims in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == dims]
            keys = lattice_keys(units([vectors[i] for i in at]))
            flat = TABLES * 2**BLOCKS
            tables = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 2**BLOCKS), len(at))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("label").take(pa.array(np.repeat(at, flat))), pa.array(np.full(len(tables), dims, np.int32)), pa.array(tables),
                    pa.array(keys.reshape(-1)), pa.array(np.repeat(np.array([members[i] for i in at], np.int64), flat)),
                ], ["label", "dims", "tab", "cell", "member"],
            )


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify a cell's pairs by cosine; each pair counts in the first table, and there the least key, that it shares."""
    out: list[tuple[int, int, int, int]] = []
    for (_, i, j), g in groups(batches):
        unit = units(g["embedding"])
        close = np.triu(unit @ unit.T >= COSINE, 1)
        if i != j:
            own = np.array(g["own"])
            close &= own[:, None] != own[None, :]
        a, b = np.nonzero(close)
        if not len(a):
            continue
        keys = lattice_keys(unit)
        table, cell = g["tab"][0], g["cell"][0]
        mine = np.ones(len(a), bool)
        for t in range(table + 1):
            shared = np.zeros(len(a), bool)
            for c in range(2**BLOCKS):
                ka = keys[a, t, c]
                same = (ka[:, None] == keys[b, t]).any(axis=1)
                shared |= same if t < table else same & (ka < cell)
            mine &= ~shared
        a, b = a[mine], b[mine]
        members, n = g["member"], np.array(g["n"])
        links = np.zeros(len(members), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        out += [(0, members[x], 0, int(links[x])) for x in np.flatnonzero(links)]
        union = Union(len(members))
        out += [(1, members[x], members[y], 0) for x, y in zip(a.tolist(), b.tolist()) if union.join(x, y)]
        if len(out) > 5000:
            yield result(out)
            out = []
    yield result(out)


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: key, n_links, component_id, kept.

    Only rows of equal, non-null labels and equal dimensions are compared. Null, empty or zero vectors, and those with
    null or non-finite components, link with nothing, nor do rows without label. A row without key is a neighbour like any other, but names no
    component (null where none of its members has a key) and is never kept. Equal vectors form a class,
    whose members link with each other (each row with all others of its class, counted once) without being paired.
    Other columns aren't read. Cells bound what a task holds; no pair is written out.
    """
    v = vectors.select(vectors[key].alias("id"), vectors[label].alias("label"), vectors[embedding].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.where(usable)
    classes = stored(good.groupBy("label", "embedding").agg(F.min("id").alias("member"), F.count("*").alias("n")))
    # Rows that repeat a key with other vectors: the class is named by its own number, not by the key
    classes = stored(classes.withColumn("least", F.col("member")).withColumn("member", F.monotonically_increasing_id()))
    kind = dict(v.dtypes)["label"]
    entries = classes.mapInArrow(entries_of, f"label {kind}, dims int, tab int, cell long, member long")
    bucket = F.struct("label", "dims", "tab", "cell").alias("bucket")
    placed = cells(entries.select(bucket, "member").distinct())
    full = placed.join(classes.select("member", "embedding", "n"), "member")
    full = full.select("*", F.col("bucket.tab").alias("tab"), F.col("bucket.cell").alias("cell"))
    found = stored(dealt(full).mapInArrow(compare, RESULT))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    parts = connected_components(classes.select(F.col("member").alias("node")), found.where("kind = 1").select("a", "b"))
    named = classes.join(parts, classes["member"] == parts["node"]).join(links, F.col("member") == links["a"], "left")
    named = stored(named.select("label", "embedding", "n", "least", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "embedding", (F.col("n_links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    rest = v.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of ``embeddings`` of equal labels, one row each (see ``near_vectors`` for what links with nothing, and for repeats)."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
