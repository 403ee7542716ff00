"""Embedding near-duplicates: int8 tiles with rigorous bounds, exact where it matters.

Equal vectors of a label are one class. The classes of a label are dealt by a
hash into blocks of at most about BLOCK_ROWS rows and BLOCK_BYTES bytes, and every
pair of blocks is a tile. A vector goes to one tile for each block of its label,
in the precision it came in: bytes moved grow with the number of blocks, work with
its square, as comparing all pairs asks. In a tile each unit vector u is held as s * q with q of int8 and the exact error
e = |u - s * q|; then |u.v - s s' q.q'| <= e (1 + e') + e', so only pairs whose
product plus bound reaches the threshold are computed again in double precision.
A tile returns link counts and a spanning forest of its links, never the pairs.

Rows: one output row per input row. Vectors that are null, empty, zero or hold
null or non-finite components, and rows with a null label, link with nothing.
Vectors of different lengths do not link. Repeated rows are vectors of their
own, linked to each other. A null id is kept and is never the least of its
component. Pairs at the threshold exactly are linked; among links that connect the
same, which ones a forest has does not matter. Extra columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, written
from .components import components

THRESHOLD = 0.98
BLOCK_ROWS = 16_384
#: Of a block's vectors as a tile holds them: doubles and codes.
BLOCK_BYTES = 16 << 20
STRIP_ROWS = 256
#: Room for rounding in the bound's own double arithmetic.
SLACK = 1e-9
#: Products of so many int8 values add up exactly in single precision.
EXACT_DIMS = 1_024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, int8 codes as float32, scales, errors) of the rows of x, which are not zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - scale[:, None] * codes, axis=1)
    return unit, codes.astype(np.float32), scale, error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T).astype(np.float64) for k in range(0, a.shape[1], EXACT_DIMS))


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD):
    """Yield (i, j) arrays of all pairs at or above the threshold; right None: pairs i < j within left."""
    u, q, s, e = quantise(left)
    u2, q2, s2, e2 = (u, q, s, e) if right is None else quantise(right)
    for at in range(0, len(u), STRIP_ROWS):
        rows = slice(at, at + STRIP_ROWS)
        upper = _products(q[rows], q2) * s[rows, None] * s2[None, :] + e[rows, None] * (1 + e2)[None, :] + e2[None, :] + SLACK
        i, j = np.nonzero(upper >= threshold)
        i += at
        if right is None:
            i, j = i[keep := i < j], j[keep]
        for k in range(0, len(i), 1 << 17):
            some = slice(k, k + (1 << 17))
            cos = np.einsum("ij,ij->i", u[i[some]], u2[j[some]])
            yield i[some][good := cos >= threshold], j[some][good]


def _forest(n: int, pairs, weight: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each of n rows, by weight, and links that connect what the pairs connect."""
    counts, root, kept = np.zeros(n, np.int64), np.arange(n), []
    for i, j in pairs:
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if len(i):
            # One link for each pair of sets; of those, the ones that join sets not joined before.
            _, first = np.unique(np.minimum(root[i], root[j]) * n + np.maximum(root[i], root[j]), return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                a, b = x, y
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    kept.append((x, y))
            while (root[root] != root).any():
                root = root[root]
    return counts, kept


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    require(vectors, "vec_id", "embedding", "label")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    value = F.transform("embedding", lambda x: x.cast("float" if kind == "float" else "double"))
    fine = F.col("label").isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), value.alias("vector"), F.coalesce(fine, F.lit(False)).alias("fine"))
    class_of = [F.xxhash64(F.lit(n), "label", F.size("vector"), "vector").alias(f"k{n}") for n in (1, 2)]
    good = rows.where("fine").select("vec_id", "label", "vector", *class_of)
    classes = good.groupBy("k1", "k2", F.col("label").cast("string").alias("label"), F.size("vector").alias("dims")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = written(classes, "classes")
    room = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.expr(f"{BLOCK_BYTES} div (12 * dims)")))
    blocks = classes.groupBy("label", "dims").agg(F.count("*").alias("rows")).select("label", "dims", F.ceil(F.col("rows") / room).alias("blocks"))
    dealt = classes.join(blocks, ["label", "dims"]).withColumn("own", F.pmod("k1", "blocks"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("label", "dims", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "k1", "k2", "n", "vector")

    def run(group: pa.Table) -> pa.Table:
        own, n = group["own"].to_numpy(), group["n"].to_numpy()
        keys = list(zip(group["k1"].to_pylist(), group["k2"].to_pylist(), strict=True))
        order = sorted(range(len(keys)), key=lambda r: (own[r], keys[r]))  # the same forest in every run
        vector = group["vector"].combine_chunks()
        x = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)[order]
        own, n, keys = own[order], n[order], [keys[r] for r in order]
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        if lo == hi:
            pairs = tile_links(x, None, threshold)
        else:
            cut = int((own == lo).sum())
            pairs = ((i, j + cut) for i, j in tile_links(x[:cut], x[cut:], threshold)) if 0 < cut < len(x) else iter(())
        counts, kept = _forest(len(x), pairs, n)
        some = np.flatnonzero(counts)
        out = [(*keys[r], int(counts[r]), None, None) for r in some] + [(*keys[i], None, *keys[j]) for i, j in kept]
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = ["k1", "k2", "links", "to1", "to2"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    found = written(tiles.groupBy("label", "dims", "lo", "hi").applyInArrow(run, ", ".join(f"{c} long" for c in names)), "tiles")
    reps = classes.select("k1", "k2", "rep", "n")
    counted = found.where("links IS NOT NULL").groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    ends = found.where("links IS NULL").join(reps.select("k1", "k2", F.col("rep").alias("a")), ["k1", "k2"])
    ends = ends.join(reps.select(F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.col("rep").alias("b")), ["to1", "to2"]).select("a", "b")
    groups = components(ends)
    of_class = reps.join(counted, ["k1", "k2"], "left").join(groups, reps["rep"] == groups["id"], "left")
    of_class = of_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.select("vec_id", "fine", *[F.when(F.col("fine"), k).alias(f"k{n}") for n, k in ((1, class_of[0]), (2, class_of[1]))])
    out = keyed.where("fine").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
