"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector, padded with zeros and rotated at random, is stored as its signs and one correction factor, the inner
product of the rotated vector with the unit vector of its signs. From these the inner product with any other vector is
estimated without bias, and a bound holds with known confidence; only pairs whose upper bound reaches the threshold
are computed again exactly, in double precision. The other vector of a pair is needed in the estimate only in steps of
four bits, rounded up or down at random, which leaves the estimate without bias and adds a known variance to the bound. So signs, steps and factors travel to the buckets, and whole vectors only to those where
the bounds leave a pair of them open.

Pairs are looked for in buckets: in each of several tables, further random rotations give a vector the axes that it is
nearest to, and vectors with equal axes share a bucket. The number of axes follows the logarithm of the number of
vectors, so buckets stay small at any size, and the number of tables the wanted recall at the threshold. A crowded
bucket is cut into parts and every two parts meet in a task of their own. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import checked_broadcast, staged, table
from terraspan.llm.components import components


@dataclass(frozen=True)
class Params:
    threshold: float = 0.9
    recall: float = 0.99  # of pairs right at the threshold, bounds of 4 sigma included; closer ones are found more surely
    bits: int = 256  # of the stored code at least; as many as there are dimensions, if these are more
    sigmas: float = 4.0  # width of the bounds
    bucket: int = 512  # vectors a bucket should hold, about, if directions were spread evenly
    part: int = 1024  # vectors of a crowded bucket that go together
    seed: int = 3


# ---- codes -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of unit vectors (rows), padded to the rotation's size."""
    turned = unit @ turn[: unit.shape[1]]
    signs = turned >= 0
    factor = np.abs(turned).sum(1) / np.sqrt(turn.shape[0])  # inner product with the unit vector of its signs
    return np.packbits(signs, axis=1), factor


def step_codes(unit: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (rows) in 15 steps of a size of their own, packed in half bytes, and the sizes. A component goes to the step
    above or below at random, so that its expected value is itself; its variance is at most size² / 4."""
    unit = np.pad(unit, ((0, 0), (0, unit.shape[1] % 2)))
    size = np.maximum(np.abs(unit).max(1) / 7.5, 1e-30).astype(np.float32)
    low = (unit / size[:, None]).astype(np.float32) + np.float32(7.5)
    steps = np.clip(np.floor(low + rng.random(low.shape, np.float32)), 0, 15).astype(np.uint8)
    return steps[:, ::2] | steps[:, 1::2] << 4, size


def unpacked_steps(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty((len(steps), 2 * steps.shape[1]), np.float32)
    out[:, ::2], out[:, 1::2] = steps & 15, steps >> 4
    return (out - np.float32(7.5)) * size[:, None].astype(np.float32)


def spread(factors: np.ndarray, d: int, sigmas: float, size: float = 0.0) -> np.ndarray:
    """Half widths of the bounds of vectors with d signs. size: of the steps of the other vectors, at most; 0 if exact."""
    return sigmas * np.sqrt(np.maximum(1 - factors**2, 0) / (d - 1) + size**2 / 4) / factors


def decoded(codes: np.ndarray, factors: np.ndarray, d: int) -> np.ndarray:
    """What stands for coded vectors in inner products with rotated ones."""
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    return signs * (1 / (factors * np.sqrt(d)))[:, None].astype(np.float32)


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated unit vectors (columns), and the
    half widths of their bounds."""
    d = turned.shape[1]
    guess = decoded(codes, factors, d) @ turned.T.astype(np.float32)
    return guess, np.broadcast_to(spread(factors, d, sigmas)[:, None], guess.shape)


@lru_cache(maxsize=256)
def agreement(d: int, axes: int, threshold: float, draws: int = 20_000) -> float:
    """Chance that two vectors with this cosine are nearest to the same one of the first axes (and their opposites)
    after a random rotation, from random pairs."""
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, draws, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= np.einsum("ij,ij->i", x, y)[:, None] * x
    y = threshold * x + np.sqrt(1 - threshold**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return max(float((nearest(x[:, :axes]) == nearest(y[:, :axes])).mean()), 1 / draws)


def nearest(turned: np.ndarray) -> np.ndarray:
    """Numbers of the axes, or their opposites, nearest to rotated vectors."""
    at = np.abs(turned).argmax(1)
    return 2 * at + (turned[np.arange(len(at)), at] < 0)


def shape_of(n: int, d: int, params: Params) -> tuple[list[int], int]:
    """Axes of each of a table's hashes, and the number of tables, for n vectors."""
    bits = float(np.log2(max(n / params.bucket, 1)))
    whole = int(bits // np.log2(2 * d))
    rest = 2 ** (bits - whole * np.log2(2 * d))
    axes = [d] * whole + ([min(d, int(np.ceil(rest / 2)))] if rest > 1.01 else [])
    agree = float(np.prod([agreement(d, k, params.threshold) for k in axes]))
    return axes, max(1, int(np.ceil(np.log(1 - params.recall) / np.log(max(1 - agree, 1e-9)))))


def table_codes(unit: np.ndarray, axes: list[int], tables: int, seed: int) -> np.ndarray:
    out = np.zeros((len(unit), tables), np.int64)
    d = unit.shape[1]
    for t in range(tables):
        for j, k in enumerate(axes):
            out[:, t] = out[:, t] * (2 * k) + nearest(unit @ rotation(d, seed * 100_003 + t * 101 + j)[:, :k])
    return out


def units(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square leaves the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- the operator ----------------------------------------------------------------------------------------------------


def near_duplicates(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors at the threshold or above that were found), ``component_id`` (smallest
    vec_id reachable by links) and ``kept`` (vec_id = component_id) for every row of ``vectors`` (vec_id, embedding).

    A vector that is null, empty, zero or holds a null or a component that is not finite links with nothing. Vectors
    of different lengths do not link. Equal vectors link with each other. Labels and other columns are not read. An
    empty table gives an empty result. Ids must be unique; a repeated id counts as another vector and comes out twice.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(valid, F.transform(x, lambda v: v + 0)).alias("embedding"))  # + 0: no negative zeros
    found = rows.where("embedding is not null")
    both = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]  # 128 bits stand for the vector
    distinct = found.select("*", *both).groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    distinct = staged(distinct.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    pieces = [_linked(distinct.where(F.size("embedding") == d), n, d, params) for d, n in sizes.items()]
    if not pieces:
        own = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return own.withColumn("kept", F.lit(True))
    pairs = pieces[0]
    for p in pieces[1:]:
        pairs = pairs.unionByName(p)
    pairs = staged(pairs, "vector_links")
    other = pairs.groupBy("vec_id").agg(F.sum("links").alias("links"))
    reached = components(pairs.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    of_rep = (
        distinct.join(other, "vec_id", "left").join(reached.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    linked = found.select("vec_id", *both).join(of_rep, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(vectors: DataFrame, n: int, d: int, params: Params) -> DataFrame:
    """For tiles with links: vec_id, the weight of its partners there and the smallest id it reaches there (root)."""
    axes, tables = shape_of(n, d, params)
    size = -(-max(params.bits, d) // 8) * 8
    short = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"  # kept as they came, so that nothing is rounded
    kind = np.float32 if short else np.float64

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                yield batch.iloc[at : at + 2048]

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in some(batches):
            codes = table_codes(units(rows["embedding"].tolist()), axes, tables, params.seed)
            yield pd.DataFrame({"t": np.tile(np.arange(tables, dtype=np.int32), len(rows)), "bucket": codes.ravel()})

    def bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(size, params.seed)
        for rows in some(batches):
            unit = units(rows["embedding"].tolist())
            codes, factors = encode(unit, turn)
            numbers = rows["row"].to_numpy()
            steps, sizes = step_codes(unit, np.random.default_rng([params.seed, *numbers[:1].tolist()]))
            scales = np.column_stack([factors, sizes]).astype(np.float32).view(np.uint8)
            code = np.array([y.tobytes() for y in np.hstack([codes, steps, scales])], object)
            yield pd.DataFrame({
                "t": np.tile(np.arange(tables, dtype=np.int32), len(rows)), "bucket": table_codes(unit, axes, tables, params.seed).ravel(),
                "row": np.repeat(numbers, tables), "code": np.repeat(code, tables),
            })

    picked = vectors.select("row", "embedding")
    counts = picked.mapInPandas(buckets, "t int, bucket long").groupBy("t", "bucket").agg(F.count("*").alias("n"))
    crowded = staged(counts.where(F.col("n") > params.part).select("t", "bucket", F.ceil(F.col("n") / params.part).cast("int").alias("parts")), "crowded")
    rows = picked.mapInPandas(bucketed, "t int, bucket long, row long, code binary")
    dealt = rows.join(checked_broadcast(crowded, crowded.count()), ["t", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("row", "t"), F.col("parts")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    tiles = dealt.withColumn("mine", own).select("*", F.inline(tile)).drop("parts")
    keys = ["t", "bucket", "i", "j"]

    def by_tile(batches: Iterator[pd.DataFrame], of_tile: Callable[[tuple, pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
        """What a function gives for each tile of two rows or more, of batches that are sorted by tile."""
        held: pd.DataFrame | None = None

        def whole(rows: pd.DataFrame, edges: np.ndarray) -> Iterator[pd.DataFrame]:
            found = [of_tile(tuple(rows[k].iat[a] for k in keys), rows.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]
            if found := [f for f in found if f is not None]:
                yield pd.concat(found)

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = held[keys].to_numpy()
            edges = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
            yield from whole(held, edges)
            held = held.iloc[edges[-1] :].reset_index(drop=True)
        if held is not None:
            yield from whole(held, np.array([0, len(held)]))

    def maybe(rows: pd.DataFrame, across: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile whose upper bound reaches the threshold, in either order of the two; pairs inside one part meet
        in that part's own tile."""
        data = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        codes, steps, scales = np.split(data, [size // 8, size // 8 + -(-d // 2)], axis=1)
        factors, sizes = np.ascontiguousarray(scales).view(np.float32).T.astype(float)
        other, mine = unpacked_steps(steps, sizes)[:, :d].T, rows["mine"].to_numpy()
        back = rotation(size, params.seed)[:d].T.astype(np.float32)  # turning one side back leaves d components of either
        least = (params.threshold - spread(factors, size, params.sigmas, sizes.max())).astype(np.float32)
        p, q = [], []
        for a in range(0, len(rows), 512):  # a block of rows against those that follow
            guess = decoded(codes[a : a + 512], factors[a : a + 512], size) @ back @ other[:, a:]
            x, y = np.nonzero(guess >= least[a : a + 512, None])
            later = (x < y) & (mine[a + x] != mine[a + y]) if across else x < y
            p.append(a + x[later])
            q.append(a + y[later])
        return np.concatenate(p), np.concatenate(q)

    def open_rows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        at = np.unique(np.concatenate(maybe(rows, key[2] != key[3])))
        return rows.iloc[at] if len(at) else None

    def exact(key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        p, q = maybe(rows, key[2] != key[3])
        unit = units(np.frombuffer(b"".join(rows["x"]), kind).reshape(len(rows), d))
        sure = [np.einsum("ij,ij->i", unit[p[a : a + 65536]], unit[q[a : a + 65536]]) >= params.threshold for a in range(0, len(p), 65536)]
        sure = np.concatenate([np.zeros(0, bool), *sure])
        p, q = p[sure], q[sure]
        if len(p) and key[0]:  # a pair counts in the first table whose bucket it shares
            among, at = np.unique(np.append(p, q), return_inverse=True)
            before = table_codes(unit[among], axes, int(key[0]), params.seed)
            apart = (before[at[: len(p)]] != before[at[len(p) :]]).all(1)
            p, q = p[apart], q[apart]
        return summed(p, q, rows["vec_id"].to_numpy(), rows["weight"].to_numpy()) if len(p) else None

    def summed(p: np.ndarray, q: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
        links = np.bincount(p, weight[q], len(ids)) + np.bincount(q, weight[p], len(ids))
        root = np.arange(len(ids))[np.argsort(np.argsort(ids))]  # rank of the id, so that the least rank is the least id
        while True:
            new = root.copy()
            np.minimum.at(new, p, root[q])
            np.minimum.at(new, q, root[p])
            if np.array_equal(new, root):
                break
            root = new
        at = np.flatnonzero(links)
        return pd.DataFrame({"vec_id": ids[at], "links": links[at].astype(np.int64), "root": np.sort(ids)[root[at]]})

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_tile(batches, open_rows)

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_tile(with_bytes(batches), exact)

    def with_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(x=[y.tobytes() for y in np.array(batch["embedding"].tolist(), kind).reshape(len(batch), -1)]).drop(columns="embedding")

    in_tiles = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    left = in_tiles(tiles.select(*keys, "mine", "row", "code")).mapInPandas(opened, "t int, bucket long, i int, j int, mine int, row long, code binary")
    return in_tiles(left.join(vectors.select("row", "vec_id", "weight", "embedding"), "row")).mapInPandas(linked, "vec_id long, links long, root long")


def op3_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs; candidates at small sizes are all pairs too, so that the results agree.
ORACLE = {
    "op3_vector_dedup": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
  WHERE len(x) > 0 AND list_bool_and(list_transform(x, lambda y: y IS NOT NULL AND isfinite(y))) AND list_dot_product(x, x) > 0),
l AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
}
