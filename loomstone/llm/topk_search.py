"""Exact top-k search by inner product in an M-tree with best-first search.

Vectors are turned into integers. With R the largest squared norm, each vector x gets one more component,
sqrt(R - |x|^2), and each query a 0: the Euclidean distance of the two, squared, is R + |q|^2 - 2 q.x, so the
nearest vectors are those of the highest inner products, in a metric space.

The tree has four levels of nodes. Under the root stand routing objects (a bounded sample of the vectors), to the
nearest of which each vector belongs. Under a routing object stand rings: its members by their distance to it, so that a
ring lies between two radii. A ring's members are a subtree of about ``SUBTREE`` vectors, or several where very many lie
at one distance (copies, say). A subtree is a set of leaf pages of at most ``PAGE`` vectors, each with its own routing
object, covering radius and the distances of its members to that object; a page also keeps its object's distance to the
parent. A subtree is one row of binary pages, so it is built and searched in one task of bounded memory.

A query first searches one subtree in the ring that is nearest to it, which bounds its k-th distance; then it goes only
to the rings that reach into that bound, and in each subtree takes pages by their least possible distance, until that
exceeds the bound. The distance of a query to a page's object is not computed where the distances of both to the parent
already exclude the page, nor that to a member where the distances of both to the object do. Distances that bound are
floats with a slack; scores are exact integers, so nothing is lost to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .scratch import Scratch

K = 10
SCALE = 1024
#: Most routing objects under the root (a bounded broadcast), vectors of a subtree, vectors of a page, queries of a block.
ROOTS, SUBTREE, PAGE, BLOCK = 256, 4096, 64, 2048
#: Steps of distance to a routing object in which its members are counted, to cut rings of about a subtree.
STEPS = 512
#: Pages that are searched together, at first (then twice as many each time).
TOGETHER = 4
#: A bound must exceed another by this share to exclude anything.
SLACK = 1e-9
_PAGES = "root int, part int, ids binary, vectors binary, objects binary, sizes binary, radii binary, to_parent binary, to_object binary"


def quantised(embeddings: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): components as floor(scale * x), x as double. Null vectors, vectors with null or non-finite components and null ids are left out."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = embeddings.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return usable.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(vectors: pd.Series | list, width: int) -> np.ndarray:
    """Rows of integers as floats, padded with zeros to the width."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """The vectors with the component that makes all norms equal."""
    return np.c_[x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * a @ b.T, 0))


def build_pages(ids: np.ndarray, x: np.ndarray, parent: np.ndarray, page: int = PAGE) -> dict[str, np.ndarray]:
    """Leaf pages of lifted vectors x under a parent object: members in page order, and for each page its object, size, radius and distance to the parent.

    Vectors are split at the median of their distance to one of two far vectors, again and again, until they fit a page;
    the object of a page is its member nearest to the mean.
    """
    todo, leaves = [np.arange(len(ids))], []
    while todo:
        at = todo.pop()
        if len(at) <= page:
            leaves.append(at)
            continue
        far = at[np.argmax(((x[at] - x[at[0]]) ** 2).sum(1))]
        other = at[np.argmax(((x[at] - x[far]) ** 2).sum(1))]
        lean = ((x[at] - x[far]) ** 2).sum(1) - ((x[at] - x[other]) ** 2).sum(1)
        order = np.argsort(lean, kind="stable")
        todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    objects = np.array([x[at[np.argmin(((x[at] - x[at].mean(0)) ** 2).sum(1))]] for at in leaves])
    to_object = [np.sqrt(((x[at] - o) ** 2).sum(1)) for at, o in zip(leaves, objects, strict=True)]
    order = np.concatenate(leaves)
    return {
        "ids": ids[order], "vectors": x[order], "objects": objects, "sizes": np.array([len(a) for a in leaves]),
        "radii": np.array([d.max() for d in to_object]), "to_parent": np.sqrt(((objects - parent) ** 2).sum(1)), "to_object": np.concatenate(to_object),
    }


class Best:
    """The k best (score, id) of a query: highest score, then smallest id."""

    def __init__(self, k: int, worst: float) -> None:
        self.k, self.floor = k, worst
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """floor: the score below which nothing counts any more."""
        keep = scores >= self.floor
        if not keep.any():
            return
        scores, ids = np.concatenate([self.scores.astype(scores.dtype), scores[keep]]), np.concatenate([self.ids, ids[keep]])
        if len(scores) > 8 * self.k:  # all that tie with the k-th stay
            tie = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= tie], ids[scores >= tie]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.scores[-1])


@dataclass(frozen=True)
class Space:
    """Of the lifted space: the largest squared norm, the number of components, and what distances may be wrong by.

    Squares of integers below 2**52 are exact floats. Beyond that distances get a slack of their own, and scores are
    taken in 64-bit integers, which are exact where a score fits into one.
    """

    most: float
    width: int

    @property
    def exact(self) -> bool:
        return self.most < 1 << 52

    @property
    def slack(self) -> float:
        return SLACK if self.exact else 8 * float(np.sqrt(self.width * 2.0**-52 * self.most))

    def reach(self, norm: float | np.ndarray, floor: float | np.ndarray) -> float | np.ndarray:
        """The distance beyond which nothing has a score of floor or more with a query of a squared norm."""
        return np.sqrt(np.maximum(self.most + norm - 2 * floor, 0)) * (1 + SLACK) + self.slack

    def below(self, floor: np.ndarray) -> np.ndarray:
        """A score as a float that isn't above it."""
        return floor if self.exact else np.where(np.isfinite(floor), floor - np.abs(floor) * 2.0**-51, floor)

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return x @ q if self.exact else (x.astype(np.int64) * q.astype(np.int64)).sum(1)


def search_pages(tree: dict[str, np.ndarray], parent: np.ndarray, own: int, q: np.ndarray, space: Space, k: int, floor: float, told: dict | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of a query in a subtree, but its own id; floor: a score that k others are known to reach.

    Pages are taken by their least possible distance, some at a time. told: gets the number of distances computed to
    objects and to members.
    """
    lifted = np.r_[q, 0.0]
    norm = float(q @ q)
    best = Best(k, floor)
    to_parent = float(np.sqrt(((lifted - parent) ** 2).sum()))
    least = np.maximum(np.abs(to_parent - tree["to_parent"]) - tree["radii"], 0)  # without a distance computed
    ends = np.cumsum(tree["sizes"])
    x, to_object, ids = tree["vectors"], tree["to_object"], tree["ids"]
    objects = members = 0
    likely = np.argsort(least, kind="stable")
    # a few pages first: what they hold bounds the rest
    for group in (likely[:TOGETHER], likely[TOGETHER:]):
        group = group[least[group] <= space.reach(norm, best.floor)]
        objects += len(group)
        mine = np.sqrt(((tree["objects"][group] - lifted) ** 2).sum(1))
        nearest = np.maximum(least[group], mine - tree["radii"][group])
        order = np.argsort(nearest, kind="stable")
        at, step = 0, TOGETHER
        while at < len(order) and nearest[order[at]] <= space.reach(norm, best.floor):
            now = order[at : at + step]
            at, step = at + step, 2 * step
            sizes = tree["sizes"][group[now]]
            rows = np.repeat(ends[group[now]] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            near = rows[np.abs(to_object[rows] - np.repeat(mine[now], sizes)) <= space.reach(norm, best.floor)]
            members += len(near)
            near = near[ids[near] != own]
            best.offer(space.scores(x[near, :-1], q), ids[near])
    if told is not None:
        told["objects"], told["members"] = told.get("objects", 0) + objects, told.get("members", 0) + members
    return [(int(s), int(i)) for s, i in zip(best.scores.tolist(), best.ids.tolist(), strict=True)]


@dataclass
class Rings:
    """Rings of the routing objects: root, least and greatest distance, first subtree and number of subtrees of each."""

    root: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    number: np.ndarray


def cut_rings(counted: list[tuple[int, int, int, float, float]], subtree: int) -> tuple[Rings, list[tuple[int, int, int, int]]]:
    """Rings of about a subtree, from counts (root, step, n, least and greatest distance), and (root, step, first, number) for each step.

    Neighbouring steps of a routing object share a ring until it is full; a step with more than a subtree has several
    subtrees of its own.
    """
    rings: list[list] = []
    steps: list[tuple[int, int, int, int]] = []
    held: dict[int, int] = {}  # members of a ring
    parts = 0
    for root, step, n, low, high in sorted(counted):
        last = len(rings) - 1
        if rings and rings[last][0] == root and held[last] + n <= subtree:
            held[last] += n
            rings[last][2] = high
        else:
            last += 1
            held[last] = n
            number = max(1, -(-n // subtree))
            rings.append([root, low, high, parts, number])
            parts += number
        steps.append((root, step, rings[last][3], rings[last][4]))
    kinds = (np.int32, float, float, np.int32, np.int32)
    return Rings(*(np.array([r[i] for r in rings], dtype=k) for i, k in enumerate(kinds))), steps


def _unpacked(row: pd.Series, width: int) -> dict[str, np.ndarray]:
    wide = {"vectors", "objects"}
    return {c: np.frombuffer(row[c], np.int64 if c in ("ids", "sizes") else np.float64).reshape(*((-1, width + 1) if c in wide else (-1,))) for c in ("ids", "vectors", "objects", "sizes", "radii", "to_parent", "to_object")}


def search(data: DataFrame, queries: DataFrame, k: int = K, roots: int = ROOTS, subtree: int = SUBTREE, page: int = PAGE) -> DataFrame:
    """For each query (id, v) its k highest inner products with the rows of data (id, v) of another id, ties to the smaller id.

    Returns query_id, rank (from 1), vec_id, score; fewer rows where there are fewer candidates. Vectors shorter than
    the longest count as padded with zeros. Rows that repeat an id count as rows of their own. No data or no queries
    give no rows. Scores must fit into 64 bits.
    """
    spark = data.sparkSession
    scratch = Scratch(spark, "mtree")
    out = "query_id long, rank int, vec_id long, score long"
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    both = data.select(F.lit(1).alias("n"), F.lit(0).alias("m"), square.alias("r"), F.size("v").alias("w")).unionByName(queries.select(F.lit(0).alias("n"), F.lit(1).alias("m"), F.lit(0.0).alias("r"), F.size("v").alias("w")))
    count, n_queries, most, width = both.agg(F.sum("n"), F.sum("m"), F.max("r"), F.max("w")).first()
    if not count or not n_queries:
        return spark.createDataFrame([], out)
    space = Space(most, max(width, 1))
    width = space.width
    n_roots = max(1, min(roots, round(count / subtree)))
    pivots = data.orderBy(F.xxhash64("id"), "id").limit(n_roots).collect()  # a bounded sample
    centres = _lift(_matrix([p.v for p in pivots], width), most)

    def routed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = _lift(_matrix(part["v"], width), most)
                root = _distances(x, centres).argmin(1)
                yield part.assign(root=root.astype("int32"), far=np.sqrt(((x - centres[root]) ** 2).sum(1)))

    belongs = scratch.keep(data.mapInPandas(routed, "id long, v array<long>, root int, far double"), "routed")
    radius = belongs.groupBy("root").agg(F.max("far").alias("radius"))  # a row for each routing object
    step = F.least(F.lit(STEPS - 1), F.floor(F.coalesce(F.try_divide(F.col("far"), F.col("radius")), F.lit(0.0)) * STEPS)).cast("int")
    stepped = belongs.join(F.broadcast(radius), "root").withColumn("step", step).drop("radius")
    counted = stepped.groupBy("root", "step").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    rings, steps = cut_rings([tuple(r) for r in counted.collect()], subtree)  # ROOTS * STEPS at most

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        root, part = int(pdf["root"].iloc[0]), int(pdf["part"].iloc[0])
        tree = build_pages(pdf["id"].to_numpy(np.int64), _lift(_matrix(pdf["v"], width), most), centres[root], page)
        return pd.DataFrame([{"root": root, "part": part, **{c: a.astype(np.int64 if c in ("ids", "sizes") else np.float64).tobytes() for c, a in tree.items()}}])

    ringed = stepped.join(F.broadcast(spark.createDataFrame(steps, "root int, step int, first int, number int")), ["root", "step"])  # ROOTS * STEPS at most
    dealt = ringed.select("id", "v", "root", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("number"))).cast("int").alias("part"))
    trees = scratch.keep(dealt.groupBy("root", "part").applyInPandas(built, _PAGES), "trees")
    scratch.drop(belongs)

    def found(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(theirs) and len(mine):
            tree = _unpacked(theirs.iloc[0], width)
            parent = centres[int(key[0])]
            for query, q, floor in zip(mine["id"], _matrix(mine["v"], width), mine["floor"], strict=True):
                rows += [(query, i, s) for s, i in search_pages(tree, parent, query, q, space, k, floor)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def visit(asked: DataFrame) -> DataFrame:
        blocks = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, -(-n_queries // BLOCK)))).cast("int")
        blocked = asked.withColumn("block", blocks)
        wanted = blocked.select("root", "part", "block").distinct()
        pages = trees.join(wanted, ["root", "part"]).withColumnsRenamed({c: f"page_{c}" for c in ("root", "part", "block")})
        return blocked.groupBy("root", "part", "block").cogroup(pages.groupBy("page_root", "page_part", "page_block")).applyInPandas(found, "query_id long, vec_id long, score long")

    def top(rows: DataFrame) -> DataFrame:
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    asked_of = "id long, v array<long>, root int, part int, floor double"

    def to_rings(q: np.ndarray) -> np.ndarray:
        """Least distance of each query to each ring."""
        d = _distances(np.c_[q, np.zeros(len(q))], centres)[:, rings.root]
        return np.maximum(np.maximum(rings.low - d, d - rings.high), 0)

    def home_of(ids: pd.Series, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ring and subtree in which a query's search begins."""
        ring = least.argmin(1)
        return ring, rings.first[ring] + ids.to_numpy() % rings.number[ring]

    def home(parts_of: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of:
            if len(part):
                ring, at = home_of(part["id"], to_rings(_matrix(part["v"], width)))
                yield part.assign(root=rings.root[ring], part=at.astype("int32"), floor=-np.inf)[["id", "v", "root", "part", "floor"]]

    first = scratch.keep(visit(queries.mapInPandas(home, asked_of)), "first")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("s").cast("double")).alias("floor"))

    def rest(parts_of: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every other subtree of the rings that reach into the bound."""
        for part in parts_of:
            rows = []
            if len(part):
                q = _matrix(part["v"], width)
                least = to_rings(q)
                floor = space.below(part["floor"].fillna(-np.inf).to_numpy(float))
                reach = space.reach((q * q).sum(1), floor)
                _, homes = home_of(part["id"], least)
                for i, (query, v) in enumerate(zip(part["id"], part["v"], strict=True)):
                    for ring in np.flatnonzero(least[i] * (1 - SLACK) - space.slack <= reach[i]):
                        first_part = int(rings.first[ring])
                        rows += [(query, v, int(rings.root[ring]), p, floor[i]) for p in range(first_part, first_part + int(rings.number[ring])) if p != homes[i]]
            yield pd.DataFrame(rows, columns=["id", "v", "root", "part", "floor"])

    asked = queries.join(floors, "id", "left").mapInPandas(rest, asked_of)
    return top(first.unionByName(visit(asked))).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every 100th vector of ``embeddings`` with all others."""
    data = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(data, data.filter(F.col("id") % 100 == 0))


#: DuckDB's version of the query, for vectors of one length.
ORACLE_SQL = f"""
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM d q JOIN d ON d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
