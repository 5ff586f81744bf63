"""Near-duplicate documents: ProbMinHash, banding and verification.

Equal texts are one node (the MD5 of the text). A node's shingles are its runs of ``WORDS`` words, weighted by one plus
the logarithm of their number. ProbMinHash draws for each shingle a Poisson process of arrivals, at a rate of its weight,
that fall on the signature's components without replacement; a component keeps the shingle that arrives first, and a
shingle's process ends as soon as it is later than every component's first arrival. Two signatures agree in a component
with the probability Jaccard of the weighted shingles. Components are cut into ``BANDS`` of ``ROWS``; nodes that agree
in a whole band share a bucket. Links go by the shingle sets, which the number of repetitions doesn't change; so texts
with repeated shingles have a second signature, of weights of one, whose bands are used besides. Of a text without any,
the two are the same.

Every pair of texts that share a bucket is either checked, or excluded by a bound that can't be wrong, or lies within one
component already; the check is exact: the Jaccard similarity of the two texts' shingle sets, ``ALIKE`` or more. No pair
list of a group is made. In each of a few rounds every node is checked against one hub only: of the most popular members
of its buckets (those that share most buckets with others, which in a group of copies is the text that they come from)
the one that it shares most buckets with. Alike nodes are contracted to components, and only buckets with several of
these go on, with other hubs. What then still lies in different components of a bucket is compared by ``parities``: bits
that tell at least how many shingles two sets differ in, and so exclude nearly all pairs that aren't links, and no link.

Hot buckets, components and texts are only ever keys of counts, minima and maxima, which are combined before the shuffle,
and of equi-joins that Spark may split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from .scratch import Scratch

#: Words of a shingle, and the least similarity of near-duplicates.
WORDS, ALIKE = 5, 0.8
#: Pairs at 0.8 share a band of the signatures without counts with a probability of 1 - (1 - 0.8**7)**36 > 0.9997.
BANDS, ROWS = 36, 7
#: Components: a prime, so that any step visits all of them; those beyond the bands are not used.
COMPONENTS = 257
#: Rounds of checks against hubs, at most; the last one finds what they have left whatever their number.
ROUNDS = 4
#: Parity bits of a text are twice its shingles, rounded up to a power of two, and this at least.
LEAST_PARITIES = 256
#: Words whose shingles are hashed at once, and bytes of a word that are hashed with its neighbours' (a longer one's digest is).
WINDOW, LONGEST_WORD = 16384, 1024
#: Signatures that are handed over at once.
HANDED = 1024
#: Shingles that are signed at once.
AT_ONCE = 100_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the shingles of texts: polynomials of their bytes, all taken from one running sum of a text."""

    def __init__(self) -> None:
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64))
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        """Powers of an odd number and of its inverse modulo 2**64."""
        if len(self.powers) < n:
            n = 1 << max(16, (n - 1).bit_length())
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64)))

    def _window(self, words: list[str], width: int) -> np.ndarray:
        raw = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.powers[: len(raw)], out=sums[1:])
        ends = np.r_[np.flatnonzero(raw == 32), len(raw)]
        starts = np.r_[0, ends[:-1] + 1][: len(ends) - width + 1]
        return (sums[ends[width - 1 :]] - sums[starts]) * self.inverses[starts]

    def shingles(self, text: str | None) -> np.ndarray:
        """Hashes of all runs of WORDS words, repeated ones repeatedly; of a shorter text, one of all its words; of no words, none."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64)
        if max(map(len, words)) > LONGEST_WORD:
            words = [w if len(w) <= LONGEST_WORD else f"\x1f{xxhash.xxh3_128_hexdigest(w.encode('utf-8', 'surrogatepass'))}" for w in words]
        width = min(WORDS, len(words))
        parts = [self._window(words[i : i + WINDOW + width - 1], width) for i in range(0, len(words) - width + 1, WINDOW)]
        return _mixed(np.concatenate(parts))

    def sets(self, text: str | None) -> np.ndarray:
        """The distinct hashes, sorted."""
        return np.unique(self.shingles(text))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits, in longs: whether the number of the (distinct) hashes that fall on a bit's place is odd.

    Each hash that only one of two sets has changes one bit, so the bits that differ are at most as many as those hashes.
    The number of bits is a power of two, and the halves of the longer of two lists are added to fold it to the shorter's.
    """
    n = max(LEAST_PARITIES, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sign(hashes: np.ndarray, weights: np.ndarray, document: np.ndarray, n_documents: int) -> np.ndarray:
    """ProbMinHash signatures: for each document (its distinct hashes with weights), the first shingle of each component.

    All processes of a batch advance together, an arrival at a time; those that are too late to matter drop out.
    """
    first = np.full(n_documents * COMPONENTS, np.inf)
    found = np.zeros(n_documents * COMPONENTS, np.uint64)
    latest = np.full(n_documents, np.inf)
    start = (_mixed(hashes ^ np.uint64(_STEP)) % np.uint64(COMPONENTS)).astype(np.int64)
    step = (_mixed(hashes + np.uint64(_STEP)) % np.uint64(COMPONENTS - 1)).astype(np.int64) + 1
    time = np.zeros(len(hashes))
    base = document * COMPONENTS
    for k in range(COMPONENTS):
        uniform = ((_mixed(hashes + np.uint64((k + 2) * _STEP & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        # without replacement: the next new component comes after a longer wait, the fewer are left
        time = time - np.log(uniform) / weights * (COMPONENTS / (COMPONENTS - k))
        held = time < latest[document]
        if not held.any():
            break
        hashes, weights, document, start, step, time, base = (a[held] for a in (hashes, weights, document, start, step, time, base))
        at = base + (start + k * step) % COMPONENTS
        np.minimum.at(first, at, time)
        won = first[at] == time
        found[at[won]] = hashes[won]
        latest = first.reshape(n_documents, COMPONENTS)[:, : BANDS * ROWS].max(1)
    return found.reshape(n_documents, COMPONENTS)[:, : BANDS * ROWS]


def signed(texts: list[str | None], shingler: Shingler) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each text: number of distinct shingles, a key for each band (none without shingles), and their parities.

    Keys are those of the weighted signature; after them, texts with repeated shingles have the keys of the signature
    without counts, null where it is the same.
    """
    band = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    odd = _mixed(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)

    def batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, list[int], list[int]]]:
        sizes = np.array([len(h) for h, _ in parts])
        hashes = np.concatenate([h for h, _ in parts])
        weights = 1 + np.log2(np.concatenate([c for _, c in parts]).astype(float))
        document = np.repeat(np.arange(len(parts)), sizes)
        key = lambda x: _mixed((x.reshape(-1, BANDS, ROWS) * odd).sum(2, dtype=np.uint64) ^ band).view(np.int64)
        keys = key(sign(hashes, weights, document, len(parts)))
        repeats = np.unique(document[weights > 1])
        own = np.isin(document, repeats)
        plain = dict(zip(repeats.tolist(), key(sign(hashes[own], np.ones(own.sum()), np.searchsorted(repeats, document[own]), len(repeats))), strict=True)) if len(repeats) else {}
        for i, n in enumerate(sizes.tolist()):
            more = [None if same else k for k, same in zip(plain[i].tolist(), (plain[i] == keys[i]).tolist(), strict=True)] if i in plain else []
            yield n, keys[i].tolist() + more if n else [], parities(parts[i][0]).tolist()

    held, size = [], 0
    for text in texts:
        held.append(np.unique(shingler.shingles(text), return_counts=True))
        size += len(held[-1][0])
        if size >= AT_ONCE or len(held) >= 256:
            yield from batch(held)
            held, size = [], 0
    if held:
        yield from batch(held)


def signatures(text: Column) -> Column:
    """Struct of n, keys and parities for a text column."""

    @F.pandas_udf("n int, keys array<long>, parities array<long>")
    def columns(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for part in parts:
            texts = part.tolist()
            for i in range(0, len(texts), HANDED):
                yield pd.DataFrame(list(signed(texts[i : i + HANDED], shingler)), columns=["n", "keys", "parities"])

    return columns(text)


def similarity(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two texts' shingle sets; 1 for two texts without words."""

    @F.pandas_udf("double")
    def jaccard(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler = Shingler()
        held: dict[str, np.ndarray] = {}

        def own(text: str) -> np.ndarray:
            if text not in held:
                if len(held) >= 64:
                    held.clear()
                held[text] = shingler.sets(text)
            return held[text]

        for left, right in parts:
            out = []
            for x, y in zip(left, right, strict=True):
                p, q = own(x), own(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / (len(p) + len(q) - both) if len(p) + len(q) else 1.0)
            yield pd.Series(out, dtype=float)

    return jaccard(a, b)


def node_of(text: str) -> Column:
    """The node of the named text column: 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): label is the component's smallest node.

    In each round a node takes its least neighbour's place, if that is smaller, and follows such steps to their end by
    doubling; then links become links between places, and those within one place go. So links are read about once: a star
    is done after the first round, and what is left shrinks fast.
    """
    total: DataFrame | None = None
    edges = scratch.keep(links.select("a", "b").filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
        place = scratch.keep(both.groupBy("node").agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "place")
        while True:
            onward = place.select(F.col("node").alias("label"), F.col("label").alias("next"))
            step = scratch.keep(place.join(onward, "label").select("node", "label", "next"), "step")
            scratch.drop(place)
            moved = not step.filter("label <> next").isEmpty()
            place = scratch.keep(step.select("node", F.col("next").alias("label")), "place")
            scratch.drop(step)
            if not moved:
                break
        of = lambda c: place.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        between = edges.join(of("a"), "a").join(of("b"), "b").filter("l_a <> l_b").select(F.least("l_a", "l_b").alias("a"), F.greatest("l_a", "l_b").alias("b")).distinct()
        left = scratch.keep(between, "edges")
        scratch.drop(edges)
        edges = left
        if total is None:
            total = place
        else:
            new = place.select(F.col("node").alias("label"), F.col("label").alias("new"))
            total = scratch.keep(total.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    return links.sparkSession.createDataFrame([], "node binary, label binary") if total is None else total


class _Checker:
    """Checks pairs of nodes once each."""

    def __init__(self, scratch: Scratch, texts: DataFrame) -> None:
        self.scratch, self.texts = scratch, texts
        self.checked: DataFrame | None = None

    def fresh(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), a < b, that were not checked before; other columns stay."""
        return pairs if self.checked is None else pairs.join(self.checked, ["a", "b"], "left_anti")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), distinct and fresh, that are alike."""
        pairs = self.scratch.keep(pairs, "pairs")
        text = lambda c: self.texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        judged = pairs.join(text("a"), "a").join(text("b"), "b").filter(similarity(F.col("text_a"), F.col("text_b")) >= ALIKE)
        self.checked = pairs if self.checked is None else self.checked.unionByName(pairs)
        return self.scratch.keep(judged.select("a", "b"), "links")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sizes_allow(x: str, y: str) -> Column:
    return F.least(x, y) >= F.greatest(x, y) * ALIKE


def may_be_alike(n: str, bits: str, n_2: str, bits_2: str) -> Column:
    """Whether the sizes and parities of two sets (named columns) leave room for a similarity of ``ALIKE``: false only where there is none."""
    folded = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, cast(size({x}) / 2 as int)), slice({x}, cast(size({x}) / 2 as int) + 1, cast(size({x}) / 2 as int)), (u, v) -> u ^ v), {x})"
    differ = F.expr(f"aggregate(zip_with({folded(bits, bits_2)}, {folded(bits_2, bits)}, (u, v) -> bit_count(u ^ v)), 0, (s, u) -> s + u)")
    # of two sets with a share s of their union in common, (1 - s) / (1 + s) of the sum of their sizes is in one only
    return _sizes_allow(n, n_2) & (differ * (1 + ALIKE) <= (F.col(n) + F.col(n_2)) * (1 - ALIKE) + 1e-6)


def node_classes(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(node, label) of the nodes that are alike to another one; label is their class's smallest node."""
    empty = docs.sparkSession.createDataFrame([], "node binary, label binary")
    plain = docs.select(node_of(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = plain.select("node", signatures(F.col("text")).alias("s")).select("node", "s.*").filter(F.col("n") > 0)
    # equal texts have equal signatures, so any of them will do
    nodes = scratch.keep(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "keys", "parities"))), "nodes")
    members = nodes.select("node", "n", F.posexplode("keys").alias("band", "key")).filter("key is not null").drop("band")
    shared = members.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > 1)
    found = scratch.keep(members.join(shared, "key"), "shared")
    # of each node with buckets: how many members they have
    wanted = scratch.keep(found.groupBy("node").agg(F.sum("c").alias("popular")), "wanted")
    if wanted.isEmpty():
        return empty
    buckets = scratch.keep(found.drop("c").join(wanted, "node"), "buckets")
    scratch.drop(found)
    bits = scratch.keep(nodes.select("node", "parities").join(wanted, "node", "left_semi"), "parities")
    scratch.drop(nodes)
    # copies are combined before the shuffle; merged at any size: the list of wanted nodes grows with the corpus
    texts = scratch.keep(plain.groupBy("node").agg(F.first("text").alias("text")).join(wanted.hint("merge"), "node", "left_semi"), "texts")
    checker = _Checker(scratch, texts)
    labels: DataFrame | None = None

    def open_buckets() -> DataFrame:
        """Members of the buckets that have several components: key, node, n, popular, label."""
        if labels is None:
            return buckets.withColumn("label", F.col("node"))
        labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter(F.col("x") != F.col("y")).select("key")
        return labelled.join(several, "key")

    def joined(links: DataFrame) -> DataFrame | None:
        """Labels after the links of a round."""
        if labels is None:
            return components(scratch, links)
        own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).filter("a <> b")
        moved = components(scratch, between).select(F.col("node").alias("label"), F.col("label").alias("new"))
        kept = labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        fresh = moved.join(labels.select(F.col("label")).distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("new").alias("label"))
        return scratch.keep(kept.unionByName(fresh).distinct(), "joined")

    used: DataFrame | None = None
    for _ in range(ROUNDS):
        now = scratch.keep(open_buckets(), "open")
        others = now if used is None else now.join(used, "node", "left_anti")
        hubs = scratch.keep(others.groupBy("key").agg(F.max(F.struct("popular", F.xxhash64("node").alias("o"), "node", "n", "label")).alias("hub")), "hubs")
        met = now.join(hubs, "key").filter((F.col("label") != F.col("hub.label")) & _sizes_allow("n", "hub.n"))
        each = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("times"), F.max("hub.popular").alias("popular"))
        best = checker.fresh(each.select("node", "hub", "times", "popular", *_ordered("node", "hub"))).groupBy("node").agg(F.max(F.struct("times", "popular", "a", "b")).alias("p"))
        links = checker.alike(best.select("p.a", "p.b").distinct())
        if links.isEmpty():
            break
        labels = joined(links)
        now_used = hubs.select("hub.node").distinct()
        used = now_used if used is None else used.unionByName(now_used).distinct()
    rest = scratch.keep(open_buckets().select("key", "node", "n", "label").join(bits, "node"), "open")
    right = rest.select(*(F.col(c).alias(f"{c}_2") for c in rest.columns))
    near = (F.col("key") == F.col("key_2")) & (F.col("label") < F.col("label_2")) & may_be_alike("n", "parities", "n_2", "parities_2")
    links = checker.alike(checker.fresh(rest.join(right, near).select(*_ordered("node", "node_2")).distinct()))
    if not links.isEmpty():
        labels = joined(links)
    scratch.only(labels)
    return empty if labels is None else labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key with class_id (the least key of its class), class_size (rows) and n_texts (different texts).

    Rows are kept one to one. Null texts count as empty, and texts without words as alike only to equal ones; null keys
    don't count for class_id, which is null where a class has no other. Texts of fewer than five words have one shingle.
    """
    scratch = Scratch(docs.sparkSession, "near")
    labels = node_classes(docs, scratch, text)
    rows = docs.select(F.col(key).alias("key"), node_of(text).alias("node")).join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    by_node = rows.groupBy("label", "node").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    found = by_node.groupBy("label").agg(F.min("key").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    return rows.join(found, "label").select("key", "class_id", "class_size", "n_texts")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each class: that of the least key (then the least MD5 of the text); nulls come last.

    All columns stay. Rows that repeat a key and a text are one document.
    """
    scratch = Scratch(docs.sparkSession, "near")
    labels = node_classes(docs, scratch, text)
    row = F.unhex(F.md5(F.encode(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), "UTF-8")))
    rows = scratch.keep(docs.select(F.col(key).alias("key"), row.alias("row"), node_of(text).alias("node")), "rows")
    labelled = rows.join(labels, "node", "left").select("row", F.coalesce("label", "node").alias("label"), F.struct(F.col("key").isNull().alias("u"), "key", "node", "row").alias("rank"))
    held = f"row_{uuid.uuid4().hex}"  # a name of no column
    kept = labelled.groupBy("label").agg(F.min("rank").alias("best")).select(F.col("best.row").alias(held))
    survivors = docs.withColumn(held, row).join(kept, held, "left_semi")
    return survivors.dropDuplicates([held]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every row of ``documents``: doc_id, class_id, class_size, n_texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).withColumnRenamed("key", "doc_id")
