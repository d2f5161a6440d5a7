"""N-gram Jaccard join by an LSH forest of MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .components import components
from .runs import Piece, keyed, scan
from .storage import NULL_ID, written
from .textscan import mix, signed

NGRAM, SIMILARITY = 5, Fraction(4, 5)
#: More trees allow longer prefixes (20: depth 3, 40: depth 5), so that fewer pairs far below the threshold meet.
TREES, MAX_DEPTH, TARGET_RECALL = 40, 8, 0.999999
#: Shingles of a chunk of a tile.
BUDGET = 1 << 19
#: Cells of a dense block of shingle counts.
CELLS = 1 << 22
_SEED = 20240229


def recall(depth: int, trees: int, similarity: float) -> float:
    """Chance that two sets of that similarity share a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int, target: float, deepest: int = MAX_DEPTH) -> int:
    """The longest prefix with which pairs of that similarity are found with the target recall."""
    depth = deepest
    while depth > 1 and recall(depth, trees, similarity) < target:
        depth -= 1
    return depth


def enough(depth: int, trees: int, target: float) -> float:
    """The least similarity of pairs that prefixes of that depth find with the target recall."""
    return min(1.0, (1 - (1 - target) ** (1 / trees)) ** (1 / depth))


def shingle_sets(piece: Piece, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct digests of each document's n-word strings; all words together where there are fewer than n."""
    first, last = piece.bounds[:-1], piece.bounds[1:]
    grams = piece.letters.windows(n)
    sets = []
    for x, y in zip(first.tolist(), last.tolist(), strict=True):
        if y - x >= n:
            sets.append(np.unique(grams[x : y - n + 1]))
        elif y > x:
            sets.append(piece.letters.of(np.array([x]), np.array([y])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_digest(shingles: np.ndarray) -> np.uint64:
    return mix(np.array([np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(shingles))], np.uint64))[0]


def prefixes(sets: list[np.ndarray], trees: int, short: int, deepest: int = MAX_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each document's signature in each tree (documents x trees), as two digests: of the first `short` minima, and of all `deepest`. Sorted by them, a tree's signatures are its trie at these two depths."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 1 << 63, trees * MAX_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    low, high = np.zeros((len(sets), trees), np.uint64), np.zeros((len(sets), trees), np.uint64)
    if not len(some):
        return low, high
    flat = np.concatenate([sets[i] for i in some])
    at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    for t in range(trees):
        key = np.full(len(some), t + 1, np.uint64)
        for k in range(deepest):
            least = np.minimum.reduceat((flat * factors[t * MAX_DEPTH + k]) >> np.uint64(24), at)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            if k + 1 == short:
                low[some, t] = key
        high[some, t] = key
    return low, high


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, by dense products over the shingles that both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out

    def places(x: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        column = np.minimum(np.searchsorted(common, x), len(common) - 1)
        keep = common[column] == x
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep], column[keep]

    (ra, ca), (rb, cb) = places(a, left), places(b, right)
    width = max(1, CELLS // max(len(left), len(right)))
    for lo in range(0, len(common), width):
        n = min(width, len(common) - lo)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            use = (c >= lo) & (c < lo + n)
            m[r[use], c[use] - lo] = 1
        out += x @ y.T
    return out


def linked_sets(sets: list[np.ndarray], similarity: Fraction, met: np.ndarray | None = None) -> tiles.Linked:
    """met(members x trees before this one): keys of which equal ones mean that a pair is compared elsewhere."""
    size = np.array([len(s) for s in sets], np.int64)

    def linked(x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
        both = _counts(sets[x], sets[y]).astype(np.int64)
        union = size[x][:, None] + size[y][None, :] - both
        hit = both * similarity.denominator >= similarity.numerator * union
        if met is not None and met.shape[1]:
            i, j = np.nonzero(hit)
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                hit[a, b] = ~(met[x][a] == met[y][b]).any(axis=1)
        return hit, both / union

    return linked


def _in_tries(classes: DataFrame) -> DataFrame:
    """(tree, short, deep, node): the signatures that share a short prefix with another, sorted: the tries of all trees without their lone branches."""
    entries = classes.select("node", F.posexplode(F.arrays_zip("short", "deep")).alias("tree", "key")).select("tree", "key.short", "key.deep", "node")
    shared = written(entries.groupBy("tree", "short").agg(F.count("*").alias("m")).where("m > 1").drop("m"))
    return written(entries.join(shared, ["tree", "short"]).sortWithinPartitions("tree", "short", "deep", "node"))


def _stars(tries: DataFrame, prefix: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) that connect the texts of each trie node at a prefix: to its least text, not pair by pair. wanted(node): only trie nodes that hold one of these."""
    rows = tries if wanted is None else tries.join(wanted.withColumn("wanted", F.lit(True)), "node", "left")
    some = F.lit(True) if wanted is None else F.coalesce(F.bool_or("wanted"), F.lit(False))
    heads = written(rows.groupBy(*prefix).agg(F.min("node").alias("head"), F.count("*").alias("m"), some.alias("some")).where("m > 1 and some").drop("m", "some"))
    return tries.join(heads, prefix).where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))


def _units(members: DataFrame, tries: DataFrame, prefix: str, budget: int) -> DataFrame:
    """members(node, cluster, weight) to node, units: where the node is compared, a list of (cluster, q, tree).

    A cluster within the budget is compared whole (tree -1). A larger one is compared whole, in tiles, or trie node
    by trie node, whichever has the fewer pairs (by weight): a group of near copies meets in every tree, a chain of
    texts only with its neighbours. In a trie node of tree t a pair counts that has met in no tree before t.
    """
    members = written(members)
    sums = written(members.groupBy("cluster").agg(F.sum("weight").cast("double").alias("w")).where(F.col("w") > budget))
    large = members.join(sums.select("cluster"), "cluster")
    names = ["tree", "short"] + (["deep"] if prefix == "deep" else [])
    placed = large.join(tries, "node").select("node", "cluster", "weight", "tree", F.xxhash64(*names).alias("unit"))
    found = placed.groupBy("cluster", "tree", "unit").agg(F.sum("weight").cast("double").alias("w")).groupBy("cluster").agg(F.sum(F.col("w") * F.col("w")).alias("pairs"))
    sparse = written(found.join(sums, "cluster").where(F.col("pairs") < F.col("w") * F.col("w")).select("cluster"))
    whole = members.join(sparse, "cluster", "left_anti").select("node", "cluster", "weight", F.lit(-1).alias("tree"))
    parts = placed.join(sparse, "cluster", "left_semi").select("node", F.col("unit").alias("cluster"), "weight", "tree")
    units = tiles.chunked(whole.unionByName(parts), budget)
    return units.groupBy("node").agg(F.collect_list(F.struct("cluster", "q", "tree")).alias("units"))


def ngram_join(docs: DataFrame, similarity: Fraction = SIMILARITY, trees: int = TREES, target: float = TARGET_RECALL, budget: int = BUDGET) -> DataFrame:
    """Links between texts whose sets of 5-word strings have a Jaccard similarity of `similarity` or more.

    docs: doc_id, text. Returns per row doc_id, class_id (least doc_id with the same set), class_size, n_links
    (other rows linked directly, those of the same class included), component_id (least doc_id that links reach)
    and kept (doc_id = component_id).

    Texts with equal sets are one class. Each class has a signature of MAX_DEPTH minima in each tree of a forest;
    sorted signatures are prefix tries. First, classes that share a whole signature in some tree meet and are
    verified with the exact sets. A class whose least similar link is one that whole signatures find with the
    target recall is done. The prefixes of the others (with less similar links, or none) are shortened to the depth
    at which pairs at the threshold are found with the target recall, and they meet all that share those.

    Trie nodes give star edges, not pairs; their components are clusters that hold all candidate pairs. They are
    verified in tiles of bounded size that return counts and least nodes, not pairs: small clusters whole, large
    ones whole or trie node by trie node, whichever has fewer pairs. Clusters that the second step leaves as they
    were are not verified again.

    Texts of one to four words have all their words as their one string; null and empty texts link with nothing
    (class_id is then their own doc_id). Rows that repeat a doc_id count as rows; all of them are kept or not. A
    null doc_id counts as smallest. Other columns are not looked at. An empty table gives an empty one.
    """
    short = prefix_depth(float(similarity), trees, target)
    texts = keyed(docs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, piece in scan(batch, True):
                sets = shingle_sets(piece)
                places = pa.array(np.arange(len(sets) + 1) * trees, pa.int32())
                keys = [pa.ListArray.from_arrays(places, pa.array(signed(x.reshape(-1)))) for x in prefixes(sets, trees, short)]
                digests = signed(np.array([set_digest(s) for s in sets], np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column("d")[rows], pa.array(digests), pa.array([len(s) for s in sets], pa.int64()), *keys], names=["d", "node", "weight", "short", "deep"])

    signatures = written(texts.mapInArrow(sign, "d long, node long, weight long, short array<long>, deep array<long>"))
    first = F.min(F.struct("d", "weight", "short", "deep")).alias("x")
    classes = written(signatures.where("weight > 0").groupBy("node").agg(first, F.count("*").alias("class_size")).select("node", F.col("x.d").alias("class_d"), "class_size", (F.col("x.weight") + tiles.MEMBER).alias("weight"), "x.short", "x.deep"))
    tries = _in_tries(classes)

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for rows, piece in scan(batch, True):
                sets = shingle_sets(piece)
                own = np.flatnonzero(signed(np.array([set_digest(s) for s in sets], np.uint64)) == node[rows])  # not another text of that doc_id
                columns = [batch.column(c)[rows].take(pa.array(own)) for c in ("node", "class_size", "units", "keys")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "class_size", "units", "keys", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, ...]]:
            for tile in tiles.groups(batches):
                node, side, size = (tile.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "class_size"))
                order = np.lexsort((node, side))
                order = order[np.concatenate(([True], node[order][1:] != node[order][:-1]))]  # repeated rows of a document
                node, side, size = node[order], side[order], size[order]
                shingles, tree = tile.column("shingles"), tile.column("tree")[0].as_py()
                sets = [np.frombuffer(shingles[int(i)].as_buffer(), np.uint64) for i in order]
                met = None if tree < 0 else np.array([tile.column("keys")[int(i)].as_py()[:tree] for i in order], np.int64).reshape(len(order), tree)
                split = None if tile.column("tile_i")[0] == tile.column("tile_j")[0] else int(np.searchsorted(side, 1))
                yield node, *tiles.links_of(len(node), size, node, split, linked_sets(sets, similarity, met))

        yield from tiles.result(each())

    def verified(clusters: DataFrame, prefix: str) -> DataFrame:
        """Links, least nodes and least similarities of the members of clusters(node, cluster), by tile."""
        units = _units(clusters.join(classes.select("node", "weight"), "node"), tries, prefix, budget)
        by_tree = F.exists("units", lambda u: u["tree"] >= 0)
        members = units.join(classes, "node").select("node", "class_d", "class_size", "units", F.when(by_tree, F.col(prefix)).alias("keys"))
        rows = texts.join(members, texts["d"] == members["class_d"]).select("node", "class_size", "units", "keys", "text")
        rows = rows.mapInArrow(as_sets, "node long, class_size long, units array<struct<cluster:bigint,q:int,tree:int>>, keys array<bigint>, shingles binary")
        rows = rows.withColumn("u", F.explode("units")).select("node", "class_size", "keys", "shingles", "u.cluster", "u.q", "u.tree")
        return written(tiles.grouped(tiles.dealt(rows)).mapInArrow(compare, tiles.RESULT))

    near = written(components(_stars(tries, ["tree", "short", "deep"])).withColumnRenamed("root", "cluster"))
    found = verified(near, "deep")
    done = found.groupBy("node").agg(F.min("low").alias("low")).where(F.col("low") >= enough(MAX_DEPTH, trees, target)).select("node")
    open_ = written(tries.select("node").distinct().join(done, "node", "left_anti"))
    stars = near.where("node <> cluster").select(F.col("cluster").alias("u"), F.col("node").alias("v"))
    wide = written(components(stars.unionByName(_stars(tries, ["tree", "short"], open_))).withColumnRenamed("root", "cluster"))
    before = wide.join(near.select("node", F.col("cluster").alias("near")), "node", "left")
    grown = before.groupBy("cluster").agg(F.min("near").alias("x"), F.max("near").alias("y"), F.count("*").alias("n"), F.count("near").alias("k")).where("x is null or x <> y or n <> k").select("cluster")
    again = written(wide.join(grown, "cluster", "left_semi").select("node", "cluster"))
    found = found.join(again.select("node"), "node", "left_anti").unionByName(verified(again, "short"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = written(components(found.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v"))))
    least = written(groups.join(classes.select("node", "class_d"), "node").groupBy("root").agg(F.min("class_d").alias("component_d")))
    named = groups.join(least, "root").select("node", "component_d")
    about = written(classes.select("node", "class_d", "class_size").join(links, "node", "left").join(named, "node", "left"))  # so that the rows of a hot class can be split
    out = signatures.select("d", F.when(F.col("weight") > 0, F.col("node")).alias("node")).join(about, "node", "left")
    class_d = F.coalesce("class_d", "d")
    component = F.coalesce("component_d", class_d)
    plain = lambda c: F.nullif(c, F.lit(NULL_ID))
    return out.select(
        plain(F.col("d")).alias("doc_id"),
        plain(class_d).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("class_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        plain(component).alias("component_id"),
        (F.col("d") == component).alias("kept"),
    )
