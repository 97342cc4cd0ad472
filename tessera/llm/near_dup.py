"""Near-duplicate groups by a chosen-path set similarity join.

A text's set holds its distinct five-word shingles. Equal sets become one class at once. For the
rest, several independent trees are grown over 64 minwise tokens of each set: the root branches
into two of the tokens, and a node that is still large and mixed branches into two more that its path
has not used, so a document goes where its tokens lead. A pair of similarity s meets along a branch
with probability s, and with two branches a node the process does not die out for s >= 0.75. The
trees and the leaf test share the 64 tokens, so misses depend on how many of them a pair has in
common: averaged over Binomial(64, 0.75), and with f -> (1 - p + p f)^2 a level for a share p in
common, a pair of s = 0.75 is missed with 1.0e-7 where all nodes are small, and 7.4e-6 where nodes
stay large to depth 5.

Small nodes are compared exhaustively on the 64 tokens; pairs with fewer than 29 in common (1.0e-7
for s = 0.75) are no candidates. In a large node every member is first compared with a few pivots. A
node that is one group of near copies is finished by that: all but a few members agree with the pivots
of one group, which makes them candidates of each other, and the few are compared with every member,
in blocks. Only nodes with many members outside the largest group branch on. Nodes that are large at
the last depth are taken as one cluster. Candidate clusters are thus a superset of the true groups, in
a number of edges linear in the documents.

Links are then confirmed on full sets inside each cluster. Small clusters are done in one task,
comparing only what is not connected yet. Large ones are dealt over tasks in blocks: first all
members against a few pivots, then the members outside the largest group against all, in blocks of
bounded size, so neither a task nor the result ever holds all pairs of a group.

Defined results: null, empty or blank texts have an empty set, are linked with nothing and kept;
texts under five words have one shingle, the whole sequence; very long texts are read whole, their
tokens found in parts; ties cannot occur, as a group is represented by its smallest id; rows that
share an id count as one document, whose links are those of any of its texts; a row without an id takes
the group of its text, and is kept if no row with an id has its text; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .components import connected_components

SHINGLE = 5
#: Similarity is at least SHARE / OF.
SHARE, OF = 75, 100
TOKENS = 64
TREES = 8
BRANCHES = 2
#: A node of at most so many members is compared exhaustively, by one task: what lies between two sizes need not branch.
LEAF = 2048
MAX_DEPTH = 5
#: Pivots of a large node. It is finished if at most LEAF members are outside the largest group around them.
NODE_PIVOTS = 4
#: Tokens in common that make two members of a leaf candidates.
CANDIDATE = 29
#: Members, and shingles, of a cluster that one task confirms.
CLUSTER, CLUSTER_SHINGLES = 1024, 4_000_000
PIVOTS = 8
_ROOTS = TREES * BRANCHES


def _odd(n: int) -> np.ndarray:
    return (np.random.default_rng(75).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)


_FACTORS = _odd(TOKENS)[:, None]


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = common.word_arrays(texts, fold_case=True)
    rolled = common.rolling(hashes, SHINGLE)
    at = 0
    for n in counts.tolist():
        if n >= SHINGLE:
            own = np.sort(rolled[at : at + n - SHINGLE + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            yield common.mix((hashes[at : at + n] * common.MULTIPLIERS[:n]).sum(keepdims=True), n)
        else:
            yield np.zeros(0, np.uint64)
        at += n


def minwise_tokens(own: np.ndarray) -> np.ndarray:
    """For each of the hash functions, the shingle of the set that it puts first."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    if len(own) <= 4096:
        return own[(_FACTORS * short).argmin(axis=1)]
    best = [minwise_tokens(own[i : i + 4096]) for i in range(0, len(own), 4096)]
    found = np.stack(best, axis=1)
    order = (_FACTORS * (found >> np.uint64(32)).astype(np.uint32)).argmin(axis=1)
    return found[np.arange(TOKENS), order]


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, set_id (16-byte digest of the set), roots and sketch of the minwise tokens."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("near_dup")
        for batch in batches:
            for first, texts in common.steps(batch, "__text"):
                sizes, ids, roots, sketches = [], [], [], []
                for own in shingle_sets(texts):
                    sizes.append(len(own))
                    tokens = minwise_tokens(own) if len(own) else None
                    ids.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    roots.append(tokens[:_ROOTS].tobytes() if len(own) else None)
                    sketches.append(tokens.astype(np.uint16).tobytes() if len(own) else None)
                keys = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (ids, roots, sketches)]], ["key", "n_shingles", "set_id", "roots", "sketch"])

    return common.small_batches(source).mapInArrow(common.trimmed(run), "key bigint, n_shingles bigint, set_id binary, roots binary, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Runs of equal ``by`` in a stream of sorted batches, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(by)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


class _Union:
    """Disjoint sets over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _in_common(sketches: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many tokens each row of sketches has in common with one: equal places are bytes of 1, added eight at a time."""
    eights = (sketches == own).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return ((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _leaf_groups(sketch: np.ndarray) -> np.ndarray:
    """For each member of a leaf, the first member of its group; a pair is compared only while it is not connected."""
    labels = np.arange(len(sketch))
    for i in range(len(sketch) - 1):
        rest = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        if not len(rest):
            continue
        near = rest[_in_common(sketch[rest] if len(rest) < len(sketch) - 1 - i else sketch[i + 1 :], sketch[i]) >= CANDIDATE]
        if len(near):
            joined = np.zeros(len(sketch), bool)
            joined[labels[near]] = joined[labels[i]] = True
            mine = joined[labels]
            labels[mine] = labels[mine].min()
    return labels


def _leaf_edges(nodes: DataFrame) -> DataFrame:
    """Compares the members of each leaf on their sketches; edges from members to the first of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        for group in _groups(batches, "node"):
            keys = group.column("key").to_numpy()
            labels = _leaf_groups(np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(keys), TOKENS))
            made += [(int(keys[i]), int(keys[labels[i]])) for i in np.flatnonzero(labels != np.arange(len(keys))).tolist()]
            if len(made) > 50_000:
                yield _edge_batch(made)
                made = []
        if made:
            yield _edge_batch(made)

    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _sketches(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(n, -1, TOKENS)


def _node_parts(rows: int) -> int:
    """Files for a table with one row for each of the large nodes that ``rows`` rows can make up."""
    return 1 + rows // LEAF // components.PART_ROWS


def _pivots(members: DataFrame) -> DataFrame:
    """node, keys and joined sketches of a few members of each node, in one aggregation."""
    spread = F.xxhash64("key")
    drawn = [F.min_by(F.struct("key", "sketch"), F.when(F.pmod(spread, F.lit(NODE_PIVOTS)) == p, spread)) for p in range(NODE_PIVOTS)]
    found = members.groupBy("node").agg(*[m.alias(f"m{p}") for p, m in enumerate(drawn)])
    names = [f"m{p}" for p in range(NODE_PIVOTS)]
    filled = [F.coalesce(name, *names) for name in names]
    return found.select("node", F.array(*[m["key"] for m in filled]).alias("pivots"), F.concat(*[m["sketch"] for m in filled]).alias("pivot_sketches"))


def _pivot_labels(sketches: np.ndarray) -> np.ndarray:
    """For each row of pivots, the first pivot of the group that each one belongs to; those that agree share a group."""
    labels = np.tile(np.arange(NODE_PIVOTS, dtype=np.int32), (len(sketches), 1))
    pairs = [(i, j) for i in range(NODE_PIVOTS) for j in range(i)]
    same = {(i, j): (sketches[:, i] == sketches[:, j]).sum(axis=1) >= CANDIDATE for i, j in pairs}
    for _ in range(NODE_PIVOTS - 1):  # the longest path between pivots
        for i, j in pairs:
            least = np.minimum(labels[:, i], labels[:, j])
            labels[:, i], labels[:, j] = np.where(same[i, j], least, labels[:, i]), np.where(same[i, j], least, labels[:, j])
    return labels


def _against_pivots(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """node, key, n, used, sketch, label (the group of pivots that the member agrees with, -1: none) and the pivots it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            own, around = batch.column("sketch"), _sketches(batch.column("pivot_sketches"), n)
            agree = (_sketches(own, n) == around).sum(axis=2) >= CANDIDATE
            labels = _pivot_labels(around)
            keys = np.array(batch.column("pivots").to_pylist(), np.int64)
            label = np.where(agree, labels, NODE_PIVOTS).min(axis=1)
            # one pivot of each group that it agrees with
            first = agree & ~np.stack([(agree[:, :i] & (labels[:, :i] == labels[:, i : i + 1])).any(axis=1) for i in range(NODE_PIVOTS)], axis=1)
            joined = [k[f].tolist() for k, f in zip(keys, first, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("node", "key", "n", "used", "sketch")], pa.array(np.where(label == NODE_PIVOTS, -1, label).astype(np.int32)), pa.array(joined, pa.list_(pa.int64()))],
                ["node", "key", "n", "used", "sketch", "label", "joined"],
            )

    return members.join(pivots, "node").mapInArrow(run, "node bigint, key bigint, n bigint, used bigint, sketch binary, label int, joined array<bigint>")


def _rest_edges(rows: DataFrame) -> DataFrame:
    """Compares, inside each cell, the members marked ``out`` with all; edges of those that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        for group in _groups(batches, "cell"):
            keys, out = group.column("key").to_numpy(), group.column("out").to_numpy()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(len(keys), TOKENS)
            union = _Union(len(keys))
            for i in np.flatnonzero(out).tolist():
                for j in np.flatnonzero(_in_common(sketch, sketch[i]) >= CANDIDATE).tolist():
                    union.join(i, j)
            made += [(int(keys[i]), int(keys[r])) for i in range(len(keys)) if (r := union.find(i)) != i]
            if len(made) > 50_000:
                yield _edge_batch(made)
                made = []
        if made:
            yield _edge_batch(made)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def _settle(members: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Edges found in large nodes (node, key, n, used, sketch; stored), and the rows of nodes that have to branch."""
    parts = _node_parts(members.count())
    pivots = common.cut(_pivots(members).coalesce(parts), "pivots")
    marked = common.cut(_against_pivots(members, pivots), "marked")
    common.discard(members)
    star = marked.select(F.col("key").alias("a"), F.explode("joined").alias("b")).where("a != b")
    counts = marked.groupBy("node").agg(F.first("n").alias("all"), *[F.count_if(F.col("label") == p).alias(f"c{p}") for p in range(NODE_PIVOTS)])
    most = F.array_max(F.array(*[F.struct(F.col(f"c{p}").alias("c"), F.lit(p).alias("label")) for p in range(NODE_PIVOTS)]))
    nodes = common.cut(counts.select("node", most["label"].alias("top"), (F.col("all") - most["c"]).alias("outside")).coalesce(parts), "settled")
    judged = marked.join(nodes, "node")
    blocks = F.ceil(F.col("n") / leaf)
    few = judged.where(f"outside BETWEEN 1 AND {leaf}").withColumn("out", F.col("label") != F.col("top"))
    block = F.when(F.col("out"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), blocks)))
    cells = few.select("node", "key", "out", "sketch", F.explode(block).alias("block")).select(F.xxhash64("node", "block").alias("cell"), "key", "out", "sketch")
    return star.unionByName(_rest_edges(cells)), judged.where(f"outside > {leaf}").select("node", "key", "used", "sketch")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Grows the trees over classes (key, roots, sketch); edges whose components hold every link."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            roots = np.frombuffer(b"".join(batch.column("roots").to_pylist()), np.uint64).reshape(n, _ROOTS)
            node = np.concatenate([common.mix(roots[:, i], 100 + i) for i in range(_ROOTS)])
            keys, used = np.tile(batch.column("key").to_numpy(), _ROOTS), np.repeat(1 << np.arange(_ROOTS), n)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(keys), pa.array(used)], ["node", "key", "used"])

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sketch = _sketches(batch.column("sketch"), n)[:, 0]
            node, used = batch.column("node").to_numpy().view(np.uint64), batch.column("used").to_numpy().view(np.uint64).copy()
            index = (common.mix(node, 7) % np.uint64(TOKENS)).astype(np.uint64)
            nodes, paths = [], []
            for k in range(BRANCHES):  # tokens that the path has not used, the same for all members of a node
                while (taken := ((used >> index) & np.uint64(1)).astype(bool)).any():
                    index[taken] = (index[taken] + np.uint64(1)) % np.uint64(TOKENS)
                value = sketch[np.arange(n), index.astype(np.int64)].astype(np.uint64)
                nodes.append(common.mix(node ^ common.mix(value * np.uint64(TOKENS) + index, 9), 10))
                used |= np.uint64(1) << index
                paths.append(used.copy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.tile(batch.column("key").to_numpy(), BRANCHES)), pa.array(np.concatenate(paths).view(np.int64))], ["node", "key", "used"])

    sketches = classes.select("key", "sketch")
    rows = classes.select("key", "roots").mapInArrow(grow, "node bigint, key bigint, used bigint")
    edges = []
    for depth in range(1, MAX_DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
        live = common.cut(rows.join(sizes, "node"), "nodes")
        edges.append(_leaf_edges(live.where(F.col("n") <= LEAF).select("node", "key").join(sketches, "key")))
        large = live.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            edges.append(large.select(F.col("key").alias("a"), F.col("least").alias("b")).where("a != b"))
            break
        members = large.select("node", "key", "n", "used").join(sketches, "key").select("node", "key", "n", "used", "sketch")
        found, mixed = _settle(common.cut(members, "large"), LEAF)
        edges.append(found)
        if mixed.isEmpty():
            break
        rows = mixed.mapInArrow(branch, "node bigint, key bigint, used bigint")
    return reduce(DataFrame.unionByName, edges)


def _linked(a: np.ndarray, b: np.ndarray, shared: np.ndarray | int) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with so many shingles in common are linked."""
    return OF * shared >= SHARE * (a + b - shared)


def _shared_with(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with many."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
    sums = np.concatenate([[0], np.cumsum(own[at] == joined)])
    ends = np.cumsum([len(x) for x in others])
    return sums[ends] - np.concatenate([[0], sums[ends][:-1]])


def link_sets(sets: list[np.ndarray]) -> _Union:
    """Groups of linked sets; a pair is compared only while it is not connected."""
    union, n = _Union(len(sets)), np.array([len(s) for s in sets])
    for i in range(len(sets) - 1):
        root = union.find(i)
        rest = [j for j in range(i + 1, len(sets)) if OF * min(n[i], n[j]) >= SHARE * max(n[i], n[j]) and union.find(j) != root]
        if rest:
            linked = _linked(n[i], n[rest], _shared_with(sets[i], [sets[j] for j in rest]))
            for j in np.array(rest)[linked].tolist():
                union.join(i, j)
    return union


def _confirm_small(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cluster"):
            keys = group.column("key").to_numpy()
            order = np.argsort(keys)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            union = link_sets([sets[i] for i in order])
            keys = keys[order]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[[union.find(i) for i in range(len(keys))]])], ["node", "label"])

    return rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "node bigint, label bigint")


def _block_edges(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Edges between two blocks (key, label, set) of the same ``by``, just enough to connect their labels."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[int, int]] = []
        if len(a) and len(b):
            labels = {x: i for i, x in enumerate(sorted({*a["label"], *b["label"]}))}
            union = _Union(len(labels))
            sets, names = [np.frombuffer(x, np.uint64) for x in a["set"]], [labels[x] for x in a["label"]]
            n = np.array([len(s) for s in sets])
            for key, label, data in zip(b["key"], b["label"], b["set"], strict=True):
                own, name = np.frombuffer(data, np.uint64), labels[label]
                rest = [j for j in range(len(sets)) if union.find(names[j]) != union.find(name)]
                if rest:
                    linked = _linked(len(own), n[rest], _shared_with(own, [sets[j] for j in rest]))
                    for j in np.array(rest)[linked].tolist():
                        if union.find(names[j]) != union.find(name):
                            union.join(names[j], name)
                            made.append((int(key), int(a["key"].iloc[j])))
        return pd.DataFrame(made, columns=["a", "b"]).astype("int64")

    columns = [*by, "key", "label", "set"]
    left, right = (side.select(*[F.col(c).alias(f"{c}_{name}" if c in by else c) for c in columns]) for side, name in ((left, "l"), (right, "r")))
    return left.groupBy(*[f"{c}_l" for c in by]).cogroup(right.groupBy(*[f"{c}_r" for c in by])).applyInPandas(run, "a bigint, b bigint")


def _confirm_large(rows: DataFrame, block: int = CLUSTER) -> DataFrame:
    """rows: cluster, n (members), key, set. node, label for every member of large clusters."""
    spread = F.xxhash64("key")
    rows = common.cut(rows.withColumn("blocks", F.ceil(F.col("n") / block)), "large").withColumn("i", F.pmod(spread, F.col("blocks")))
    chosen = rows.groupBy("cluster", F.pmod(F.shiftright(spread, 20), F.lit(PIVOTS)).alias("p")).agg(F.min(F.struct(spread.alias("h"), "key")).alias("m")).select(F.col("m.key").alias("key"))
    pivots = rows.join(chosen, "key", "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first = common.cut(_block_edges(rows.withColumn("label", F.col("key")), pivots.withColumn("label", F.col("key")), ["cluster", "i"]), "edges")
    loose = rows.select(F.col("key").alias("a"), F.col("key").alias("b"))

    def labelled(edges: DataFrame) -> DataFrame:
        found = connected_components(edges)
        return loose.select(F.col("a").alias("node")).join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))

    so_far = common.cut(rows.join(labelled(first).withColumnRenamed("node", "key"), "key"), "large")
    largest = so_far.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    outside = common.cut(so_far.join(largest, "cluster").where("label != top").drop("top"), "outside")
    sizes = outside.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / block).alias("columns"))
    if sizes.isEmpty():
        return so_far.select(F.col("key").alias("node"), "label")
    left = so_far.join(sizes, "cluster").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)))
    right = outside.join(sizes, "cluster").withColumn("j", F.pmod(F.shiftright(spread, 20), F.col("columns"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    second = _block_edges(left, right, ["cluster", "i", "j"])
    return labelled(first.unionByName(second))


def _sets(docs: DataFrame, members: DataFrame, text: str, key: str) -> DataFrame:
    """cluster, n, total, key, set of the members; texts are read again rather than kept."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("__text"))
    rows = source.join(common.broadcast_if_small(members), "key").select("cluster", "n", "total", "key", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in common.steps(batch, "__text"):
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["cluster", "n", "total", "key", "set"])

    return rows.mapInArrow(common.trimmed(run), "cluster bigint, n bigint, total bigint, key bigint, set binary")


@common.tidy
def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", cluster_limit: int = CLUSTER) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept (the document stands for its group)."""
    found = common.cut(features(docs, text, key), "features")
    rep = F.min("key").alias("rep")
    classes = common.cut(
        found.where("n_shingles > 0 AND key IS NOT NULL").groupBy("set_id").agg(rep, F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")),
        "classes",
    )
    clusters = connected_components(candidate_edges(classes.withColumnRenamed("rep", "key")))
    sized = clusters.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sizes = sized.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    members = common.cut(clusters.join(sizes, "label").select(F.col("node").alias("key"), F.col("label").alias("cluster"), "n", "total"), "members")
    is_large = (F.col("n") > cluster_limit) | (F.col("total") > CLUSTER_SHINGLES)
    rows = _sets(docs, members, text, key)
    labels = _confirm_small(rows.where(~is_large))
    if not members.where(is_large).isEmpty():
        labels = labels.unionByName(_confirm_large(rows.where(is_large), cluster_limit))
    labels = labels.groupBy("node").agg(F.min("label").alias("label"))  # an id on several rows
    groups = classes.select("set_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("label", "rep").alias("label"))
    out = found.select("key", "n_shingles", "set_id").join(groups, "set_id", "left")
    component = F.coalesce("label", "key")
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
