"""Near-duplicate documents by MinHash and an LSH forest.

A document's set is its distinct `shingle`-word shingles, A-Z in lower case.  Equal sets are one node.
Each node has a MinHash signature, and each order of the forest sorts nodes by its own hashes of it.
Nodes that share SHARED first hashes of an order are a region, and in a region all are held against
each other by their signatures.  A region of more than TILE nodes is crowded and goes deeper: its
nodes are sorted anew by each of twice as many orders, within the region, and so on until regions are
small or their nodes are connected anyway.  Before that a crowded region is dealt into parts of about
TILE nodes, each with the region's first node, so that near copies of one text find each other without
all pairs.  There is no limit on a region, and nothing depends on how rows are partitioned.

Candidates only need to connect what may belong together: within each connected group of
candidates the full sets decide.  A task has the sets of a group or of a part of a large one, counts
intersections exactly and links nodes of similarity >= threshold; pairs that are connected already
needn't be looked at, and no pairs are emitted, only a node and one that speaks for its class.  Of
large groups the classes meet next, and at last what is outside the largest class meets all.  Connected
components of all links are found by alternating large-star and small-star steps.

Null texts and texts without words have an empty set and link with nothing.  Texts of fewer words
than a shingle have their whole sequence as one shingle.  component_id is the smallest doc_id of the
component; a null id counts only where there is no other, and rows with equal doc_id are kept or
dropped together.

Signatures make candidates random but fixed.  Two nodes just at 0.8 share no region with chance
(1 - 0.8 ** 3) ** 16, about 0.00001, and their estimate is too low with about 0.000004.  If all their
regions are crowded, they must share further orders, of 32, within one: two with chance 0.9999999 or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import WordHashes, frozen, hashes_at_length, joined, kept, mixed, numbered_rows, removed, runs, scratch, starts_of

TREES, DEPTH = 16, 4
SHARED = 3  # so many equal hashes of one order put two nodes in one region
TILE = 4096
PART, MEET, PART_SHINGLES = 256, 1024, 4 << 20  # nodes of a part of a group that finds its classes, and of one of two parts that meet at last; shingles of either
FEW_PARTS = 8  # so many of the latter parts meet all of their group; more are joined by prefixes, which takes more steps
MOST_SHARE = 512  # nodes that share a key of their prefixes and are held against each other in one task
_SLACK = 0.24  # five standard errors of an estimate from TREES * DEPTH hashes at 0.8
_FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles_of(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The set of a text as ascending 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        for x in h[1:]:
            h = joined(h[:1], np.array([x]))
        return mixed(h[:1] + np.uint64(len(words)))
    return np.unique(hashes_at_length(h, size))


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[at : at + 4096, None] * _FACTORS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(its_row, doc_id, n_shingles, node, signature) of docs(its_row, doc_id, text as bytes); node is null for an empty set."""

    def sketch(batches):
        hashes = WordHashes()
        for b in batches:
            if len(hashes) > 500_000:
                hashes.clear()
            found = []
            for t in b["text"]:
                s = shingles_of(t.as_py() or b"", size, hashes)
                found.append((len(s), set_id(s), signature(s).astype(">u4").tobytes()) if len(s) else (0, None, None))
            n, node, sig = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["its_row"], b["doc_id"], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["its_row", "doc_id", "n_shingles", "node", "signature"])

    return docs.select("its_row", "doc_id", "text").mapInArrow(sketch, "its_row long, doc_id long, n_shingles long, node binary, signature binary")


def alike(low: np.ndarray, planes: np.ndarray, need: int) -> np.ndarray:
    """For each row of low bytes of signatures one that speaks for all that at least `need` equal bytes connect."""
    label, most = np.arange(len(low), dtype=np.int32), low.shape[1] - need
    for a in range(len(low) - 1):
        differ = planes[0, a + 1 :] ^ planes[0, a]
        for plane in planes[1:]:
            differ |= plane[a + 1 :] ^ plane[a]
        near = a + 1 + np.flatnonzero((np.bitwise_count(differ) <= most) & (label[a + 1 :] != label[a]))
        near = near[(low[near] == low[a]).sum(axis=1) >= need] if len(near) else near
        if len(near):
            label[np.isin(label, label[near])] = label[a]
            if (label == label[0]).all():
                break
    return label


def _order_keys(deeper: bool):
    """Per order the SHARED hashes of a signature that it sorts by first: runs of hashes and, for crowded regions, hashes far apart, too."""
    runs_of = [f"substring(signature, {4 * DEPTH * t + 1}, {4 * SHARED})" for t in range(TREES)]
    apart = [f"concat({', '.join(f'substring(signature, {4 * (t + TREES * k) + 1}, 4)' for k in range(SHARED))})" for t in range(TREES)]
    return F.expr(f"array({', '.join(runs_of + (apart if deeper else []))})")


def compared(members: DataFrame, lows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links among the nodes of each part of a region, of members(region, part, node)."""
    need = int(np.ceil(TREES * DEPTH * (threshold - _SLACK)))

    def compare(batches):
        keys, low, node = np.empty((0, 2), np.int64), np.empty((0, TREES * DEPTH), np.uint8), []

        def links(until):
            ends = np.concatenate([np.flatnonzero((keys[1:until] != keys[: until - 1]).any(axis=1)) + 1, [until]])
            planes = np.stack([np.packbits((low[:until] >> k) & 1, axis=1).view(np.uint64)[:, 0] for k in range(4)])
            a, b = [], []
            for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                if e - s > 1:
                    label = alike(low[s:e], planes[:, s:e], need)
                    far = np.flatnonzero(label != np.arange(e - s))
                    a += [node[s + x] for x in far.tolist()]
                    b += [node[s + x] for x in label[far].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.column_stack([batch[c].to_numpy() for c in ("region", "part")])])
            low = np.concatenate([low, np.frombuffer(b"".join(batch["low"].to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)])
            node += batch["node"].to_pylist()
            last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])  # its part may go on in the next batch
            if last:
                yield links(last)
                keys, low, node = keys[last:], low[last:], node[last:]
        if node:
            yield links(len(node))

    rows = members.join(lows, F.col("node") == F.col("its_node")).select("region", "part", "node", "low")
    return rows.repartition("region", "part").sortWithinPartitions("region", "part", "node").mapInArrow(compare, "a binary, b binary")


def parts_of(members: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, part, node): members(region, node) dealt into parts of about TILE, each with the first node of regions(its_region, n, first) that have more than one."""
    n_parts = F.ceil(F.col("n") / TILE).cast("long")
    placed = members.join(regions, F.col("region") == F.col("its_region")).select("region", F.pmod(F.xxhash64("node", "region"), n_parts).alias("part"), "node")
    first = regions.where(n_parts > 1).select(F.col("its_region").alias("region"), F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part"), F.col("first").alias("node"))
    return placed.unionByName(first)


def candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect all nodes(node, signature) that may be near each other."""

    def lowest(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b["signature"].to_pylist()), ">u4").reshape(-1, TREES * DEPTH)
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([x.tobytes() for x in (sig & 255).astype(np.uint8)], pa.binary())], ["its_node", "low"])

    lows = nodes.select("node", "signature").mapInArrow(lowest, "its_node binary, low binary")
    rows = nodes.select("node", F.posexplode(_order_keys(False)).alias("nth", "own")).select("node", F.xxhash64("nth", "own").alias("region"))
    regions = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    regions = frozen(regions.withColumnRenamed("region", "its_region"), "regions")
    found = frozen(compared(parts_of(rows, regions), lows, threshold).where("a <> b").distinct(), "candidates")
    for _ in range(2 * TREES):
        crowded = regions.where(F.col("n") > TILE)
        if crowded.isEmpty():
            break
        # deeper: only what isn't connected yet, by every order within each crowded region
        roots = components(found).withColumnRenamed("node", "its_node")
        labelled = rows.join(crowded.select("its_region", "n"), F.col("region") == F.col("its_region")).select("region", "n", "node")
        labelled = labelled.join(roots, F.col("node") == F.col("its_node"), "left").select("region", "n", "node", F.coalesce("root", "node").alias("root"))
        labelled = frozen(labelled, "crowded")
        mixed_ones = labelled.groupBy("region").agg((F.min("root") != F.max("root")).alias("open")).where("open").select(F.col("region").alias("its_region"))
        deeper = labelled.join(mixed_ones, F.col("region") == F.col("its_region")).select("region", "n", "node", "root")
        deeper = deeper.join(nodes.select(F.col("node").alias("its_node"), "signature"), F.col("node") == F.col("its_node"))
        deeper = deeper.select("region", "n", "node", "root", F.posexplode(_order_keys(True)).alias("nth", "own"))
        deeper = frozen(deeper.select(F.xxhash64("region", "nth", "own").alias("region"), "n", "node", "root"), "deeper")
        inner = deeper.groupBy("region").agg(F.count("*").alias("n"), F.first("n").alias("outer"), F.min("node").alias("first"), F.min("root").alias("low_root"), F.max("root").alias("high_root"))
        inner = inner.where((F.col("n") > 1) & (F.col("n") < F.col("outer")) & (F.col("low_root") != F.col("high_root")))  # an order that parts nothing is dropped
        regions = frozen(inner.select(F.col("region").alias("its_region"), "n", "first"), "regions")
        rows = deeper.select("region", "node")
        found = frozen(found.unionByName(compared(parts_of(rows, regions), lows, threshold).where("a <> b")).distinct(), "candidates")
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of links(a, b) and the smallest node it is connected to.

    The smallest neighbours are dealt out anew before they are joined, so that a node with very many
    neighbours is a join partition that Spark can split.
    """
    edges = frozen(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    state = edges.agg(F.count("*"), mark).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance").withColumnRenamed("u", "its_u")
        large = both.where("v > u").join(least, F.col("u") == F.col("its_u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance").withColumnRenamed("u", "its_u")
        small = large.hint("rebalance").join(first, F.col("u") == F.col("its_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = frozen(small.unionByName(first.select(F.col("its_u").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        now = after.agg(F.count("*"), mark).first()
        removed(edges)
        edges, settled, state = after, now == state, now
        if settled:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked_exactly(sets: list[np.ndarray], per_cent: int, label: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Joins the labels of sets that links of at least per_cent / 100 connect, the sets of `by` against all others.

    Returns labels, the order by likeness to all, and a link for each two labels that were joined.
    """
    sizes = np.array(list(map(len, sets)))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at, label, links = starts_of(sizes), label.copy(), []
    common = np.add.reduceat(np.bincount(ids)[ids], at[:-1]) / sizes
    here, order = np.zeros(int(ids.max()) + 1, bool), np.argsort(-common, kind="stable")
    for a in order[by[order]]:  # those that look most like the others first
        fits = (100 * np.minimum(sizes, sizes[a]) >= per_cent * np.maximum(sizes, sizes[a])) & (label != label[a])
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        here[ids[at[a] : at[a + 1]]] = True
        shared = np.add.reduceat(here[ids[runs(at[others], sizes[others])]].astype(np.int64), starts_of(sizes[others])[:-1])
        here[ids[at[a] : at[a + 1]]] = False
        near = others[100 * shared >= per_cent * (sizes[a] + sizes[others] - shared)]
        if len(near):
            old, first = np.unique(label[near], return_index=True)
            links += [(int(a), int(x)) for x in near[first]]
            label[np.isin(label, old)] = label[a]
    return label, order, links


def _often(key: tuple, table: pa.Table) -> pa.Table:
    """The shingles that two sets or more of a sample have, and how many: pairs of 64-bit numbers, by shingle."""
    shingle, n = np.unique(np.frombuffer(b"".join(table["members"].to_pylist()), "<u8"), return_counts=True)
    pairs = np.column_stack([shingle[n > 1], n[n > 1].astype(np.uint64)])
    return pa.table({"root": pa.array([key[0].as_py()], pa.binary()), "often": pa.array([pairs.astype("<u8").tobytes()], pa.binary())})


#: The least sizes of classes of sets by size; a set is held against sets of each class in turn.
_SIZES = np.unique(np.ceil(1.1 ** np.arange(400)).astype(np.int64))


def _prefixes(per_cent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Keys of which two sets of a group share one if at least per_cent / 100 of their shingles, all told, are common.

    Shingles are in one order within a group, those first that a sample of it has seldom or never.  If sets
    of n and m shingles have k in common, the first of these is among the first n - k + 1 and m - k + 1; k
    must be per_cent * (n + m) / (100 + per_cent) or more.  So for each class of sizes that a partner may
    have a set has its first shingles, no more than that allows, as keys.  The order only decides how
    many sets share a key.
    """

    def prefixes(key: tuple, table: pa.Table) -> pa.Table:
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        sets = [np.frombuffer(m, "<u8") for m in table["members"].to_pylist()]
        often = next(x for n, x in zip(nodes, sets) if n is None).reshape(-1, 2)
        salt = np.array([xxhash.xxh3_64_intdigest(key[0].as_py())], np.uint64)
        keys, n_keys, own = [], [], []
        for k, (node, x) in enumerate(zip(nodes, sets)):
            if node is None:
                continue
            n = len(x)
            at = np.minimum(np.searchsorted(often[:, 0], x), max(0, len(often) - 1))
            count = np.where(often[at, 0] == x, often[at, 1], 0) if len(often) else np.zeros(n, np.uint64)
            order = x[np.lexsort((x, count))]
            least, most = -(-per_cent * n // 100), 100 * n // per_cent
            mine = int(np.searchsorted(_SIZES, n, "right")) - 1
            for its in range(int(np.searchsorted(_SIZES, least, "right")) - 1, int(np.searchsorted(_SIZES, most, "right"))):
                m = max(int(_SIZES[its]), least)
                first = n + 1 + (-per_cent * (n + m) // (100 + per_cent))  # n + 1 - the ceiling
                if first > 0:
                    sizes = joined(salt, np.array([min(mine, its) * 1000 + max(mine, its)], np.uint64))
                    keys.append(joined(order[:first], sizes))
                    n_keys.append(first)
                    own.append(k)
        which = np.repeat(own, n_keys)
        return pa.table({
            "key": pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()),
            "node": pa.array(nodes, pa.binary()).take(pa.array(which, pa.int64())),
            "label": pa.array(labels, pa.binary()).take(pa.array(which, pa.int64())),
        })

    return prefixes


def verified(docs: DataFrame, groups: DataFrame, size: int, per_cent: int) -> DataFrame:
    """(a, b): what connects the nodes that exact links connect within each of groups(node, root, n_shingles, holder), from the full sets of the texts of docs(its_row, text).

    Groups are dealt into parts of about PART nodes and PART_SHINGLES shingles; each part finds its classes.  Of groups with
    more than one part, the node most like the others speaks for its class at the next level, until
    the classes of a group have met.  If no more than FEW_PARTS parts of MEET nodes are outside a
    group's largest class then, they meet all parts.  Otherwise the group's nodes get keys by prefixes of their sets:
    only nodes that share a key, up to MOST_SHARE of them and not all of one class, are held against
    each other, and equal lists of them once.  Nodes of keys that more share, as sets just below the
    threshold may, meet in parts: each outside the largest class with all of them.
    """

    def sets_of(placed: DataFrame, *columns: str) -> DataFrame:
        """(*columns, node, members): the rows of placed, one for each node, with their sets, from the texts of the rows that hold them."""
        columns = (*columns, "node")
        schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns)

        def rebuild(batches):
            hashes = WordHashes()
            for b in batches:
                if len(hashes) > 500_000:
                    hashes.clear()
                sets = [shingles_of(t.as_py() or b"", size, hashes).astype("<u8").tobytes() for t in b["text"]]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(sets, pa.binary())], [*columns, "members"])

        held = placed.select(*columns, "holder").hint("shuffle_hash")
        return docs.select("its_row", "text").join(held, F.col("its_row") == F.col("holder")).select(*columns, "text").mapInArrow(rebuild, f"{schema}, members binary")

    def n_parts(n, shingles, most=None):
        return F.greatest(F.ceil(n / (most or PART)), F.ceil(shingles / PART_SHINGLES)).cast("long")

    def pairs(nodes: list, found: list[tuple[int, int]]) -> pa.Table:
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.binary()), "b": pa.array([nodes[y] for _, y in found], pa.binary())})

    def star(key: tuple, table: pa.Table) -> pa.Table:
        sets = {n: np.frombuffer(s, "<u8") for n, s in zip(table["node"].to_pylist(), table["members"].to_pylist())}
        nodes = sorted(sets)
        label, order, _ = linked_exactly([sets[n] for n in nodes], per_cent, np.arange(len(nodes)), np.ones(len(nodes), bool))
        speaker = np.empty(len(nodes), np.int64)
        speaker[label[order[::-1]]] = order[::-1]  # the first in the order is written last
        return pairs(nodes, [(k, s) for k, s in enumerate(speaker[label].tolist()) if k != s])

    def complete(key: tuple, table: pa.Table) -> pa.Table:
        rows = {n: (lab, rest, np.frombuffer(s, "<u8")) for n, s, lab, rest in zip(*(table[c].to_pylist() for c in ("node", "members", "label", "rest")))}
        nodes = sorted(rows)
        label = np.unique(np.array([rows[n][0].hex() for n in nodes]), return_inverse=True)[1]
        return pairs(nodes, linked_exactly([rows[n][2] for n in nodes], per_cent, label, np.array([rows[n][1] for n in nodes]))[2])

    def level(members: DataFrame, salt: int) -> DataFrame:
        parts = members.groupBy("root").agg(n_parts(F.count("*"), F.sum("n_shingles")).alias("n_parts")).withColumnRenamed("root", "its_root")
        placed = members.join(parts, F.col("root") == F.col("its_root")).select("node", "holder", "root", F.pmod(F.xxhash64("node", F.lit(salt)), "n_parts").alias("p"))
        return frozen(sets_of(placed, "root", "p").groupBy("root", "p").applyInArrow(star, "a binary, b binary"), "links")

    found = level(groups, 0)
    large = groups.groupBy("root").agg(n_parts(F.count("*"), F.sum("n_shingles")).alias("n")).where("n > 1").select(F.col("root").alias("its_root"))
    members = frozen(groups.join(large, F.col("root") == F.col("its_root"), "left_semi"), "large")
    if members.isEmpty():
        return found

    def classes(of: DataFrame, links: DataFrame) -> DataFrame:
        met = links.select(F.col("a").alias("its_label"), "b")
        return frozen(of.join(met, F.col("label") == F.col("its_label"), "left").select("node", "root", "n_shingles", "holder", F.coalesce("b", "label").alias("label")), "classes")

    def speaking(of: DataFrame) -> DataFrame:
        return of.where("node = label").drop("label")

    labels = classes(members.withColumn("label", F.col("node")), found)
    speakers = speaking(labels)
    for salt in range(1, 64):
        per_root = speakers.groupBy("root").agg(F.count("*").alias("n"), n_parts(F.count("*"), F.sum("n_shingles")).alias("parts"))
        before, most, parts = per_root.agg(F.sum("n"), F.max("n"), F.max("parts")).first()
        if most == 1:
            break
        links = level(speakers.join(per_root.where("n > 1").select(F.col("root").alias("its_root")), F.col("root") == F.col("its_root"), "left_semi"), salt)
        found, labels = found.unionByName(links), classes(labels, links)
        speakers = speaking(labels)
        if parts == 1 or 2 * speakers.count() > before:
            break

    def top_of(of: DataFrame) -> DataFrame:
        """(its_root, top, n, s, and the same of the top class) for the roots of `of` that have more than one class; top is the class of most nodes."""
        classes_of = of.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        per_root = classes_of.groupBy("root").agg(F.max(F.struct("n", "label", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        return per_root.where(F.col("n") > F.col("top.n")).select(F.col("root").alias("its_root"), "top", "n", "s")

    def by_prefixes(of: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of nodes that share a key with few, and the rows of the nodes that share one with many, for the roots(its_root, n_parts) of `of`."""
        left = frozen(of.join(roots, F.col("root") == F.col("its_root")).withColumn("p", F.pmod(F.xxhash64("node"), "n_parts")).drop("its_root"), "wide")
        often = frozen(sets_of(left.where("p = 0"), "root").groupBy("root").applyInArrow(_often, "root binary, often binary"), "often")  # the first part is a sample
        copies = left.groupBy("root").agg(F.first("n_parts").alias("n_parts")).join(often.withColumnRenamed("root", "its_root"), F.col("root") == F.col("its_root"))
        copies = copies.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("p"), F.lit(None).cast("binary").alias("label"), F.lit(None).cast("binary").alias("node"), F.col("often").alias("members"))
        keys = sets_of(left, "root", "p", "label").unionByName(copies).groupBy("root", "p").applyInArrow(_prefixes(per_cent), "key long, node binary, label binary")
        keys = frozen(keys, "prefixes")
        met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 1 AND low <> high").select(F.col("key").alias("its_key"), "n")
        met = frozen(met, "met")
        shared = frozen(keys.join(met, F.col("key") == F.col("its_key")).select("key", "n", "node"), "shared")
        few = shared.where(F.col("n") <= MOST_SHARE).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").distinct()
        few = few.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("its_node"))
        held = left.select("node", "holder").join(few, F.col("node") == F.col("its_node")).select("list", "node", "holder")
        links = frozen(sets_of(held, "list").groupBy("list").applyInArrow(star, "a binary, b binary"), "links")
        crowd = shared.where(F.col("n") > MOST_SHARE).select(F.col("node").alias("its_node")).distinct()
        return links, left.join(crowd, F.col("node") == F.col("its_node"), "left_semi")

    def sizes_of(of: DataFrame) -> DataFrame:
        return top_of(of).select("its_root", F.col("top.label").alias("top"), n_parts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"), MEET).alias("n_rest"), n_parts(F.col("top.n"), F.col("top.s"), MEET).alias("n_top"), n_parts(F.col("n"), F.col("s")).alias("n_parts"))

    sizes = frozen(sizes_of(labels), "open")
    wide = sizes.where(F.col("n_rest") > FEW_PARTS).select("its_root", "n_parts")  # else no node of the largest class moves more often than that
    if not wide.isEmpty():
        links, crowd = by_prefixes(labels, wide)
        found = found.unionByName(links)
        narrow = labels.join(sizes.where(F.col("n_rest") <= FEW_PARTS).select("its_root"), F.col("root") == F.col("its_root"), "left_semi")
        labels = frozen(narrow.unionByName(crowd.select(*labels.columns)), "crowd")
        sizes = sizes_of(labels)
    placed = labels.join(sizes.drop("n_parts"), F.col("root") == F.col("its_root")).withColumn("rest", F.col("label") != F.col("top"))
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), "n_rest")).otherwise(F.col("n_rest") + F.pmod(F.xxhash64("node"), "n_top"))
    others = F.when(F.col("rest"), F.col("n_rest") + F.col("n_top")).otherwise(F.col("n_rest"))
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    placed = placed.select("node", "holder", "root", "label", "rest", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    placed = frozen(placed, "placed")
    if placed.isEmpty():
        return found
    sets = sets_of(placed.select("node", "holder").distinct()).withColumnRenamed("node", "its_node")
    last = placed.join(sets, F.col("node") == F.col("its_node")).select("root", "p", "q", "label", "rest", "node", "members").groupBy("root", "p", "q").applyInArrow(complete, "a binary, b binary")
    return found.unionByName(last)


def classified(docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """numbered_rows(docs), and (its_row, doc_id, n_shingles, node, root): node is null for an empty set, root names a class."""
    per_cent = round(100 * threshold)
    with scratch(docs.sparkSession) as made:  # only what is returned stays
        rows = numbered_rows(docs)
        numbered = rows.select("its_row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").cast("binary").alias("text"))
        sketches = frozen(sketched(numbered, size), "sketches")
        nodes = sketches.where("node IS NOT NULL").groupBy("node").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.min("its_row").alias("holder"))
        nodes = frozen(nodes, "nodes")
        groups = components(candidates(nodes.select("node", "signature"), threshold)).withColumnRenamed("node", "its_node")
        groups = frozen(nodes.join(groups, F.col("node") == F.col("its_node")).select("node", "root", "n_shingles", "holder"), "groups")
        roots = frozen(components(verified(numbered, groups, size, per_cent)).withColumnRenamed("node", "its_node"), "roots")  # joined by itself, so that Spark can split crowded partitions
        found = sketches.select("its_row", "doc_id", "n_shingles", "node").join(roots, F.col("node") == F.col("its_node"), "left")
        found = frozen(found.select("its_row", "doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root")), "classified")
        kept(made, rows, found)
    return rows, found


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    _, rows = classified(docs, size, threshold)
    least = frozen(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "its_root"), "least")
    joined_rows = rows.join(least, F.col("root") == F.col("its_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined_rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without all but one row of each class: the one with the smallest doc_id, a null one last, the first row on ties.  Rows without words stay."""
    numbered, rows = classified(docs, size, threshold)
    stays = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("its_row"))).alias("first")).select(F.col("first.its_row").alias("stays"))
    stays = stays.unionByName(rows.where("root IS NULL").select(F.col("its_row").alias("stays")))
    return numbered.join(stays.hint("shuffle_hash"), F.col("its_row") == F.col("stays"), "left_semi").select("doc.*")
