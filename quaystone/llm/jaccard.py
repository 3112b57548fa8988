"""N-gram Jaccard join (10) with a token-group matrix; exact components of documents whose shingle sets link.

1. Sets. A document's shingles are 64-bit hashes; equal sets are one *node*, so exact copies never multiply.
2. Clusters, without pairs. If J(x, y) >= t and |x| <= |y| then the sets differ in d = |x|(1-t)/t shingles at most.
   Shingles are dealt into P > d parts; so at least P-d parts of x and y are equal, and sharing a part's
   content is a necessary condition. Parts whose shingles are all very common are left out where the others
   still suffice (fewer than P-d such parts). Equal parts give a star to their smallest node, first within a task
   (so a part that very many nodes share has a row a task), then over all tasks. The components are the clusters.
3. Token-group matrix in each cluster. Similar nodes form small groups with the union of their shingles. A query's
   overlap with a union bounds its overlap with every member; only groups that reach the least overlap a link
   needs, by size, are opened, and only if they hold a node not yet connected with the query. A cluster is cut into blocks
   of few nodes. First each block is joined with itself and with the cluster's *pivots*: its few nodes with the fewest rare
   shingles, which most copies of one text are near to. Where that leaves a cluster of several blocks in several components, it is cut
   into larger blocks, of bounded shingles, that meet pairwise; nodes that are connected already aren't compared. No task holds
   more than two blocks.
4. The links found connect exactly the nodes that all links connect; their components give the result.

Equality of sets and shingles is that of their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base
from quaystone.llm.components import connected_components
from quaystone.llm.words import mix, shingle_hashes, word_hashes

#: Size classes grow by RATIO; parts are SLACK times the number of differences, and one more.
RATIO, SLACK = 1.35, 1.2
#: A shingle counted in this many distinct texts, and this share of all documents, is common. It only steers which parts are left out.
COMMON_LEAST, COMMON_SHARE = 12, 1e-7
#: Bits of the filter of common shingles, and of a task's note of the shingles it has seen (8 MB each, fixed).
COMMON_BITS = 1 << 26
#: Shingles of a block and nodes of a small one, pivots of a cluster, and nodes of a group of the token-group matrix.
BLOCK_SHINGLES, BLOCK_NODES, PIVOTS, GROUP_NODES = 1 << 19, 128, 4, 24
#: Bits of the map of ids whose texts are needed again (4 MB).
FILTER_BITS = 1 << 25
#: Signatures that a task gathers before it sends them on.
GATHERED = 1_500_000


def sets_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted within a text), n+1 offsets, and each set's 64-bit node."""
    raw, offsets = base.text_buffer(texts)
    words, first = word_hashes(raw, offsets)
    h, at = shingle_hashes(words, first, k)
    found = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    sizes = np.array([len(x) for x in found], np.int64)
    tokens = np.concatenate([*found, np.zeros(0, np.uint64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0xA5A5A5A5)))])
        nodes = mix((sums[ends[1:]] - sums[ends[:-1]]) ^ sizes.astype(np.uint64)).astype(np.int64)
    return tokens, ends, nodes


class Classes:
    """Size classes: each has its largest size, the most differences of a pair whose smaller set is in it, and its parts."""

    def __init__(self, percent: int):
        self.percent, lows = percent, [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * RATIO)))
        self.low = np.array(lows, np.int64)
        most = self.low[1:] - 1
        self.differ = most * (100 - percent) // percent
        self.parts = (self.differ * SLACK).astype(np.int64) + 1
        self.largest_partner = most * 100 // percent

    def of(self, sizes: np.ndarray) -> list[np.ndarray]:
        """For each size its own class, then the lower classes that it can be the larger partner of (-1: none)."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        out, down = [np.where(self.differ[own] > 0, own, -1)], own - 1
        while True:
            fits = (down >= 0) & (self.largest_partner[np.maximum(down, 0)] >= sizes) & (self.differ[np.maximum(down, 0)] > 0)
            if not fits.any():
                return out
            out.append(np.where(fits, down, -1))
            down = down - 1


def _bits_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(COMMON_BITS - 1)
    return (tokens & mask).astype(np.int64), (tokens >> np.uint64(32) & mask).astype(np.int64)


def _is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


def signatures(tokens: np.ndarray, ends: np.ndarray, common: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets' parts and the set each belongs to. common: the filter of common shingles."""
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    one, two = _bits_of(tokens)
    rare = (~(_is_set(common, one) & _is_set(common, two))).astype(np.float64)
    out, whose = [], []
    for kinds in classes.of(sizes) if len(sizes) else ():
        used = np.flatnonzero(kinds >= 0)
        if not len(used):
            continue
        parts = np.zeros(len(sizes), np.int64)
        parts[used] = classes.parts[kinds[used]]
        begin = np.concatenate([[0], np.cumsum(parts)])
        mine = parts[owner] > 0
        t, o = tokens[mine], owner[mine]
        seeded = mix(t ^ mix(kinds[o].astype(np.uint64) + np.uint64(77)))
        part = (seeded >> np.uint64(33)).astype(np.int64) % parts[o] + begin[o]
        content = mix(seeded + np.uint64(0x1234567))
        n = int(begin[-1])
        low = np.bincount(part, (content & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(part, (content >> np.uint64(32)).astype(np.float64), n)
        count, n_rare = np.bincount(part, minlength=n), np.bincount(part, rare[mine], n)
        who = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(n) - begin[who]
        with np.errstate(over="ignore"):
            key = mix(low.astype(np.uint64) + mix(high.astype(np.uint64)) + mix((place << 20 | kinds[who] << 8).astype(np.uint64) + mix(count.astype(np.uint64))))
        light = n_rare == 0
        spare = np.zeros(len(sizes), np.int64)
        spare[used] = parts[used] - classes.differ[kinds[used]]
        sent = ~light | (np.bincount(who, light, len(sizes)) >= spare)[who]
        out.append(key[sent])
        whose.append(who[sent])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(whose)


_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("shingle", T.LongType()), T.StructField("df", T.LongType())])


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, noted = set(), np.zeros(COMMON_BITS // 64, np.uint64)
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def send() -> pa.RecordBatch:
            null = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([null, null, null, pa.array(keys.astype(np.int64)), pa.array(n)], names=_SETS.names)

        for batch in base.slices(batches):
            tokens, ends, nodes = sets_of(batch.column(1), k)
            sizes = np.diff(ends)
            null = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(nodes, mask=sizes == 0), null, null], names=_SETS.names)
            fresh = np.array([not (x in met or met.add(x)) for x in nodes.tolist()], bool)  # copies count once
            new, times = np.unique(tokens[np.repeat(fresh, sizes)], return_counts=True)
            one, two = _bits_of(new)
            seen = _is_set(noted, one) & _is_set(noted, two)
            for at in (one, two):
                np.bitwise_or.at(noted, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            again = seen | (times > 1)
            known = np.isin(new, keys, assume_unique=True)
            more = times + (seen & ~known)  # with the first sight, which was only noted
            keys, at = np.unique(np.concatenate([keys, new[again]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, more[again]]), len(keys)).astype(np.int64)
            if len(keys) > GATHERED:
                yield send()
                keys, n = keys[:0], n[:0]
        yield send()

    return run


_STARS = T.StructType([T.StructField("signature", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _stars(k: int, percent: int, common):
    """Rows (signature, node, null), one a signature and task, and (any, node, smaller node) for those that met in this task."""

    def send(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, key))
        key_, node_ = key[order], node[order]
        new = np.ones(len(key_), bool)
        new[1:] = key_[1:] != key_[:-1]
        leader = node_[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key_) else node_
        met = np.unique(np.stack([node_[~new], leader[~new]]), axis=1)
        first = np.zeros(len(key), bool)
        first[order[new]] = True  # in the documents' order, in which nodes repeat and so compress well
        a, b = met[:, met[0] != met[1]]
        with np.errstate(over="ignore"):
            spread = mix(a.astype(np.uint64) * np.uint64(3) + b.astype(np.uint64)).astype(np.int64)
        column = lambda x, y: pa.array(np.concatenate([x, y]))
        return pa.RecordBatch.from_arrays([column(key[first].astype(np.int64), spread), column(node[first], a), pa.array(np.concatenate([np.zeros(int(first.sum()), np.int64), b]), mask=np.arange(int(first.sum()) + len(b)) < first.sum())], names=_STARS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen, keys, nodes, held = Classes(percent), set(), [], [], 0
        for batch in base.slices(batches):
            tokens, ends, node = sets_of(batch.column(1), k)
            key, whose = signatures(tokens, ends, common.value, classes)
            fresh = np.array([not (x in seen or seen.add(x)) for x in node.tolist()], bool)
            used = fresh[whose]
            keys.append(key[used])
            nodes.append(node[whose[used]])
            held += int(used.sum())
            if held > GATHERED:
                yield send(np.concatenate(keys), np.concatenate(nodes))
                keys, nodes, held = [], [], 0
        if held:
            yield send(np.concatenate(keys), np.concatenate(nodes))

    return run


class Matrix:
    """Token-group matrix over some nodes' sets; finds links that connect what all links connect."""

    def __init__(self, tokens: list[np.ndarray], percent: int, side: np.ndarray, label: np.ndarray):
        """label: nodes of equal label are connected already."""
        self.percent, self.side = percent, side
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        values, ids = np.unique(np.concatenate(tokens), return_inverse=True)
        self.n_tokens = len(values)
        self.ids = np.split(ids, np.cumsum(self.sizes)[:-1])
        # similar nodes stand together: by side, size and least shingle
        self.order = np.lexsort(([int(x.min()) for x in self.ids], self.sizes, side))
        first, of = np.unique(label, return_index=True, return_inverse=True)[1:]
        self.parent = first[of]

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self) -> np.ndarray:
        """Of all nodes."""
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def need(self, x, y):
        """The least overlap with which sets of these sizes link: (100 + p) * overlap >= p * (x + y)."""
        return -(-self.percent * (x + y) // (100 + self.percent))

    def links(self, crossed: bool) -> list[tuple[int, int]]:
        """crossed: only links between the two sides are looked for."""
        found, p = [], self.percent
        groups = []
        for s in np.unique(self.side):
            mine = self.order[self.side[self.order] == s]
            groups += [mine[i : i + GROUP_NODES] for i in range(0, len(mine), GROUP_NODES)]
        for members in groups:
            least, most = self.sizes[members].min(), self.sizes[members].max()
            roots = self.roots()
            together = (roots[members] == roots[members[0]]).all()
            queries = np.flatnonzero((self.sizes * 100 >= p * least) & (self.sizes * p <= 100 * most) & ~(together & (roots == roots[members[0]])))
            if crossed:
                queries = queries[self.side[queries] != self.side[members[0]]]
            if not len(queries):
                continue
            # the group's column of the matrix, and its members' own columns for when it is opened
            column = np.zeros(self.n_tokens, np.int16)
            own = np.zeros((self.n_tokens, len(members)), bool) if len(members) * self.n_tokens <= 1 << 25 else None
            for j, x in enumerate(members):
                column[self.ids[x]] = 1
                if own is not None:
                    own[self.ids[x], j] = True
            starts = np.concatenate([[0], np.cumsum(self.sizes[queries])])
            bound = np.add.reduceat(column[np.concatenate([self.ids[q] for q in queries])], starts[:-1], dtype=np.int64)
            smallest = np.maximum(least, -(-p * self.sizes[queries] // 100))
            for q in queries[bound >= self.need(self.sizes[queries], smallest)]:
                rq = self.root(q)
                open_to = [j for j, x in enumerate(members) if self.root(x) != rq]
                if not open_to:
                    continue
                overlap = own[self.ids[q]].sum(axis=0) if own is not None else np.array([len(np.intersect1d(self.ids[q], self.ids[x], assume_unique=True)) for x in members])
                for j in open_to:
                    x = members[j]
                    if overlap[j] >= self.need(self.sizes[q], self.sizes[x]) and (rx := self.root(x)) != (rq := self.root(q)):
                        self.parent[max(rx, rq)] = min(rx, rq)
                        found.append((int(q), int(x)))
        return found


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _join_cells(k: int, percent: int):
    """Rows (cluster, left, right, node, side, label, text), sorted by their first three columns, to links (a, b); where ``right`` is another block than ``left``, links between the two sides."""

    def solve(nodes: np.ndarray, sides: np.ndarray, labels: np.ndarray, texts: list[str], crossed: bool) -> list[tuple[int, int]]:
        sets, keep, taken = [], [], set()
        cell = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["place", "text"])
        for part in base.slices(iter([cell])):  # a cell's texts at once would need much memory for a moment
            tokens, ends, now = sets_of(part.column(1), k)
            for i, place in enumerate(part.column(0).to_pylist()):
                n = int(nodes[place])
                if now[i] == n and (n, sides[place]) not in taken:  # another text under the same doc_id isn't this node's
                    taken.add((n, sides[place]))
                    keep.append(place)
                    sets.append(tokens[ends[i] : ends[i + 1]])
        if len(keep) < 2:
            return []
        nodes = nodes[keep]
        return [(int(nodes[i]), int(nodes[j])) for i, j in Matrix(sets, percent, sides[keep], labels[keep]).links(crossed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def finish() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            nodes, sides, labels, texts = zip(*held, strict=True)
            return solve(np.array(nodes, np.int64), np.array(sides, np.int64), np.array(labels, np.int64), list(texts), now[2] not in (-1, now[1]))

        for batch in batches:
            links = []
            for cluster, left, right, node, side, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, left, right) != now:
                    links += finish()
                    held, now = [], (cluster, left, right)
                held.append((node, side, label, text or ""))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=_LINKS.names)
        if links := finish():
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=_LINKS.names)

    return run


def _bit_table(places: DataFrame, bits: int):
    """A broadcast bit table of fixed size with the bits ``at`` of the rows set; it is made up on the executors, word by word."""
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint64)
    return places.sparkSession.sparkContext.broadcast(table)


_WANTED = T.StructType([T.StructField("node", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rare", T.DoubleType())])


def _wanted(rows: DataFrame, k: int, bit_map, common) -> DataFrame:
    """node, text, rare (the share of its shingles that aren't common) of the rows whose id may be in the bit map, so that the others' texts aren't shuffled.

    A task sends a node once, however many of its rows have that text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = bit_map.value, set()
        for batch in batches:
            there = batch.filter(pa.array(_is_set(table, batch.column(2).to_numpy() & (64 * len(table) - 1))))
            for part in base.slices(iter([there])):
                tokens, ends, nodes = sets_of(part.column(1), k)
                one, two = _bits_of(tokens)
                rare = np.append(0, np.cumsum(~(_is_set(common.value, one) & _is_set(common.value, two))))
                share = (rare[ends[1:]] - rare[ends[:-1]]) / np.maximum(1, np.diff(ends))
                new = []
                for i, (node, size) in enumerate(zip(nodes.tolist(), np.diff(ends).tolist(), strict=True)):
                    if size and node not in sent:
                        sent.add(node)
                        new.append(i)
                take = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes).take(take), part.column(1).take(take), pa.array(share).take(take)], names=_WANTED.names)

    return rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, _WANTED)


def _links_in(cells: DataFrame, k: int, percent: int) -> DataFrame:
    ordered = cells.select("cluster", "left", "right", "node", "side", "label", "text").repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    return base.materialise(ordered.mapInArrow(_join_cells(k, percent), _LINKS), "links")


def _own_cells(texts: DataFrame) -> DataFrame:
    """Each block with itself and, where a cluster has several, its pivots."""
    best = Window.partitionBy("cluster").orderBy("rare", "node")
    pivots = texts.where("blocks > 1").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= PIVOTS)
    pivots = pivots.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("left"), "node", "text")
    own = texts.select("cluster", F.col("block").alias("left"), "node", "text")
    return own.union(pivots).select("*", F.lit(-1).alias("right"), F.lit(0).alias("side"), F.col("node").alias("label"))


def _cross_cells(texts: DataFrame, components: DataFrame) -> DataFrame:
    """Of clusters of several small blocks that aren't one component yet: large blocks, each with each."""
    cut = texts.where("blocks > 1").drop("block", "blocks").join(components.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = cut.groupBy("cluster", "label").agg(F.sum("n").alias("n")).groupBy("cluster").agg(F.count("*").alias("labels"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    met = cut.join(sizes.where("labels > 1"), "cluster").withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("side")).alias("left"), F.greatest(x, F.col("side")).alias("right")))
    return met.withColumn("cell", F.explode(others)).select("cluster", "cell.left", "cell.right", "node", "side", "label", "text")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, its own included.

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles (A-Z lower-cased). With
    fewer than k words the whole sequence is the one shingle; null, empty and blank texts have none and link with
    nothing. One row per input row; repeated rows and rows that share a doc_id each count. A null doc_id is
    never the smallest: such a row has the component's smallest other id, or null. Other columns aren't read; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = base.id_and_text(docs, id_col, text_col)
    described = base.materialise(rows.mapInArrow(_describe(k), _SETS), "sets")
    sets = described.where("shingle is null").select("doc_id", "n_shingles", "node")
    n_docs = sets.count()
    least = max(COMMON_LEAST, COMMON_SHARE * n_docs)
    hot = described.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    shingle, mask = F.col("shingle"), F.lit(COMMON_BITS - 1).cast("long")
    common = _bit_table(hot.select(F.explode(F.array(shingle.bitwiseAND(mask), F.shiftrightunsigned(shingle, 32).bitwiseAND(mask))).alias("at")), COMMON_BITS)

    stars = rows.mapInArrow(_stars(k, percent, common), _STARS)
    leader = F.min(F.when(F.col("b").isNull(), F.col("a"))).over(Window.partitionBy("signature"))
    shared = stars.select("a", F.coalesce("b", leader).alias("b")).where("a != b")
    clusters = base.materialise(connected_components(shared), "clusters").withColumnRenamed("component", "cluster")

    per_node = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = base.materialise(per_node.join(clusters, "node"), "members")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES)).cast("int").alias("blocks"))
    placed = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = _wanted(rows, k, _bit_table(members.select(F.xxhash64("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")).alias("at")), FILTER_BITS), common)
    once = placed.join(wanted, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("cluster", "blocks", "block", "n", "rare", "text")))  # tasks may send the same node
    texts = base.materialise(once.select("cluster", "blocks", "node", "block", "n", "rare", "text"), "texts")
    links = _links_in(_own_cells(texts), k, percent)
    components = base.materialise(connected_components(links), "components")
    if not texts.where("blocks > 1").isEmpty():
        more = _links_in(_cross_cells(texts, components), k, percent)
        if not more.isEmpty():
            stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = base.materialise(connected_components(stars.union(more)), "components")
    keyed = per_node.join(components, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = keyed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = keyed.join(smallest, "component").select("node", "component_id")
    linked = sets.where("node is not null").join(answer, "node").select("doc_id", "n_shingles", "component_id")
    return linked.union(sets.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(base.documents(spark, sf_dir))


#: The query's rows for DuckDB: pairs by common shingles, and what links reach. For small tables: a shingle's texts meet in pairs there.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id"""
