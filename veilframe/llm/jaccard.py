"""N-gram Jaccard join by a MinHash LSH forest.

Texts with the same words are one class. In each tree of the forest a class has a string of DEPTH min-hash
labels; the strings of all classes and trees are range-partitioned and sorted, which lays every tree out as a prefix trie, left to
right. Classes that share a prefix are candidates. A class starts from its full string and shortens it until
a text of the least similarity that its size allows would be met in some tree with the target recall:
few shingles allow few similarities, so short texts keep longer prefixes than long ones.

What candidates connect, directly or not, is a component. Its texts meet once, and candidate pairs are
verified on the shingles themselves. A component too large for a task is cut into blocks that follow the first tree's
trie, and two blocks meet only if they hold candidates of each other.
Pairs never leave a task: what leaves are link counts and, per task, what its links connect.
"""

from __future__ import annotations

import functools
import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import TABLE
from .storage import keep, small_batches, tidy, unused

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.999
#: Bytes of words that a task verifies: of a block of a component, or of a bundle of small components.
BLOCK_BYTES = 16 << 20
#: Classes whose pairs are verified at a time inside a task.
ROWS = 1024
#: The most bits of the filter by which texts are found again (32 MB).
FILTER_BITS = 1 << 28
#: Sets above this size are taken to allow every similarity.
SMALL = 256


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, depth at most, with which a pair at the threshold meets in some tree with this probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(size: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity from the threshold on that a set of this size can have with a different set; None if there is none."""
    exact = Fraction(threshold).limit_denominator(1000)
    if size > SMALL:
        return float(exact)
    least = None
    for common in range(size, 0, -1):
        if Fraction(common, size) < exact:
            break
        largest_union = int(common / exact)  # the other set's own elements take the union from size up to this
        if largest_union > size or common < size:
            found = Fraction(common, largest_union)
            least = found if least is None or found < least else least
    return None if least is None else float(least)


@functools.cache
def depths(threshold: float, trees: int, depth: int, recall: float) -> list[int]:
    """The prefix that sets of 0, 1, ... SMALL + 1 (and more) elements need; depth + 1 for those that only equal sets can match."""
    found = [least_similarity(n, threshold) for n in range(SMALL + 2)]
    return [depth + 1 if s is None else prefix_length(s, trees, depth, recall) for s in found]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of word shingles from prefix sums of a polynomial over the bytes, modulo 2^64."""

    def __init__(self, shingle: int = SHINGLE, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.shingle = shingle
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct hashes; of fewer words than a shingle has, the one of all of them; of none, none."""
        if not words:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        n = min(self.shingle, len(words))
        a, b = starts[: len(words) - n + 1], ends[n - 1 :]
        return np.unique(_mixed((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64)))


class Forest:
    """The trees' label strings."""

    def __init__(self, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.needs = depths(threshold, trees, depth, recall)
        self.shortest = min(self.needs)
        n = depth * trees
        self.multipliers = rng.integers(1, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64)
        # the functions of the shortest prefixes come first; the sets that need more, or can meet such a set, take all of them
        at = np.arange(n).reshape(trees, depth)
        self.order = np.concatenate([at[:, : self.shortest].ravel(), at[:, self.shortest :].ravel()])
        longest = max((k for k, x in enumerate(self.needs) if self.shortest < x <= depth), default=0)
        self.long_until = int(longest / threshold) + 1

    def need(self, size: int) -> int:
        return self.needs[min(size, SMALL + 1)]

    def labels(self, shingles: np.ndarray) -> bytes:
        """depth labels of 16 bits for each tree, in an order that bytes compare by; labels that nothing can ask for are 0."""
        n = len(self.order) if len(shingles) <= self.long_until else self.trees * self.shortest
        m, shift = self.multipliers[:n], self.shifts[:n]
        least = np.full(n, np.iinfo(np.uint64).max)
        for k in range(0, len(shingles), 512):
            least = np.minimum(least, (m * shingles[k : k + 512] + shift).min(axis=1))
        out = np.zeros(self.trees * self.depth, ">u2")
        out[self.order[:n]] = _mixed(least) >> np.uint64(48)
        return out.tobytes()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def signatures(documents: DataFrame, forest: Forest, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, cls, labels, need, size) of documents(doc_id, text): cls names the words, need is the prefix that the class
    shortens its labels to, size its words' bytes; no words: all of these are null."""

    @tidy
    def scan(batches):
        shingler = Shingler(shingle)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                words = _words(text)
                row = (None,) * 4
                if words:
                    found, joined = shingler.shingles(words), b" ".join(words)
                    row = (hashlib.md5(joined).digest(), forest.labels(found), forest.need(len(found)), len(joined))
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int64())))],
                names=["doc_id", "cls", "labels", "need", "size"]
            )

    return documents.mapInArrow(scan, "doc_id long, cls binary, labels binary, need int, size long")


def _places(doc_id, bits: int) -> list:
    return [F.pmod(F.xxhash64(doc_id, F.lit(i)), F.lit(bits)) for i in range(3)]


def id_filter(ids: DataFrame, column: str, count: int) -> tuple[int, bytes]:
    """(bits, bitmap): a Bloom filter of FILTER_BITS bits at most; what passes it wrongly is sorted out by the join after it."""
    bits = min(FILTER_BITS, 1 << max(15, (16 * count - 1).bit_length()))
    places = ids.select(F.explode(F.array(*_places(F.col(column), bits))).alias("place"))

    def chunk(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        bitmap = np.zeros(1 << 15, bool)
        bitmap[place & 0x7FFF] = True
        return pa.table({
            "chunk": pa.array([int(place[0] >> 15)], pa.int64()), "data": pa.array([np.packbits(bitmap).tobytes()], pa.binary())
        })

    chunks = places.distinct().withColumn("chunk", F.shiftright("place", 15)).groupBy("chunk").applyInArrow(chunk, "chunk long, data binary")
    bitmap = bytearray(bits // 8)
    for r in chunks.toLocalIterator():
        bitmap[4096 * r["chunk"] : 4096 * (r["chunk"] + 1)] = r["data"]
    return bits, bytes(bitmap)


def word_texts(documents: DataFrame, bits: int, bitmap: bytes) -> DataFrame:
    """(cls, words) of documents(doc_id, text) with words that pass the filter: the words joined by spaces.

    The filter stands here and not as a join, which would shuffle all texts to find the few whose words are needed.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    @tidy
    def scan(batches):
        wanted = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            places = [batch.column(i).to_numpy() for i in (1, 2, 3)]
            chosen = np.logical_and.reduce([(wanted[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1 for p in places])
            texts = batch.column(0).filter(pa.array(chosen)).to_pylist()
            rows = [b" ".join(w) for w in map(_words, texts) if w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(r).digest() for r in rows], pa.binary()), pa.array(rows, pa.binary())],
                names=["cls", "words"]
            )

    rows = documents.where("doc_id is not null").select("text", *(p.alias(f"p{i}") for i, p in enumerate(_places(F.col("doc_id"), bits))))
    return rows.mapInArrow(scan, "cls binary, words binary")


def trie_groups(classes: DataFrame, forest: Forest) -> DataFrame:
    """(rep, node): the nodes of the tries at which classes(rep, labels, need) are candidates of others.

    The label strings of all trees are sorted in one range partitioning, so a node of any size may span tasks.
    A class is at the nodes from its full string up to its own need; a node counts if a member
    shortens to just there, as shorter prefixes hold the longer ones. Nodes with one member are left out, except
    at the edge of a task, where the neighbour may have more: equal nodes have equal names, so they meet.
    """
    depth, trees, shortest = forest.depth, forest.trees, forest.shortest
    strings = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"), F.substring("labels", t * (2 * depth) + 1, F.lit(2 * depth)).alias("string"))
    )
    rows = classes.where(F.col("need") <= depth).select("rep", "need", F.explode(strings).alias("s")).select("s.tree", "s.string", "rep", "need")
    rows = rows.repartitionByRange("tree", "string", "rep").sortWithinPartitions("tree", "string", "rep")

    @tidy
    def walk(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        tree, rep, need = (np.concatenate([b.column(i).to_numpy() for b in table]) for i in (0, 2, 3))
        labels = np.concatenate([np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, depth) for b in table]).astype(np.uint64)
        name = _mixed(tree.astype(np.uint64) + np.uint64(1))
        reps, nodes = [], []
        for level in range(1, depth + 1):
            name = _mixed(name * np.uint64(0x9E3779B97F4A7C15) + labels[:, level - 1] + np.uint64(1))
            if level < shortest:
                continue
            at = np.flatnonzero(need <= level)
            if not len(at):
                continue
            first = np.ones(len(at), bool)
            first[1:] = name[at][1:] != name[at][:-1]
            group = np.cumsum(first) - 1
            used = (np.bincount(group) > 1) & (np.bincount(group, need[at] == level) > 0)
            used[[0, -1]] = True
            chosen = at[used[group]]
            reps.append(rep[chosen])
            nodes.append(name[chosen].view(np.int64))
        for a, b in zip(reps, nodes):
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["rep", "node"])

    return rows.mapInArrow(walk, "rep long, node long")


def components(members: DataFrame, node: str, group: str) -> DataFrame:
    """(node, root): nodes of members(node, group) that share a group, directly or over others, get the same root.

    Labels spread as minima over groups and nodes in turn, and every label then takes its own label (pointer
    jumping), until none changes; each round is kept in the shared folder. Minima are combined before
    they are shuffled, and the joins are between kept tables, whose large keys Spark can split.
    """
    members = members.select(F.col(node).alias("node"), F.col(group).alias("group"))
    labels = None  # at first every node is its own
    while True:
        named = members.withColumn("root", F.col("node")) if labels is None else members.join(labels, "node")
        by_group = keep(named.groupBy("group").agg(F.min("root").alias("low")), "labels-group")
        lower = keep(members.join(by_group, "group").groupBy("node").agg(F.min("low").alias("low")), "labels-low")
        jumped = lower.join(lower.select(F.col("node").alias("at"), F.col("low").alias("far")), F.col("low") == F.col("at"), "left")
        new = keep(jumped.select("node", F.least("low", F.coalesce("far", "low")).alias("root")), "labels")
        old = new.withColumn("old", F.col("node")) if labels is None else new.join(labels.withColumnRenamed("root", "old"), "node")
        changed = old.where(F.col("root") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("node", node)


def shingle_numbers(texts: list[list[bytes]], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's shingles: equal numbers are equal shingles, word by word; no hash is involved."""
    vocabulary: dict[bytes, int] = {}
    counts = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t), np.int64, int(counts.sum()))
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = ends[owner] - np.arange(len(words))  # words from here to the end of the text
    number, lengths = words, np.minimum(counts, shingle)
    width = np.ones(len(words), np.int64)
    for step in range(1, shingle):  # a shingle of step words and the next word, as a pair; new numbers do not collide with the old ones
        grow = np.flatnonzero((left > step) & (lengths[owner] > step))
        if not len(grow):
            break
        pairs = number[grow] * np.int64(len(vocabulary)) + words[grow + step]
        number = number.copy()
        number[grow] = np.unique(pairs, return_inverse=True)[1]
        width[grow] = step + 1
    full = width == lengths[owner]
    owner, number = owner[full], number[full]
    # texts of fewer words than a shingle has are told apart from others by their number of words
    number = number * np.int64(shingle) + (lengths[owner] - 1)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(number[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of slices of their incidence matrix."""
    both = left + right
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]]
    n = len(left)
    common = np.zeros((n, len(right)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    at = np.searchsorted(column, np.arange(0, columns + 4096, 4096))
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        part = np.zeros((len(both), min(4096, columns - 4096 * k)), np.float32)
        part[owner[a:b], column[a:b] - 4096 * k] = 1
        common += part[:n] @ part[n:].T
    return common.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], candidates: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which candidate pairs of left and right sets reach the threshold, in exact arithmetic.

    Few pairs are verified one by one. Many are by a product of the sets that have any; its other pairs come with it, so
    those that reach the threshold are links as well.
    """
    ratio = Fraction(threshold).limit_denominator(1000)
    up, down = ratio.numerator, ratio.denominator
    a, b = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    small, large = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
    candidates = candidates & (small * down >= large * up)  # sizes alone tell most others apart
    result = np.zeros(candidates.shape, bool)
    i, j = np.nonzero(candidates)
    if len(i) * 50 < candidates.size:  # few pairs: one by one
        for x, y in zip(i.tolist(), j.tolist()):
            common = len(np.intersect1d(left[x], right[y], assume_unique=True))
            result[x, y] = common * down >= (a[x] + b[y] - common) * up
    elif len(i):  # by a product, which gives the pairs beside them too
        rows, columns = np.unique(i), np.unique(j)
        common = _common([left[x] for x in rows], [right[y] for y in columns])
        reached = common * down >= (a[rows][:, None] + b[columns][None, :] - common) * up
        result[np.ix_(rows, columns)] = reached
    return result


class _Union:
    """Disjoint sets; the smallest member names one."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, others: list[int]) -> None:
        roots = {self.find(o) for o in others} | {self.find(x)}
        least = min(roots)
        for r in roots:
            self.parent[r] = least


def _verify(threshold: float, shingle: int, forest: Forest):
    """Verifies a bundle: rows (comp, left, right, block, cls, copies, labels, words) to (cls, links, root)."""
    depth, trees, shortest = forest.depth, forest.trees, forest.shortest

    def candidates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = np.zeros((len(left), len(right)), bool)
        for t in range(trees):
            found |= left[:, t, None] == right[None, :, t]
        return found

    def nodes(labels: list[bytes]) -> np.ndarray:
        """Numbers of the nodes at the shortest prefix, by class and tree."""
        strings = np.frombuffer(b"".join(labels), ">u2").reshape(-1, trees, depth)[:, :, :shortest].astype(np.uint64)
        number = np.zeros(strings.shape[:2], np.uint64)
        for d in range(shortest):
            number = np.unique(
                number * np.uint64(1 << 16) + strings[:, :, d], return_inverse=True
            )[1].reshape(number.shape).astype(np.uint64)
        return number

    def run(table: pa.Table) -> pa.Table:
        # keys first: the words of one component at a time become Python objects
        keys = sorted(zip(*(table.column(c).to_pylist() for c in ("comp", "left", "right", "block", "cls")), range(table.num_rows)))
        out, a = [], 0
        copies, labels, words = (table.column(c).combine_chunks() for c in ("copies", "labels", "words"))
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b][:3] == keys[a][:3]:
                b += 1
            group, a = [r for i, r in enumerate(keys[a:b], a) if i == a or keys[i - 1][:5] != r[:5]], b
            split = sum(r[3] == r[1] for r in group) if group[0][1] != group[0][2] else 0
            if group[0][1] != group[0][2] and split in (0, len(group)):
                continue
            at = [r[5] for r in group]
            sets = shingle_numbers([words[i].as_py().split(b" ") for i in at], shingle)
            node = nodes([labels[i].as_py() for i in at])
            many = np.array([copies[i].as_py() for i in at], np.int64)
            n, total, union = len(group), np.zeros(len(group), np.int64), _Union(len(group))
            for p in range(0, split or n, ROWS):
                q = min(p + ROWS, split or n)
                for u in range(split or p, n, ROWS):
                    v = min(u + ROWS, n)
                    pairs = candidates(node[p:q], node[u:v])
                    link = linked(sets[p:q], sets[u:v], np.triu(pairs, 1) if u == p else pairs, threshold)
                    if u == p:
                        link = np.triu(link, 1)
                    total[p:q] += link @ many[u:v]
                    total[u:v] += link.T @ many[p:q]
                    for x in np.flatnonzero(link.any(axis=1)).tolist():
                        union.join(p + x, (np.flatnonzero(link[x]) + u).tolist())
            # the root names what the links of this block connect
            out += [(r[4], int(total[i]), group[union.find(i)][4]) for i, r in enumerate(group) if total[i]]
        return pa.table({
            "cls": pa.array([r[0] for r in out], pa.binary()), "links": pa.array([r[1] for r in out], pa.int64()),
            "root": pa.array([r[2] for r in out], pa.binary())
        })

    return run


def _tasks(active: DataFrame, nodes: DataFrame, block_bytes: int) -> DataFrame:
    """(cls, copies, labels, comp, block, left, right, task) of active(rep, cls, copies, labels, size, comp): a row per task that a class goes to.

    Components up to block_bytes go to bundles. Of others, the classes below one node of the first tree share a
    block unless they exceed it, and each pair of blocks is a task if some of nodes(rep, node) has members in both.
    """
    sizes = active.groupBy("comp").agg(F.sum("size").alias("bytes")).select(
        "comp", "bytes", F.ceil(F.col("bytes") / block_bytes).cast("long").alias("blocks")
    )
    sizes = keep(sizes, "jaccard-sizes")
    n_bundles, large = sizes.agg(
        F.coalesce(F.ceil(F.sum(F.when(F.col("blocks") == 1, F.col("bytes"))) / block_bytes), F.lit(1)).cast("long"),
        F.count_if(F.col("blocks") > 1)
    ).first()
    joined = active.join(sizes.select("comp", "blocks"), "comp")
    zero = F.lit(0).cast("long")
    whole = joined.where("blocks = 1").select(
        "cls", "copies", "labels", "comp", zero.alias("block"), zero.alias("left"), zero.alias("right"),
        F.pmod(F.xxhash64("comp"), F.lit(max(1, n_bundles))).alias("task")
    )
    if not large:
        return whole
    home = F.xxhash64(F.substring("labels", 1, 2))
    cut = joined.where("blocks > 1").withColumn("home", F.pmod(home, F.col("blocks")))
    crowds = cut.groupBy("comp", "home").agg(F.ceil(F.sum("size") / block_bytes).cast("long").alias("parts"))
    cut = cut.join(crowds, ["comp", "home"]).withColumn(
        "block", F.col("home") + F.col("blocks") * F.pmod(F.xxhash64("cls"), F.col("parts"))
    )
    cut = keep(cut.select("rep", "cls", "copies", "labels", "comp", "block"), "jaccard-blocks")
    # blocks by node are distinct before they meet: a node has as many rows here as blocks, whatever its members
    present = nodes.join(cut.select("rep", "comp", "block"), "rep").select("node", "comp", "block").distinct()
    present = keep(present, "jaccard-present")
    other = present.select("node", "comp", F.col("block").alias("right"))
    pairs = present.withColumnRenamed("block", "left").join(other, ["node", "comp"]).where(F.col("left") <= F.col("right")).select("comp", "left", "right").distinct()
    pairs = keep(pairs, "jaccard-block-pairs")
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    spread = cut.join(ends, ["comp", "block"]).select(
        "cls", "copies", "labels", "comp", "block", "left", "right", F.xxhash64("comp", "left", "right").alias("task")
    )
    return whole.unionByName(spread)


def jaccard_links(
    documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH,
    recall: float = RECALL, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of documents(doc_id, text, ...).

    n_links: other rows with at least the threshold's similarity, copies included. class_id: the smallest
    doc_id that a row is linked to, directly or over others, its own if it has no link. Texts
    without words (null or empty too) have no links; fewer words than a shingle has make one shingle. A row
    with a null doc_id takes no part: class_id null, no links. Rows repeated with their
    id are copies of each other. Extra columns are ignored.
    """
    small_batches(documents.sparkSession)
    forest = Forest(threshold, trees, depth, recall)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(signatures(texts, forest, shingle), "jaccard-signatures")
    named = signed.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("labels").alias("labels"), F.min("need").alias("need"),
        F.min("size").alias("size")
    )
    classes = keep(classes, "jaccard-classes")
    nodes = keep(trie_groups(classes, forest), "jaccard-nodes")
    comps = components(nodes, "rep", "node").select("rep", F.col("root").alias("comp"))
    crowded = comps.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
    comps = keep(comps.join(crowded, "comp", "left_semi"), "jaccard-components")
    active = keep(comps.join(classes, "rep").select("rep", "cls", "copies", "labels", "size", "comp"), "jaccard-active")
    words = word_texts(texts, *id_filter(active, "rep", active.count()))
    checked = _tasks(active, nodes, block_bytes).join(words, "cls").groupBy("task").applyInArrow(
        _verify(threshold, shingle, forest), "cls binary, links long, root binary"
    )
    checked = keep(checked, "jaccard-checked")
    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(checked, "cls", "root")
    # classes by root, the smallest representative of each root names it
    final = classes.join(links, "cls", "left").join(roots, "cls", "left").select(
        "cls", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")
    )
    final = keep(final, "jaccard-final")
    heads = final.groupBy("root").agg(F.min("rep").alias("class_id"))
    final = keep(
        final.join(heads, "root").select("cls", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")),
        "jaccard-classes"
    )
    whole = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"))
    out = whole.join(final, "cls", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def deduplicated(documents: DataFrame, **how) -> DataFrame:
    """documents without all but one row of each class: the row that names it stays; all columns are kept.

    Rows without an id stay. Of rows that repeat the kept id one of the smallest text stays.
    """
    id_, n, least = unused(documents.columns, "id", "n", "least")
    classes = jaccard_links(documents, **how)
    gone = classes.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias(id_)).distinct()
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    # ids alone are shuffled to find those that repeat; texts only for them
    twice = documents.where(F.col("doc_id").isNotNull()).groupBy(doc_id.alias(id_)).agg(F.count("*").alias(n)).where(F.col(n) > 1)
    twice = keep(twice.select(id_), "jaccard-twice")
    left = documents.join(keep(gone, "jaccard-gone"), doc_id == F.col(id_), "left_anti")
    if not twice.limit(1).count():
        return left.select(*documents.columns)
    twice = keep(documents.join(twice, doc_id == F.col(id_)).groupBy(id_).agg(F.min(text).alias(least)), "jaccard-twice")
    single = left.join(twice, doc_id == F.col(id_), "left_anti").select(*documents.columns)
    repeated = left.join(twice, doc_id == F.col(id_)).where(text == F.col(least)).dropDuplicates([id_])
    return single.unionByName(repeated.select(*documents.columns))
