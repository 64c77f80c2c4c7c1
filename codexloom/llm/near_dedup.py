"""Near-duplicate groups by a chosen-path set similarity join.

A document's set is its distinct word shingles.  Equal sets are one point.  Each of
``TREES`` independent trees puts every point into root nodes, each named by the minwise
tokens of ``ROOT_TOKENS`` coordinates, and then into nodes that are named by the path of
tokens chosen so far.  A node is settled as follows.

* A node whose points are all in one component already is closed.
* A node of at most ``LEAF`` points is compared exhaustively, in one worker: first
  sketches of 256 bits, which keep pairs at the threshold with five standard deviations
  to spare, then the full sets, recomputed from the texts of the points that are left.
* A larger node with at most half as many points outside its largest component is dealt
  into parts of that component, each compared with all the points outside.
* Any other node is branched: a child takes the minwise tokens of up to ``MOST_TOKENS``
  further coordinates at once, and a node has so many children for a point that one of
  them is expected to keep a similar pair (``fan``).  (If the tokens of all its points are
  equal, it is compared in all pairs of its parts.)  In the first trees such a node is also
  dealt into parts of ``LEAF`` points, with two points of the node in every part, and these
  are compared first; a group of copies that fills a node is then mostly one component.

Comparisons return which components meet, a spanning forest for each node, and never
their pairs, so what is written grows with the points of a group and not with its square.
The trees go on until no node is open: there is no cap on the size of a node, a group or
a bucket, and nodes of long texts are compared in pairs of blocks of ``ROOM`` shingles.

Recall.  A pair at J = 0.75 is together in a root of a tree with probability 0.80, and
with 0.78 of that or more in the children of each level below.  All 8 trees miss it with
probability 2e-6 at the root.  Points that were in nodes that had to be branched, as
documents that share a passage are, get further trees until a pair of them is missed with
``MISSED`` at most at the deepest level that they reached (11 trees one level down, 18 two),
taking the trees as independent.  Pairs of higher similarity are missed less often.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._shared import Stage, small

SHINGLE = 5
PERCENT = 75
TREES = 8
#: Tokens that name a root.
ROOT_TOKENS = 3
#: Trees that come first; the others begin when these have joined the large groups, so
#: that a group of copies is carried through few trees.
FIRST_TREES = 2
#: Probability with which all trees may miss a pair at the threshold.
MISSED = 3e-5
COORDINATES = 64
#: Points of a node that one worker compares: 131,000 pairs of sketches at most.
LEAF = 512
#: Tokens that a branch takes at once, at most.
MOST_TOKENS = 6
#: Shingles of the sets that one worker holds for a comparison (a longer text alone is a block).
ROOM = 4_000_000
#: Bytes of text that a worker tokenises at a time; shingles and tokens take many times that.
PIECE_BYTES = 1 << 20

_rng = np.random.default_rng(75)
_SALT = _rng.integers(0, 1 << 32, (COORDINATES, 1), dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, (COORDINATES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(words: K.Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of all its words if fewer than k."""
    rolling = K.Rolling(words.hashes)
    runs = rolling.windows(k)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(rolling.spans(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(points: np.ndarray) -> np.ndarray:
    """The minwise token of every coordinate."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    top = (points >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(top), 4096):
        np.minimum(low, ((top[None, a : a + 4096] ^ _SALT) * _ODD).min(1), out=low)
    return low


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Four bits of each token, 16 to a word."""
    nibbles = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64).reshape(4, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)


def _signer(k: int):
    def sign(batches):
        for batch in batches:
            for piece in K.pieces(batch, "text", PIECE_BYTES):
                sets = shingle_sets(K.tokenise(piece.column("text"), K.SPACED, True), k)
                tokens = [minwise(s) for s in sets]
                sums = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(K.mix(s))) if len(s) else 0) for s in sets]
                keys = np.array(sums, np.uint64).reshape(-1, 2).astype(np.int64)
                columns = [piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                columns += [pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary()), pa.array([_sketch(t).astype("<u8").tobytes() for t in tokens], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "k1", "k2", "tokens", "sketch"])

    return sign


def _lister(k: int):
    def listed(batches):
        for batch in batches:
            for piece in K.pieces(batch, "text", PIECE_BYTES):
                sets = shingle_sets(K.tokenise(piece.column("text"), K.SPACED, True), k)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["id", "points"])

    return listed


def joined_labels(links: np.ndarray) -> np.ndarray:
    """Smallest place reachable over a symmetric matrix of links."""
    labels = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(links, labels[None, :], len(links)).min(1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _runs(batches, key: str):
    """Tables of the rows that share a key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0, 0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                if held and held[0].column(key)[0].as_py() != int(keys[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy() if len(column) else np.zeros(0, np.int32)


def most_different(similarity: float) -> int:
    """Differing sketch nibbles of a pair at the threshold, five deviations above the mean
    (32 of 64 at 0.75, where the mean is 15)."""
    p = (1 - similarity) * 15 / 16
    return math.ceil(COORDINATES * p + 5 * math.sqrt(COORDINATES * p * (1 - p)))


def _gatherer(room: int, most: int):
    """Rows of a node (``task``, id, comp, n, sketch) to those of its points that are near
    one of another component, in tasks of points that are near each other."""

    def gather(batches):
        for node in _runs(batches, "task"):
            comps = _codes(node.column("comp"))
            if len(comps) < 2 or comps.max() == 0:
                continue
            sketches = np.frombuffer(b"".join(node.column("sketch").to_pylist()), "<u8").reshape(-1, 4)
            differ = np.zeros((len(comps), len(comps)), np.uint8)
            for s in sketches.T:
                x = s[:, None] ^ s[None, :]
                x |= x >> np.uint64(2)
                x = (x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)
                differ += np.bitwise_count(x)
            labels = joined_labels((differ <= most) & (comps[:, None] != comps[None, :]))
            names, places, sizes = np.unique(labels, return_inverse=True, return_counts=True)
            if (sizes < 2).all():
                continue
            weights, out_at, out_task = node.column("n").to_numpy(), [], []
            task = node.column("task")[0].as_py()
            for name in np.flatnonzero(sizes >= 2).tolist():
                at = np.flatnonzero(places == name)
                block = np.zeros(len(at), np.int64)
                if weights[at].sum() > room:
                    held = 0
                    for i, w in enumerate(weights[at].tolist()):  # blocks of half the room
                        held += w
                        if i and held > room // 2:
                            block[i:] += 1
                            held = w
                last = int(block[-1])
                for x in range(last + 1):
                    for y in range(x + 1 if last else x, last + 1):
                        inside = at[(block == x) | (block == y)]
                        out_at.append(inside)
                        out_task.append(np.full(len(inside), hash((task, int(names[name]), x, y)) & 0x7FFFFFFFFFFFFFFF, np.int64))
            picked = node.take(pa.array(np.concatenate(out_at)))
            yield from pa.table([pa.array(np.concatenate(out_task)), picked.column("id"), picked.column("comp")], names=["task", "id", "comp"]).to_batches()

    return gather


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    values = values[counts > 1]
    out = np.zeros((len(sets), len(sets)))
    step = 1 << 13
    for a in range(0, len(values), step):
        part = values[a : a + step]
        has = np.zeros((len(sets), len(part)), np.float32)
        for i, s in enumerate(sets):
            lo, hi = np.searchsorted(s, [part[0], part[-1]])
            own = s[lo : hi + 1]
            at = np.searchsorted(part, own)
            at = at[part[np.minimum(at, len(part) - 1)] == own]
            has[i, at] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _comparer(percent: int):
    """Rows of a task (``task``, id, comp, points) to (a, b): component a joins b."""

    def compare(batches):
        for node in _runs(batches, "task"):
            comps = _codes(node.column("comp"))
            sets = [np.frombuffer(p, "<u8") for p in node.column("points").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            shared = shared_counts(sets)
            links = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) | (comps[:, None] == comps[None, :])
            first = np.unique(comps, return_index=True)[1]
            labels = joined_labels(links)[first]
            low = {}
            names = node.column("comp").take(pa.array(first)).to_pylist()
            for label, name in zip(labels.tolist(), names, strict=True):
                low[label] = min(low.get(label, name), name)
            pairs = [(name, low[label]) for label, name in zip(labels.tolist(), names, strict=True) if name != low[label]]
            if pairs:
                kind = node.schema.field("comp").type
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind)], names=["a", "b"])

    return compare


def kept_together(tokens: int, children: int, similarity: float) -> float:
    """Probability that a pair is in one of the children that take so many tokens each."""
    return 1 - (1 - similarity**tokens) ** children


def fan(tokens: int, similarity: float) -> int:
    """Children of a node that take so many tokens each."""
    return math.ceil(1.25 * similarity**-tokens)


def _roots(points: DataFrame, trees: range, similarity: float) -> DataFrame:
    """Root nodes of the trees, for each point those below its ``trees`` if it has such."""
    n = fan(ROOT_TOKENS, similarity)
    rng = np.random.default_rng(64)
    picks = [rng.choice(COORDINATES, ROOT_TOKENS, replace=False).tolist() for _ in range(trees.stop * n)]
    token = lambda at: F.substring("tokens", 4 * at + 1, 4)
    paths = []
    for tree in trees:
        for c in range(n):
            path = F.xxhash64(F.lit(tree), F.lit(c), *(token(at) for at in picks[tree * n + c]))
            paths.append(F.when(F.col("trees") > tree, path) if "trees" in points.columns else path)
    mark = F.xxhash64("tokens").alias("mark")
    recall = F.lit(kept_together(ROOT_TOKENS, n, similarity)).alias("recall")
    return points.select("id", F.explode(F.array_compact(F.array(*paths))).alias("path"), "comp", mark, recall)


def _children(nodes: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """Children of large nodes (path, id, comp, mark, recall, size): each takes the tokens of
    further coordinates that its path picks, as many as its size asks for."""
    pick = lambda c, j: F.pmod(F.xxhash64("path", F.lit(c), F.lit(j)), F.lit(COORDINATES)).cast("int")
    token = lambda c, j: F.substring("tokens", pick(c, j) * 4 + 1, F.lit(4))
    wanted = F.ceil(F.log(F.col("size") / F.lit(float(LEAF))) / F.lit(max(-math.log(similarity), 0.01)))
    depth = F.least(F.greatest(wanted, F.lit(1)), F.lit(MOST_TOKENS)).cast("int")
    paths, stays = None, None
    for k in range(1, MOST_TOKENS + 1):
        n = fan(k, similarity)
        names = F.array(*(F.xxhash64("path", F.lit(c), *(x for j in range(k) for x in (pick(c, j), token(c, j)))) for c in range(n)))
        kept = F.lit(kept_together(k, n, similarity))
        paths = F.when(F.col("depth") == k, names) if paths is None else paths.when(F.col("depth") == k, names)
        stays = F.when(F.col("depth") == k, kept) if stays is None else stays.when(F.col("depth") == k, kept)
    grown = nodes.withColumn("depth", depth).join(points.select("id", "tokens"), "id")
    return grown.select("id", F.explode(paths).alias("path"), "comp", "mark", (F.col("recall") * stays).alias("recall"))


def _measured(nodes: DataFrame) -> DataFrame:
    """Nodes of two components or more: points, the largest component, the points outside
    it, whether all have equal tokens (no coordinate tells them apart), and two points."""
    by = F.xxhash64("id", "path")
    of = nodes.groupBy("path", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.min(by).alias("l"), F.min_by("id", by).alias("one"), F.max(by).alias("h"), F.max_by("id", by).alias("other")
    )
    size = F.sum("n")
    sizes = of.groupBy("path").agg(
        size.alias("size"), F.max_by("comp", "n").alias("top"), (size - F.max("n")).alias("outside"), (F.min("low") == F.max("high")).alias("alike"), F.min_by("one", "l").alias("one"), F.max_by("other", "h").alias("other")
    )
    return sizes.where("outside > 0")


def _part(size: Column, most: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(size / F.lit(most)).cast("long"))


def _parts(large: DataFrame) -> DataFrame:
    """Large nodes dealt into parts, two points of the node in each (task, id)."""
    dealt = large.withColumn("task", F.xxhash64("path", _part(F.col("size"), LEAF - 2)))
    shared = dealt.select("task", F.explode(F.array("one", "other")).alias("id"))
    return dealt.select("task", "id").unionByName(shared).distinct()


def _around(nodes: DataFrame) -> DataFrame:
    """Nodes with few points outside their largest component: its points dealt into parts,
    with all the others in each (task, id)."""
    inside = nodes.where("comp = top").select("path", "id", _part(F.col("size"), LEAF // 2).alias("part"))
    others = nodes.where("comp <> top").select("path", "id")
    both = inside.select("path", "part").distinct().join(small(others), "path").unionByName(inside)
    return both.select(F.xxhash64("path", "part").alias("task"), "id")


def _crossed(nodes: DataFrame) -> DataFrame:
    """Nodes that can't be branched, as all pairs of parts of half a leaf (task, id)."""
    own = nodes.select("path", "id", _part(F.col("size"), LEAF // 2).alias("x"))
    both = own.join(own.select("path", F.col("x").alias("y")).distinct(), "path")
    return both.select(F.xxhash64("path", F.least("x", "y"), F.greatest("x", "y")).alias("task"), "id").distinct()


def components(stage: Stage, links: DataFrame) -> DataFrame:
    """Smallest id reachable over links (a, b), for every id that has a link.

    A round gives each id the least label of its neighbours and then that label's own
    label; one exchange while the labels are few enough to be broadcast."""
    edges = stage.save(links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a")).distinct())
    labels = stage.save(edges.groupBy("id").agg(F.min("to").alias("low")).select("id", F.least("id", "low").alias("comp")))
    while True:
        known = small(labels)
        said = edges.join(known.withColumnRenamed("id", "to"), "to").select("id", "comp", F.lit(None).cast(labels.schema["comp"].dataType).alias("was"))
        step = said.union(labels.select("id", "comp", F.col("comp").alias("was"))).groupBy("id").agg(F.min("comp").alias("comp"), F.max("was").alias("was"))
        jump = known.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = stage.save(step.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        stage.drop(labels)
        labels = new.select("id", "comp")
        if not new.where("was <> comp").limit(1).count():
            stage.drop(edges)
            return labels


class _Join:
    """The components found so far, and the steps that find more."""

    def __init__(self, stage: Stage, texts: DataFrame, points: DataFrame, shingle: int, percent: int, repeated: bool) -> None:
        self.stage, self.texts, self.points, self.shingle, self.percent = stage, texts, points, shingle, percent
        self.repeated = repeated  # whether an id has several rows
        self.id = texts.schema["id"].dataType
        self.comp: DataFrame | None = None

    def placed(self, rows: DataFrame) -> DataFrame:
        """``comp`` of each row's id as far as it is known."""
        if self.comp is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(small(self.comp), "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def link(self, links: DataFrame) -> bool:
        """Takes in links (a, b) of components; whether there were any."""
        if not links.limit(1).count():
            return False
        new = components(self.stage, links)
        if self.comp is not None:  # old labels are ids of the new ones
            further = small(new.select(F.col("id").alias("comp"), F.col("comp").alias("further")))
            old = self.comp.join(further, "comp", "left").select("id", F.coalesce("further", "comp").alias("comp"))
            fresh = new.join(small(self.comp.select("id")), "id", "left_anti")
            merged = self.stage.save(old.unionByName(fresh))
            self.stage.drop(self.comp)
            self.stage.drop(new)
            new = merged
        self.comp = new
        return True

    def compare(self, tasks: DataFrame) -> None:
        """Links the points of each task (task, id) that are similar on full sets."""
        fields = lambda *f: T.StructType([T.StructField(n, t) for n, t in f])
        rows = self.placed(tasks.join(self.points.select("id", "n", "sketch"), "id"))
        rows = rows.select("task", "id", "comp", "n", "sketch").repartition("task").sortWithinPartitions("task", "id")
        near = self.stage.save(rows.mapInArrow(_gatherer(ROOM, most_different(self.percent / 100)), fields(("task", T.LongType()), ("id", self.id), ("comp", self.id))))
        needed = near.select("id").distinct()
        listed = self.texts.join(small(needed), "id", "left_semi").mapInArrow(_lister(self.shingle), fields(("id", self.id), ("points", T.BinaryType())))
        if self.repeated:
            listed = listed.distinct()
        rows = listed.join(small(near), "id").select("task", "id", "comp", "points").repartition("task").sortWithinPartitions("task", "id")
        links = self.stage.save(rows.mapInArrow(_comparer(self.percent), fields(("a", self.id), ("b", self.id))))
        self.stage.drop(near)
        self.link(links)
        self.stage.drop(links)

    def grow(self, nodes: DataFrame, deal: bool) -> list[DataFrame]:
        """Settles nodes (path, id, comp, mark, recall) and all below them; returns the points of
        large nodes with the recall of the nodes that they were put into (id, recall)."""
        opened, tasks, held = [], [], []
        nodes = self.stage.save(nodes)
        while True:
            sizes = self.stage.save(_measured(nodes))
            leaves = nodes.join(small(sizes.where(F.col("size") <= LEAF).select("path")), "path", "left_semi")
            tasks.append(leaves.select(F.col("path").alias("task"), "id"))
            held += [nodes, sizes]
            big = sizes.where(F.col("size") > LEAF)
            more = big.limit(1).count() > 0
            if more:
                large = self.stage.save(nodes.join(small(big), "path"))
                held.append(large)
                if deal:
                    deal = False
                    self.compare(tasks.pop().unionByName(_parts(large)))
                    # What the parts have joined is closed.
                    again = self.stage.save(self.placed(large.select("path", "id", "mark", "recall")))
                    sizes = self.stage.save(_measured(again))
                    large = self.stage.save(again.join(small(sizes), "path"))
                    held += [again, sizes, large]
                few, alike = F.col("outside") <= LEAF // 2, F.col("alike")
                tasks += [_around(large.where(few)), _crossed(large.where(~few & alike))]
                nodes = self.stage.save(_children(large.where(~few & ~alike), self.points, self.percent / 100))
                more = nodes.limit(1).count() > 0
            if not more:
                if tasks:
                    self.compare(functools.reduce(DataFrame.unionByName, tasks))
                for table in held:
                    self.stage.drop(table)
                return opened
            opened.append(self.stage.save(nodes.groupBy("id").agg(F.min("recall").alias("recall"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over
    links of similarity ``percent`` / 100 or more) and kept (the id is that smallest one).

    Words are runs without white space, A-Z in lower case; a text with fewer words than
    a shingle is one shingle of all of them.  Null, empty and blank texts have an empty
    set and stand alone.  Rows that repeat an id are one document: if their texts differ,
    the groups of all of them are one.  Rows with a null id have a null component and are
    kept.  Ties go to the smallest id.  An empty table stays empty; other columns are left
    out, whatever their names.  Sets are compared as sets of 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field = docs.schema["id"]
    signed = T.StructType([id_field, *(T.StructField(n, T.LongType()) for n in ("n", "k1", "k2")), T.StructField("tokens", T.BinaryType()), T.StructField("sketch", T.BinaryType())])
    sets = stage.save(docs.mapInArrow(_signer(shingle), signed))
    named = sets.where("n > 0 and id is not null")
    # Equal sets have equal tokens, so any row's will do.
    points = stage.save(named.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    of_id = named.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), *(f(k).alias(f"{n}_{k}") for n, f in (("low", F.min), ("high", F.max)) for k in ("k1", "k2")))
    several = stage.save(of_id.where("rows > 1").select("id", F.expr("low_k1 <> high_k1 or low_k2 <> high_k2").alias("differ")))
    repeated = several.limit(1).count() > 0
    join = _Join(stage, docs.where("id is not null"), points, shingle, percent, repeated)
    if repeated:  # an id with different texts joins their points
        several = several.where("differ")
        of = named.join(small(several), "id", "left_semi").join(points.select(F.col("id").alias("rep"), "k1", "k2"), ["k1", "k2"])
        join.link(stage.save(of.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()))

    opened = join.grow(_roots(join.placed(points.select("id", "tokens")), range(FIRST_TREES), percent / 100), True)
    trees, new = FIRST_TREES, TREES
    rows = points.select("id", "tokens")
    while new > trees:
        opened += join.grow(_roots(join.placed(rows), range(trees, new), percent / 100), False)
        trees = new
        if opened:  # trees that points of deep nodes need
            least = functools.reduce(DataFrame.unionByName, opened).groupBy("id").agg(F.min("recall").alias("recall"))
            most = math.log(MISSED)
            need = F.ceil(F.lit(most) / F.log(1 - F.col("recall")) - 1e-9).cast("int")
            wanted = stage.save(least.select("id", need.alias("trees")).where(F.col("trees") > trees))
            new = wanted.agg(F.max("trees")).first()[0] or 0
            rows = points.select("id", "tokens").join(small(wanted), "id")

    reps = points.select("k1", "k2", F.col("id").alias("rep"))
    if join.comp is not None:
        reps = reps.join(small(join.comp.withColumnRenamed("id", "rep")), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("rep"))
    out = sets.select("id", "n", "k1", "k2").join(reps, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
