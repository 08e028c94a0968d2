"""Self-join of documents by Jaccard similarity of word shingles: a chosen-path join.

Every text is a set of five-word shingles, embedded as COORDINATES minimum hashes; a *token* of a set is
one coordinate with its value.  A run starts with all sets in one node.  Each node samples coordinates by
a hash of its path, 1/threshold of them on average, and every set goes to a child for each of its tokens
that is sampled.  Buckets of at most ``bucket`` sets are compared by brute force, larger ones are split
again, and runs are repeated until a pair at the threshold is met with probability ``recall``.

A bucket that one task can hold is searched to the end there; larger ones are split across tasks.  Before a
split, a bucket's sets are compared with one of them, its hub.  Jaccard distance is a metric: what is linked
to a near copy of the hub is itself not far from the hub.  So once all sets not far from the hub are dealt
with, its near copies leave the bucket, and a dense group does not grow from level to level.

What the buckets bring together is then verified exactly.  Sets that may be linked form candidate groups,
a group's sets are shuffled once into blocks, and the blocks of a large group meet in pairs, packed as one
row each, so that no task holds more than two blocks and no pair of sets is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.scratch import BROADCAST_ROWS, ship, sized, stored
from quarry.llm.workers import tidy

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
BUCKET = 64
#: Sets that one task searches at most; of a sketch it holds COORDINATES bytes.
IN_TASK = 4096
#: Sets and bytes of shingle hashes of a block in the exact verification.
BLOCK, BLOCK_BYTES = 128, 8 << 20
DEPTH = 4
RECALL = 0.999
#: Standard deviations by which a sketch's estimate may fall short of the threshold and still be verified.
SLACK = 4.0
#: Share of equal coordinates from which a set counts as a near copy of a bucket's hub.
COPY = 0.95
#: Characters that a worker takes on at once.
CHARS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_list(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(words: list[str], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text is one shingle, an empty one none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out * _MIX + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def node_of(words: list[str]) -> int:
    """The signed 64-bit id shared by all texts with these words."""
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Minimum hashes (32 bits each) of non-empty sets, one row a set."""
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), coordinates), np.uint32)
    for i, seed in enumerate(mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * _MIX)):
        out[:, i] = np.minimum.reduceat(((joined ^ seed) * (seed | np.uint64(1))) >> np.uint64(32), starts)
    return out


def sampled(path: int, coordinates: int, threshold: float) -> list[int]:
    """Coordinates that the node at this path splits on."""
    h = mixed(np.uint64(path) + np.arange(1, coordinates + 1, dtype=np.uint64) * _MIX)
    return np.flatnonzero(h < np.uint64(2**64 / (threshold * coordinates))).tolist()


def child(path: int, coordinate: int, values: np.ndarray) -> np.ndarray:
    """Paths of the children for the values of one coordinate."""
    base = mixed(np.array([path], np.uint64) * _MIX + np.uint64(coordinate + 1))[0]
    return mixed(base ^ (values.astype(np.uint64) * _MIX))


def survival(depth: int) -> float:
    """Chance that a pair at the threshold that is together at one node is together ``depth`` levels below."""
    s = 1.0
    for _ in range(depth):
        s = 1.0 - math.exp(-s)
    return s


def root_splits(coordinates: int, threshold: float, depth: int, recall: float) -> list[tuple[int, int]]:
    """(run, coordinate) of as many runs as the target recall needs, were every bucket split to full depth."""
    out, missed, run = [], 1.0, 0
    while missed > 1 - recall:
        run += 1
        for i in sampled(run, coordinates, threshold):
            out.append((run, i))
            missed *= 1 - threshold * survival(depth - 1)
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that share their first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        differs = np.zeros(batch.num_rows, bool)
        for c in cols:
            differs[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            differs[0] = any(last.column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys))
        cuts = np.flatnonzero(differs).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node, size (number of shingles), sketch (null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                nodes, sets, full, chars, began = [], [], [], 0, at
                while at < batch.num_rows and chars < CHARS:
                    text = batch.column(1)[at].as_py() or ""
                    words = word_list(text)
                    chars += len(text) + 1
                    nodes.append(node_of(words))
                    full.append(bool(words))
                    if words:
                        sets.append(shingles(words))
                    at += 1
                rows = iter([r.tobytes() for r in sketches(sets)] if sets else [])
                sizes = iter([len(x) for x in sets])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).slice(began, at - began),
                        "node": pa.array(nodes, pa.int64()),
                        "size": pa.array([next(sizes) if f else 0 for f in full], pa.int64()),
                        "sketch": pa.array([next(rows) if f else None for f in full], pa.binary()),
                    }
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "id long, node long, size long, sketch binary"
    )


def _split(paths: DataFrame, threshold: float) -> DataFrame:
    """Children (path, node) of rows path, node, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column(0).to_numpy().view(np.uint64)
            nodes = batch.column(1).to_numpy()
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(len(nodes), -1)
            for path in np.unique(paths):
                own = paths == path
                for i in sampled(int(path), COORDINATES, threshold):
                    yield pa.RecordBatch.from_pydict(
                        {"path": child(int(path), i, values[own, i]).view(np.int64), "node": nodes[own]}
                    )

    return paths.select("path", "node", "sketch").mapInArrow(tidy(run), "path long, node long")


def _first_level(nodes: DataFrame, splits: list[tuple[int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(own), -1)
            for path, i in splits:
                yield pa.RecordBatch.from_pydict(
                    {"path": pa.array(child(path, i, values[:, i]).view(np.int64)), "node": own}
                )

    return nodes.select("node", "sketch").mapInArrow(tidy(run), "path long, node long")


def agreement(coordinates: int, threshold: float, copy: float = COPY) -> tuple[int, int, int]:
    """Equal coordinates (least, cut, sure) that decide what is compared.

    A pair at the threshold has ``least`` of them.  A set with ``sure`` of them in common with a hub has a
    similarity to it that is no lower than some p, so what is linked to that set has p - (1 - threshold) at
    least, and with that ``cut`` equal coordinates.  All but SLACK standard deviations.
    """

    def below(p: float) -> float:
        return coordinates * p - SLACK * math.sqrt(coordinates * p * (1 - p))

    sure = math.ceil(coordinates * copy)
    p = 1.0
    while p > 0 and 2 * coordinates * p - below(p) > sure:
        p -= 0.005
    q = max(p - (1 - threshold), 0.0)
    return max(1, math.ceil(below(threshold))), max(1, math.floor(below(q))), sure


class BucketSearch:
    """The search of one bucket that fits in a task: hubs, brute force, splits on sampled coordinates."""

    def __init__(self, low: np.ndarray, threshold: float, bucket: int, depth: int):
        self.low, self.threshold, self.bucket, self.depth = low, threshold, bucket, depth
        self.least, self.cut, self.sure = agreement(low.shape[1], threshold)
        self.forest = Forest(len(low))

    def against(self, one: int, rows: np.ndarray) -> np.ndarray:
        """Equal coordinates of a set and of each of the others; those that may be linked are connected."""
        equal = (self.low[rows] == self.low[one]).sum(axis=1)
        for j in rows[equal >= self.least].tolist():
            self.forest.join(one, j)
        return equal

    def search(self, rows: np.ndarray, path: int, level: int) -> None:
        while len(rows) > self.bucket:
            before, equal = len(rows), self.against(int(rows[0]), rows)
            copies = equal >= self.sure
            for r in rows[(equal >= self.cut) & ~copies].tolist():
                if copies.sum() > 1:
                    self.against(r, rows[copies])
            rows = rows[~copies]
            if 8 * len(rows) > 7 * before:
                break  # not dense about this hub: split
        if len(rows) <= self.bucket or level >= self.depth:
            for k in range(len(rows) - 1):
                self.against(int(rows[k]), rows[k + 1 :])
            return
        for i in sampled(path, self.low.shape[1], self.threshold):
            values = self.low[rows, i]
            order = np.argsort(values, kind="stable")
            cuts = np.flatnonzero(np.diff(values[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    below = int(child(path, i, values[part[:1]])[0])
                    self.search(rows[np.sort(part)], below, level + 1)


def _near_in_bucket(members: DataFrame, threshold: float, bucket: int, depth: int) -> DataFrame:
    """Edges (a, b) that connect what is connected in each bucket: every node with its component's smallest.

    Naming the smallest node makes buckets that hold the same group say the same, so that equal edges fall
    together later.  Rows: path, block, other, side, level, node, low (one byte a coordinate).  A pair of
    blocks of a bucket is one group.
    """
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in sorted_groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            order = np.argsort(group.column("node").to_numpy(), kind="stable")
            nodes = group.column("node").to_numpy()[order]
            low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(n, -1)[order]
            found = BucketSearch(low, threshold, bucket, depth)
            path = group.column("path")[0].as_py() & (2**64 - 1)
            if group.column("block")[0].as_py() == group.column("other")[0].as_py():
                found.search(np.arange(n), path, group.column("level")[0].as_py())
            else:
                side = group.column("side").to_numpy()[order]
                one, two = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
                for i in one.tolist():
                    found.against(i, two)
            roots = np.array([found.forest.find(i) for i in range(n)])
            joined = np.flatnonzero(nodes[roots] != nodes)
            a += nodes[joined].tolist()
            b += nodes[roots[joined]].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    return (
        members.select("path", "block", "other", "side", "level", "node", "low")
        .repartition("path", "block", "other")
        .sortWithinPartitions("path", "block", "other")
        .mapInArrow(tidy(run), "a long, b long")
    )


def _star(rows: DataFrame) -> DataFrame:
    """path, node, hub and the coordinates equal to the hub's, of rows path, node, low, hub (a struct of node and low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, hub = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for i in (3, 4)
                )
                equal = pa.array((own == hub).sum(axis=1), pa.int32())
                names = ["path", "node", "hub", "equal"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], equal], names)

    rows = rows.select("path", "node", F.col("hub.node").alias("hub_node"), "low", F.col("hub.low").alias("hub_low"))
    return rows.mapInArrow(tidy(run), "path long, node long, hub long, equal int")


def _blocks(rows: DataFrame, count, block: int) -> DataFrame:
    """Repeat each row for every pair of blocks that its own block is part of: block, other, side."""
    parts = F.ceil(count / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    return (
        rows.withColumn("side", own)
        .withColumn("partner", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("block", F.least("side", "partner"))
        .withColumn("other", F.greatest("side", "partner"))
        .drop("partner")
    )


class Block:
    """Sets of one candidate group, with what a comparison needs."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, sizes: np.ndarray, items: np.ndarray):
        self.nodes, self.copies, self.sizes, self.items = nodes, copies, sizes, items

    def pack(self) -> bytes:
        parts = (np.array([len(self.nodes)], np.int64), self.nodes, self.copies, self.sizes, self.items)
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def unpack(cls, packed: bytes) -> Block:
        n = int(np.frombuffer(packed, np.int64, 1)[0])
        head = np.frombuffer(packed, np.int64, 3 * n, 8).reshape(3, n)
        return cls(*head, np.frombuffer(packed, np.uint64, offset=8 * (3 * n + 1)))

    def links(self, other: Block | None, threshold: float) -> pa.RecordBatch:
        """Per node: links (copies included) and the smallest node it is connected with here, if smaller.

        Within the block, or with no other, between it and the other block.
        """
        blocks = [self, other] if other else [self]
        nodes, copies, sizes, items = (
            np.concatenate([getattr(b, x) for b in blocks]) for x in ("nodes", "copies", "sizes", "items")
        )
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        universe, codes = np.unique(items, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(universe), np.int32)
        links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
        for i in range(len(self.nodes) if other else len(nodes) - 1):
            first = len(self.nodes) if other else i + 1
            own = codes[starts[i] : starts[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[codes[starts[first] :]], starts[first:-1] - starts[first])
            mark[own] = 0
            at = np.flatnonzero(common >= threshold * (sizes[i] + sizes[first:] - common) - 1e-9) + first
            links[i] += copies[at].sum()
            links[at] += copies[i]
            for j in at.tolist():
                forest.join(int(rank[i]), int(rank[j]))
        roots = nodes[order][[forest.find(r) for r in rank.tolist()]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(nodes),
                pa.array(links),
                pa.array(roots, pa.int64(), mask=roots == nodes),
            ],
            ["node", "links", "near"],
        )


def _within_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """node, links, near inside each block; for blocks of a group of several also a row comp, part, parts, packed.

    Rows: comp, part, parts, node, copies, items (sorted 64-bit shingle hashes).
    """
    kinds = {"node": pa.int64(), "links": pa.int64(), "near": pa.int64()}
    kinds |= {"comp": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "packed": pa.binary()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for group in sorted_groups(batches, 2):
            nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
            sets = [np.frombuffer(group.column("items")[i].as_py(), np.uint64) for i in first.tolist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            block = Block(nodes, group.column("copies").to_numpy()[first], sizes, np.concatenate(sets))
            parts = group.column("parts")[0].as_py()
            found = block.links(None, threshold)
            columns = [*found.columns, *([pa.nulls(found.num_rows, kinds[k]) for k in ("comp", "part")])]
            columns += [pa.array([parts] * found.num_rows, pa.int32()), pa.nulls(found.num_rows, pa.binary())]
            held.append(pa.RecordBatch.from_arrays(columns, schema=schema))
            n_held += found.num_rows
            if parts > 1:
                keys = {"comp": group.column("comp")[0].as_py(), "part": group.column("part")[0].as_py()}
                row = {"node": None, "links": None, "near": None} | keys | {"parts": parts, "packed": block.pack()}
                held.append(pa.RecordBatch.from_pylist([row], schema))
            if n_held > 2000 or parts > 1:
                yield from held
                held, n_held = [], 0
        yield from held

    types = "node long, links long, near long, comp long, part int, parts int, packed binary"
    return (
        rows.select("comp", "part", "parts", "node", "copies", "items")
        .repartition("comp", "part")
        .sortWithinPartitions("comp", "part")
        .mapInArrow(tidy(run), types)
    )


def _between_blocks(packed: DataFrame, threshold: float) -> DataFrame:
    """node, links, near of every pair of blocks of a group. Rows: comp, part, parts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in sorted_groups(batches, 3):
            one, two = (Block.unpack(x) for x in pair.column("packed").to_pylist())
            yield one.links(two, threshold)

    partner = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
    return (
        packed.select("comp", "part", "packed", partner.alias("partner"))
        .select("comp", F.least("part", "partner").alias("one"), F.greatest("part", "partner").alias("two"), "packed")
        .repartition("comp", "one", "two")
        .sortWithinPartitions("comp", "one", "two")
        .mapInArrow(tidy(run), "node long, links long, near long")
    )


def _with_items(rows: DataFrame) -> DataFrame:
    """rows: text and node first; texts become their sorted shingle hashes, texts of another node go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                keep, items, chars = [], [], 0
                while at < batch.num_rows and chars < CHARS:
                    text = batch.column(0)[at].as_py() or ""
                    words = word_list(text)
                    chars += len(text) + 1
                    if node_of(words) == batch.column(1)[at].as_py():
                        keep.append(at)
                        items.append(shingles(words).tobytes())
                    at += 1
                part = batch.take(pa.array(keep, pa.int64()))
                columns = {n: part.column(i) for i, n in enumerate(part.schema.names) if i}
                yield pa.RecordBatch.from_pydict(columns | {"items": pa.array(items, pa.binary())})

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(tidy(run), f"{rest}, items binary")


def candidate_edges(nodes: DataFrame, threshold: float, bucket: int, in_task: int, depth: int, recall: float) -> DataFrame:
    """Edges that connect nodes whose sketches are close and that meet in a bucket of some run.

    nodes: stored rows node, sketch.  Buckets that a task can hold are searched there.  A larger one is
    first compared with its smallest node; all that is not far from that hub is connected to it, near copies
    of it leave the bucket, and the rest is searched or split again.
    """
    _, cut, sure = agreement(COORDINATES, threshold)
    level = _first_level(nodes, root_splits(COORDINATES, threshold, depth, recall))
    buckets, edges = [], []

    def counted(rows: DataFrame, tag: str) -> DataFrame:
        return stored(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), tag)

    def whole(rows: DataFrame, d: int) -> DataFrame:
        zero = F.lit(0)
        return rows.select("path", zero.alias("block"), zero.alias("other"), zero.alias("side"), F.lit(d).alias("level"), "node")

    for d in range(1, depth + 1):
        level = stored(level, f"level{d}")
        counts = counted(level, f"buckets{d}")
        n_large = counts.filter(F.col("n") > in_task).count()
        buckets.append(whole(level.join(sized(counts.filter(F.col("n") <= in_task)), "path"), d))
        if not n_large:
            break
        large = level.join(sized(counts.filter(F.col("n") > in_task), n_large), "path").join(_low_bytes(nodes), "node")
        hubs = stored(large.groupBy("path").agg(F.min(F.struct("node", "low")).alias("hub")), f"hubs{d}")
        starred = stored(_star(large.join(sized(hubs, n_large), "path")), f"star{d}")
        edges.append(starred.filter((F.col("equal") >= cut) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b")))
        rest = starred.filter(F.col("equal") < sure).select("path", "node")
        left = counted(rest, f"rest{d}")
        n_left = left.filter(F.col("n") > in_task).count()
        buckets.append(whole(rest.join(sized(left.filter(F.col("n") <= in_task)), "path"), d))
        if not n_left:
            break
        again = rest.join(sized(left.filter(F.col("n") > in_task), n_left), "path")
        if d == depth:  # what full depth could not split is compared block by block
            blocks = _blocks(again, F.col("n"), in_task // 2)
            buckets.append(blocks.select("path", "block", "other", "side", F.lit(d).alias("level"), "node"))
        else:
            level = _split(again.select("path", "node").join(nodes, "node"), threshold)
    members = buckets[0]
    for more in buckets[1:]:
        members = members.unionByName(more)
    found = _near_in_bucket(members.join(_low_bytes(nodes), "node"), threshold, bucket, depth)
    for more in edges:
        found = found.unionByName(more)
    return found


def _low_bytes(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                low = [r.tobytes() for r in (values & 0xFF).astype(np.uint8)]
                yield pa.RecordBatch.from_pydict({"node": batch.column(0), "low": pa.array(low, pa.binary())})

    return nodes.select("node", "sketch").mapInArrow(tidy(run), "node long, low binary")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bucket: int = BUCKET,
    in_task: int = IN_TASK,
    block: int = BLOCK,
    depth: int = DEPTH,
    recall: float = RECALL,
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its group) and n_links.

    Texts are lower-cased and split at white space; two texts are linked if the Jaccard similarity of their
    shingle sets is at least the threshold.  n_links counts the other rows a row is linked to, copies
    included; a class is a connected group of links.  A text of fewer than five words is one shingle.
    Null and empty texts have no shingles and are linked to nothing; a row with a null id has a null class
    and takes no part.  Rows that repeat an id count as copies.  Empty tables give empty results; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    known = docs.filter(F.col(id_col).isNotNull())
    rows = stored(profile(known, id_col, text_col), "profile")
    nodes = stored(
        rows.filter(F.col("sketch").isNotNull())
        .groupBy("node")
        .agg(
            F.min("id").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.min("size").alias("size"),
            F.min("sketch").alias("sketch"),
        ),
        "nodes",
    )
    near = candidate_edges(nodes.select("node", "sketch"), threshold, bucket, in_task, depth, recall)
    groups = components(near)
    members = stored(groups.withColumnRenamed("v", "node").join(nodes.drop("sketch"), "node"), "members")
    counts = stored(
        members.groupBy("comp")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        .select("comp", F.ceil(F.greatest(F.col("n") / block, F.col("size") * 8 / BLOCK_BYTES)).cast("int").alias("parts")),
        "counts",
    )
    dealt = members.join(sized(counts), "comp").select(
        "rep", "node", "copies", "comp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts"
    )
    texts = known.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    n_members = members.count()
    with_text = texts.join(F.broadcast(dealt) if n_members <= BROADCAST_ROWS else dealt, "rep")
    items = _with_items(with_text.select("text", "node", "copies", "comp", "part", "parts"))
    found = stored(_within_blocks(items, threshold), "links")
    links = found.filter("packed is null").select("node", "links", "near", "parts")
    packed = found.filter("packed is not null").select("comp", "part", "parts", "packed")
    joined = None
    if packed.count():
        between = stored(_between_blocks(packed, threshold), "links-between").withColumn("parts", F.lit(2))
        links = links.unionByName(between)
        joined = components(links.filter("parts > 1 and near is not null"), "node", "near")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"), F.min("near").alias("near"))
    linked = members.select("node", "rep").join(degree.filter("links > 0"), "node")
    if joined is None:
        linked = linked.withColumn("label", F.coalesce("near", "node"))
    else:
        linked = linked.join(joined.withColumnRenamed("v", "node"), "node", "left")
        linked = linked.withColumn("label", F.coalesce("comp", "near", "node"))
    linked = stored(linked.select("node", "rep", "links", "label"), "linked")
    smallest = linked.groupBy("label").agg(F.min("rep").alias("class_id"))
    decided = stored(linked.join(smallest, "label").select("node", "class_id", "links"), "decided")
    of_node = nodes.select("node", "rep", "copies")
    out = (
        rows.filter(F.col("sketch").isNotNull())
        .select(F.col("id").alias("doc_id"), "node")
        .join(of_node, "node")
        .join(sized(decided), "node", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    empty = rows.filter(F.col("sketch").isNull()).select(
        F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    unknown = docs.filter(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return out.unionByName(empty).unionByName(unknown)
