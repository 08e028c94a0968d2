"""Interpolated modified Kneser-Ney trigram model, counted in Spark and scored from memory-mapped arrays.

Counting takes two passes.  The first counts words; a word's id is its place in the order of 64-bit
hashes.  The second counts triples of ids.  From the distinct triples follows what pairs need: how many
words a pair follows, and how often, and by how many words once, twice and more often, it is followed
itself; from the distinct pairs follows the same for words.  Tasks send sorted runs of keys and counts,
compressed, to hash buckets, and a bucket's task merges its runs, writes one sorted array and sends runs
of the next lower order on.  Scoring workers map these files into memory and look words, pairs and
triples up by binary search, so their own memory doesn't grow with the model.

The files lie in the shared folder.  Where that is not a file system that can be mapped, a worker copies
them to its own disk first.

A text begins after a start mark that is no token.  What follows the mark has no longer context, so the
counts of such pairs are plain ones, and a text's first token is scored by pairs.
"""

from __future__ import annotations

import atexit
import mmap
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.jaccard_join import mixed, sorted_groups
from quarry.llm.scratch import delete, new_path, ship, shuffles_released
from quarry.llm.workers import tidy

#: A token that no text can hold: words have no space.
END = b" end"
#: Characters that a worker takes on at once, and keys it holds before it sends them.
CHARS, KEYS = 4_000_000, 3_000_000
#: The successors of one context are dealt to this many buckets.
SPREAD = 16
#: Bytes of text whose words and triples one bucket gathers, and so one task merges.
BUCKET_TEXT = 8 << 20
#: Numbers kept of a pair: the words it follows, how often it is followed, and by how many words once, twice, more often.
PAIR = 5
#: Numbers kept of a word: the words that follow it after one other word, after two, after more, all such pairs, the words it follows.
WORD = 5
#: Buckets for counts of counts, beside those of keys.
SUMMARIES = 16
#: Parts in which runs are merged one after another, so that few lie on disk twice.
PARTS = 4
#: Files that a worker maps at once: the system allows a process 65,530 maps, and less than half as many open files.
MOST_MAPS = 50_000
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
RUN = "bucket int, run binary"
LOW = np.uint64(0xFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased, and the end token."""
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words, and for every token the place of its word's."""
    back, different = pd.factorize(hashes([w for t in texts for w in t]))
    return different, back


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places where it stands."""
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max(initial=0)))), kind="stable")  # up to 16 bits sort fastest
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for part in np.split(order, cuts[1:]):
        if len(part):
            yield int(bucket[part[0]]), part


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts; keys have one column or two, the second below 2**32."""
    if not len(keys):
        return keys, counts
    lead = keys if keys.ndim == 1 else keys[:, 0]
    order = np.argsort(lead)
    new = np.diff(lead[order], prepend=lead[order[:1]]) != 0
    if keys.ndim == 2:  # the place of the first column among its distinct values leaves room for the second
        whole = np.empty(len(keys), np.uint64)
        whole[order] = np.cumsum(new, dtype=np.uint64) << np.uint64(32)
        whole |= keys[:, 1]
        order = np.argsort(whole)
        whole = whole[order]
        new = np.diff(whole, prepend=whole[:1]) != 0
    new[0] = True
    first = np.flatnonzero(new)
    return keys[order[first]], np.add.reduceat(counts[order], first, axis=0)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: differences of the leading keys, second keys and counts, each column in the bytes it needs, compressed."""
    columns = [*np.atleast_2d(keys.T), *np.atleast_2d(counts.T.astype(np.uint64))]
    columns[0] = np.diff(columns[0], prepend=np.uint64(0))
    widths, planes = [], []
    for x in columns:
        widths.append((int(x.max(initial=0)).bit_length() + 7) // 8)
        planes += [(x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(widths[-1])]
    return len(keys).to_bytes(8, "little") + bytes(widths) + zstandard.compress(b"".join(planes), 1)


def unpack(blob: bytes, columns: int = 1, key_columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    n, total = int.from_bytes(blob[:8], "little"), columns + key_columns
    raw = np.frombuffer(zstandard.decompress(blob[8 + total :]), np.uint8)
    numbers, at = np.zeros((total, n), np.uint64), 0
    for x, width in zip(numbers, blob[8 : 8 + total], strict=True):
        for k in range(width):
            x |= raw[at : at + n].astype(np.uint64) << np.uint64(8 * k)
            at += n
    numbers[0] = np.cumsum(numbers[0], dtype=np.uint64)
    keys, counts = numbers[:key_columns].T, numbers[key_columns:].T
    return keys if key_columns > 1 else keys[:, 0], counts if columns > 1 else counts[:, 0]


def word_bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def pair_bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    context, word = keys >> np.uint64(32), keys & LOW
    return (mixed(context * np.uint64(SPREAD) + word % np.uint64(SPREAD) + np.uint64(1)) >> np.uint64(64 - bits)).astype(
        np.int64
    )


def triple_bucket(contexts: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(mixed(contexts) + words % np.uint64(SPREAD)) >> np.uint64(64 - bits)).astype(np.int64)


def triple_hash(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(contexts + np.uint64(1)) + words)


class Runs:
    """Collects keys and counts of one task and yields them as packed runs by bucket."""

    def __init__(self, bucket_of: Callable[[np.ndarray], np.ndarray]):
        self.bucket_of, self.held, self.n = bucket_of, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, counts))
        self.n += len(keys)
        if self.n > KEYS:
            self.held = [summed(*map(np.concatenate, zip(*self.held, strict=True)))]
            self.n = len(self.held[0][0])
            if self.n > KEYS // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, counts = summed(*map(np.concatenate, zip(*self.held, strict=True)))
        self.held, self.n = [], 0
        bucket = self.bucket_of(keys)
        buckets, blobs = zip(*cut_runs(bucket, keys, counts), strict=True)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "run": pa.array(blobs, pa.binary())})


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches of about CHARS characters, with the words of their texts."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            began, chars, texts = at, 0, []
            while at < batch.num_rows and chars < CHARS:
                text = batch.column(column)[at].as_py()
                chars += len(text or "") + 1
                texts.append(words_of(text))
                at += 1
            yield batch.slice(began, at - began), texts


def write_file(uri: str, *parts: np.ndarray) -> None:
    """Atomic, so that a task may be run again or twice at once."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for data in parts:
            f.write(np.ascontiguousarray(data).tobytes())
    fs.move(part, path)


def write_table(uri: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """One file of keys and counts: its three sizes, the keys, places and counts of 255 and more, and a byte for every count."""
    counts = counts.reshape(-1)
    large = np.flatnonzero(counts >= 255)
    apart = np.column_stack([large.astype(np.uint64), counts[large].astype(np.uint64)])
    sizes = np.array([len(keys), len(large), len(counts)], np.uint64)
    write_file(uri, sizes, keys, apart, np.minimum(counts, 255).astype(np.uint8))


def local_path(uri: str) -> str | None:
    """Where the file can be mapped, after a copy if need be; none if it is missing or empty."""
    fs, path = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound or info.size == 0:
        return None
    if not isinstance(fs, pafs.LocalFileSystem):
        own = tempfile.mkdtemp(prefix="quarry-model-")
        atexit.register(shutil.rmtree, own, True)
        pafs.copy_files(path, f"{own}/x", source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        path = f"{own}/x"
    return path


def mapped(path: str | None) -> mmap.mmap | bytes:
    """The bytes of a file; its map stays when the file is closed, and takes no handle from Python 3.13 on."""
    if path is None:
        return b""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)


def read_table(data: mmap.mmap | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros((0, 2), np.uint64)
    keys, large, counts = np.frombuffer(data, np.uint64, 3).tolist()
    apart = np.frombuffer(data, np.uint64, 2 * large, 24 + 8 * keys).reshape(-1, 2)
    return np.frombuffer(data, np.uint64, keys, 24), np.frombuffer(data, np.uint8, counts, 24 + 8 * keys + 16 * large), apart


def read_around(data: mmap.mmap | bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(-1, WORD)


def merged(runs: DataFrame, buckets: int, columns: int, write: Callable, result: str, key_columns: int = 1) -> DataFrame:
    """Merge each bucket's runs in one task; write(bucket, keys, counts) yields result rows as dicts of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 1):
            bucket = group.column("bucket")[0].as_py()
            keys, counts = zip(*[unpack(x.as_py(), columns, key_columns) for x in group.column("run")], strict=True)
            del group
            found = summed(np.concatenate(keys), np.concatenate(counts))
            del keys, counts
            for row in write(bucket, *found):
                yield pa.RecordBatch.from_pydict(row)

    return runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), result)


def add_runs(runs: DataFrame, place: str) -> None:
    """Add runs to the table of runs at a place, dealt to PARTS folders by bucket."""
    dealt = runs.withColumn("part", F.col("bucket") % PARTS)
    dealt.write.mode("append").option("compression", "none").partitionBy("part").parquet(place)


def merged_parts(place: str, like: DataFrame, buckets: int, columns: int, write: Callable, key_columns: int = 1) -> str:
    """Merge the runs of the table at a place part by part and delete them; the runs that result lie at the returned place."""
    spark, after = like.sparkSession, new_path(like.sparkSession, "runs")
    for part in range(PARTS):
        runs = spark.read.schema(f"{RUN}, part int").parquet(place).filter(F.col("part") == part).drop("part")
        add_runs(merged(runs, -(-buckets // PARTS), columns, write, RUN, key_columns), after)
        delete(spark, [f"{place}/part={part}"])
    return after


def cut_runs(buckets: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed run for every bucket; keys are in order."""
    for bucket, part in by_bucket(buckets):
        yield bucket, pack(keys[part], counts[part])


def kinds(counts: np.ndarray) -> np.ndarray:
    """Three columns: whether a count is one, two, more."""
    found = np.zeros((len(counts), 3), np.uint64)
    found[np.arange(len(counts)), np.minimum(counts, 3).astype(np.int64) - 1] = 1
    return found


@dataclass
class TrigramModel:
    """Where the arrays are, and the few numbers that go with them."""

    place: str
    bits: int
    starts: np.ndarray  # id of each word bucket's first word
    train_tokens: int
    vocabulary: int
    documents: int
    pairs: int = 0
    triples: int = 0
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))  # of triples
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_weight: float = 1.0  # what the word distribution leaves to a uniform one

    @property
    def start(self) -> int:
        """Id of the mark before a text; one more is the id of what would stand before that."""
        return self.vocabulary

    @property
    def range_size(self) -> int:
        """Ids in one file of neighbour counts."""
        return -(-(self.vocabulary + 1) // (1 << self.bits))

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Looks words, pairs and triples up in the mapped arrays of one model."""

    def __init__(self, model: TrigramModel):
        self.model, self.files, self.paths = model, {}, {}

    def _file(self, name: str) -> mmap.mmap | bytes:
        if name not in self.paths:
            self.paths[name] = local_path(f"{self.model.place}/{name}")
        return mapped(self.paths[name])

    def _kept(self, name: str, read: Callable) -> np.ndarray | tuple[np.ndarray, ...]:
        """What is read from a file, mapped until there are too many maps."""
        if name not in self.files:
            if len(self.files) >= MOST_MAPS:
                self.files.clear()
            self.files[name] = read(self._file(name))
        return self.files[name]

    def _table(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, counts of one byte, and places and counts of the large ones."""
        return self._kept(name, read_table)

    @staticmethod
    def _counts(table: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        _, counts, apart = table
        found = counts[at].astype(np.int64)
        large = found == 255
        if large.any():
            found[large] = apart[np.searchsorted(apart[:, 0], at[large].astype(np.uint64)), 1]
        return found

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: never seen) and training counts of distinct sorted hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for b, part in by_bucket(word_bucket(h, self.model.bits)):
            table = self._table(f"words-{b}")
            at, found = self._find(table[0], h[part])
            if found.any():
                ids[part[found]] = self.model.starts[b] + at[found]
                counts[part[found]] = self._counts(table, at[found])
        return ids, counts

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """The PAIR numbers of distinct sorted pairs."""
        counts = np.zeros((len(keys), PAIR), np.int64)
        for b, part in by_bucket(pair_bucket(keys, self.model.bits)):
            table = self._table(f"pairs-{b}")
            at, found = self._find(table[0], keys[part])
            if found.any():
                counts[part[found]] = self._counts(table, at[found, None] * PAIR + np.arange(PAIR))
        return counts

    def triples(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Training counts of triples."""
        counts = np.zeros(len(contexts), np.int64)
        keys = triple_hash(contexts, words)
        for b, part in by_bucket(triple_bucket(contexts, words, self.model.bits)):
            part = part[np.argsort(keys[part])]  # neighbours in the array are looked up one after another
            table = self._table(f"triples-{b}")
            at, found = self._find(table[0], keys[part])
            if found.any():
                counts[part[found]] = self._counts(table, at[found])
        return counts

    def around(self, ids: np.ndarray) -> np.ndarray:
        """The WORD numbers of words."""
        out, size = np.zeros((len(ids), WORD), np.int64), self.model.range_size
        for r, part in by_bucket(ids // size):
            table = self._kept(f"around-{r}", read_around)
            at = ids[part] - r * size
            inside = at < len(table)
            out[part[inside]] = table[at[inside]]
        return out


def kneser_ney_discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and more; where counts of counts are missing, a half of the count."""
    if min(n1, n2) <= 0:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([min(max(x, 0.0), max(k - 0.05, 0.0)) for k, x in enumerate(d)])


def train(rows: DataFrame, text_col: str = "text", buckets: int | None = None) -> TrigramModel:
    """Count the model over every row of the table; a null text is empty and still has its end token.

    buckets (a power of two is taken) follows from the bytes of text unless given, so that what one task
    merges stays the same however large the corpus is.
    """
    spark = rows.sparkSession
    ship(spark)
    texts = rows.select(F.col(text_col).alias("text"))
    wanted = buckets or -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_TEXT)
    bits = max(1, (wanted - 1).bit_length())
    place = new_path(spark, "trigrams")
    if place.startswith("/"):
        place = f"file://{place}"

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(lambda h: word_bucket(h, bits))
        for _, found in chunks(batches, 0):
            keys, counts = np.unique(hashes([w for t in found for w in t]), return_counts=True)
            yield from runs.add(keys, counts.astype(np.uint64))
        yield from runs.flush()

    def write_words(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        write_table(f"{place}/words-{bucket}", keys, counts)
        end = keys == np.uint64(xxhash.xxh3_64_intdigest(END))
        yield {"bucket": [bucket], "n": [len(keys)], "total": [int(counts.sum())], "ends": [int(counts[end].sum())]}

    with shuffles_released(spark):
        runs = texts.mapInArrow(tidy(count_words), RUN)
        made = merged(runs, 1 << bits, 1, write_words, "bucket long, n long, total long, ends long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for row in made:
        sizes[row.bucket] = row.n
    model = TrigramModel(
        place, bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sum(r.total for r in made), int(sizes.sum()), sum(r.ends for r in made)
    )
    if not model.train_tokens:
        return model
    if model.vocabulary + 2 > 1 << 32:
        raise ValueError("pairs are packed of two ids of 32 bits; the corpus has more different words")
    before_text = np.uint64((model.start + 1) << 32 | model.start)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, reader = Runs(lambda k: triple_bucket(k[:, 0], k[:, 1], bits)), model.reader()
        for _, found in chunks(batches, 0):
            batch = Batch(reader, found)
            context = batch.before(batch.pairs, before_text)
            word = batch.ids[batch.back].astype(np.uint64)
            yield from runs.add(np.column_stack([context, word]), np.ones(len(word), np.uint64))
        yield from runs.flush()

    def summary(level: int, bucket: int, counts: np.ndarray) -> tuple[int, bytes]:
        """Counts of the counts 1 to 4, and of all, as a run for a bucket of their own."""
        numbers = [np.count_nonzero(counts == k) for k in (1, 2, 3, 4)] + [len(counts)]
        return (1 << bits) + bucket % SUMMARIES, pack(np.array([level], np.uint64), np.array([numbers]))

    def write_triples(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        context, word = keys[:, 0], keys[:, 1]
        first = context == before_text
        pairs, follows = summed((context & LOW) << np.uint64(32) | word, np.where(first, counts, np.uint64(1)))
        context, word, counts = context[~first], word[~first], counts[~first]
        found = triple_hash(context, word)
        order = np.argsort(found)
        write_table(f"{place}/triples-{bucket}", found[order], counts[order])
        del found, order
        contexts, followed = summed(context, np.column_stack([counts, kinds(counts)]))
        sums = np.zeros((len(pairs) + len(contexts), PAIR), np.uint64)
        sums[: len(pairs), 0], sums[len(pairs) :, 1:] = follows, followed
        pairs, sums = summed(np.concatenate([pairs, contexts]), sums)
        for own, run in [*cut_runs(pair_bucket(pairs, bits), pairs, sums), summary(3, bucket, counts)]:
            yield {"bucket": pa.array([own], pa.int32()), "run": pa.array([run], pa.binary())}

    size = model.range_size

    def write_pairs(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        if bucket >= 1 << bits:  # sums of summaries
            yield {"bucket": pa.array([bucket], pa.int32()), "run": pa.array([pack(keys, counts)], pa.binary())}
            return
        write_table(f"{place}/pairs-{bucket}", keys, counts)
        follows = counts[:, 0]
        sums = np.zeros((2 * len(keys), WORD), np.uint64)
        sums[: len(keys), :3], sums[: len(keys), 3], sums[len(keys) :, 4] = kinds(follows), follows, 1
        ids, sums = summed(np.concatenate([keys >> np.uint64(32), keys & LOW]), sums)
        for own, run in [*cut_runs((ids // np.uint64(size)).astype(np.int64), ids, sums), summary(2, bucket, follows)]:
            yield {"bucket": pa.array([own], pa.int32()), "run": pa.array([run], pa.binary())}

    def write_words_around(bucket: int, ids: np.ndarray, sums: np.ndarray) -> Iterator[dict]:
        if bucket >= 1 << bits:
            for level, numbers in zip(ids.tolist(), sums.tolist(), strict=True):
                yield {"level": pa.array([level], pa.int64()), "seen": pa.array([numbers], pa.list_(pa.int64()))}
            return
        table = np.zeros((size, WORD), np.uint64)
        table[(ids - np.uint64(bucket * size)).astype(np.int64)] = sums
        write_file(f"{place}/around-{bucket}", table)
        follows = sums[:, 4][sums[:, 4] > 0]  # no word but the start mark follows none
        numbers = [np.count_nonzero(follows == k) for k in (1, 2, 3, 4)] + [len(follows)]
        yield {"level": pa.array([1], pa.int64()), "seen": pa.array([numbers], pa.list_(pa.int64()))}

    with shuffles_released(spark):
        triples = new_path(spark, "runs")
        add_runs(texts.mapInArrow(tidy(count_triples), RUN), triples)
        pairs = merged_parts(triples, texts, 1 << bits, 1, write_triples, 2)
        words = merged_parts(pairs, texts, 1 << bits, PAIR, write_pairs)
    runs = spark.read.schema(f"{RUN}, part int").parquet(words).drop("part")
    found = merged(runs, 1 << bits, WORD, write_words_around, "level long, seen array<long>")
    totals = {r.level: r[1:] for r in found.groupBy("level").agg(*[F.sum(F.col("seen")[k]) for k in range(5)]).collect()}
    model.triples, model.pairs = totals.get(3, [0] * 5)[4], totals[2][4]
    model.discounts, model.pair_discounts, model.word_discounts = (kneser_ney_discounts(*totals.get(k, [0] * 5)[:4]) for k in (3, 2, 1))
    once, twice = totals[1][:2]
    model.word_weight = float(model.word_discounts[1:] @ [once, twice, totals[1][4] - once - twice] / model.pairs)
    return model


class Batch:
    """Tokens of some texts: places of first tokens, and for every token the place of its word among the different ones.

    ids and counts are those of the different words, -1 and 0 for unknown ones; ids has the start mark's at its end.
    """

    def __init__(self, reader: Reader, texts: list[list[bytes]]):
        lengths = np.array([len(t) for t in texts])
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h, self.back = coded(texts)
        order = np.argsort(h)
        self.ids, self.counts = np.empty(len(h) + 1, np.int64), np.empty(len(h), np.int64)
        self.ids[order], self.counts[order] = reader.words(h[order])
        self.ids[-1] = reader.model.start
        self.prior = self.before(self.back, len(h))

    def before(self, x: np.ndarray, at_start: int) -> np.ndarray:
        """For every token the value of the token before it in its text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = at_start
        return out

    @property
    def pairs(self) -> np.ndarray:
        """Key of every token with the one before; of unknown words it means nothing."""
        ids = self.ids.astype(np.uint64)
        return (ids << np.uint64(32))[self.prior] | (ids & LOW)[self.back]


def score_tokens(reader: Reader, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and training count of every token."""
    model, batch = reader.model, Batch(reader, texts)
    ids, back, prior, counts = batch.ids, batch.back, batch.prior, batch.counts[batch.back]
    uniform = 1.0 / (model.vocabulary + 1)
    if not model.train_tokens:
        return np.full(len(back), np.log10(uniform)), counts
    known = ids >= 0
    # words: what is known of the different ones
    around = np.zeros((len(ids), WORD), np.int64)
    around[known] = reader.around(ids[known])
    p = (_discounted(around[:, 4], model.word_discounts) / model.pairs + model.word_weight * uniform)[back]
    # pairs, the last of the different ones is for those with an unknown word
    both = np.flatnonzero(known[back] & known[prior])
    keys = batch.pairs
    distinct, at = np.unique(keys[both], return_inverse=True)
    pair = np.full(len(back), len(distinct))
    pair[both] = at
    found = np.concatenate([reader.pairs(distinct), np.zeros((1, PAIR), np.int64)])
    together = found[:, 0][pair]
    p = _interpolated(p, together, around[:, 3][prior], (around[:, :3] @ model.pair_discounts[1:])[prior], model.pair_discounts)
    # triples: what is known of the pair before is known of the context
    context = batch.before(pair, len(distinct))
    total = found[:, 1][context]
    met = np.flatnonzero((total > 0) & (together > 0))
    together = np.zeros(len(back), np.int64)
    together[met] = reader.triples(keys[met - 1], ids[back[met]].astype(np.uint64))
    return np.log10(_interpolated(p, together, total, (found[:, 2:] @ model.discounts[1:])[context], model.discounts)), counts


def _discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.maximum(counts - discounts[np.minimum(counts, 3)], 0)


def _interpolated(p: np.ndarray, counts: np.ndarray, total: np.ndarray, weight: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """Probabilities with one more word of context, where the context was met; p are those with one less."""
    return np.where(total > 0, (_discounted(counts, discounts) + weight * p) / np.maximum(total, 1), p)


def score(docs: DataFrame, model: TrigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    score is the model's log10 probability of the whole text with its end token; base_score that of
    add-one smoothed words.  Null and empty texts have the end token alone.  Words that training never met
    share the mass that Kneser-Ney smoothing leaves to a uniform distribution.  A map over rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = own.reader()
        for batch, texts in chunks(batches, 1):
            lengths = np.array([len(t) for t in texts])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            logs, counts = score_tokens(reader, texts)
            base = np.log10((counts + 1) / (own.train_tokens + own.vocabulary + 1))
            total = np.add.reduceat(logs, starts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    "train_tokens": pa.array(np.full(len(texts), own.train_tokens, np.int64)),
                    "base_score": pa.array(np.add.reduceat(base, starts)),
                    "score": pa.array(total),
                    "perplexity": pa.array(10 ** np.minimum(-total / lengths, 300)),
                }
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run),
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )
