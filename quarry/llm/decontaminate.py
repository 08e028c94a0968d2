"""Benchmark decontamination by latent semantic retrieval.

The benchmark's passages are weighted by TF-IDF with document frequencies counted over the whole corpus,
and a randomised SVD, its products summed over the rows in Spark, gives a latent space of lower rank than
there are passages.  Every overlapping window of every document is projected into it, and windows whose
cosine there with a benchmark passage reaches a threshold are candidates.  The threshold is found from the
benchmark and the corpus's document frequencies alone: nearly all of the worst paraphrases that the later
checks would accept, put among random words, must reach it.  A longest-common-subsequence check around the
window and a check for the passage's answer (its last sentence) then decide, so that copies with changed,
dropped or added words are caught as well as exact ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.scratch import ship
from quarry.llm.workers import tidy

#: Words by which windows advance; a window is two strides, the check around it four.
STRIDE = 32
#: A longer benchmark item is searched for in pieces of this many words, which begin at every so many words: a run of
#: LCS x PIECE words of the item lies, wherever it begins, within one piece or fills as much of one.
PIECE, PIECE_STRIDE = 64, 16
#: Rank of the latent space: RANK, or half the number of passages if that is less; up to SMALL passages need no lower one.
RANK, SMALL = 128, 16
#: Bytes of what a task holds to search; a benchmark that needs more is searched in several passes.
SEARCH_BYTES = 512 << 20
#: Paraphrases made to find the threshold, and the share of them that may fall below it.
PARAPHRASES, MISSED = 5000, 0.002
#: Windows compared with all passages at once hold so many numbers at most.
CELLS = 4_000_000
#: Share of a passage's words found in order, without and with its answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.75, 0.55, 0.8
#: An answer of fewer words says nothing; with one, so much of the passage's term weight must be there too.
ANSWER_WORDS, WEIGHT_WITH_ANSWER = 3, 0.5
POWER_ROUNDS = 2
CHARS = 400_000

#: What separates words beyond ASCII, and letters of scripts that put no blanks between words: each is a word.
_SEPARATES = re.compile(r"[^\w\x00-\x7f]")
_ALONE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TO_SPACE = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def tokens(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8; what is neither letter nor digit separates, ideographs and the like stand alone."""
    text = text.lower()
    if not text.isascii():
        text = _SEPARATES.sub(" ", text)
        if _ALONE.search(text):
            text = _ALONE.sub(r" \g<0> ", text)
    return text.encode().translate(_TO_SPACE).split()


def piece_starts(n: int) -> list[int]:
    """Where the pieces of an item of n words begin; the last one ends with the item."""
    return [*range(0, max(0, n - PIECE), PIECE_STRIDE), max(0, n - PIECE)]


class Passages:
    """The benchmark's passages: their terms, and what checks them.

    A piece of a longer item that doesn't hold its last sentence takes its own last words for the answer.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.item_ids: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.sequences: list[list[int]] = []
        self.answers: list[list[int]] = []
        for item_id, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in tokens(text)]
            last = [self.terms[w] for w in tokens(_SENTENCE.split(text.strip())[-1])]
            for s in piece_starts(len(ids)):
                piece = ids[s : s + PIECE]
                if piece:
                    self.item_ids.append(item_id)
                    self.sequences.append(piece)
                    self.answers.append(last if len(ids) <= PIECE else piece[-8:])


def document_frequencies(docs: DataFrame, text_col: str, terms: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term; one short array a partition is summed."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found, n = shared.value, Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                found.update(vocabulary.intersection(tokens(text.as_py() or "")))
        found[b""] = n
        yield pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "term binary, n long")
    df, total = np.zeros(len(terms)), 0
    for term, n in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if term:
            df[terms[bytes(term)]] = n
        else:
            total = n
    return total, df


def weights_of(total: int, df: np.ndarray) -> np.ndarray:
    """Squared inverse document frequency: a term in every document keeps next to nothing."""
    return np.maximum(np.log((total + 1) / (df + 0.5)), 0.05) ** 2


def randomised_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], terms: int, rank: int) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular vectors of the rows' matrix.

    Range finder with power rounds; each round sums A'(A X) over the rows in Spark.
    """
    rank = min(rank, len(rows), terms)
    table = spark.createDataFrame(rows, "term array<int>, weight array<double>").repartition(
        max(1, min(len(rows) // 64, spark.sparkContext.defaultParallelism))
    )

    def product(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(shared.value)
            for batch in batches:
                for term, weight in zip(batch.column(0), batch.column(1), strict=True):
                    at, w = np.array(term.as_py()), np.array(weight.as_py())
                    out[at] += np.outer(w, w @ shared.value[at])
            yield pa.RecordBatch.from_pydict({"part": [out.tobytes()]})

        total = np.zeros_like(x)
        for (part,) in table.mapInArrow(tidy(run), "part binary").toLocalIterator():
            total += np.frombuffer(part).reshape(x.shape)
        shared.destroy()
        return total

    x = np.random.default_rng(7).standard_normal((terms, min(terms, len(rows), rank + 8)))
    for _ in range(POWER_ROUNDS):
        x = np.linalg.qr(product(x))[0]
    inner = x.T @ product(x)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return x @ vectors[:, np.argsort(-values)[:rank]]


def lcs_length(masks: dict[int, int], size: int, sequence: list[int]) -> int:
    """Longest common subsequence by bit rows; masks has each term's places in the first sequence."""
    full = (1 << size) - 1
    row = full
    for term in sequence:
        mask = masks.get(term)
        if mask:
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def masks_of(sequence: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, t in enumerate(sequence):
        masks[t] = masks.get(t, 0) | 1 << i
    return masks


class Searcher:
    """Compares texts with passages."""

    def __init__(self, passages: Passages, weights: np.ndarray, basis: np.ndarray, chosen: range, cosine: float | None = None):
        self.terms, self.weights = passages.terms, weights
        self.item_ids, self.sequences, self.answers = (
            [x[p] for p in chosen] for x in (passages.item_ids, passages.sequences, passages.answers)
        )
        self.project = np.vstack([basis * weights[:, None], np.zeros(basis.shape[1])]).astype(np.float32)
        self.latent = np.array([self.place(s) for s in self.sequences], np.float32).T
        self.masks = [masks_of(s) for s in self.sequences]
        self.answer_masks = [masks_of(s) for s in self.answers]
        self.cosine = cosine

    def place(self, ids: list[int]) -> np.ndarray:
        """Where a sequence of terms lies in the latent space, at length 1 (0 if it has no weight)."""
        total = self.project[ids].sum(axis=0, dtype=np.float64)
        return total / max(np.linalg.norm(total), 1e-12)

    def paraphrase_cosines(self, df: np.ndarray, made: int) -> np.ndarray:
        """Cosines of passages with windows that hold their worst accepted paraphrase.

        Of a passage and its answer as many words stay as the checks need; the window is cut where a
        stride may cut it and filled with words drawn by their document frequency.
        """
        rng = np.random.default_rng(11)
        common, out = (df + 0.5) / (df + 0.5).sum(), []
        noise = rng.choice(len(df), 2 * STRIDE * made, p=common)
        for k in range(made):
            p = k % len(self.sequences)
            sequence = np.array(self.sequences[p])
            stay = rng.permutation(len(sequence))[: math.ceil(len(sequence) * LCS_WITH_ANSWER)]
            words = sequence[np.sort(stay)]
            begin = int(rng.integers(0, STRIDE))
            around = noise[2 * STRIDE * k : 2 * STRIDE * (k + 1)]
            window = np.concatenate([around[:begin], words, around[begin:]])[: 2 * STRIDE]
            out.append(float(self.place(window) @ self.latent[:, p]))
        return np.array(out)

    def ids(self, text: str | None) -> list[int]:
        get, unknown = self.terms.get, len(self.terms)
        return [get(w, unknown) for w in tokens(text or "")]

    def _has_answer(self, p: int, region: list[int]) -> bool:
        answer = self.answers[p]
        if len(answer) < ANSWER_WORDS:
            return False
        return lcs_length(self.answer_masks[p], len(answer), region) >= ANSWER * len(answer)

    def _weight_in(self, p: int, region: list[int]) -> float:
        """Share of the passage's term weight that the region's words hold."""
        terms = set(self.sequences[p])
        total = sum(self.weights[t] for t in terms)
        return sum(self.weights[t] for t in terms.intersection(region)) / total

    def search(self, texts: list[list[int]]) -> list[tuple[int, int, float, float, bool]]:
        """(text, passage, cosine, lcs share, answer found) of the passages that are in a text; the best place of each."""
        starts, sizes = [], []
        for t in texts:
            strides = -(-len(t) // STRIDE)
            starts.append(strides)
            sizes.append(len(t))
        joined = np.fromiter((x for t in texts for x in t), np.int64, sum(sizes))
        if not len(joined):
            return []
        # sums of every stride, strides never crossing texts
        text_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        stride_at = np.concatenate([a + np.arange(n) * STRIDE for a, n in zip(text_at, starts, strict=True)]).astype(int)
        owner = np.repeat(np.arange(len(texts)), starts)
        # terms outside the passages have no weight: only the others are projected
        known = joined != len(self.terms)
        kept = np.concatenate([[0], np.cumsum(known)])
        edges = kept[np.append(stride_at, len(joined))]
        inside = joined[known]
        n, rank = len(stride_at), self.project.shape[1]
        latent = np.zeros((n, rank), np.float32)
        full = np.flatnonzero(edges[1:] > edges[:-1])
        for i in range(0, len(full), 1024):
            part = full[i : i + 1024]
            own = inside[edges[part[0]] : edges[part[-1] + 1]]
            latent[part] = np.add.reduceat(self.project[own], edges[part] - edges[part[0]], axis=0)
        follows = np.append(owner[1:] == owner[:-1], False)
        latent[:-1][follows[:-1]] += latent[1:][follows[:-1]]
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        step = max(1, CELLS // len(self.sequences))
        for at, p, cosine in self._candidates(latent, step):
            t, masks, sequence = int(owner[at]), self.masks[p], self.sequences[p]
            begin = int(stride_at[at] - text_at[t])
            region = texts[t][max(0, begin - STRIDE) : begin + 3 * STRIDE]
            share = lcs_length(masks, len(sequence), region) / len(sequence)
            known_best = best.get((t, p))
            if share < LCS_WITH_ANSWER or (known_best and known_best[1] >= share):
                continue
            has = self._has_answer(p, region)
            if share >= LCS or (has and self._weight_in(p, region) >= WEIGHT_WITH_ANSWER):
                best[t, p] = (cosine, share, has)
        return [(t, p, *found) for (t, p), found in best.items()]

    def _candidates(self, latent: np.ndarray, step: int) -> Iterator[tuple[int, int, float]]:
        """(window, passage, cosine) of all at the threshold, so many windows at a time."""
        for i in range(0, len(latent), step):
            cosines = latent[i : i + step] @ self.latent
            at, p = np.nonzero(cosines >= self.cosine)
            yield from zip((at + i).tolist(), p.tolist(), cosines[at, p].tolist(), strict=True)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    cosine: float | None = None,
    rank: int = RANK,
) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, cosine, lcs_share, answer_found.

    Of an item's pieces and places in a document the one with the largest LCS share is reported.  Null and
    empty texts on either side match nothing; a repeated item is reported once, a repeated document in
    each of its rows; an empty table gives an empty result.  Other columns are ignored.  cosine is found from
    the benchmark unless given.  The benchmark is a query set: one latent space holds all of it, the corpus
    is read once for document frequencies and once for the search (again only where SEARCH_BYTES are passed),
    all windows of whole texts are searched, and nothing is shuffled but the term counts.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    passages = Passages([(r.i, r.t) for r in items.filter("t is not null").orderBy("i", "t").toLocalIterator()])
    if not passages.sequences:
        return out
    total, df = document_frequencies(docs, text_col, passages.terms)
    weights = weights_of(total, df)
    matrix = []
    for sequence in passages.sequences:
        counted = Counter(sequence)
        value = np.array([n * weights[t] for t, n in counted.items()])
        matrix.append((list(counted), (value / max(np.linalg.norm(value), 1e-12)).tolist()))
    basis = randomised_svd(spark, matrix, len(passages.terms), min(rank, max(SMALL, len(matrix) // 2)))
    everything = Searcher(passages, weights, basis, range(len(matrix)))
    if cosine is None:
        made = everything.paraphrase_cosines(df, PARAPHRASES)
        cosine = max(float(np.quantile(made, MISSED)), 0.05)
    # a passage is three lists of its words' numbers and their masks
    own = 4 * everything.project.size
    each = 4 * everything.latent.shape[0] + 600 * PIECE
    at_once = max(1, (SEARCH_BYTES - own) // each)
    for first in range(0, len(matrix), at_once):
        part = Searcher(passages, weights, basis, range(first, min(first + at_once, len(matrix))), cosine)
        out = out.unionByName(rows.mapInArrow(tidy(_search_with(spark.sparkContext.broadcast(part))), schema))
    return out


def _search_with(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                began, chars, texts = at, 0, []
                while at < batch.num_rows and chars < CHARS:
                    text = batch.column(1)[at].as_py()
                    chars += len(text or "") + 1
                    texts.append(searcher.ids(text))
                    at += 1
                best: dict[tuple[int, int], tuple] = {}
                for t, p, *found in searcher.search(texts):
                    key = (t, searcher.item_ids[p])
                    if key not in best or best[key][1] < found[1]:
                        best[key] = tuple(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([batch.column(0)[began + t].as_py() for t, _ in best], pa.int64()),
                        "item_id": pa.array([i for _, i in best], pa.int64()),
                        "cosine": pa.array([round(x[0], 4) for x in best.values()], pa.float64()),
                        "lcs_share": pa.array([round(x[1], 4) for x in best.values()], pa.float64()),
                        "answer_found": pa.array([x[2] for x in best.values()], pa.bool_()),
                    }
                )

    return run
