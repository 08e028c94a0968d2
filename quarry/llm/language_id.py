"""Language identification of mixed-language text.

Character features of each word give it one score per learned language; the word's script first narrows
the languages that may compete.  A Viterbi pass over the words with a penalty for each switch of language
labels spans, and the language with most letters in its spans is the document's.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import ship
from quarry.llm.workers import tidy

UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LETTER = regex.compile(r"\p{L}")

#: First code points of the Unicode blocks that tell scripts apart, in code point order.
_SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C60, "Latin"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3130, "Hangul"), (0x3400, "Han"), (0xA720, "Latin"), (0xAC00, "Hangul"),
    (0xF900, "Han"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF66, "Kana"), (0x20000, "Han"),
]
_STARTS = [x for x, _ in _SCRIPT_STARTS]
_SCRIPTS = [x for _, x in _SCRIPT_STARTS]

#: A language competes for words of a script that makes up at least this share of its training words.
SCRIPT_SHARE = 0.005
#: What a language loses on a word of a script that is not its own.
OUT_OF_SCRIPT = -50.0
#: Added to every relative frequency of a feature.
FLOOR = 1e-6
#: Distinct words a worker remembers between documents.
CACHED_WORDS = 250_000


def script_of(word: str) -> str:
    return _SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1]


def features(word: str) -> list[str]:
    """Pairs and triples of characters, with the word's ends marked."""
    p = f"\x02{word}\x03"
    return [p[i : i + 3] for i in range(len(p) - 2)] + [p[i : i + 2] for i in range(len(p) - 1)]


def fold(doc_id: Column, folds: int = 4, held: int = 2) -> Column:
    """Whether a document is held out: crc32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held


class LanguageModel:
    """Feature scores of each language: one row a feature of the sample, one float a language."""

    def __init__(self, counts: list[tuple[str, str, int]], languages: list[str]):
        self.languages = languages
        at = {x: i for i, x in enumerate(languages)}
        names = sorted({f for _, f, _ in counts if f[0] != "\x00"})
        self.row_of = {f: i for i, f in enumerate(names)}
        table = np.zeros((len(names) + 1, len(languages)))
        scripts: dict[str, np.ndarray] = {}
        for lang, feature, n in counts:
            if feature[0] == "\x00":
                scripts.setdefault(feature[1:], np.zeros(len(languages)))[at[lang]] = n
            else:
                table[self.row_of[feature], at[lang]] = n
        total = np.maximum(table.sum(axis=0), 1)
        self.table = np.log(table / total + FLOOR)  # the last row, for unseen features, favours no language
        words = np.maximum(sum(scripts.values(), np.zeros(len(languages))), 1)
        self.out_of_script = {}
        for script, n in scripts.items():
            own = n / words >= SCRIPT_SHARE
            if own.any():
                self.out_of_script[script] = np.where(own, 0.0, OUT_OF_SCRIPT)

    def score_word(self, word: str) -> np.ndarray:
        get, unseen = self.row_of.get, len(self.row_of)
        score = self.table[[get(f, unseen) for f in features(word)]].sum(axis=0)
        narrowed = self.out_of_script.get(script_of(word))
        return score if narrowed is None else score + narrowed


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every row when each change of label costs penalty; of equal paths, fewest changes."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # no path beats the constant one if no stretch gains more than its switch, nor a first and a last one together
    gain = np.vstack([np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, best : best + 1], axis=0)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty and (
        gain.max() + (gain[-1] - gain.min(axis=0)).max() <= penalty
    ):
        return np.full(len(scores), best)
    rows, n = scores.tolist(), scores.shape[1]
    value, came = rows[0], []
    for row in rows[1:]:
        top = max(value)
        top_at, least = value.index(top), top - penalty
        came.append([top_at if v < least else i for i, v in enumerate(value)])
        value = [(v if v >= least else least) + s for v, s in zip(value, row, strict=True)]
    label = max(range(n), key=value.__getitem__)
    path = [label]
    for back in reversed(came):
        label = back[label]
        path.append(label)
    return np.array(path[::-1])


class Labeller:
    """Labels whole texts with one model; remembers the scores of words it has met."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))

    def _score(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHED_WORDS:
            self._clear()
        place = self.place
        for w in set(words).difference(place):
            if len(place) == len(self.scores):
                self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            self.scores[len(place)] = self.model.score_word(w)
            place[w] = len(place)
        return self.scores[[place[w] for w in words]]

    def label(self, text: str | None, with_spans: bool = True) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score in 0..1, and spans (start, end, language) in code points, end exclusive.

        The score is the share of letters in the language's spans times its posterior over the whole text.
        """
        if not text or not self.model.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, []
        words = _WORD.findall(text.lower())
        scores = self._score(words)
        path = viterbi(scores, self.penalty)
        if (path == path[0]).all():
            label, share = int(path[0]), 1.0
        else:
            letters = np.bincount(path, [len(w) for w in words], len(self.model.languages))
            label = int(letters.argmax())
            share = letters[label] / letters.sum()
        total = scores.sum(axis=0)
        posterior = 1.0 / np.exp(np.clip(total - total[label], -700, 700)).sum()
        spans: list[tuple[int, int, str]] = []
        if with_spans:
            # lower-casing may change lengths, so places come from the text itself
            for (start, end), at in zip((m.span() for m in _WORD.finditer(text)), path, strict=False):
                lang = self.model.languages[at]
                if spans and spans[-1][2] == lang:
                    spans[-1] = (spans[-1][0], end, lang)
                else:
                    spans.append((start, end, lang))
        return self.model.languages[label], float(share * posterior), spans


def learn(rows: DataFrame, text_col: str, lang_col: str, docs_per_language: int = 3000) -> LanguageModel:
    """Fit on a bounded sample: about docs_per_language rows of each language, drawn by a hash of the text.

    Rows with a null text or language teach nothing.  All features of the sample are kept; the sample holds
    the model's size whatever the corpus.
    """
    ship(rows.sparkSession)
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], [])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_language / n))])
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                own = found.setdefault(lang.as_py(), Counter())
                for word, n in Counter(_WORD.findall(text.as_py().lower())).items():
                    own["\x00" + script_of(word)] += n
                    for f in features(word):
                        own[f] += n
        out = [(lang, f, n) for lang, own in found.items() for f, n in own.items()]
        for i in range(0, len(out), 50_000):
            part = out[i : i + 50_000]
            yield pa.RecordBatch.from_pydict(
                {"lang": [x[0] for x in part], "feature": [x[1] for x in part], "n": [x[2] for x in part]}
            )

    counted = drawn.mapInArrow(tidy(count), "lang string, feature string, n long")
    counted = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    return LanguageModel([tuple(r) for r in counted.collect()], sorted(sizes))


def language_id(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    penalty: float = 15.0,
    with_spans: bool = True,
    whole_rows: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score and, with_spans, spans.

    lang_pred is a learned language, or ``und`` if the text is null or has no letter (or nothing was
    learned); its score is then 0.  Of languages that tie, the first in alphabetical order wins.  Texts are
    labelled whole, whatever their length.  With whole_rows all input columns are returned instead of the
    id; input columns named like a result are replaced.  Repeated rows and empty tables need no care: the
    operator is a map over rows, without a shuffle.
    """
    ship(docs.sparkSession)
    new = "lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if with_spans else "")
    taken = {"lang_pred", "score", *(["spans"] if with_spans else [])}
    if whole_rows:
        rows = docs.select(F.col(text_col).alias("0text"), *[F.col(f"`{c}`") for c in docs.columns if c not in taken])
    else:
        rows = docs.select(F.col(text_col).alias("0text"), F.col(id_col).cast("long").alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            found = [labeller.label(x.as_py(), with_spans) for x in batch.column(0)]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i}
            columns["lang_pred"] = pa.array([x[0] for x in found], pa.string())
            columns["score"] = pa.array([x[1] for x in found], pa.float64())
            if with_spans:
                spans = [[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x[2]] for x in found]
                columns["spans"] = pa.array(spans, span_type)
            yield pa.RecordBatch.from_pydict(columns)

    from pyspark.sql.types import StructType

    schema = StructType(rows.schema.fields[1:] + StructType.fromDDL(new).fields)
    return rows.mapInArrow(tidy(run), schema)
