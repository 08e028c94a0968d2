"""BPE encoding and decoding with a word-end vocabulary.

The encoder never replays merges.  For every prefix of a word it stores the one token that ends the
prefix's encoding: an automaton over the vocabulary names all tokens that are suffixes of the prefix, and
the right one is the token that may stand after the last token of the shorter prefix (pair
compatibility).  Following the stored tokens back from the end of the word gives the exact ids.

Compatibility of neighbours decides validity: BPE keeps a boundary exactly if no merge fires across it at
any time while both sides are still being built.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import ship
from quarry.llm.workers import tidy

#: The last symbol of a word is its character moved up by this much: a symbol of its own, as in the vocabulary.
END = 0x8000
NEVER = 1 << 60

#: Words of up to CACHED_LENGTH characters are remembered, at most 2 * CACHED_WORDS of them a worker.
CACHED_LENGTH, CACHED_WORDS = 64, 80_000
#: Pairs of tokens whose compatibility a worker remembers: 2 * KNOWN_PAIRS at most.
KNOWN_PAIRS = 60_000

#: Below this code point NFC changes nothing and lower-casing is the same in all Unicode versions.
SIMPLE_BELOW = 0x250
_NOT_SIMPLE = regex.compile(f"[^\\x00-{chr(SIMPLE_BELOW - 1)}]")
#: The word pattern of the vocabulary's pre-tokenizer; \s is spelt out for simple text.
_WORDS_SIMPLE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBPE:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._bytes = byte_alphabet()
        self._table = {b: c for b, c in self._bytes.items()}

        symbols: dict[int, str] = {}
        for c in self._bytes.values():
            symbols[self.vocab[c]] = c
            symbols[self.vocab[c + suffix]] = chr(ord(c) + END)
        self._rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}  # token: rank and halves
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            l, r, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self._rank.setdefault((l, r), rank)
            if whole not in symbols and l in symbols and r in symbols:
                symbols[whole] = symbols[l] + symbols[r]
                made[whole] = (rank, l, r)
        # the pieces at each side's edge, from single symbol to whole token, each followed by the rank that used it up
        self._right_edge: dict[int, tuple[int, ...]] = {}
        self._left_edge: dict[int, tuple[int, ...]] = {}
        for token in symbols:
            if token not in made:
                self._right_edge[token] = self._left_edge[token] = (token, NEVER)
        self._compatible = _Remembered(lambda pair: self._holds(pair >> 32, pair & 0xFFFFFFFF), KNOWN_PAIRS)
        automaton = ahocorasick.Automaton()
        for token in sorted(made, key=lambda t: made[t][0]):
            rank, l, r = made[token]
            for edges, part in ((self._right_edge, r), (self._left_edge, l)):
                edges[token] = (*edges[part][:-1], rank, token, NEVER)
        whole_ok = {t: True for t in symbols if t not in made}
        for token in sorted(made, key=lambda t: made[t][0]):
            rank, l, r = made[token]
            whole_ok[token] = whole_ok[l] and whole_ok[r] and self._holds(l, r, rank)
        for token, text in symbols.items():
            if whole_ok[token]:  # a token that BPE itself never makes can't end a prefix
                automaton.add_word(text, (len(text), token))
        automaton.make_automaton()
        self._automaton = automaton
        self._ids = _Remembered(self._word_ids, CACHED_WORDS)
        self._slow = None
        self._path = path

    def _holds(self, l: int, r: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank under ``before`` fires across the boundary of tokens l and r."""
        left, right, i, j = self._right_edge[l], self._left_edge[r], 0, 0
        while True:
            a_ends, b_ends = left[i + 1], right[j + 1]
            rank = self._rank.get((left[i], right[j]))
            # of merges with one rank the leftmost goes first: it beats the right token's own, not the left one's
            if rank is not None and rank < before and rank < a_ends and rank <= b_ends:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 2
            else:
                j += 2

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one word given as symbols, its last one already marked."""
        n = len(word)
        last, came_from = [0] * (n + 1), [-1] * (n + 1)
        came_from[0] = 0
        fits = self._compatible
        for end, (length, token) in self._automaton.iter(word):
            at = end + 1
            if came_from[at] >= 0:
                continue  # the one token is found; longer matches come first
            start = at - length
            if start == 0 or (came_from[start] >= 0 and fits[last[start] << 32 | token]):
                last[at], came_from[at] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = came_from[at]
        return ids[::-1]

    def _word_ids(self, word: str) -> bytes:
        symbols = word.encode().decode("latin-1").translate(self._table)
        ids = self.encode_symbols(symbols[:-1] + chr(ord(symbols[-1]) + END))
        return array("I", ids).tobytes()

    def words(self, text: str) -> list[str]:
        """Words of one stretch without special tokens, after the vocabulary's normaliser."""
        if not _NOT_SIMPLE.search(text):
            return _WORDS_SIMPLE.findall(text.lower())
        if self._slow is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self._path)
            back = {c: b for b, c in self._bytes.items()}
            self._slow = lambda x: [
                bytes([back[c] for c in w]).decode()
                for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(x))
            ]
        return self._slow(text)

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self._ids.__getitem__
        if "<|" not in text:
            return b"".join(map(known, self.words(text)))
        parts = []
        for part in self._split_special.split(text):
            if part in self.special:
                parts.append(self.special[part].to_bytes(4, "little"))
            elif part:
                parts += map(known, self.words(part))
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_packed(self, packed: bytes) -> str:
        """The decoded text of ids as encode_packed() gives them."""
        return " ".join(map(self.token_of.__getitem__, array("I", packed)))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the library does for a vocabulary without a decoder."""
        return " ".join([self.token_of[i] for i in ids if i in self.token_of])


class _Remembered(dict):
    """A memory of two generations, so that its size never follows the corpus and what recurs stays.

    Values made are young.  When ``most`` are young, they become the old ones and the old ones are
    forgotten, but for those asked for again since: these are young by then.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > CACHED_LENGTH:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_loaded: dict[str, PrefixBPE] = {}


def load(path: str) -> PrefixBPE:
    if path not in _loaded:
        _loaded[path] = PrefixBPE(path)
    return _loaded[path]


def bpe_encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_output, ids and decoded.

    Null and empty texts have no tokens and decode to the empty text.  Texts of any length are encoded
    whole.  Special-token strings inside a text become their ids, as in the library.  Repeated rows give
    repeated results, an empty input an empty result; other columns are ignored.  A map over rows: no
    shuffle, and nothing beyond one batch and the bounded word memory is held.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_output:
        schema += ", ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = [bpe.encode_packed(text.as_py()) for text in batch.column(1)]
            decoded = list(map(bpe.decode_packed, ids))
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
            if with_output:
                columns |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
