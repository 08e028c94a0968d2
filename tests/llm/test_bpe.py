import hashlib
import random

from tokenizers import Tokenizer

from quarry.llm.bpe import PrefixBPE, bpe_encode
from quarry.llm.queries import vocabulary

POOL = "abcdeéèß ’'sStTrRmMlLdD0123½²  \t\n—中文あ한😀İıΣςσǅﬁ́\x85\x1c​\x00!?#$%&<|>"


def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts_agree_with_the_library():
    mine, lib, rng = PrefixBPE(vocabulary()), library(), random.Random(3)
    for k in range(4000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 40)))
        if k % 7 == 0:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>"]) + text
        ids = lib.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_words_of_random_letters_agree_with_the_library():
    mine, lib, rng = PrefixBPE(vocabulary()), library(), random.Random(4)
    for _ in range(500):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 60)))
        assert mine.encode(word) == lib.encode(word, add_special_tokens=False).ids


def test_operator(spark, docs, hard, empty):
    lib = library()
    for table in (docs, hard):
        out = bpe_encode(table, vocabulary()).collect()
        texts = [r.text or "" for r in table.collect()]
        assert len(out) == len(texts)
        expected = sorted(
            (len(e.ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e.ids)).hexdigest(),
             hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
            for e in lib.encode_batch(texts, add_special_tokens=False)
        )
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == expected
    assert bpe_encode(empty, vocabulary()).count() == 0


def test_a_small_memory_changes_nothing():
    lib, rng = library(), random.Random(5)
    mine = PrefixBPE(vocabulary())
    mine._ids.most = mine._compatible.most = 3
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(12))
        assert mine.encode(text) == lib.encode(text, add_special_tokens=False).ids
        assert len(mine._ids) + len(mine._ids.old) <= 6
