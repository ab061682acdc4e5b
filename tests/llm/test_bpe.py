import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from riskmill.llm import bpe
from riskmill.llm.shared import WordCache

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "  two  spaces ", "tab\tand\nline", "don't we'll 's", "ß中文😀é́", "\xa0\x85\x1c", "1²Ⅷ٣",
    "<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "x" * 5000, " " * 3000 + "x", "=-" * 2000, "\x00​", "क्ष",
    "word, word. word! (word)",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(library):
    own = bpe.codec(bpe.vocabulary(PATH))
    draw = random.Random(3)
    alphabet = [*ODD[1:13], "the", "ing", "tion", " ", " ", "'", ".", "b", "\n"]
    texts = ODD + ["".join(draw.choice(alphabet[:4] + alphabet[4:]) for _ in range(draw.randint(0, 25)))
                   for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    own = bpe.codec(bpe.vocabulary(PATH))
    for number, name in enumerate(own.names):
        pair = own.parts[number]
        assert number < 256 or own._compatible(*pair) is False
        assert own.decode_bytes([own.out[number]]) == name.encode("latin-1")


def test_broken_bytes_decode_as_in_the_library(library):
    own = bpe.codec(bpe.vocabulary(PATH))
    draw = random.Random(5)
    for _ in range(300):
        ids = [draw.randrange(0, 300) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(i, t, "x", "y", 1.5) for i, t in enumerate([*ODD, None, "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string, score double")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    encoded = bpe.encode_documents(docs, PATH)
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded, PATH).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[i] == (text or "")
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_pieces_encoded_together_equal_the_library(library):
    """Slices of random texts, so that many pieces are new at once: short and long, odd spaces, marks, other scripts."""
    own, draw = bpe.Codec(bpe.vocabulary(PATH)), random.Random(11)
    syllables = ["th", "in", "er", "an", "re", "on", "é", "ß", "日本", "😀", "ing", "tion", "'s", "1", "\n", "  ", "\x00", "Ä", "<"]
    slices = [
        [" ".join("".join(draw.choices(syllables, k=draw.randint(1, 9))) for _ in range(draw.randint(0, 60)))
         for _ in range(40)] + ["a" * 300, "xyz" * 40 + " " + "é" * 33, "", " ", "<|endoftext|> x", " a  b "]
        for _ in range(6)
    ]
    for texts in slices:
        for ids, text in zip(own.encode_many(texts), texts, strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_pair_table_equals_single_answers():
    own, draw = bpe.Codec(bpe.vocabulary(PATH)), random.Random(3)
    n = len(own.parts)
    left = np.array([draw.choice((draw.randrange(256), draw.randrange(n))) for _ in range(3000)])
    right = np.array([draw.choice((draw.randrange(256), draw.randrange(n))) for _ in range(3000)])
    wanted = [own._compatible(int(a), int(b)) for a, b in zip(left, right, strict=True)]
    assert own._compatible_all(left, right).tolist() == wanted
    for _ in range(2):
        assert own._fits_all(left, right).tolist() == wanted


class Counted(WordCache):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_a_repeated_word_is_looked_up_once_in_a_slice(library):
    own = bpe.Codec(bpe.vocabulary(PATH))
    own.words = Counted(own._word)
    texts = ["start " + "some words, (again) and again " * 50 + "end"] * 20
    for ids, text in zip(own.encode_many(texts), texts, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < own.words.asked <= 3 * len({w for t in texts for w in t.split(" ")})


def test_caches_that_turn_over(library):
    own, draw = bpe.Codec(bpe.vocabulary(PATH), cached=8), random.Random(17)
    words = [*ODD, "known", "known,", "x1", "naïve!", "l'été", "e.\nThe", "日本語" * 30, "Donaudampfschifffahrtsgesellschaft", "q" * 63]
    for _ in range(40):
        texts = [" ".join(draw.choices(words, k=draw.randint(0, 6))) for _ in range(5)]
        for ids, text in zip(own.encode_many(texts), texts, strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.encode_many([]) == [] and [len(r) for r in own.encode_many(["", ""])] == [0, 0]


def test_arrow_finds_every_odd_space():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = pa.array([f"a {c}b" for c in every] + ["a ", "a"])
    found = pc.match_substring_regex(texts, bpe.MAYBE_ODD).to_pylist()
    assert all(found[i] for i, c in enumerate(every) if bpe.ODD_SPACE.search(f"a {c}b"))
    assert found[-2:] == [True, False] and not any(found[i] for i, c in enumerate(every) if c.isalnum())
