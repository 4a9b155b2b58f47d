import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return bpe.SpeculativeBPE(PATH), t


def test_matches_the_library(pair):
    own, library = pair
    rng = random.Random(2)
    some = "Don't I'll <|endoftext|> naïve Straße İstanbul ΣΑΣ 12345 á ﬁ 你好 🙂 \x1c \x85 \xa0 ... !!! 's 'S hyphen-ated <|startoftext|> supercalifragilistic".split(" ")
    texts = ["", None, " ", "\n"] + [" ".join(rng.choice(some) for _ in range(15)) for _ in range(200)]
    texts += ["".join(rng.choice("etaoin shrdlu.,1é'AB") for _ in range(80)) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2FF), rng.randrange(0x300, 0x3000)])) for _ in range(30)) for _ in range(300)]
    got = list(own.encode_batch(texts))
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert 0 < own.merged < own.speculated


def test_words_of_any_length(pair):
    """One word of 200,000 letters, and random ones around the length from which a heap merges."""
    own, library = pair
    rng = random.Random(3)
    letters = "etaoinshrdluéß"
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (200_000, 1, 30, 60, 63, 64, 65, 70, 100, 500)]
    words += ["a" * 5000, "ab" * 3000, "aaab" * 100, "the" * 400]
    for w in words:
        want = library.encode(w, add_special_tokens=False).ids
        assert list(own.encode_batch([w])) == [want]
        assert own.merge(w) == want or len(own.split(w)) > 1
    assert not any(len(w) > bpe.LONGEST_KNOWN for w in own.known)


def test_merging_looks_only_at_pairs_beside_a_merge(pair):
    own, library = bpe.SpeculativeBPE(PATH), pair[1]
    asked = []

    class Ranks(dict):
        def get(self, *key):
            asked.append(key)
            return super().get(*key)

    own.rank = Ranks(own.rank)
    rng = random.Random(5)
    for w in ["aaab" * 12, "ab" * 20, *("".join(rng.choice("etaoinshrdlu") for _ in range(50)) for _ in range(50))]:
        asked.clear()
        assert own.merge(w) == library.encode(w, add_special_tokens=False).ids
        assert len(asked) <= 3 * len(w)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    own = bpe.SpeculativeBPE(PATH)
    texts = ["one two three four", "two five", "one two six seven eight"] * 3
    assert list(own.encode_batch(texts)) == [next(own.encode_batch([t])) for t in texts]


def test_frames(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "long word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as n_tokens", "'k' as id")
    out = bpe.digests(df, PATH).collect()
    assert len(out) == 6 and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0} and [r.n_tokens for r in out if r.doc_id == 4] == [100_000]
    assert {r.ids_sha256 for r in out if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    encoded = bpe.encode(df, PATH, decoded=True)
    again = bpe.decode(encoded.drop("decoded"), PATH).collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in encoded.collect()} == {(r.doc_id, tuple(r.ids), r.decoded) for r in again}
    assert bpe.digests(df.limit(0), PATH).count() == 0
