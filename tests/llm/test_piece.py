import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quern.llm import piece

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return piece.PieceAgenda(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_matches_the_library(pair):
    own, library = pair
    rng = random.Random(5)
    some = "the quick brown fox can't 12345 3.14 naïve Straße İstanbul 你好 🙂 é ﬁ ▁ ▁▁x \x00 \t \n \r\n \xa0 <s> </s> <unk> <0x41> ... !!! def f(x): return".split(" ")
    texts = ["", None, " ", "   ", "\n", "▁", " a", "a ", "a  b   c", "\n\n  x"] + [" ".join(rng.choice(some) for _ in range(20)) for _ in range(300)]
    texts += ["".join(rng.choice("etaoin shrdlu.,1é'AB\n") for _ in range(120)) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x2FF), rng.randrange(0x300, 0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(30)) for _ in range(500)]
    got = [x.tolist() for x in own.encode_batch(texts)]
    want = library.encode([t or "" for t in texts])
    assert got == want and own.corrected == 0 and own.merged
    assert [own.decode(x) for x in got] == library.decode(want)


def test_words_of_any_length(pair):
    own, library = pair
    rng = random.Random(6)
    for w in ["".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "a" * 20_000, "ab" * 5000, " " * 5000, "x" + " " * 1001 + "y", "the" * 300, "日" * 3000]:
        assert [x.tolist() for x in own.encode_batch([w])] == [library.encode(w)]
    assert own.corrected == 0 and not any(len(c) > piece.LONGEST_KNOWN for c in own.known)


def test_rows_of_agendas_and_heaps_agree(pair):
    """Chunks of every length up to beyond the widest matrix."""
    own, library = pair
    rng = random.Random(8)
    for n in range(2, 40):
        some = list({piece.SPACE * rng.randrange(2) + "".join(rng.choice("etaoinshrdluéßABC.,_日本") for _ in range(n)) for _ in range(60)})
        assert own.split(" ".join(some).replace(piece.SPACE, "")) is not None
        for w in piece.WIDTHS:
            fits = [c for c in some if len(c) <= w]
            symbols, counts = own.merge_many(fits, w)
            ends = np.cumsum(counts).tolist()
            made = [",".join(own.joined[x] for x in symbols[a:b].tolist()) for a, b in zip([0, *ends], ends)]
            assert made == [",".join(map(str, own.merge(c))) for c in fits]


def test_decodes_any_ids(pair):
    """Bytes that are no text, control and unknown ids among others."""
    own, library = pair
    rng = random.Random(7)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece, "MOST_CHUNKS", 3)
    own = piece.PieceAgenda(PATH)
    texts = ["one two three four", "two five", "one two six seven eight"] * 3
    assert list(own.encode_joined(texts)) == [next(own.encode_joined([t])) for t in texts]


def test_a_difference_is_corrected_and_counted(monkeypatch):
    monkeypatch.setattr(piece.PieceAgenda, "merge", lambda self, chunk: [5])
    monkeypatch.setattr(piece.PieceAgenda, "merge_many", lambda self, chunks, width: (np.zeros(len(chunks), int), np.ones(len(chunks), int)))
    own = piece.PieceAgenda(PATH)
    assert next(own.encode_batch(["hello world"])).tolist() == own.library.encode("hello world") and own.corrected == 2


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")  # a trainer of another type
    with pytest.raises(ValueError):
        piece.PieceAgenda(str(tmp_path / "m"))


def test_frames(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "long word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as n_tokens", "'k' as id")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = piece.digests(df, PATH).collect()
    assert len(out) == 6 and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    assert sorted(map(tuple, out), key=str) == sorted(((i, len(x := library.encode(t or "")), sha(",".join(map(str, x))), sha(library.decode(x))) for i, t in rows), key=str)
    both = piece.decode(piece.encode(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both) == sorted((str(i), library.encode(t or ""), t or "") for i, t in rows)
    assert piece.digests(df.limit(0), PATH).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in piece.digests(docs, PATH).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
