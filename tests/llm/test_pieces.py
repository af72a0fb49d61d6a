import random
from hashlib import sha256

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from covspark.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(1)
    fixed = [None, "", " ", "  ", " a ", "a  b", "a  ", "\n", "▁", "a▁b", "</s>", "<0x0A>", "😀 é\x00b", "日本語", "x" * 3000, "tab\t\tx", "⁇"]
    made = ["".join(rng.choice(" ▁a\nbé日😀th e</s>") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return fixed + made + made[:5]


def test_matches_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in pieces.encoded(df, PATH, with_ids=True).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == sp.decode(ids)
        assert got[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(sp.decode(ids).encode()).hexdigest()


def test_difference_fails():
    v = pieces.Vocabulary(PATH)
    v.scores = dict.fromkeys(v.scores, 0.0)
    with pytest.raises(ValueError, match="differ"):
        v.learn(["▁international", "▁understanding"])


def test_bytes_without_characters():
    v = pieces.Vocabulary(PATH)
    for raw in (b"\xff", b"\xc3", b"a\xe6\x97", b"\xf0\x9f\x98\x80\x80"):
        ids = [v.bytes[b] for b in raw]
        assert v.decode(ids) == v.library.decode(ids)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encoded(df, PATH).count() == 0
