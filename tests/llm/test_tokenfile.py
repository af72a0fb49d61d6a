import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from covspark.llm import rangecoder, tokenfile  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 15, 63, 64, 65, 200, 1000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.zeros(n, int), rng.integers(0, 65536, n), np.tile([7, 50256, 3], n)[:n], np.full(n, 65535), rng.zipf(1.5, n) % 50257):
        payloads, crcs = rangecoder.encode(ids, block=64)
        assert len(payloads) == -(-n // 64)
        assert (rangecoder.decode(payloads, crcs, n, block=64) == ids).all()
        k = len(payloads) // 2  # each block stands alone
        own = ids[64 * k : 64 * (k + 1)]
        assert (rangecoder.decode([payloads[k]], [crcs[k]], len(own), block=64) == own).all()


def test_learns_repetition():
    ids = np.tile(np.arange(1000, 1050), 20)
    assert sum(map(len, rangecoder.encode(ids)[0])) < len(ids) / 2


def test_damage_and_bounds():
    payloads, crcs = rangecoder.encode(np.arange(300))
    broken = bytes([payloads[0][0] ^ 255]) + payloads[0][1:]
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode([broken], crcs, 300)
    with pytest.raises(ValueError, match="65536"):
        rangecoder.encode(np.array([70000]))
    assert rangecoder.encode(np.array([], int)) == ([], [])


def test_files(spark, root):
    texts = [None, "", "one two", "a  b\n c", "word " * 500, "é日😀", "one two", "zz " * 60]
    rows = [(i, t, "x") for i, t in zip([5, 3, 9, 1, 7, 2, 2, None], texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    tokenfile.write(df, f"{root}/t", PATH, 2, segment=300)
    lib = tokenizers.Tokenizer.from_file(PATH)
    wanted, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.append((i, at, len(ids), ids))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfile.read(spark, f"{root}/t").collect()]
    assert sorted(got, key=lambda r: r[1]) == wanted


def test_empty(spark, root):
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), f"{root}/e", PATH)
    assert tokenfile.read(spark, f"{root}/e").count() == 0
