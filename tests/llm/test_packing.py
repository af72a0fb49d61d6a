import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from covspark.llm import packing  # noqa: E402
from covspark.llm.bytebpe import ByteBpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "one two", " lead", "tail  ", "a\n b", "<|endoftext|> x", "word " * 900, "é日😀", "one two", "x" * 400]


def ids_of(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_stretches_give_the_library_ids():
    odd = [t for t in TEXTS] + ["\xa0 a", "\t b", "a\r\n  c", "　 x", "it's  we'll", "12 3.4 ...", "\x1c q", "\x85 q"]
    got = ByteBpe(PATH).encode(odd)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t) for t in odd]


def test_pack(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string, part int").repartition(3)
    tokens = packing.tokenized(df, PATH, 1)
    got = packing.pieces(tokens, 64).collect()
    docs = {}
    seqs = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        docs.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(range(len(TEXTS) * 4))
    for i, p in docs.items():
        flat = [x for _, ids, _ in sorted(p) for x in ids]
        assert flat == ids_of(TEXTS[i % len(TEXTS)]) + [1] and {n for *_, n in p} == {len(flat)}
        assert [s for s, *_ in sorted(p)] == np.cumsum([0] + [len(x) for _, x, _ in sorted(p)])[:-1].tolist()
    last = max(seqs)
    assert set(seqs) == set(range(last + 1))
    for s, p in seqs.items():
        assert [o for o, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist()
        assert sum(n for _, n in p) == 64 or s == last
    whole = packing.sequences(packing.pieces(tokens, 64), 1, 64).collect()
    assert len(whole) == last + 1 and {len(r.ids) for r in whole} == {256}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH).count() == 0
    assert packing.pack(df, PATH).withColumn("c", F.crc32("ids")).columns[-1] == "c" and zlib.crc32(b"") == 0
