import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from covspark.llm import runs
from covspark.llm.queries import QUERIES

SPACE = r"[^\x20\x09-\x0D]+"


def brute(words, length=6, exponent=4):
    """Every stretch that no word extends, with its smallest period, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return list(words)
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(lines):
    return hashlib.sha256(lines.encode()).hexdigest()


def expected(doc_id, text):
    words = re.findall(SPACE, text or "")
    if doc_id is not None:
        words = planted(words, doc_id)
    found = brute(words)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    top = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2])) if found else (None,) * 3
    milli = 1000 * top[1] // top[2] if found else None
    return (
        doc_id, len(found), *top, milli, digest("".join(f"{a},{m},{q}\n" for a, m, q in found)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words),
    )


def codes_of(texts):
    words, starts = [], [0]
    for t in texts:
        words += t
        starts.append(len(words))
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array([names[w] for w in words], np.int64), np.array(starts)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_like_the_definition(letters):
    r = random.Random(letters)
    texts = []
    for _ in range(250):
        t = [r.choice("abcdefg"[:letters]) for _ in range(r.randrange(0, 50))]
        for _ in range(r.randrange(3)):
            unit = [r.choice("abcdefg"[:letters]) for _ in range(r.randrange(1, 6))]
            at = r.randrange(len(t) + 1)
            t[at:at] = (unit * 9)[: r.randrange(1, 9 * len(unit) + 1)]
        texts.append(t)
    codes, starts = codes_of(texts)
    for s in (runs.Settings(), runs.Settings(length=4, exponent=2), runs.Settings(length=10, exponent=3)):
        found = runs.find(codes, starts, s)
        for i, t in enumerate(texts):
            assert found.get(i, []) == brute(t, s.length, s.exponent), (t, s)


def test_suffix_agreements():
    codes, starts = codes_of(["abab", "ab", "", "bbbb"])
    order, agree = runs.suffixes(codes, starts)
    text = lambda p: codes[p : starts[np.searchsorted(starts, p, side="right")]].tolist()
    for i in range(1, len(order)):
        one, two = text(order[i - 1]), text(order[i])
        same = np.searchsorted(starts, order[i - 1], side="right") == np.searchsorted(starts, order[i], side="right")
        n = next((j for j, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
        assert agree[i] == (n if same else 0)


def test_words_are_split_at_ascii_white_space_only():
    import pyarrow as pa

    texts = [" a\tb\n\nc\x0bd\x0ce\r ", "x y  z\x1fq\x85", "", None, "   ", "é 漢字  \U0001f600"]
    words, starts = runs.words_of(pa.array(texts))
    for i, t in enumerate(texts):
        assert words.to_pylist()[starts[i] : starts[i + 1]] == re.findall(SPACE, t or "")
    words, starts = runs.words_of(pa.array(texts).slice(1, 3))
    assert words.to_pylist() == re.findall(SPACE, texts[1]) and starts.tolist()[0] == 0


def test_query_like_brute_force(spark, root):
    r = random.Random(7)
    docs = [(None, "a b " * 20, "x"), (0, None, "x"), (1, "", "x"), (2, " \n\t", "x"), (3, "one", None), (4, "w " * 30, "x"), (4, "w " * 30, "x")]
    hits = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    for i in [*hits, *range(5000, 5040)]:
        n = r.choice([1, 2, 5, 30, 200])
        docs.append((i, "\n ".join(r.choice(["a", "b", "wörter", "d e", "longer"]) for _ in range(n)) + " ", "x"))
    docs.append((9001, "p q r s t u v " * 4000, "x"))  # very long, one run
    frame = spark.createDataFrame(docs, "doc_id long, text string, number string").repartition(3)
    frame.write.parquet(f"{root}/documents.parquet")
    got = sorted((tuple(x) for x in QUERIES["op12_periodic_runs"](spark, root).collect()), key=str)
    want = [expected(i, t) for i, t, _ in docs[:-1]]
    top = (0, 28000, 7)
    lines = digest("".join(f"{a},{m},{q}\n" for a, m, q in [top]))
    want.append((9001, 1, *top, 4000000, lines, digest("p q r s t u v"), 28000))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, best string, runs int")
    assert runs.digests(frame).count() == 0


def test_slices_hold_every_row_once():
    sizes = np.array([5, 1, 1, 9, 30, 0, 2, 3])
    parts = list(runs.slices(sizes, 10))
    assert [i for a, n in parts for i in range(a, a + n)] == list(range(8))
    assert all(sizes[a : a + n].sum() <= 10 or n == 1 for a, n in parts)
    assert list(runs.slices(np.zeros(0, int), 10)) == []
