import random
import re

from pyspark.sql import functions as F

from covspark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )
    return (*base, base[0] < 50 or 100 * base[4] > 50 * base[0])


TEXTS = [
    None,
    "",
    " \t\n",
    "a b c a b c",
    "a a a a",
    "x y z\nx y z\n\nq",
    "Ünï ## <b> $5 x\x0b y 12 é𝒳",
    "the of and " * 40,
    "one two three four " + "five six seven eight nine ten " * 3 + " ".join(f"w{i}" for i in range(60)),
]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "en", "n") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, m string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.assess(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_verdict(spark):
    rng = random.Random(5)
    own = "the of and to in a is that it for on was be with as by this are at from reading garden houses fields rivers".split()
    clean = [(i, " ".join(rng.choice(own) for _ in range(300)) + ".", "en") for i in range(30)]
    junk = [(100, " ".join(f"%%%{i}$$$ |||{i * 7}###" for i in range(300)), "en"), (101, " ".join(f"{i * 37 % 1009}" for i in range(400)), None)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.assess(df).collect()}
    assert all(kept[i] for i in range(30)) and not kept[100] and not kept[101]
    both = df.withColumn("n_words", F.lit("x"))
    out = quality.keep(both)
    assert out.columns == both.columns and {r.doc_id for r in out.collect()} == set(range(30))


def test_every_language_has_a_reference(spark):
    rng = random.Random(6)
    en = "the of and to in a is that it for on was be with as by reading garden houses fields".split()
    letters = {"ar": "ابتثجحخدذرزسش", "ko": "가나다라마바사아자", "pl": "abcdefghijklmnoprstuwz"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randint(4, 7)))
    docs = [(i, " ".join(rng.choice(en) for _ in range(250)), "en") for i in range(400)]
    # one document of a language, caseless scripts, and documents of fewer than 200 words
    docs += [(1000, " ".join(word("ar") for _ in range(250)), "ar"), (1001, " ".join(word("ko") for _ in range(300)), "ko")]
    docs += [(1002, " ".join(word("pl") for _ in range(250)), "pl"), (1003, " ".join(word("ko") for _ in range(150)), "zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.assess(df).collect()}
    assert len(rows) == len(docs) and all(r.kept for r in rows.values())
    assert all(rows[i].class_distance < 0.01 for i in (1000, 1001, 1002, 1003))
    assert quality.keep(df).count() == len(docs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.assess(df).count() == 0 and quality.keep(df).columns == df.columns
