"""Quality rules: how far a document's characters and common words are from its language's.

Built-in functions only. Each text is measured once: counts of the base rules, a histogram of
character classes and one of common words. The measurements are written to the shared folder;
their sums by language, over every document that passes the base rules, are the references, so
every language of such a document has one. A document's verdict is the Jensen-Shannon distance
(base 2, so 0 to 1) of its two histograms to the reference of its language, or to the nearest
reference where its language is null. A histogram with too few words or characters is not judged.

Defined results: a null or empty text has no words and fails the base rules. Documents of
a null language use the nearest reference; without any reference only the base rules count.
Repeated rows are measured each by itself. Long texts need time in proportion to n log n. Two
three-word windows count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.llm.common import fresh, written

#: Common words of four languages; in others all words are one bin.
COMMON = {
    "en": "the of and to in a is that it for on was be with as by this are at from an or not but have he you they",
    "de": "der die und das den von zu mit dem des ist nicht ein eine auf für im sich als auch an es bei aus er sie wir werden",
    "fr": "de la le les et des en un du une que est dans qui pour par au sur pas plus ne ce il sont avec se ou aux",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha me",
}
WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")
SYMBOLS = "[#*$%&|<>]"
SPACES = " \\t-\\r"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the base rules, of the length from which a histogram is judged, and of the distances."""

    min_words: int = 50
    repeat_percent: int = 50
    min_chars: int = 400
    min_common: int = 200
    max_class_distance: float = 0.28
    max_word_distance: float = 0.30


def measured(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The frame with all measurements of ``text`` in one struct column ``name``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    no = F.lit(False)
    names = {x: fresh(docs, f"_{x}") for x in ("words", "tokens", "lines", "low", "windows", "common", "repeats", "ends")}
    words, tokens, lines, low, windows, common, repeats, ends = map(F.col, names.values())
    # the steps are separate projections, so that each array is made once
    split = docs.select(
        "*",
        F.filter(F.split(raw, f"[{SPACES}]+"), lambda w: w != "").alias(names["words"]),
        F.filter(F.split(F.lower(raw), "[^\\p{L}]+"), lambda w: w != "").alias(names["tokens"]),
        F.filter(F.split(raw, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias(names["lines"]),
        F.regexp_replace(raw, "\\p{Ll}+", "").alias(names["low"]),
    )
    ordered = split.select(
        "*",
        F.sort_array(
                F.transform(
                    F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                    lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
                )
            ).alias(names["windows"]),
        F.sort_array(F.filter(tokens, lambda x: x.isin(WORDS))).alias(names["common"]),
    )
    found = ordered.select(
        "*",
        F.sort_array(
                F.transform(
                    F.filter(
                        windows,
                        lambda x, i: F.coalesce(F.get(windows, i - 1)["h"] == x["h"], no)
                        | F.coalesce(F.get(windows, i + 1)["h"] == x["h"], no),
                    ),
                    lambda x: x["i"],
                )
            ).alias(names["repeats"]),
        F.filter(
                F.transform(
                    common,
                    lambda x, i: F.when(
                        ~F.coalesce(F.get(common, i + 1) == x, no), F.struct(x.alias("w"), (i + 1).alias("upto"))
                    ),
                ),
                lambda x: x.isNotNull(),
            ).alias(names["ends"]),
    )
    no_upper = F.regexp_replace(low, "\\p{Lu}+", "")
    no_digit = F.regexp_replace(no_upper, "[0-9]+", "")
    no_space = F.regexp_replace(no_digit, f"[{SPACES}]+", "")
    rest = F.regexp_replace(no_space, f"{SYMBOLS}+", "")
    left = [F.length(x) for x in (raw, low, no_upper, no_digit, no_space, rest)]
    covered = F.aggregate(
        repeats,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            (left[0] - (left[3] - left[4])).cast("long").alias("word_chars"),
            (left[4] - left[5]).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
            F.array(*[(a - b).cast("double") for a, b in zip(left, [*left[1:], F.lit(0)], strict=True)]).alias("classes"),
            F.size(tokens).cast("double").alias("n_tokens"),
            F.transform(
                ends,
                lambda x, i: F.struct(
                    x["w"].alias("w"), (x["upto"] - F.coalesce(F.get(ends, i - 1)["upto"], F.lit(0))).cast("double").alias("n")
                ),
            ).alias("common"),
        ).alias(name),
    )


def failed(m: Column, rules: Rules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])


def references(measures: DataFrame, lang: str, name: str, rules: Rules) -> DataFrame:
    """lang and refs: the histograms of each language, summed over all its documents that pass the base rules.

    A null language has those of all languages. The table has a row for each language and is joined.
    """
    m = F.col(name)
    total = F.aggregate("m.classes", F.lit(0.0), lambda a, x: a + x)
    passed = measures.where(~failed(m, rules) & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), m.alias("m"))
    usable = passed.withColumn("total", total).where(F.col("total") > 0)
    # every document weighs the same, so a few very long ones don't make the reference
    classes = usable.groupBy("lang").agg(
        F.array(*[F.avg(F.element_at("m.classes", i + 1) / F.col("total")) for i in range(len(CLASSES))]).alias("classes"),
        F.count_if(F.col("m.n_tokens") > 0).alias("docs"),
    )
    share = (
        usable.select("lang", "m.n_tokens", F.explode("m.common").alias("x"))
        .groupBy("lang", "x.w")
        .agg(F.sum(F.col("x.n") / F.col("n_tokens")).alias("p"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("w", "p")).alias("found"))
    )
    p = F.transform("found", lambda x: F.struct(x["w"].alias("w"), (x["p"] / F.col("docs")).alias("p")))
    words = F.map_from_entries(F.coalesce(p, F.expr("array()").cast("array<struct<w:string,p:double>>")))
    made = written(classes.join(share, "lang", "left").select("lang", F.struct("lang", "classes", words.alias("words")).alias("ref")), "references")
    every = made.agg(F.collect_list("ref").alias("refs"))
    return written(made.select("lang", F.array("ref").alias("refs")).unionByName(every.select(F.lit(None).cast("string").alias("lang"), "refs")), "references")


def _term(p: Column, q: Column) -> Column:
    """One bin's share of twice the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.least(F.greatest(twice / 2, F.lit(0.0)), F.lit(1.0)))


def class_distance(m: Column, ref: Column) -> Column:
    total = F.aggregate(m["classes"], F.lit(0.0), lambda a, x: a + x)
    return _distance(
        sum((_term(F.get(m["classes"], i) / total, F.get(ref["classes"], i)) for i in range(len(CLASSES))), F.lit(0.0))
    )


def word_distance(m: Column, ref: Column) -> Column:
    """Bins of common words that the document lacks add their reference share; all other words are one bin."""
    n = m["n_tokens"]
    held = F.aggregate(
        m["common"],
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct(
            (a["d"] + _term(x["n"] / n, F.coalesce(ref["words"][x["w"]], F.lit(0.0)))).alias("d"),
            (a["p"] + x["n"] / n).alias("p"),
            (a["q"] + F.coalesce(ref["words"][x["w"]], F.lit(0.0))).alias("q"),
        ),
    )
    q = F.aggregate(F.map_values(ref["words"]), F.lit(0.0), lambda a, x: a + x)
    zero = F.lit(0.0)
    return _distance(held["d"] + F.greatest(q - held["q"], zero) + _term(F.greatest(1 - held["p"], zero), F.greatest(1 - q, zero)))


def judged(measures: DataFrame, lang: str, name: str, rules: Rules = Rules()) -> DataFrame:
    """Measurements with the struct column ``name`` widened by both distances, base_failed and kept."""
    m = F.col(name)
    own, refs = fresh(measures, "_lang"), fresh(measures, "_refs")
    to = references(measures, lang, name, rules).select(F.col("lang").alias(own), F.col("refs").alias(refs))
    joined = measures.join(to, F.col(lang).eqNullSafe(F.col(own)), "left")
    chars = F.aggregate(m["classes"], F.lit(0.0), lambda a, x: a + x)
    nearest = lambda f: F.array_min(F.transform(refs, lambda r: f(m, r)))  # noqa: E731  null without a reference
    out = joined.withColumn(
        name,
        F.struct(
            F.col(f"{name}.*"),
            failed(m, rules).alias("base_failed"),
            F.when(chars >= rules.min_chars, nearest(class_distance)).alias("class_distance"),
            F.when(m["n_tokens"] >= rules.min_common, nearest(word_distance)).alias("word_distance"),
        ),
    )
    near = (F.coalesce(m["class_distance"], F.lit(0.0)) <= rules.max_class_distance) & (
        F.coalesce(m["word_distance"], F.lit(0.0)) <= rules.max_word_distance
    )
    return out.withColumn(name, m.withField("kept", ~m["base_failed"] & near))


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row for each document: its id and its measurements, distances and verdict."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    measures = written(measured(rows, "text", "m").select("doc_id", "lang", "m"), "quality")
    return judged(measures, "lang", "m", rules).select("doc_id", "m.*")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    name = fresh(docs, "_quality")
    measures = written(measured(docs, text, name), "quality")
    return judged(measures, lang, name, rules).where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
