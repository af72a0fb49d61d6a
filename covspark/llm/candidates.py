"""Candidate pairs from band keys, linear in the rows of a key, for keys of any weight."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.llm.common import written


def candidates(
    signed: DataFrame, bands: int, salts: int = 32, lags: int = 1, fits: Callable[[Column, Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``first_pairs`` without the rows' keys."""
    return first_pairs(signed, bands, salts, lags, fits)[:2]


def first_pairs(
    signed: DataFrame, bands: int, salts: int = 32, lags: int = 1, fits: Callable[[Column, Column], Column] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First pairs a < b of the ids of rows (id, keys) that share a key in the same place of ``keys``, the rows of shared keys, and their (id, keys).

    The pairs link most of what belongs together; ``rest`` gives all others of keys of many classes.

    Keys of one row go at once. Every other row is paired with its key's centre, the row that meets
    most others over all its keys: near copies of one text are nearer to that than to each other.
    It is also paired with the ``lags`` rows before it, in the order of its next band's key, and
    with the first of them. For that the rows of a key are dealt by a salt, and the salts' firsts
    meet after that. So the pairs are linear in the rows of a key, no group is unbounded, and a hot
    key spreads: counts and centres are combined before the shuffle, and joins on keys are inner
    joins whose hot partitions Spark splits. ``fits`` says of two rows' keys whether the pair is
    worth a closer look.
    """
    rows = signed.select("id", F.posexplode("keys").alias("band", "half"))
    rows = rows.select(F.xxhash64("band", "half").alias("key"), "id", F.col("band").cast("byte").alias("band"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    live = written(rows.join(counts, "key"), "buckets")

    degree = written(live.groupBy("id").agg(F.sum("n").alias("degree")).join(signed.select("id", "keys"), "id"), "degrees")
    near = F.shiftright(F.get("keys", F.pmod(F.col("band") + 1, F.lit(bands))), 32).cast("int").alias("near")
    ranked = written(live.join(degree, "id").select("key", "id", "band", "n", "degree", near), "ranked")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("c")).select("key", F.col("c.id").alias("other"))
    stars = ranked.select("key", "id").join(centre, "key").select("id", "other")

    def met(rows: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part)
        others = F.array(F.col("head"), *[F.lag("id", k + 1).over(w.orderBy("near", "id")) for k in range(lags)])
        return rows.withColumn("head", F.min("id").over(w)).withColumn("others", others)

    salted = met(ranked.select("key", "id", "near", F.pmod("id", F.lit(salts)).cast("int").alias("salt")), ["key", "salt"])
    firsts = met(salted.where(F.col("id") == F.col("head")).select("key", "id", "near"), ["key"])
    chains = [x.select("id", F.explode(F.array_compact("others")).alias("other")) for x in (salted, firsts)]
    pairs = stars.unionByName(chains[0]).unionByName(chains[1]).where(F.col("id") != F.col("other"))
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    held = degree.select("id", "keys")
    if fits is None:
        return pairs, ranked, held
    one, two = held.select(F.col("id").alias("a"), F.col("keys").alias("x")), held.select(F.col("id").alias("b"), F.col("keys").alias("y"))
    return pairs.join(one, "a").join(two, "b").where(fits(F.col("x"), F.col("y"))).select("a", "b"), ranked, held


def rest(
    ranked: DataFrame,
    signed: DataFrame,
    pairs: DataFrame,
    roots: DataFrame,
    bands: int,
    fits: Callable[[Column, Column], Column],
    block: int = 1024,
    part_rows: int = 4096,
) -> DataFrame:
    """All other pairs a < b of rows that share a key and aren't in one class yet, each once: nothing is capped.

    ``ranked`` and ``pairs`` are those of ``candidates``; ``roots`` (node, root) are the classes their
    links make, and ``fits`` says of two rows of ``signed`` (id, keys and what else it needs, as structs)
    whether they are worth a closer look. A key whose rows are one class is done. In every other key
    each class meets each other class, and then their rows: as many steps as there are such pairs, and
    none for the pairs within a class. Hot keys spread: classes of a key are dealt into blocks of about
    ``block`` that meet two by two, and rows of a class into parts of about ``part_rows``. A pair that
    shares several keys is taken at the first.
    """
    rows = placed(ranked, roots)
    held = signed.select("id", F.struct(*signed.columns).alias("row"))
    met = across(rows.select("key", "id", "root", "band"), held, block, part_rows)
    halves = [(F.get("x.keys", F.lit(k)) == F.get("y.keys", F.lit(k)), k) for k in range(bands)]
    first = F.coalesce(*[F.when(same, F.lit(k)) for same, k in halves])
    met = met.where((first == F.col("band")) & fits(F.col("x"), F.col("y")))
    met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return met.join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def placed(ranked: DataFrame, roots: DataFrame) -> DataFrame:
    """``ranked`` with the class (root) of each row; a row without a link is its own."""
    rows = ranked.where(F.col("n") > 2).join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    return rows.withColumn("root", F.coalesce("root", "id"))


def weighed(ranked: DataFrame, roots: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys of at most ``few`` classes, for ``rest``, and the rows (key, id, root, band) of keys of more classes."""
    rows = placed(ranked, roots)
    sizes = rows.select("key", "root").distinct().groupBy("key").agg(F.count("*").alias("classes"))
    sizes = written(sizes.where(F.col("classes") > 1), "classes")
    light = ranked.join(sizes.where(F.col("classes") <= few).select("key"), "key", "left_semi")
    heavy = rows.join(sizes.where(F.col("classes") > few).select("key"), "key", "left_semi")
    return light, heavy.select("key", "id", "root", "band")


def by_weight(ranked: DataFrame, roots: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys of at most ``few`` classes, for ``rest``, and the ids (and roots) that a key of more classes holds, for ``prefixed``."""
    light, heavy = weighed(ranked, roots, few)
    return light, heavy.select("id", "root").distinct()


def seen_in(slot: Column | list[Column], rows: DataFrame, slots: int) -> Column:
    """How often each of ``slots`` numbers is a ``slot`` of the rows, as an array: one size for any table.

    A subquery's value, so that it is looked up in generated code; higher-order functions can't hold it.
    """
    each = F.explode(F.array(*slot)) if isinstance(slot, list) else slot
    seen = written(rows.select(each.alias("slot")).groupBy("slot").agg(F.count("*").alias("seen")), "seen")
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(seen, "slot", "left")
    every = every.select(F.struct("slot", F.coalesce("seen", F.lit(0)).alias("seen")).alias("x"))
    return every.agg(F.sort_array(F.collect_list("x")).alias("all")).select(F.col("all.seen")).scalar()


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, root and more) of the keys that hold several roots."""
    live = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rows.join(live.select("key"), "key")


def narrowed(
    heavy: DataFrame,
    held: DataFrame,
    parts: Callable[[Column], list[Column]],
    per: int,
    agree: int,
    few: int,
    fits: Callable[[Column, Column], Column],
    slots: int = 1 << 16,
    block: int = 1024,
    part_rows: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of rows of ``heavy`` (key, id, root, band) that share a key, ``agree`` parts and no root, and the rows (id, root) left over.

    ``parts`` gives what the keys of a row of ``held`` (id, keys) are made of, ``per`` to a key. Two rows of a key that agree
    in ``agree`` parts share ``agree - per`` others, and so one of those that are left when each leaves out the commonest
    ``agree - per - 1``. They meet by the key and that part. Rows that still meet more than ``few`` classes by one are left
    over: any two of them may not have met. Which parts are common is told by ``slots`` counts; any order would do.
    """
    each = parts(F.col("keys"))
    slot = [F.pmod(F.xxhash64(F.lit(i), part), F.lit(slots)).cast("int") for i, part in enumerate(each)]
    table = seen_in(slot, held.join(heavy.select("id").distinct(), "id", "left_semi"), slots)
    of = [F.when(F.lit(i // per) != F.col("band"), F.struct(F.get(table, slot[i]).alias("seen"), F.lit(i).alias("part"), part.alias("value"))) for i, part in enumerate(each)]
    rarest = F.slice(F.sort_array(F.array_compact(F.array(*of))), 1, len(each) - agree + 1)
    rows = heavy.join(held.select("id", "keys"), "id").select("key", "id", "root", "band", F.explode(rarest).alias("rare"))
    rows = rows.select(F.xxhash64("key", "rare.part", "rare.value").alias("key"), "id", "root", "band")
    rows = written(mixed(written(rows, "rare")), "live")
    sizes = rows.select("key", "root").distinct().groupBy("key").agg((F.count("*") <= few).alias("light"))
    rows = written(rows.join(sizes, "key"), "sized")
    met = across(rows.where("light").drop("light"), held.select("id", F.struct("id", "keys").alias("row")), block, part_rows)
    met = met.where(fits(F.col("x"), F.col("y"))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return met.distinct(), rows.where(~F.col("light")).select("id", "root").distinct()


def prefixed(elements: DataFrame, members: DataFrame, threshold: float, block: int = 1024, part_rows: int = 4096, slots: int = 1 << 18) -> DataFrame:
    """All pairs a < b of ``members`` (id, root) of two classes whose weighted Jaccard similarity can reach the threshold, each once.

    ``elements`` (id, name, weight) are the members' sets, in one order, the rarest first. What two sets share lies
    at or after the first element they share, so little of either's weight can lie before that: with weights x <= y,
    sets so similar share t / (1 + t) of x + y. So they meet by that element if the lighter one shows those with at
    most 1 - 2t / (1 + t) of its weight before them, and the heavier one those that the size of a lighter one allows, a
    step of t at a time. Nothing is lost, and sets that only share common elements don't meet.

    Which elements are rare is told by ``slots`` counts, any order would do: only those shown are moved to where they meet.
    Elements that lie by id needn't be moved before that.
    """
    part, step = threshold / (1 + threshold), 1 / threshold
    slot = F.pmod(F.xxhash64("name"), F.lit(slots)).cast("int")
    each = elements.withColumn("n", F.get(seen_in(slot, elements, slots), slot))
    own = Window.partitionBy("id")
    before = F.sum("weight").over(own.orderBy("n", "name").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("id", "name", F.coalesce(before, F.lit(0.0)).alias("before"), F.sum("weight").over(own).alias("total"))
    # sums of weights are rounded, so a little more is taken
    most = F.col("total") * 1.0001
    first = each.where(F.col("before") <= most - F.col("total") * threshold)
    first = written(mixed(written(first.withColumnRenamed("name", "key").join(members, "id"), "shown")), "prefixes").withColumnRenamed("key", "name")
    size = lambda w: F.floor(F.log(w) / math.log(step)).cast("int")
    row = F.struct("id", "total", "before").alias("row")
    light = first.where(F.col("before") <= most - F.col("total") * (2 * part)).withColumn("size", size(F.col("total")))
    heavy = first.withColumn("size", F.explode(F.sequence(size(F.col("total") * (threshold * 0.9999)), size(most))))
    heavy = heavy.where(F.col("before") <= most - (F.col("total") + F.pow(F.lit(step), F.col("size"))) * part)
    light, heavy = (x.select(F.xxhash64("name", "size").alias("key"), "id", "root", row) for x in (light, heavy))
    reach = lambda left, total: left * 1.0001 >= total * part
    # what the best rows of two classes could do
    bounds = [F.max(F.col("row.total") - F.col("row.before")).alias("left"), F.min("row.total").alias("low"), F.max("row.total").alias("high")]
    can = lambda x, y: (x("low") <= y("high")) & reach(F.least(x("left"), y("left")), x("low") + y("low"))
    met = between(light, heavy, block, part_rows, bounds, can)
    x, y = F.col("x"), F.col("y")
    left = F.least(x["total"] - x["before"], y["total"] - y["before"])
    met = met.where((F.struct(x["total"], x["id"]) < F.struct(y["total"], y["id"])) & reach(left, x["total"] + y["total"]))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def between(
    xs: DataFrame, ys: DataFrame, block: int, part_rows: int, bounds: list[Column], can: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
) -> DataFrame:
    """x and y, the ``row`` of any row of ``xs`` and any of ``ys`` (key, id, root, row) that share a key but no root.

    Classes meet first, then the rows of those that ``can``, as the ``bounds`` of their rows say, in blocks and parts as in ``rest``.
    """
    sides = []
    for rows in (xs, ys):
        sizes = rows.groupBy("key", "root").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"), *bounds)
        sides.append((sizes, sizes.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))))
    (one, i), (two, j) = sides
    both = written(i.withColumnRenamed("blocks", "bi").join(j.withColumnRenamed("blocks", "bj"), "key"), "keys")
    at = lambda n: F.pmod(F.xxhash64("root"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = [c for c in one.columns if c not in ("key", "root", "parts")]
    one, two = (
        side.join(both, "key").select("key", F.col("root").alias(f"r{k}"), F.col("parts").alias(f"p{k}"), *[F.col(c).alias(f"{c}{k}") for c in held], at(own).alias(mine), all_of(other).alias(theirs))
        for k, side, own, other, mine, theirs in ((1, one, "bi", "bj", "i", "j"), (2, two, "bj", "bi", "j", "i"))
    )
    met = one.join(two, ["key", "i", "j"]).where((F.col("r1") != F.col("r2")) & can(lambda c: F.col(f"{c}1"), lambda c: F.col(f"{c}2")))
    met = written(met.select("key", "r1", "p1", "r2", "p2"), "met")

    def dealt(rows: DataFrame, k: int) -> DataFrame:
        parts = met.select("key", F.col(f"r{k}").alias("root"), F.col(f"p{k}").alias("parts")).distinct()
        rows = rows.join(parts, ["key", "root"])
        return rows.select("key", F.col("root").alias(f"r{k}"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias(f"q{k}"), F.col("row").alias("xy"[k - 1]))

    left, right = dealt(xs, 1), dealt(ys, 2)
    pairs = met.select("key", "r1", "r2", "p2", all_of("p1").alias("q1")).join(left, ["key", "r1", "q1"])
    pairs = pairs.select("key", "r2", "x", all_of("p2").alias("q2"))
    return pairs.join(right, ["key", "r2", "q2"]).select("x", "y")


def across(rows: DataFrame, held: DataFrame, block: int, part_rows: int) -> DataFrame:
    """band, x and y of any two rows (key, id, root, band) of one key that aren't of one root; x and y are their ``row`` of ``held``."""
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("classes")).where(F.col("classes") > 1)
    cells = sizes.join(mixed, "key").select(
        "key",
        "root",
        F.ceil(F.col("m") / part_rows).cast("int").alias("parts"),
        F.ceil(F.col("classes") / block).cast("int").alias("blocks"),
    )
    cells = written(cells.withColumn("at", F.pmod(F.xxhash64("root"), F.col("blocks")).cast("int")), "cells")
    members = rows.join(cells.select("key", "root", "parts"), ["key", "root"])
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    members = written(members.join(held, "id"), "members")

    one = cells.select("key", F.col("root").alias("r1"), F.col("parts").alias("p1"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    two = cells.select("key", F.col("root").alias("r2"), F.col("parts").alias("p2"), F.col("at").alias("j"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"))
    met = one.join(two, ["key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("r1") < F.col("r2")))
    met = met.select("key", "r1", "r2", "p2", F.explode(F.sequence(F.lit(0), F.col("p1") - 1)).alias("q1"))
    x = members.select("key", F.col("root").alias("r1"), F.col("part").alias("q1"), "band", F.col("row").alias("x"))
    y = members.select("key", F.col("root").alias("r2"), F.col("part").alias("q2"), F.col("row").alias("y"))
    met = met.join(x.select("key", "r1", "q1", "band", "x"), ["key", "r1", "q1"])
    met = met.select("key", "r2", "band", "x", F.explode(F.sequence(F.lit(0), F.col("p2") - 1)).alias("q2")).join(y, ["key", "r2", "q2"])
    return met
