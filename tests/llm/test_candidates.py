"""Populations of one template: most rows are at similarity 0.5 to 0.75 to each other, so keys hold many classes."""

import random

from covspark.llm import candidates, components, lines, neardup

VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "ser", "po") for b in ("ran", "del", "fo", "xi", "wu") for c in ("us", "em", "ost", "y", "ing")]


def population(n, length, changes, copies):
    rng = random.Random(12)
    template = [rng.choice(VOCABULARY) for _ in range(length)]
    out = set()
    while len(out) < n:
        row = list(template)
        for at in rng.sample(range(length), changes):
            row[at] = rng.choice(VOCABULARY)
        for _ in range(copies):
            near = list(row)
            near[rng.randrange(length)] = rng.choice(VOCABULARY)
            out.add(" ".join(near))
    return sorted(out)


def recall(links, place):
    """Share of the links, found by comparing all pairs, whose ends are in one class."""
    assert len(links) > 100
    return sum(place[a] == place[b] for a, b in links) / len(links)


def test_lines_of_a_template(spark):
    texts = population(700, 40, 6, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    links = []
    for i, x in enumerate(sets):
        links += [(i, j) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)]
    place = {r.doc_id: r.class_id for r in lines.classify(df).collect()}
    assert len(set(place.values())) > 50
    assert recall(links, place) >= 0.9  # signatures lose some at 0.8


def test_documents_of_a_template(spark):
    texts = population(500, 110, 5, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    s = neardup.Settings()
    weights = neardup.document_frequencies(df.select("text"), s)
    sets = [neardup.shingle_hashes(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(sets[i], sets[j], weights) >= s.threshold]
    place = {r.doc_id: r.class_id for r in neardup.classify(df).collect()}
    assert len(set(place.values())) > 50
    assert recall(links, place) >= 0.95


def test_every_pair_of_a_shared_key(spark):
    """Whatever the rounds before found, every pair of a shared key is either tried or in one class."""
    rng = random.Random(3)
    keys = {i: [7 if rng.random() < 0.6 else 100 + i, rng.randrange(40), *(rng.randrange(4) << 32 | i for _ in range(2))] for i in range(160)}
    label = {i: rng.choice([0] * 6 + list(range(1, 40))) for i in keys}
    signed = spark.createDataFrame(list(keys.items()), "id long, keys array<long>").repartition(3)
    signed = signed.join(spark.createDataFrame(list(label.items()), "id long, label int"), "id")
    pairs, ranked = candidates.candidates(signed.select("id", "keys"), 4)
    tried = {(r.a, r.b) for r in pairs.collect()}
    first = [i for i in keys if label[i] == 0][:12]
    known = [p for p in tried if label[p[0]] == label[p[1]]] + list(zip(first, first[1:]))
    roots = components.components(spark.createDataFrame(known, "a long, b long"))
    root = {r.node: r.root for r in roots.collect()}
    wanted = {
        (a, b)
        for a in keys
        for b in range(a + 1, 160)
        if any(x == y for x, y in zip(keys[a], keys[b])) and (a, b) not in tried and root.get(a, a) != root.get(b, b) and (label[a] + label[b]) % 3
    }
    assert len(wanted) > 1000 and max(list(root.values()).count(r) for r in root.values()) > 9
    for block, part_rows in ((1024, 4096), (5, 3)):
        got = candidates.rest(ranked, signed, pairs, roots, 4, lambda x, y: (x["label"] + y["label"]) % 3 != 0, block, part_rows).collect()
        assert len(got) == len(wanted) and {(r.a, r.b) for r in got} == wanted


def test_every_link_of_a_hot_key(spark):
    """No link of two lines that share a key is lost, though most lines of the key are in other classes."""
    texts = population(900, 30, 4, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    s = lines.Settings()
    signed = {r.id: r["keys"] for r in lines.distinct_lines(lines.occurrences(df, "doc_id", "text"), s).collect()}
    found = lines.classify(df)
    ids = {r.doc_id: r.id for r in lines.occurrences(df, "doc_id", "text").collect()}
    cut = lambda k: [k >> 42, k >> 21 & lines.FIELD, k & lines.FIELD]
    keys = [signed[ids[i]] for i in range(len(texts))]
    components_of = [[c for k in row for c in cut(k)] for row in keys]
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    place = {r.doc_id: r.class_id for r in found.collect()}
    links = [
        (i, j)
        for i, x in enumerate(sets)
        for j, y in enumerate(sets[:i])
        if len(x & y) >= 0.8 * len(x | y)
        and any(a == b for a, b in zip(keys[i], keys[j]))
        and sum(a == b for a, b in zip(components_of[i], components_of[j])) >= s.agree
    ]
    assert len(links) > 100 and len(set(place.values())) > 50
    assert [p for p in links if place[p[0]] != place[p[1]]] == []


def test_a_hot_key_of_rows_that_share_little(spark):
    """Rows that have only a common passage in common don't meet one by one, and no similar pair among them is lost."""
    rng = random.Random(5)
    common = [(k, 1.0) for k in range(30)]
    sets = {}
    for i in range(400):
        own = [(1000 + 100 * i + k, 1.0 + k % 3) for k in range(60)]
        if i % 20 == 1:  # nearly the row before
            own = sets[i - 1][30:90][: rng.randrange(48, 61)] + own[:4]
        sets[i] = common + own

    def similarity(x, y):
        x, y = dict(x), dict(y)
        both = sum(w for k, w in x.items() if k in y)
        return both / (sum(x.values()) + sum(y.values()) - both)

    wanted = {(i, j) for i in sets for j in range(i + 1, 400) if similarity(sets[i], sets[j]) >= 0.8}
    assert len(wanted) > 10
    elements = spark.createDataFrame([(i, k, w) for i, s in sets.items() for k, w in s], "id long, name long, weight double")
    members = spark.createDataFrame([(i, i) for i in sets], "id long, root long")
    for block, part_rows in ((1024, 4096), (5, 3)):
        got = [(r.a, r.b) for r in candidates.prefixed(elements, members, 0.8, block, part_rows).collect()]
        assert wanted <= set(got) and len(got) == len(set(got)) < 100
    one = spark.createDataFrame([(i, i // 20) for i in sets], "id long, root long")
    assert not wanted & {(r.a, r.b) for r in candidates.prefixed(elements, one, 0.8).collect()}


def test_keys_of_many_classes_lose_no_link(spark):
    """Documents of a template by their rarest shingles give the classes that all pairs give."""
    texts = population(300, 110, 5, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    apart = neardup.classify(df, s=neardup.Settings(few=10**6))
    place = {r.doc_id: r.class_id for r in apart.collect()}
    assert len(set(place.values())) > 50
    found = {r.doc_id: r.class_id for r in neardup.classify(df, s=neardup.Settings(few=2)).collect()}
    assert all(len({found[i] for i in place if place[i] == c}) == 1 for c in set(place.values()))


def test_lines_of_common_words_move_few_rows(spark, monkeypatch):
    """Lines that share a key only because a third of their words is common are told apart by their signatures, not by all their shingles."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    common = [word() for _ in range(12)]
    texts = [" ".join(common[i // 3] if i % 3 == 0 else word() for i in range(36)) for _ in range(1200)]
    rows = {}

    def counted(df, purpose, written=candidates.written):
        out = written(df, purpose)
        rows[purpose] = rows.get(purpose, 0) + out.count()
        return out

    for module in (candidates, lines):
        monkeypatch.setattr(module, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = lines.classify(df)
    assert len({r.class_id for r in found.collect()}) == 1200
    # a row for each shingle of each of them would be 300 times as many
    assert rows["heavy"] > 100 and sum(rows.get(x, 0) for x in ("elements", "shown", "prefixes")) < 20 * rows["heavy"]


def test_narrowed_loses_no_pair(spark):
    """Two rows of a key that agree in enough parts meet by another part, or both are left over."""
    rng = random.Random(9)
    base = [[rng.randrange(5) for _ in range(18)] for _ in range(12)]
    parts = {}
    for i in range(300):
        row = [x if rng.random() < 0.75 else 1000 + rng.randrange(400) for x in base[i % 12]]
        parts[i] = base[0][:3] + row[3:]
    keys = {i: [r[k] << 42 | r[k + 1] << 21 | r[k + 2] for k in range(0, 18, 3)] for i, r in parts.items()}
    held = spark.createDataFrame(list(keys.items()), "id long, keys array<long>")
    roots = {i: i // 2 for i in keys}
    heavy = spark.createDataFrame([(5, i, roots[i], 0) for i in keys], "key long, id long, root long, band int")
    same = lambda i, j: sum(x == y for x, y in zip(parts[i], parts[j]))
    wanted = {(i, j) for i in keys for j in range(i + 1, 300) if same(i, j) >= 9 and roots[i] != roots[j]}
    fits = lambda x, y: lines.alike(x["keys"], y["keys"], 6) >= 9
    for few in (4, 1000):
        met, left = candidates.narrowed(heavy, held, lambda k: lines.components_of(k, 6), 3, 9, few, fits, slots=64)
        got, over = {(r.a, r.b) for r in met.collect()}, {r.id for r in left.collect()}
        assert got <= wanted and all(p in got or over >= set(p) for p in wanted)
        assert len(wanted) > 500 and (got == wanted) == (few == 1000) and bool(over) == (few == 4)
