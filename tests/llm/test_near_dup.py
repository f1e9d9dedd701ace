import random
import re

import xxhash

from lodeworks.llm import near_dup as n


def plain(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", " \n", "One", "One two", "a b c", "a b c d\té  F\x0bG", " ".join(rng.choices("abcdefgh", k=500)), "x\u00a0y z", "w " * 70_000]:
        assert n.fingerprint(text.encode()) == plain(text)
        assert n.fingerprint(text.encode(), 5) == plain(text, 5)


def groups(points, bits):
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i, _ in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in points:
        for j, b in points:
            if i < j and bin(a ^ b).count("1") <= bits:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in points}


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    points, signed = [], lambda x: x - (1 << 64) if x >> 63 else x
    for centre in [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(6))]:
        x = centre
        for _ in range(25):  # chains: each a few bits from one before
            points.append(x)
            x = rng.choice(points[-3:])
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3, 4])):
                x ^= 1 << b
    points += [rng.getrandbits(64) for _ in range(50)]
    points = list(enumerate(points, 100))
    rng.shuffle(points)
    rows = spark.createDataFrame([(i, signed(x)) for i, x in points], "__id long, __fp long")
    for bits in (1, 2, 3):
        got = {r["__id"]: r.component for r in n.labelled(rows, bits).collect()}
        assert got == groups(sorted(points), bits)


DOCS = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, None), (7, ""), (1, "other words in this one"), (1, "other words in this one"), (None, "a b c d e f g"), (None, None)]


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, component string")
    out = n.labelled(n.cut(n.fingerprints(docs))).collect()
    assert sorted((r["__id"], r.component) for r in out if r["__id"] is not None) == [(1, 1), (1, 1), (3, 3), (5, 3), (7, 7), (9, 7)]
    assert sorted(r.component for r in out if r["__id"] is None) == [3, 7]
    one = n.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in one.collect()) == [(0, ""), (0, "a b c d e f g"), (1, "other words in this one"), (3, "A b c d e f g"), (7, "")]
    assert n.one_of_each(docs.limit(0)).count() == 0


def test_texts_four_fifths_alike_are_one(spark):
    rng = random.Random(6)
    sets, rows = {}, []
    prose = lambda k: [rng.choice("abcdefgh") + str(rng.randrange(5000)) for _ in range(k)]
    common = prose(60)
    for i in range(60):
        words = prose(rng.choice([6, 40, 300])) + common * (i % 2)
        for k in range(3):  # edited copies, from nearly equal to far
            rows.append((10 * i + k, " ".join(words)))
            for at in rng.sample(range(len(words)), max(1, len(words) * rng.choice([1, 2, 4, 6]) // 100)):
                words[at] = f"edit{rng.randrange(10**6)}"
    rows += [(900, "one two"), (901, "one two"), (902, ""), (903, None), (904, "w " * 50), (905, "w " * 70)]
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    fps = {i: n.fingerprint((t or "").encode(), 5) for i, t in rows}
    root = {i: i for i in sets}
    near = lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3
    found_by_sets = 0
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (near(i, j) or both and 100 * both >= 80 * len(sets[i] | sets[j])):
                found_by_sets += not near(i, j)
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert found_by_sets > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in n.one_of_each(docs, 5, 3, least=80).collect()) == sorted(set(root.values()))


def test_hubs_and_the_pairs_left_after_them(spark, monkeypatch):
    """Copies of one original, further from each other than from it; with no rounds of hubs all pairs are compared at once."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [0, *range(100, 120)]
    assert sorted(r.doc_id for r in n.one_of_each(docs, 5, 1, least=80).collect()) == wanted
    marks, texts = n.cut(n.marked(docs, 5)), docs.select(n.F.xxhash64("text").alias("__key"), n.F.col("text").alias("__text"))
    none = spark.createDataFrame([], "a long, b long")
    for rounds in (0, 1):
        roots = n.components(n.alike(marks, texts, none, 80, 5, rounds)).collect()
        assert len(roots) == 40 and len({r.root for r in roots}) == 1


def test_bands_catch_what_is_alike():
    rng = random.Random(9)
    for share in (0.8, 0.9):
        for size in (10, 60, 400):
            caught = 0
            for _ in range(40):
                both = [rng.getrandbits(64) for _ in range(int(size * share))]
                a, b = ([rng.getrandbits(64) for _ in range((size - len(both)) // 2)] for _ in range(2))
                keys = n.bands(n.np.array([n.minima(n.np.array(both + x, "<u8")) for x in (a, b)]))
                caught += bool((keys[0] == keys[1]).any())
            assert caught == 40


def test_repeated_ids_and_clashing_names(spark):
    rows = [(0, "B b b b b b", 1), (1, "b b b b b b", 1), (1, "other text of its own", 2), (2, "same row here", 3), (2, "same row here", 3), (2, "same row here", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int").withColumns({"__stays": n.F.lit(1), "component": n.F.lit(2), "n": n.F.lit(3), "k": n.F.lit(4)})
    out = n.one_of_each(docs, least=80)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r["__id"]) for r in out.collect()) == [(0, "B b b b b b", 1), (1, "other text of its own", 2), (2, "same row here", 3)]
    # near copies of one id: one text of theirs stays
    near = spark.createDataFrame([(4, "x y z"), (4, "X y z")], "doc_id long, text string")
    assert n.one_of_each(near).count() == 1


def test_registered_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = n.op4_simhash(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    assert {i: x[0] for i, x in got.items()} == {i: f"{plain(t):016x}" for i, t in rows.items()}
    assert {i: x[1] for i, x in got.items()} == groups(sorted((i, plain(t)) for i, t in rows.items()), 2)


def test_a_loose_group_of_copies_makes_no_pairs_and_loses_no_link(spark):
    """Copies of one text that each have changes of their own are not 0.8 alike; some of them have near copies of their own, which are."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(200), 9):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
        if i % 6 == 0:
            texts.append(" ".join([*words[:-1], f"z{i}"]))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in n.one_of_each(df, 5, 3, least=80).collect())
    sets = [set(n.shingles(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) or (n.fingerprint(texts[i].encode(), 5) ^ n.fingerprint(texts[j].encode(), 5)).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == sorted({find(i) for i in range(len(texts))}) and len(kept) < len(texts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes the 64 variants of each fingerprint for one row, and would broadcast millions of them."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    fps = spark.range(100).withColumnRenamed("id", "__fp")
    assert "Broadcast" not in plan(n.links(fps))
    prints = n.cut(fps.withColumn("__id", n.F.col("__fp")))
    out = n.labelled(prints)
    assert "Broadcast" not in plan(out) and out.count() == 100
    monkeypatch.setattr(n, "MAX_BROADCAST", 10)
    assert "Broadcast" in plan(fps.join(n._few(fps.limit(5)), "__fp", "left_anti"))
    assert "Broadcast" not in plan(fps.join(n._few(fps), "__fp", "left_anti"))


def test_a_small_graph_leaves_few_files_however_many_partitions_a_shuffle_has(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = n.components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)], "a long, b long"))
        assert found.rdd.getNumPartitions() <= n.GRAPH_TASKS
        assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(31)} | {(i, 100) for i in range(100, 130)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
