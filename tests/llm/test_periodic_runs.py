import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.llm import periodic_runs as o

DATA = Path("/root/testdata/sf0.001")


def plain(words, least=6, times=4):
    """Runs by comparing all words with those q further on, for each q; of several periods of one stretch the smallest counts."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q) and not any(q % p == 0 and (start, i + q, p) in out for p in range(1, q)):
                out[start, i + q, q] = True
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_extensions_and_orders_of_a_tree():
    rng = random.Random(5)
    for n in (1, 2, 7, 40, 300):
        for letters in (1, 2, 3, 50):
            numbers = [rng.randint(1, letters) for _ in range(n)] + [0]
            tree = o.SuffixTree(numbers)
            a, b = (np.array([rng.randrange(n + 1) for _ in range(400)]) for _ in "ab")
            a, b = a[a != b], b[a != b]
            common = lambda x, y: next(k for k in range(n + 1) if x + k > n or y + k > n or numbers[x + k] != numbers[y + k])
            assert tree.extension(a, b).tolist() == [common(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda i: numbers[i:])
            assert np.argsort(tree.rank_reversed).tolist() == sorted(range(n + 1), key=lambda i: [-x if x else -999 for x in numbers[i:]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_are_all_runs(parts):
    words = [w for root, n in parts for w in root * n]
    codes = np.array(words, np.int64)
    wanted = plain(words)
    assert list(map(tuple, o.runs_of(codes).tolist())) == wanted
    found = o.runs_in_parts(codes, o.stretches(codes, np.zeros(len(codes), np.int64)))
    assert sorted(map(tuple, found.tolist()), key=lambda r: (r[0], r[2])) == wanted


def expected(text):
    words = (text or "").encode().split()
    runs = plain(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    return len(words), [(a, b - a, q) for a, b, q in runs], b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_texts_of_many_kinds_in_one_slice():
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "a", "a b " * 3 + "a b", "a b c " * 7 + "d " * 9, "é ß é ß é ß é ß é ß é ß", "a\x1cb a\x1cb " * 5]
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 8)):
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] * rng.choice((1, 1, 2, 4, 5, 9))
        texts.append(rng.choice((" ", "\n", "  ")).join(words))
    n, runs, collapsed = o.judged(pa.array(texts, pa.string()))
    for text, count, found, rest in zip(texts, n.to_pylist(), runs.to_pylist(), collapsed.to_pylist(), strict=True):
        assert (count, [(r["start"], r["length"], r["period"]) for r in found], rest) == expected(text)


def test_stretches_leave_words_that_do_not_repeat():
    words = np.random.default_rng(1).zipf(1.3, 200_000)
    words[150_000:150_400] = np.tile(words[150_000:150_050], 8)
    parts = o.stretches(words, np.zeros(len(words), np.int64))
    assert sum(b - a for a, b in parts) < 20_000 and any(a <= 150_000 and b >= 150_400 for a, b in parts)
    assert (150_000, 150_400, 50) in map(tuple, o.runs_in_parts(words, parts).tolist())


def test_a_long_text_with_a_long_period(spark):
    root = [f"w{i}" for i in range(9_000)]
    rows = [(1, " ".join(root * 5)), (2, "x " * 60_000), (3, None)]
    got = {r.doc_id: r for r in o.with_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 45_000, 9_000)] and got[1].collapsed == " ".join(root)
    assert [tuple(r) for r in got[2].runs] == [(0, 60_000, 1)] and got[2].collapsed == "x" and got[3].runs == [] and got[3].collapsed == ""


def test_ids_repeated_rows_clashing_names_and_empty_table(spark):
    rows = [(None, "a " * 8, "r", 1)] * 2 + [(1, "b c", "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, period int")
    out = o.with_runs(df)
    assert out.columns == [*df.columns, "n_words", "runs", "collapsed"]
    assert sorted((str(r.doc_id), r.start, r.collapsed) for r in out.collect()) == [("1", "s", "b c"), ("None", "r", "a"), ("None", "r", "a")]
    assert o.with_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        o.with_runs(df.withColumn("runs", F.lit(1)))
    with pytest.raises(ValueError):
        o.with_runs(df, times=3)


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_op11(spark):
    out = o.op11_periodic_runs(spark, str(DATA))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, texts = {r.doc_id: tuple(r)[1:] for r in out.collect()}, {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        _, runs, rest = expected(b" ".join(words).decode())
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (len(runs), *top, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(rest))


def test_planting_without_an_id_or_words_changes_nothing(spark):
    rows = [(None, "a b"), (None, None), (0, ""), (3, " ")] + [(i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit(1)).withColumn("g", F.lit(2))
    assert sorted(map(repr, o.planted(df).collect())) == sorted(map(repr, df.collect()))
