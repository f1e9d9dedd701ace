import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(text, items, n):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        for i in range(max(1, len(own) - n + 1) if own else 0):
            w = own[i : i + n]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    if item is not None:
                        found.add(str(item))
    return len(words), sorted(hit), sorted(found)


TEXTS = [
    None, "", "...", "a b c d e", "A, b! C; d-e f", "x a b c d y c d e f z", "é É ß a b", "b c", "a a a a a a", "q " * 300 + "a b c d " * 40, "b c d e f" + "\n" * 3 + "g", "K a b c d", "a b c d", "a b c d",
]
ITEMS = [(1, "a b c d e f"), (2, "B C"), (10, "a a a"), (3, None), (4, ""), (None, "q q q q"), (5, "nowhere at all to be found"), (5, "x a")]


def rows(spark, **options):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return d.hits(docs, bench, window=4, **options), docs, bench


def check(out):
    for r in out.orderBy("doc_id").collect():
        n, hit, found = plain(TEXTS[r.doc_id], ITEMS, 4)
        assert (r["__hits"].n_words, [i for a, b in r["__hits"].spans for i in range(a, b)], r["__hits"].items) == (n, hit, found)


def test_against_plain_search(spark):
    check(rows(spark)[0])


def test_small_shards_and_many_blocks(spark):
    check(rows(spark, shard_words=3, block_chars=10)[0])


def test_removal_keeps_the_rest_and_the_columns(spark):
    _, docs, bench = rows(spark)
    docs = docs.selectExpr("*", "1 AS spans", "2 AS item_id")
    out = d.remove(docs, bench, window=4)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[5] == " y  z" or WORD.findall(lower(got[5])) == ["y", "z"]
    assert got[0] is None and got[2] == "..." and got[13] == ""
    for i, t in got.items():
        n, hit, _ = plain(TEXTS[i], ITEMS, 4)
        assert WORD.findall(lower(t)) == [w for k, w in enumerate(WORD.findall(lower(TEXTS[i]))) if k not in hit]


def test_empty_tables(spark):
    _, docs, bench = rows(spark)
    assert d.hits(docs.limit(0), bench).count() == 0
    assert all(not r["__hits"].spans for r in d.hits(docs, bench.limit(0)).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=5))
def test_index_finds_every_place(seq, phrase):
    seq = np.array([*seq, 0], np.int32)
    index = d.FMIndex(seq)
    who, lo, hi = index.search(np.array([phrase], np.int32))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(who) else []
    assert found == [i for i in range(len(seq)) if seq[i : i + len(phrase)].tolist() == phrase]


def test_words_above_the_largest_of_the_shard():
    texts, items = [[b"a"]], [("1", "a"), ("2", "b")]
    spans, found = d.search_shard(texts, d.Windows(items, 10))
    assert [[tuple(x) for x in s] for s in spans] == [[(0, 1)]] and found == [{"1"}]
    for k in (2, 3, 5):  # the shard's largest number is 2^k - 1, the benchmark has more words
        names = [f"w{i}" for i in range(2**k + 3)]
        items = [(str(i), w) for i, w in enumerate(names)]
        text = [w.encode() for w in names[: 2**k - 1]]
        spans, found = d.search_shard([text], d.Windows(items, 10))
        assert sorted(tuple(x) for x in spans[0]) == [(i, i + 1) for i in range(2**k - 1)] and found == [{str(i) for i in range(2**k - 1)}]


def test_ranks():
    rng = random.Random(3)
    seq = np.array([rng.randrange(11) for _ in range(500)], np.int64)
    tree = d.Wavelet(seq, 10)
    i = np.arange(501)
    for s in range(11):
        assert tree.rank(np.full(501, s), i).tolist() == [int((seq[:k] == s).sum()) for k in i]
    assert tree.at(np.arange(500)).tolist() == seq.tolist()


def test_columns_named_like_its_own(spark):
    _, docs, bench = rows(spark)
    clash = docs.selectExpr("*", "1 AS __hits", "2 AS _hits", "3 AS hits")
    out = d.remove(clash, bench, window=4)
    assert out.columns == clash.columns and {(r["__hits"], r["_hits"], r.hits) for r in out.collect()} == {(1, 2, 3)}
