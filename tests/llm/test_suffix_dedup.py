import hashlib
import random

import pytest

from lodeworks.llm import suffix_dedup as s


def plain(docs):
    first, out = {}, []
    for doc, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - s.SPAN + 1):
            w, at = raw[i : i + s.SPAN], (2**63 if doc is None else doc, i)
            first[w] = min(first.get(w, at), at)
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - s.SPAN + 1):
            if first[raw[i : i + s.SPAN]] < (2**63 if doc is None else doc, i):
                gone[i : i + s.SPAN] = b"\1" * s.SPAN
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(raw, gone, strict=True) if not x)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(15, 60)) for _ in range(4)]
    docs = [(i, " ".join(rng.choice([prose(rng.randint(1, 30)), rng.choice(passages), rng.choice(passages)[:130]]) for _ in range(rng.randint(1, 5)))) for i in range(n)]
    docs += [(100, docs[3][1]), (101, docs[3][1] + "x"), (102, None), (103, ""), (104, "short"), (105, "ab" * 400), (106, "z" * 350), (107, "z" * 100), (50, docs[50][1]), (None, docs[2][1]), (None, docs[2][1]), (7, docs[9][1]), (108, "\0" * 250), (109, "\0" * 120 + "q")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, most, part", [(1, 2_000, 1 << 24), (2, 3, 2_000), (3, 0, 4_000), (4, 2_000, 3_000)])
def test_against_every_window(spark, seed, most, part):
    docs = corpus(seed)
    rows = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, to int").repartition(3)
    got = sorted((tuple(r) for r in s.deduped(rows, part_bytes=part, most=most).collect()), key=repr)
    assert got == plain(docs)


def test_empty_table(spark):
    assert s.deduped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_in_pieces(spark):
    docs = corpus(5)
    got = sorted((tuple(r) for r in s.deduped(spark.createDataFrame(docs, "doc_id long, text string"), chunk=300).collect()), key=repr)
    assert got == plain(docs)
