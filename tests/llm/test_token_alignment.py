import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import token_alignment as o

DATA = Path("/root/testdata/sf0.001")
ODD = [
    "a  b", " a", "a ", "  ", " ", "\n", "a\n b", "a \nb", "a\n \nb", "x\ta \t b", "foo.\nBar baz", "it's 'tis we'll x's", "<|endoftext|> a<|endoftext|>b <s> </s> <unk> <0x41>", "é É ß ÿ × ÷", "漢字 かな ガ", "a b   c", "a\x1c b\x1c c",
    "a\x00b \x00", "🙂 a🙂b", "a▁b", "▁", "x ▁ y", "１２ ½ Ⅷ", "a\r\nb \r\n c;\r", "ﬀ x̖̀", "--- === ...", "   lots    of     spaces      ", "𝒳 ԱԲ", "1234567 8", "abc" * 400, "no-break sep  ", "　wide　",
]


@pytest.fixture(scope="module")
def tools():
    return o.Tokenizers(*o.paths())


def brute(tools, text):
    """Ids of the whole text, its groups by the places where both end, and its links by comparing ranges."""
    if not text:
        return [], [], [], []
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tools.a_bytes[i] for i in a) != raw or b"".join(tools.b_bytes[i] for i in b) != raw:
        return [], [], [], []

    def spans(ids, sizes):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + int(sizes[i])))
            at += int(sizes[i])
        return out

    x, y = spans(a, tools.a_size), spans(b, tools.b_size)
    ends = sorted({e for *_, e in x} & {e for *_, e in y})
    groups, links, at = [], [], 0
    for end in ends:
        p, q = [t for t in x if at <= t[1] < end], [t for t in y if at <= t[1] < end]
        groups.append((",".join(str(t[0]) for t in p) + "|" + ",".join(str(t[0]) for t in q)))
        links += [(s[0], t[0]) for s in p for t in q if max(s[1], t[1]) < min(s[2], t[2])]
        at = end
    return a, b, groups, links


def wanted(tools, texts):
    found = [brute(tools, t) for t in texts]
    counts = Counter(p for *_, links in found for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups, links in found:
        text = ";".join(groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), text))
    return out


def aligned(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, o.aligned(df, o.paths(), drop_text=True, **more).collect()), key=repr)


def test_parts_have_the_tokens_of_the_whole_text(tools):
    rng = random.Random(2)
    pool = [*ODD, "the", "Queueíes", "chßn.", "of,", "THAT!!\nIn,", "can't", "x\n", "\ny", "\t", "12,345.67", "ñgaci", "|"]
    texts = ODD + [rng.choice((" ", "", "\n", "  ")).join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(1_500)]
    one = o.Alignments(o.paths())
    for at in range(0, len(texts) * 2, 40):
        some = (texts * 2)[at : at + 40]
        places, counts = one.numbered(some)
        for text, end, n in zip(some, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            found, (a, b, groups, links) = places[end - n : end].tolist(), brute(tools, text)
            numbers = one.table()[found]
            if not numbers[:, 4].all():
                assert not a, text
                continue
            assert (";".join(one.groups[i].decode() for i in found), numbers[:, 0].sum(), numbers[:, 1].sum(), numbers[:, 3].sum()) == (";".join(groups), len(a), len(b), len(links)), text
            pairs = [p for i in found for p in one.links[one.link_ends[i] : one.link_ends[i + 1]]]
            assert pairs == [x << 32 | y for x, y in links], text


def test_the_quick_form_has_the_tokenizers_ids(tools):
    rng = random.Random(7)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    parts = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(3_000)] + ["".join(rng.choices(letters[32:], k=rng.randint(1, 9))) + rng.choice(("", ".", ",", "!!", "'s", "'ll")) for _ in range(3_000)]
    parts += [f"{p}\n{q}" for p, q in zip(parts[:500], parts[-500:], strict=True)]
    order, ids, counts = tools.encoded(parts)
    assert order == parts  # all of them are plain
    cut = lambda flat, n: [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert cut(ids[0], counts[0]) == [e.ids for e in tools.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
    assert cut(ids[1], counts[1]) == tools.b.encode(parts)


@pytest.mark.parametrize("more", [{}, {"head": 40}, {"head": 0}, {"memory": 3_000}, {"head": 25, "memory": 20_000}])
def test_numbers_groups_and_counts(spark, tools, monkeypatch, more):
    monkeypatch.setattr(o, "SLICE", 300)
    texts = [None, "", *ODD, *ODD[:5], "the cat sat on the mat, the end.", "the the the of the", "of of, THE The the"]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    expected = sorted(((i, *x) for (i, _), x in zip(rows, wanted(tools, texts), strict=True)), key=repr)
    assert aligned(spark, rows, **more) == expected


def test_repeated_rows_rows_of_one_id_clashing_names_and_empty_table(spark, tools):
    texts = ["a b a", "a b a", "a b", None]
    rows = [(1, t) for t in texts]
    assert aligned(spark, rows, head=0) == sorted(((1, *x) for x in wanted(tools, texts)), key=repr)
    df = spark.createDataFrame([(1, "a", 5, "x", 2)], "doc_id long, text string, pair int, _tail string, n int")
    for head in (0, 9):
        out = o.aligned(df, o.paths(), head=head, digest=True)
        assert out.columns == [*df.columns, *o.NUMBERS, "groups_sha256"] and [(r.pair, r._tail, r.n, r.n_links) for r in out.collect()] == [(5, "x", 2, 1)]
    assert o.aligned(df.limit(0), o.paths()).count() == 0
    with pytest.raises(ValueError, match="n_a"):
        o.aligned(df.withColumn("n_a", F.lit(1)), o.paths())


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_op13(spark, tools):
    out = o.op13_token_alignment(spark, str(DATA))
    assert out.columns == ["doc_id", *o.NUMBERS, "groups_sha256"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    assert sorted(map(tuple, out.collect())) == sorted((i, *x[:-1], digest(x[-1])) for (i, _), x in zip(docs, wanted(tools, [t for _, t in docs]), strict=True))
