import zlib

import numpy as np
import pytest

from lodeworks.llm import orc_tokens as o

ODD = [
    "<|STARTOFTEXT|> <|EndOfText|>, A<|ENDoftext|>b <|endoftext|>. X<| STARTOFTEXT |>", "<|a <|| |> <|>",
    "a\nb  c\t\td", "x y z", "ΑΣ ΟΔΟΣ, ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "é éx \r\n", "İstanbul 'S don't 'll we've", "", " ", "\x1c\x1f a", "漢字 ガ", "a​b ﻿ c", "Ⅷ ½ x̖̀ ﬀ",
    "foo. foo, foo.' foo'. foo's. A.B. U.S. 3. a3. x--y -- a- É. é. Foo!!! foo) (foo", "the cat́. a̸= b≠", "ẞ straße ÿ. Ǆ ǅ", "it's. its'; 'tis|'ll|x",
]


@pytest.fixture(scope="module")
def encoder():
    return o.Encoder.of(o.tokenizer_path())


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers_own(encoder, text):
    for _ in range(2):  # learnt, then remembered
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(o, "MEMORY", 2_000)
    encoder = o.Encoder(o.tokenizer_path())
    for i in range(30):
        text = f"word{i} other thing. Other{i % 3}, x{i}y"
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip_through_files(spark, encoder, tmp_path):
    docs = [(i * 3 % 50, t) for i, t in enumerate(ODD * 3)] + [(None, "null id"), (7, None), (7, "again"), (60, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    folder = str(tmp_path / "ids")
    o.write(df, folder, o.tokenizer_path(), parts=3)
    got = sorted(o.with_starts(o.read_digests(spark, folder)).collect(), key=lambda r: r.start)
    assert len(got) == len(docs)
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    digest = lambda t: (len(x := encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i if i is not None else -1, *digest(t)) for i, t in docs)
    assert [r.ids[-1] for r in o.find(spark, folder, [60]).collect()] == [1]


def test_the_file_has_stripes_row_indexes_and_bloom_filters_and_a_search_skips_by_them(spark, tmp_path):
    folder = str(tmp_path / "many")
    words = np.random.default_rng(1).integers(0, 10**9, 60_000)
    docs = spark.createDataFrame([(i * 2, " ".join(map(str, words[3 * i : 3 * i + 3]))) for i in range(20_000)], "doc_id long, text string")
    o.write(docs, folder, o.tokenizer_path(), parts=1, stride=1_000, stripe=64 << 10)
    (file,) = (tmp_path / "many").glob("*.orc")
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1_000 and reader.getStripes().size() > 1
    every = spark.sparkContext._gateway.new_array(jvm.boolean, 6)
    every[:] = [True] * 6
    index = reader.rows().readRowIndex(0, every, every)
    assert index.getRowGroupIndex()[1].getEntryCount() >= 1 and index.getBloomFilterIndex()[1].getBloomFilterCount() >= 1
    assert not any(index.getBloomFilterIndex()[k] for k in (2, 3, 4))  # on doc_id only

    def met(ids):
        found = o.find(spark, folder, ids)
        rows = [r.doc_id for r in found.collect()]
        return rows, found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert met([20_002]) == ([20_002], 1_000)  # one row group, by its least and greatest id
    rows, read = met([20_001])  # within a group's range, and in none: by its Bloom filter
    assert rows == [] and read == 0


def test_equal_and_null_ids_are_spread(spark, tmp_path):
    folder = str(tmp_path / "same")
    rows = [(None, f"text {i}") for i in range(300)] + [(5, f"other {i}") for i in range(300)]
    o.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, o.tokenizer_path(), parts=6)
    got = o.with_starts(o.read_digests(spark, folder)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 300
    assert len({r.part for r in got}) >= 4


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    o.write(spark.createDataFrame([], "doc_id long, text string"), folder, o.tokenizer_path(), parts=2)
    assert o.with_starts(o.read_digests(spark, folder)).count() == 0


def test_the_query_reads_its_files_once(spark):
    out = o.op8_orc_tokens(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # digests of stripes, read once, not once for the sums and once for the rows
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_a_piece_is_remembered_once_and_what_it_is_made_of_is_known(encoder):
    fresh = o.Encoder(o.tokenizer_path())
    fresh.ids("Zqword, zqword zqword; zqword. ſt Éa.")
    assert set(fresh.known) == {"", "Zqword,", "zqword", "zqword;", "zqword.", ",", ";", ".", "ſt", "Éa.", "Éa"}
    size = fresh.held
    fresh.ids("zqword zqword, . ;")
    assert "zqword," in fresh.known and fresh.held - size < 300  # one piece more, none of its parts again


@pytest.mark.parametrize("piece", ["foo.", "Foo!?", "É.", "Éa.", "...", "a.b", "<|x.", "", "x|", "'s.", "foo'."])
def test_parts_are_their_own_bodies(piece):
    for part in o.parted(piece):
        assert o.parted(part) == (part, "")
