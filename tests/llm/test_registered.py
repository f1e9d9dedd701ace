"""The registered queries over the smallest tables: against their SQL, or against plain Python."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import test_suffix_dedup  # in this folder

from lodeworks.llm import nbest, orc_tokens, registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in cur.fetchall()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_op6(spark, docs):
    out = registry.QUERIES["op6_suffix_dedup"](spark, str(DATA))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == test_suffix_dedup.plain(sorted(docs.items()))


def test_op8(spark, docs):
    out = registry.QUERIES["op8_orc_tokens"](spark, str(DATA))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    tokenizer, at, wanted = orc_tokens.Encoder.of(orc_tokens.tokenizer_path()).tokenizer, 0, []
    for i, text in sorted(docs.items()):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out.collect())) == wanted


def test_op9(spark, docs):
    out = registry.QUERIES["op9_nbest_segmentation"](spark, str(DATA))
    assert out.columns == ["doc_id", "n_ids", "ids_sha256", "scores", "crcs", "round_trip"]
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.round_trip for r in rows)
    tool = nbest.Segmenter.of(nbest.model_path(), nbest.N_BEST)
    for r in rows[:40]:
        whole = nbest.n_best(nbest.SPACE + (docs[r.doc_id] or "").replace(" ", nbest.SPACE), tool.pieces) if docs[r.doc_id] else [(0, ())]
        assert r.scores == [s for s, _ in whole]  # the text as one lattice, not stretch by stretch
