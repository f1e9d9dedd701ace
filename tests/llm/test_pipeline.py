import hashlib
from pathlib import Path

import duckdb
import pytest
import test_decontaminate  # in this folder
import test_secret_scan

from lodeworks.llm import near_dup, nbest, quality_rules

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    import random

    rng = random.Random(4)
    prose = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(k))
    texts = [prose(80) for _ in range(60)]
    passage = prose(25)
    texts[5] = texts[5] + " " + passage + " tail words here"
    texts[6] = texts[6] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(70, texts[0], "en", "s", 1), (71, "too short", "en", "s", 1), (72, None, "en", "s", 0), (73, "### $$$ " * 60, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 3:
            by_id = {r.doc_id: r for r in docs.collect()}
            assert sorted(by_id) == list(range(60))
            assert passage not in by_id[5].text and by_id[5].text.endswith("tail words here") and by_id[5].text.startswith(texts[5][:100])
            assert "04dbebab" not in by_id[6].text and by_id[6].text.endswith(" end") and by_id[6].n_chars == len(by_id[6].text)
            assert all(by_id[i].text == texts[i] for i in range(60) if i not in (5, 6))
    assert docs.count() == 60 and docs.where("NOT round_trip").count() == 0


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_stages_against_plain_python(spark, tmp_path):
    """Each stage's rows over the smallest tables, from its own input, one document after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    assert len(before) == docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count(), name
        if name == "quality rules":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
            assert set(after) == {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.OP5_SQL})").fetchall() if kept}
            assert after == {i: before[i] for i in after}
        elif name == "near duplicates":
            assert after == {i: before[i] for i in plain_groups({i: r.text for i, r in before.items()})}
        elif name == "benchmark passages":
            for i, r in before.items():
                hit, text = set(test_decontaminate.plain(r.text, bench, 10)[1]), r.text
                places = [m.span() for m in test_decontaminate.WORD.finditer(test_decontaminate.lower(text))]
                for w in sorted(hit, reverse=True):
                    a, b = places[w]
                    text = text[:a] + (text[places[w + 1][0] :] if w + 1 in hit else text[b:])
                assert after[i].text == text, i
        elif name == "secrets":
            for i, r in before.items():
                text, ends = r.text, len(r.text)
                for a, _, b in sorted(test_secret_scan.linked(r.text), reverse=True):
                    if b > ends:  # overlaps the one after it
                        a, b = min(a, ends), ends
                    text, ends = text[:a] + "[SECRET]" + text[b:], a
                assert after[i].text == text and after[i].n_chars == len(text), i
        else:
            tool = nbest.Segmenter.of(nbest.model_path(), nbest.N_BEST)
            for i, r in before.items():
                paths, _ = tool.paths(r.text)
                assert (after[i].n_ids, after[i].ids_sha256, after[i].scores, after[i].round_trip) == (len(paths[0][1]) // 4, hashlib.sha256(paths[0][1]).hexdigest(), [s for s, _ in paths], True)
        before = after


def plain_groups(texts):
    """The least id of each group of texts within three bits or four fifths alike."""
    fps = {i: near_dup.fingerprint(t.encode(), 5) for i, t in texts.items()}
    sets = {i: set(near_dup.shingles(t.encode(), 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and root[i] != root[j] and (bin(fps[i] ^ fps[j]).count("1") <= 3 or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                new, old = sorted((root[i], root[j]))
                root = {k: new if v == old else v for k, v in root.items()}
    return set(root.values())


def test_empty_tables_repeated_rows_nulls_and_other_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key int, q string, row int"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "some words that make up a text of more than ten words in all " + "and so on"
    rows = [(1, text, None, None, 1, 1, "q", 2), (1, text, None, None, 1, 1, "q", 2), (2, text, "en", "s", 1, 1, "q", 2), (None, text + " or so", "en", "s", 1, 1, "q", 2), (3, None, "en", "s", 0, 1, "q", 2), (4, "", "en", "s", 0, 1, "q", 2)]
    for docs, wanted in ((spark.createDataFrame([], schema), []), (spark.createDataFrame(rows, schema), [None, 1])):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert sorted(docs.columns) == sorted(x.split()[0] for x in schema.split(", "))
        assert sorted((r.doc_id for r in docs.collect()), key=lambda i: i or 0) == wanted
