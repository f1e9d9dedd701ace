import math
import time
from pathlib import Path

import numpy as np
import pytest

from lodeworks.llm import language_id as g
from lodeworks.runtime import table

WORDS = {"en": "the and of to in that is for with was", "fr": "le la les des une que dans pour elle est", "de": "der die das und ist nicht ein mit auf den"}


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), 60)), lang) for i, lang in enumerate([*WORDS] * 20)] + [(99, None, "en"), (98, "x", None)]
    return g.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, lang string")


def test_visible_text_and_declarations():
    assert g.visible("<p>a&amp;b<script>var t='</p>'</script><!-- c --><style>p{}</style>d").split() == ["a&b", "d"]
    assert g.declared('<!DOCTYPE html><html class="x" LANG=\'fr-CA\'>') == "fr" and g.declared("<html>") is None


def test_evidence_of_all_kinds(spark, model):
    langs, logs = model
    text = lambda lang, n=30: f"<html lang='{lang}'><p>{(WORDS[lang] + ' ') * n}</p>"
    rows = [("http://a.example.fr/x", text("fr")), ("http://a.example.fr/y", text("fr")), ("http://a.example.fr/z", "<html lang='fr'>"), ("http://a.example.fr/w", None), ("http://b.example.de/", text("de")), ("http://b.example.de/q", "<html><p>" + WORDS["de"] + "</p>"), (None, text("en")), ("bad", ""), ("http://c.org/", text("de").replace("lang='de'", "lang='en'"))]
    got = {r.page_id: r for r in g.fused(g.cut(g.evidence(pages(spark, rows), langs, logs)), langs).collect()}
    assert langs == ["de", "en", "fr"]
    assert [got[i].lang for i in range(7)] == ["fr", "fr", "fr", "fr", "de", "de", "en"]
    assert got[8].lang == "de" and got[8].declared == "en"
    assert 0 < got[3].confidence < got[0].confidence <= 1
    shuffled = {r.page_id: r for r in g.fused(g.cut(g.evidence(pages(spark, rows), langs, logs)), langs, max_broadcast=0).collect()}
    assert shuffled == got


def test_nothing_to_learn_from_and_nothing_to_judge(spark, model):
    none = g.trained(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none[0] == []
    rows = pages(spark, [("http://a.fr/", "<p>x")])
    assert [r.lang for r in g.fused(g.evidence(rows, *none), none[0]).collect()] == [None]
    assert g.fused(g.cut(g.evidence(rows.limit(0), *model)), model[0]).count() == 0
    with pytest.raises(ValueError):
        g.trained(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string"), max_langs=1)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the given tables")
def test_accuracy_of_the_text_alone(spark):
    d = "/root/testdata/sf0.01"
    langs, logs = g.trained(table(spark, d, "documents"))
    rows = g.cut(g.evidence(table(spark, d, "pages"), langs, logs)).collect()
    assert sum(langs[int(np.argmax(r.loglik))] == r.declared for r in rows) >= 0.97 * len(rows)


def plain_fusion(rows, langs, strength):
    """One page after the other, from sums over the others."""
    n, m = len(langs), 10**6
    out = {}
    for r in rows:
        others = [x for x in rows if x is not r]
        sums = lambda fits: [sum(x.p[i] for x in others if fits(x)) for i in range(n)]  # noqa: E731, B023
        last = lambda x, k: ".".join(x.host.split(".")[-k:])
        all_ = sums(lambda x: True)
        shares = [(s + m) / (sum(all_) + m * n) for s in all_]
        for fits in (lambda x: last(x, 1) == last(r, 1), lambda x: last(x, 2) == last(r, 2), lambda x: x.host == r.host):  # noqa: B023
            own = sums(fits)
            shares = [(s + strength * m * t) / (sum(own) + strength * m) for s, t in zip(own, shares, strict=True)]
        seen_in = lambda fits: [math.log((s + strength * m * 0.1) / (t + strength * m)) for s, t in zip(sums(fits), all_, strict=True)]  # noqa: E731, B023
        said = seen_in(lambda x: x.declared == r.declared) if r.declared is not None else [0.0] * n  # noqa: B023
        score = [round(a + math.log(b) + c + d, 9) for a, b, c, d in zip(r.loglik, shares, seen_in(lambda x: last(x, 1) == last(r, 1)), said, strict=True)]  # noqa: B023
        out[r.page_id] = langs[score.index(max(score))], round(1 / sum(math.exp(x - max(score)) for x in score), 5)
    return out


def test_fusion_against_plain_python(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "pages"))
    langs, model = g.trained(docs)
    seen = g.cut(g.evidence(pages, langs, model, most=3))  # little text, so that the rest matters
    got = {r.page_id: (r.lang, round(r.confidence, 5)) for r in g.fused(seen, langs).collect()}
    wanted = plain_fusion(seen.collect(), langs, g.STRENGTH)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(abs(got[k][1] - wanted[k][1]) < 1e-4 for k in got)


def test_registered_query(spark):
    out = g.op10_language_id(spark, "/root/testdata/sf0.001")
    assert out.columns == ["page_id", "lang", "text_lang", "declared", "host", "confidence"]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_markup_that_is_never_closed():
    assert g.visible("a<script>x</script >b<!-- c -->d<style>e</STYLE>f<br/>g").split() == ["a", "b", "d", "f", "g"]
    assert g.visible("a <!-- b c> d").split() == ["a", "d"] and g.visible("1 < 2").split() == ["1", "<", "2"]
    began = time.perf_counter()
    for part in ("<script ", "<script>", "<!--", "<html ", "<style x", "<"):
        g.visible(part * 50_000), g.declared(part * 50_000)
    assert time.perf_counter() - began < 5
    assert g.declared("<HTML class=x LANG = 'Fr-ca'>") == "fr" and g.declared("<html><p lang=de>") is None
