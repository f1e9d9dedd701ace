"""Language ID: Bayesian fusion of a page's text, its declared language, its address suffix and its host's prior.

Text: naive Bayes over hashed byte trigrams, trained on every labelled document by grouped counts; a page's likelihood is
tempered to at most `evidence` trigrams' worth, as neighbouring trigrams are not independent. The text's posterior alone
then gives, by grouped sums over all pages, how often each language is declared and which address suffixes (last host
label) it has, and a prior for each host that is smoothed towards its domain's (last two labels), that towards the
suffix's, that towards the corpus's. A page's own share is taken out of all of these sums, so that what occurs on one page only says
nothing about it. The fused score is the sum of the four logarithms.

Defined results. Null or empty html: no text and no declaration, other evidence decides; null or malformed url: the empty
host. Ties: the language first in order. Documents with a null lang train nothing. Without any labelled document the
language is null. Repeated pages are judged one by one. An empty table gives an empty result. Sums are of whole millionths, so that they don't depend on the order.
Other columns are not read. Texts are used whole; of a page's html, tags, comments, scripts and styles are left out.

Scale: one narrow pass over documents and one over pages; then rows without text. Trigram counts are combined in each task to at most
`BUCKETS` rows a language; languages are `max_langs` at most (an error otherwise), which bounds the model that is
broadcast. Sums by host are combined before their shuffle; they are broadcast where they are few, else joined by key
with skew splitting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.text import let
from lodeworks.llm.url_filter import host_of
from lodeworks.runtime import cut, is_small, ship, table

BUCKETS = 8_192
EVIDENCE = 60
STRENGTH = 4.0
MAX_LANGS = 500
MAX_BROADCAST = 2_000_000  # numbers
MILLION = 1_000_000

_OPEN = re.compile(r"<(?:(script|style)\b|(!--))?", re.I)
_CLOSE = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->")}
_LANG = re.compile(r"""\blang\s*=\s*["']?\s*([A-Za-z]+)""", re.I)
_HTML = re.compile(r"<html\b[^<>]*", re.I)


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of the text's bytes, lower-cased, white space as one space."""
    raw = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77)) + raw[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ mixed >> 15) * np.uint32(0x2C1B3C6D) >> 19).astype(np.int64)  # 13 bits: BUCKETS


def visible(html: str) -> str:
    """What is not in a tag, a comment, a script or a style. One that is never closed ends with its tag, so the work is linear."""
    out, at, open_ended = [], 0, set()
    while found := _OPEN.search(html, at):
        out.append(html[at : found.start()])
        kind = (found[1] or found[2] or "").lower()
        closed = None if not kind or kind in open_ended else _CLOSE[kind].search(html, found.end())
        if closed:
            at = closed.end()
            continue
        if kind:
            open_ended.add(kind)
        at = html.find(">", found.start()) + 1
        if not at:
            out.append(html[found.start() :])
            at = len(html)
            break
    out.append(html[at:])
    return unescape(" ".join(out))


def declared(html: str) -> str | None:
    """The language that the first html tag declares."""
    tag = _HTML.search(html)
    found = _LANG.search(tag[0]) if tag else None
    return found[1].lower() if found else None


def trained(docs: DataFrame, max_langs: int = MAX_LANGS, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the logarithm of each bucket's share in each (buckets x languages)."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t.is_valid:
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(trigrams(t.as_py()), minlength=BUCKETS)
        for name, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    langs = [r[0] for r in counts.select("lang").distinct().limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages are labelled")
    langs.sort()
    total = np.full((BUCKETS, len(langs)), 0.5)
    for r in counts.toLocalIterator():  # BUCKETS rows a language at most
        total[r[1], langs.index(r[0])] += r[2]
    return langs, np.log(total / total.sum(axis=0)) if langs else total


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, most: int = EVIDENCE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, declared, n_trigrams, loglik (an array by language, tempered), p (the text's posterior, millionths)."""
    spark = pages.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)
    n = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = known.value
        for batch in batches:
            said, sizes, likely, share = [], [], [], []
            for h in batch.column(2):
                page = h.as_py() or ""
                said.append(declared(page))
                at = trigrams(visible(page))
                sizes.append(len(at))
                score = logs[at].sum(axis=0) * (min(1.0, most / len(at)) if len(at) else 0.0)
                score -= score.max()
                p = np.exp(score)
                likely.append(score.tolist())
                share.append(np.rint(p / p.sum() * MILLION).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(sizes, pa.int64()), pa.array(likely, pa.list_(pa.float64())), pa.array(share, pa.list_(pa.int64()))],
                names=["page_id", "host", "declared", "n_trigrams", "loglik", "p"],
            )

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    if not n:
        empty = {"declared": "string", "n_trigrams": "long", "loglik": "array<double>", "p": "array<bigint>"}
        return rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    return rows.withColumn("host", F.coalesce("host", F.lit(""))).mapInArrow(run, "page_id long, host string, declared string, n_trigrams long, loglik array<double>, p array<long>")


def _sums(rows: DataFrame, by: str, n: int) -> DataFrame:
    """by, s (sums of p by language, as an array)."""
    each = rows.groupBy(by).agg(*(F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(n)))
    return each.select(by, F.array(*(f"s{i}" for i in range(n))).alias("s"))


def _total(sums: Column) -> Column:
    return F.aggregate(sums, F.lit(0).cast("long"), lambda a, b: a + b)


def _smoothed(sums: Column, towards: Column, strength: float) -> Column:
    """Shares of sums, with `strength` pages' worth of the shares above added."""
    both = F.struct(sums.alias("s"), towards.alias("t"))
    return let(both, lambda x: F.zip_with(x.s, x.t, lambda s, t: (s + strength * MILLION * t) / (_total(x.s) + strength * MILLION)))


def fused(seen: DataFrame, langs: list[str], strength: float = STRENGTH, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, lang, text_lang, declared, host, confidence. seen: from `evidence`, read several times: cut it first."""
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return seen.select("page_id", none.alias("lang"), none.alias("text_lang"), "declared", "host", F.lit(None).cast("double").alias("confidence"))
    domain = F.substring_index("host", ".", -2)
    hosts = cut(_sums(seen, "host", n)).select("host", F.col("s").alias("p"), domain.alias("domain"), F.substring_index("host", ".", -1).alias("suffix"))
    domains = _sums(hosts, "domain", n).withColumnRenamed("s", "of_domain")
    suffixes = _sums(hosts, "suffix", n).withColumnRenamed("s", "of_suffix")
    corpus = cut(_sums(hosts.withColumn("all", F.lit(1)), "all", n)).first()
    total = F.array(*(F.lit(s) for s in corpus["s"])) if corpus else F.array(*(F.lit(0).cast("long") for _ in langs))
    above = hosts.join(domains, "domain").join(suffixes, "suffix").select("host", F.col("p").alias("of_host"), "of_domain", "of_suffix")
    said = _sums(seen.where("declared IS NOT NULL"), "declared", n).withColumnRenamed("s", "of_declared")
    rows = max_broadcast // (4 * n)  # a row has three lists of n numbers and some more: what is broadcast is bounded in numbers, not in rows
    out = _joined(_joined(seen, above, "host", rows), said, "declared", rows)
    # all without the page's own share
    for c, sums in (("of_host", "of_host"), ("of_domain", "of_domain"), ("of_suffix", "of_suffix"), ("of_declared", "of_declared"), ("of_all", total)):
        out = out.withColumn(c, F.zip_with(sums, "p", lambda a, b: a - b))
    corpus_share = let(F.col("of_all"), lambda x: F.transform(x, lambda s: (s + MILLION) / (_total(x) + MILLION * n)))
    shares = corpus_share
    for c in ("of_suffix", "of_domain", "of_host"):
        shares = _smoothed(F.col(c), shares, strength)
    host_log = F.transform(shares, lambda x: F.log(x))
    seen_in = lambda c: F.zip_with(c, "of_all", lambda s, t: F.log((s + strength * MILLION * 0.1) / (t + strength * MILLION)))
    flat = F.array(*(F.lit(0.0) for _ in langs))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add("loglik", host_log), add(seen_in("of_suffix"), F.coalesce(seen_in("of_declared"), flat)))
    out = out.withColumn("score", F.transform(score, lambda x: F.round(x, 9)))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    sure = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return out.select("page_id", best(F.col("score")).alias("lang"), best(F.col("p")).alias("text_lang"), "declared", "host", F.round(sure, 6).alias("confidence"))


def _joined(rows: DataFrame, few: DataFrame, by: str, max_broadcast: int) -> DataFrame:
    few = cut(few)
    return rows.join(F.broadcast(few) if is_small(few, max_broadcast) else few, by, "left")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = trained(table(spark, sf_dir, "documents"))
    return fused(cut(evidence(table(spark, sf_dir, "pages"), langs, model)), langs)
