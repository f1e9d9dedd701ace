"""Quality rules: base limits, then thresholds that each language and source sets for itself.

A sketch holds, for a language, a source and a feature, how many documents fall into each bucket; a bucket keeps the six
leading bits of a value, so a quantile read from it is within a 32nd. Sketches merge by adding counts: those of a
language's sources give the language's, those of all languages the corpus's. They hold the documents that have the feature
at all: most have no symbol, no line twice and no words in repeats, and quartiles over all would be nought. The upper threshold
is the upper edge of the third quartile's bucket plus `spread` times its distance to the lower edge of the first's (word
length has a lower threshold too), so no constant is in it, and it is above every value of a group whose values are alike.
A source with fewer than `min_rows` documents that have a feature uses its language's sketch of it, then the corpus's.
Documents that fail the base limits take no part in the sketches. Then documents are joined with their group's thresholds.

Native: only SQL functions.

Defined results. Null and empty texts have no words and fail the base limit. Null language or source counts as "". A
group none of whose documents pass the base limits has no thresholds and needs none. Repeated rows are judged one by
one, and count in the sketches as often as they occur. An empty table gives an empty result. `keep` returns the input's
columns whatever their names. Whole texts are used.

Scale: one narrow pass over the texts, whose measures are kept in the shared folder, and an aggregation of at most 32 buckets for each doubling of a value, by feature and group, combined before
its shuffle, so that a source with a third of all rows costs no more than another. The thresholds are broadcast where
they are `max_broadcast` rows at most; beyond that they are copied `salts` times and joined on a salted key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm.text import let, words
from lodeworks.runtime import cut, is_small, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
SPREAD = 4
#: Leading bits of a value that its bucket keeps.
BITS = 6
MIN_ROWS = 30
#: Thousandths of the characters, of the lines or of the words; tenths of a character.
FEATURES = ("symbols", "capitals", "lines", "repeated", "length")
MAX_BROADCAST = 100_000
SALTS = 64


def _words_in_repeats(starts: Column) -> Column:
    """Words covered by windows at these ascending starts: each covers up to the next start, and no more than itself."""
    return let(starts, lambda at: F.aggregate(at, F.lit(0), lambda n, x: n + F.lit(WINDOW)) - F.aggregate(F.transform(at, lambda x, i: F.greatest(F.lit(0), x + WINDOW - F.coalesce(F.get(at, i + 1), x + WINDOW))), F.lit(0), lambda n, x: n + x))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more. Most texts have none; only the others are sorted."""
    ordered = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, x.h == F.get(s, k - 1).h), F.lit(False)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False)))
    covered = lambda h: _words_in_repeats(F.array_sort(F.transform(let(ordered(h), again), lambda x: x.i)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def _counts(whole: Column) -> Column:
    n = F.size
    windows = lambda w: F.when(n(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n(w) - (WINDOW - 1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    of_words = let(words(whole), lambda w: F.struct(
        n(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(windows(w)).cast("long").alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(n(x).cast("long").alias("n_lines"), (n(x) - n(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda x: F.struct(
        x.w.n_words.alias("n_words"), x.w.word_chars.alias("word_chars"), x.w.n_repeat_words.alias("n_repeat_words"), x.l.n_lines.alias("n_lines"), x.l.n_dup_lines.alias("n_dup_lines"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(whole, F.lit("[A-Z!]")).cast("long").alias("n_capitals"),
    ))


def _with_features(c: Column) -> Column:
    share = lambda k, of: F.floor(F.lit(1000) * k / F.greatest(F.lit(1), of)).cast("long")
    failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEATED * c.n_words)
    return F.struct(
        *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"),
        share(c.n_symbols, c.word_chars).alias("symbols"), share(c.n_capitals, c.word_chars).alias("capitals"), share(c.n_dup_lines, c.n_lines).alias("lines"),
        share(c.n_repeat_words, c.n_words).alias("repeated"), F.floor(F.lit(10) * c.word_chars / F.greatest(F.lit(1), c.n_words)).cast("long").alias("length"),
    )


def measures(text: str = "text") -> Column:
    """A struct: the counts of the base rules, base_failed, and the features."""
    return let(_counts(F.coalesce(F.col(f"`{text}`"), F.lit(""))), _with_features)


def _shift(value: Column) -> Column:
    return F.greatest(F.lit(0), F.length(F.bin(value)) - BITS)


def bucket(value: Column) -> Column:
    """The lower edge of a value's bucket: its leading bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _shift(value)), _shift(value))


def upper_edge(lower: Column) -> Column:
    """The first value above the bucket that begins at lower."""
    return lower + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(lower))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n: from rows (lang, source, q: `measures`)."""
    some = lambda q: F.when(~q.base_failed, F.filter(F.array(*(F.struct(F.lit(f).alias("feature"), q[f].alias("value")) for f in FEATURES)), lambda x: x.value > 0))
    each = rows.select("lang", "source", F.explode(some(F.col("q"))).alias("x")).select("lang", "source", "x.feature", bucket(F.col("x.value")).alias("bucket"))
    return each.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *by: str) -> DataFrame:
    """For each group and feature: n (documents that have it), lo and hi, the outer edges of the quartiles' buckets."""
    keys = [*by, "feature"]
    upto = sketch.select("*", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    return upto.groupBy(*keys).agg(F.max("total").alias("n"), quartile(1).alias("lo"), upper_edge(quartile(3)).alias("hi"))


def thresholds(rows: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source, low_ and high_ of each feature: one row for each pair that has a sketch. rows: lang, source, q."""
    own = cut(sketches(rows))
    by_lang = merged(own, "lang")
    level = lambda sketch, name, *by: fences(sketch, *by).select(*by, "feature", F.struct("n", "lo", "hi").alias(name))
    out = level(own, "s", "lang", "source").join(level(by_lang, "l", "lang"), ["lang", "feature"])
    out = out.join(F.broadcast(level(merged(by_lang), "c")), "feature")  # a row a feature
    pick = lambda x: F.when(F.col("s.n") >= min_rows, F.col(f"s.{x}")).when(F.col("l.n") >= min_rows, F.col(f"l.{x}")).otherwise(F.col(f"c.{x}"))
    each = out.select("lang", "source", "feature", pick("lo").alias("lo"), pick("hi").alias("hi"))
    each = each.select("lang", "source", "feature", (F.col("lo") - spread * (F.col("hi") - F.col("lo"))).alias("low"), (F.col("hi") + spread * (F.col("hi") - F.col("lo"))).alias("high"))
    return each.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == f, F.col(x))).alias(f"{x}_{f}") for f in FEATURES for x in ("low", "high")))


def judged(docs: DataFrame, spread: int = SPREAD, min_rows: int = MIN_ROWS, text: str = "text", lang: str = "lang", source: str = "source", max_broadcast: int = MAX_BROADCAST, drop_text: bool = False) -> DataFrame:
    """row (a struct of docs' columns, without the text if drop_text), q (`measures`) and kept."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if not (drop_text and c == text)))
    group = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    out = cut(docs.select(own.alias("row"), *group, measures(text).alias("q")))
    limits = cut(thresholds(out, spread, min_rows))
    limits = limits.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.struct(*limits.columns[2:]).alias("t"))
    on = (F.col("lang") == F.col("of_lang")) & (F.col("source") == F.col("of_source"))
    if is_small(limits, max_broadcast):
        out = out.join(F.broadcast(limits), on, "left")
    else:
        out = out.withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(SALTS)))
        limits = limits.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.join(limits, on & (F.col("salt") == F.col("copy")), "left")
    outside = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"q.{f}") > F.col(f"t.high_{f}"), F.lit(False)) for f in FEATURES))
    outside = outside | F.coalesce(F.col("q.length") < F.col("t.low_length"), F.lit(False))
    return out.select("row", "q", (~F.col("q.base_failed") & ~outside).alias("kept"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judged(docs, **options).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), drop_text=True)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select("row.doc_id", *(F.col(f"q.{c}") for c in counts), "kept")


def _limits_sql(level: str, by: str) -> str:
    """Quartiles' outer edges of the sketches at one level."""
    return f"""
{level}_run AS (SELECT *, sum(n) OVER (PARTITION BY {by} feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by} feature) AS total FROM {level}),
{level}_q AS (SELECT {by} feature, min(bucket) FILTER (4 * upto >= total) AS lo, min(bucket) FILTER (4 * upto >= 3 * total) AS b, max(total) AS docs FROM {level}_run GROUP BY {by} feature),
{level}_f AS (SELECT {by} feature, docs, lo, b + (1::BIGINT << greatest(0, length(bin(b)) - {BITS})::BIGINT) AS hi FROM {level}_q)"""


_SPLIT = "[ \\t-\\r]+"
OP5_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPLIT}'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT r, i, ws[i:i + {WINDOW - 1}] AS five FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS i)
), repeats AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeats, range({WINDOW}) AS g(k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM w
), counts AS (
  SELECT r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z!]'))::BIGINT AS n_capitals,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r)
), features AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
         1000 * n_symbols // greatest(1, word_chars) AS symbols, 1000 * n_capitals // greatest(1, word_chars) AS capitals,
         1000 * n_dup_lines // greatest(1, n_lines) AS lines, 1000 * n_repeat_words // greatest(1, n_words) AS repeated, 10 * word_chars // greatest(1, n_words) AS length
  FROM counts
), long AS (
  SELECT r, lang, source, unnest(['symbols', 'capitals', 'lines', 'repeated', 'length']) AS feature, unnest([symbols, capitals, lines, repeated, length]) AS v, base_failed FROM features
), s AS (
  SELECT lang, source, feature, (v >> greatest(0, length(bin(v)) - {BITS})::BIGINT) << greatest(0, length(bin(v)) - {BITS})::BIGINT AS bucket, count(*) AS n
  FROM long WHERE NOT base_failed AND v > 0 GROUP BY ALL
), l AS (SELECT lang, feature, bucket, sum(n) AS n FROM s GROUP BY ALL),
c AS (SELECT feature, bucket, sum(n) AS n FROM l GROUP BY ALL),
{_limits_sql("s", "lang, source,")},
{_limits_sql("l", "lang,")},
{_limits_sql("c", "")},
picked AS (
  SELECT s_f.lang, s_f.source, s_f.feature, CASE WHEN s_f.docs >= {MIN_ROWS} THEN s_f.lo WHEN l_f.docs >= {MIN_ROWS} THEN l_f.lo ELSE c_f.lo END AS lo,
         CASE WHEN s_f.docs >= {MIN_ROWS} THEN s_f.hi WHEN l_f.docs >= {MIN_ROWS} THEN l_f.hi ELSE c_f.hi END AS hi
  FROM s_f JOIN l_f ON s_f.lang = l_f.lang AND s_f.feature = l_f.feature JOIN c_f ON s_f.feature = c_f.feature
), bad AS (
  SELECT DISTINCT r FROM long JOIN picked USING (lang, source, feature) WHERE v > hi + {SPREAD} * (hi - lo) OR (feature = 'length' AND v < lo - {SPREAD} * (hi - lo))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM features LEFT JOIN bad ON features.r = bad.r
"""
