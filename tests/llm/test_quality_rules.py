import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodeworks.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


rng = random.Random(5)
PROSE = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(30, 90))) for _ in range(120)]
ODD = [None, "", " \n\t", "one two", "a b c d e " * 5, "a b c d e x a b c d e y " + PROSE[0], "l1\nl1\n \n\nl2 \nl2\n" + PROSE[1], "é ü ß " + PROSE[2], "### $$$ &&& |||\n" * 30, "a\x0bb\x0cc\rd " + PROSE[3], "w\u00a0v " * 20, PROSE[4] + "\n" + PROSE[4], "x" * 100_000]


def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", "clash") for i, t in enumerate(PROSE + ODD + ODD[3:4])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")


def measured(rows):
    group = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return rows.select("doc_id", "text", *group, q.measures().alias("q"))


def test_counts_against_plain_python(spark):
    for r in measured(docs(spark)).collect():
        c = r.q
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == plain(r.text), r.text
        assert c.base_failed == (c.n_words < 10 or 100 * c.n_repeat_words > 20 * c.n_words)


def test_prose_stays_and_symbols_go(spark):
    kept = {r.doc_id for r in q.keep(docs(spark)).collect()}
    assert set(range(len(PROSE))) <= kept
    assert not kept & {len(PROSE) + ODD.index(t) for t in (None, "", "one two", "### $$$ &&& |||\n" * 30)}


def test_columns_and_empty_table(spark):
    out = q.keep(docs(spark))
    assert out.columns == docs(spark).columns
    assert q.keep(docs(spark).limit(0)).count() == 0


def test_salted_join_gives_the_same(spark):
    a, b = (sorted(r.doc_id for r in q.keep(docs(spark), max_broadcast=m).collect()) for m in (100, 0))
    assert a == b


def test_small_groups_use_larger_ones(spark):
    few = measured(docs(spark)).withColumn("source", F.when(F.col("doc_id") == 0, "tiny").otherwise(F.col("source")))
    rows = {(r.lang, r.source): r for r in q.thresholds(few).collect()}
    own = {(r.lang, r.source): r for r in q.thresholds(few.withColumn("source", F.lit("all"))).collect()}
    assert rows["", "tiny"].high_length == own["", "all"].high_length


def test_sketches_merge(spark):
    rows = measured(docs(spark)).withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    whole = {(r.feature, r.bucket): r.n for r in q.sketches(rows).collect()}
    halves = [q.sketches(rows.where(f"doc_id % 2 = {i}")) for i in (0, 1)]
    assert {(r.feature, r.bucket): r.n for r in q.merged(halves[0].union(halves[1]), "lang", "source").collect()} == whole
    values = spark.range(1, 3000).select("id", q.bucket(F.col("id")).alias("b"), q.upper_edge(q.bucket(F.col("id"))).alias("u")).collect()
    assert all(r.b <= r.id < r.u and 32 * (r.u - r.b) <= max(32, r.b) for r in values)


def test_thresholds_come_from_the_group_and_keep_what_is_alike(spark):
    """Long words throughout, as in languages without spaces; a group with more symbols than another; no repeated lines at all."""
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdefgh", k=n))
    marked = lambda k: " ".join(word(6) + "#" * (i < k) for i in range(50))
    rows = [(i, " ".join(word(62) for _ in range(20)), "ja", "a") for i in range(50)] + [(100 + i, " ".join(word(120) for _ in range(20)), "th", "a") for i in range(50)]
    rows += [(200 + i, marked(1 + i % 3), "en", "few") for i in range(50)]
    rows += [(300 + i, marked(20 + i % 20), "en", "many") for i in range(50)]
    rows += [(400, marked(30), "en", "few"), (401, marked(30), "en", "many"), (402, " ".join(word(1) for _ in range(50)), "ja", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in q.keep(df).collect()}
    assert kept == {i for i, *_ in rows} - {400, 402}
    limits = {(x.lang, x.source): x for x in q.thresholds(measured(df)).collect()}
    assert limits["en", "few"].high_symbols < limits["en", "many"].high_symbols and limits["ja", "a"].high_length < limits["th", "a"].high_length


def test_columns_named_like_its_own(spark):
    clash = docs(spark).withColumns({c: F.lit(1) for c in ("q", "row", "t", "__q", "salt", "of_lang", "high_length")})
    out = q.keep(clash)
    assert out.columns == clash.columns and out.count() == q.keep(docs(spark)).count()


def test_native(spark):
    assert not re.search("Python|Pandas|Arrow", q.judged(docs(spark))._jdf.queryExecution().toString())
