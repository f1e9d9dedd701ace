import pytest

from lodeworks.llm import url_filter as u

URLS = [
    "http://example.org/es/a", "http://www.EXAMPLE.org/es/", "http://example.org/es", "http://example.org/en/1", "http://example.org/en/10?x", "http://example.org/en/2", "http://example.org",
    "https://a.com/fr/1#t", "https://a.com/de/", "https://a.com/de", "x://a.com?b://c/", "ftp://notexample.org/es/", "no scheme", "", None, "http://:80/", "http://a..org/x", "http://org/", "http://example.org:80/es/", "HTTP://É.ORG/ü\n/x?y",
]


def plain(url, rules, default="allow"):
    """The contract, rule by rule."""
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r.text), r.host.count("."), r.action == "block"))
    return host, path, best.text, best.action


def rows(df):
    return [(r.host, r.path, r.rule, r.verdict) for r in df.orderBy("page_id").collect()]


EXTRA = (*u.RULES, u.rule("block", "org"), u.rule("allow", "a.com/de/"), u.rule("block", "com/f"), u.rule("allow", "example.org/es/"))


@pytest.mark.parametrize("rules", [u.RULES, EXTRA, ()])
@pytest.mark.parametrize("block", [u.MAX_BLOCK_CHARS, 20])
def test_against_each_rule_in_turn(spark, rules, block):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert rows(u.judge(pages, rules, max_block_chars=block)) == [plain(x, rules) for x in URLS]


def test_empty_table_repeated_rows_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x"), (1, "http://a.org/", "x")], "page_id long, url string, action string")
    assert rows(u.judge(pages)) == [("a.org", "/", "org/", "allow")] * 2
    assert u.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        u.judge(pages.withColumnRenamed("action", "Rule"))


def test_columns_of_any_name_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "kept", 7, "too")], "page_id long, url string, __labels string, _labels int, __found string").withColumnRenamed("_labels", "_found")
    (row,) = u.judge(pages).collect()
    assert (row["__labels"], row["_found"], row["__found"], row.verdict) == ("kept", 7, "too", "allow")


def test_rules_are_checked():
    with pytest.raises(ValueError):
        u.rule("deny", "a/")
    with pytest.raises(ValueError):
        u.rule("allow", "/a")


def test_a_rule_may_be_deep():
    import pickle

    deep = u.rule("block", "a.org/" + "x/" * 5_000)
    trie = pickle.loads(pickle.dumps(u.Trie([deep])))
    assert trie.longest("a.org", "/" + "x/" * 6_000) == deep and trie.longest("a.org", "/" + "x/" * 4_999) is None
