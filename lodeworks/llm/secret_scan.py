"""Secret scans: base patterns, and weak candidates that are reported only beside their complement.

Base spans, by kind: assign (a key word, then a value of 8 or more characters), access (an access identifier of 16 or
more), hex (32 or more hex digits). The method adds multipart linking. A weak access identifier (8 to 15 characters) is
reported where a secret stands within `scope` code points of it; a weak secret (24 or more characters with an upper-case
letter, a lower-case letter and a digit) where an access identifier or an endpoint stands that near. Secrets are assign,
hex and weak secrets; endpoints are http(s) addresses, never reported themselves. A weak secret that overlaps a base
span or an endpoint is no candidate. Parts meet in an interval join: equal document and scope bin, then the distance.

Native: only SQL functions. Spark gives the texts of matches but no offsets, so a match's offset is the running sum of
the lengths of what `split` leaves between matches and of the matches before it, by a window per document and kind.

Defined results. Null and empty texts have no spans. A span is a whole match: code points, end exclusive, from 0. Texts are scanned whole. Repeated rows get the same
spans each: parts are keyed by doc_id and a digest of the text, nulls equal. Equal starts sort by kind as listed. An
empty table gives an empty result. Columns the input has besides are kept by `redact`, whatever their names.

Scale: the scan is one narrow pass; rows exist only for matches. Pairs within a bin are bounded by the bin's width
over a part's least length, whatever the document's length. Only match lengths and keys are shuffled by the query; `redact`
broadcasts the spans where they are `max_broadcast` at most, and shuffles the texts to them beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.runtime import cut, table

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
SCOPE = 256
BIN = 512
#: The kinds in the order in which equal starts sort.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
BASE, ENDPOINT = 3, 5
MARK = "[SECRET]"
MAX_BROADCAST = 500_000


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = rf"""({"|".join(map(_either_case, KEYWORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so the least length can stand in the pattern
SECRET = r"[A-Za-z0-9+/_=-]{24,}"
URL = r"""https?://[^\s"'<>]+"""


def _rows_of(i: int, kind) -> Column:
    """The matches of rule i as structs; gap: the characters between a match and the one before it."""
    return F.transform(f"m{i}", lambda m, k: F.struct(F.lit(i).alias("rule"), k.alias("at"), F.get(f"g{i}", k).alias("gap"), F.length(m).alias("size"), kind(m).cast("int").alias("kind")))


def _parts(docs: DataFrame) -> DataFrame:
    """One row for each match of any pattern: key columns, kind, start, end."""
    number = {k: F.lit(i) for i, k in enumerate(KINDS)}
    none = F.lit(None).cast("int")
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    rules = {
        ASSIGN: lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, number["assign"]),
        ACCESS: lambda m: F.when(F.length(m) >= 16, number["access"]).when(F.length(m) >= 8, number["weak_access"]).otherwise(none),
        HEX: lambda m: number["hex"],
        SECRET: lambda m: F.when(mixed(m), number["weak_secret"]),
        URL: lambda m: number["endpoint"],
    }
    out = docs.select("__id", "__digest", *(F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate(rules)), "__text")
    some = [F.size(f"m{i}") > 0 for i in range(len(rules))]
    out = out.where(some[0] | some[1] | some[2] | some[3] | some[4])
    out = out.select("*", *(F.when(s, F.transform(F.split("__text", p, -1), F.length)).alias(f"g{i}") for i, (p, s) in enumerate(zip(rules, some, strict=True))))
    rows = [_rows_of(i, kind) for i, kind in enumerate(rules.values())]
    out = out.select("__id", "__digest", F.inline(F.concat(*rows))).distinct()
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("__id", "__digest", "rule").orderBy("at"))
    out = out.select("__id", "__digest", "kind", (upto - F.col("size")).alias("start"), upto.alias("end"))
    return out.where("kind IS NOT NULL")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("__id"), F.md5(whole).alias("__digest"), whole.alias("__text"))


def spans(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __digest (of the text), kind (a number in KINDS), start, end: base spans and linked weak candidates."""
    parts = _parts(_keyed(docs, doc_id, text))
    roles = F.when(F.col("kind").isin(1, 3), "access").when(F.col("kind") == ENDPOINT, "endpoint").otherwise("secret")
    reach = F.explode(F.sequence(F.floor((F.col("start") - scope) / BIN), F.floor((F.col("end") + scope) / BIN)))
    around = parts.select("__id", "__digest", reach.alias("bin"), roles.alias("role"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("kind").isin(0, 1, 2, ENDPOINT).alias("firm"))
    weak = parts.where(F.col("kind").isin(3, 4))
    weak = weak.select("*", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("bin"))
    c, e = weak.alias("c"), around.alias("e")
    near = (F.col("e.from") < F.col("c.end") + scope) & (F.col("e.to") > F.col("c.start") - scope)
    over = (F.col("e.from") < F.col("c.end")) & (F.col("e.to") > F.col("c.start"))
    complement = F.when(F.col("c.kind") == 3, F.col("e.role") == "secret").otherwise(F.col("e.role") != "secret")
    met = c.join(e, F.col("c.__id").eqNullSafe(F.col("e.__id")) & (F.col("c.__digest") == F.col("e.__digest")) & (F.col("c.bin") == F.col("e.bin")) & near)
    linked = met.groupBy("c.__id", "c.__digest", "c.kind", "c.start", "c.end").agg(F.max(complement & ~over).alias("linked"), F.max(over & F.col("e.firm")).alias("taken"))
    return parts.where(F.col("kind") < BASE).unionByName(linked.where("linked AND NOT taken").select(*parts.columns))


def scan(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its id as doc_id, counts of base kinds, base_sha256 and all spans as text."""
    found = spans(docs, scope, doc_id, text)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("as_text"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda x: x.as_text), ",")
    each = found.groupBy("__id", "__digest").agg(
        *(F.count_if(F.col("kind") == i).alias(f"__n{i}") for i in range(BASE)), F.array_sort(F.collect_list(one)).alias("__all")
    )
    each = each.withColumn("__base", joined(F.filter("__all", lambda x: x.kind < BASE))).withColumn("__spans", joined("__all")).drop("__all")
    d, e = _keyed(docs, doc_id, text).drop("__text").alias("d"), each.alias("e")
    out = d.join(e, F.col("d.__id").eqNullSafe(F.col("e.__id")) & (F.col("d.__digest") == F.col("e.__digest")), "left")
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select(
        F.col("d.__id").alias("doc_id"), *(F.coalesce(f"__n{i}", F.lit(0)).alias(f"n_{KINDS[i]}") for i in range(BASE)),
        F.sha2(text_of("__base"), 256).alias("base_sha256"), text_of("__spans").alias("spans"),
    )


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = MARK, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs, the same columns, with each span in the text replaced by mark (overlapping spans by one mark)."""
    key = ["__id", "__digest"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans(docs, scope, doc_id, text).withColumn("__new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    runs = runs.withColumn("__run", F.sum("__new").over(order)).groupBy(*key, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = cut(runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")))
    if (cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= max_broadcast:
        cuts = F.broadcast(cuts)
    whole = F.col(f"d.`{text}`")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("e.__id")) & (F.md5(F.coalesce(whole, F.lit(""))) == F.col("e.__digest"))
    out = docs.alias("d").join(cuts.alias("e"), same, "left")
    found = F.col("e.cuts")
    n = F.size(found)
    piece = lambda i: F.substring(whole, F.when(i == 0, 0).otherwise(F.get(found, i - 1).end).cast("int") + 1, (F.when(i == n, F.length(whole)).otherwise(F.get(found, i).start) - F.when(i == 0, 0).otherwise(F.get(found, i - 1).end)).cast("int"))
    clean = F.when(found.isNull(), whole).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n), piece), mark))
    return out.select(*(clean.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_rules() -> tuple[str, str]:
    """Matches of each rule and what stands between them, by row; and the length of an assigned value."""
    quoted = lambda p: p.replace("\\s", " \\t-\\r").replace("'", "''")
    each = [f"SELECT r, {i} AS rule, regexp_extract_all(t, '{quoted(p)}') AS ms, string_split_regex(t, '{quoted(p)}') AS gs FROM d" for i, p in enumerate((ASSIGN, ACCESS, HEX, SECRET, URL))]
    return " UNION ALL ".join(each), f"length(regexp_extract(m, '{quoted(ASSIGN)}', 2))"


_RULES, _VALUE = _sql_rules()
#: Every weak candidate is compared with every part of its row, without bins.
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_RULES}),
places AS (SELECT r, rule, ms[k] AS m, list_sum(list_transform(gs[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM found WHERE len(ms) > 0)),
parts AS (SELECT * FROM (SELECT r, s::BIGINT AS s, (s + length(m))::BIGINT AS e, CASE
    WHEN rule = 0 AND {_VALUE} >= 8 THEN 0 WHEN rule = 1 AND length(m) >= 16 THEN 1 WHEN rule = 1 AND length(m) >= 8 THEN 3 WHEN rule = 2 THEN 2
    WHEN rule = 3 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]') THEN 4 WHEN rule = 4 THEN 5 END AS kind FROM places) WHERE kind IS NOT NULL),
linked AS (SELECT c.r, c.s, c.e, c.kind FROM parts c JOIN parts o ON c.r = o.r AND o.s < c.e + {SCOPE} AND o.e > c.s - {SCOPE} WHERE c.kind IN (3, 4) GROUP BY ALL
  HAVING bool_or((CASE WHEN c.kind = 3 THEN o.kind IN (0, 2, 4) ELSE o.kind IN (1, 3, 5) END) AND NOT (o.s < c.e AND o.e > c.s)) AND NOT bool_or(o.s < c.e AND o.e > c.s AND o.kind IN (0, 1, 2, 5))),
spans AS (SELECT r, s, kind, ['assign', 'access', 'hex', 'weak_access', 'weak_secret'][kind + 1] || ':' || s || ':' || e AS as_text FROM (SELECT r, s, e, kind FROM parts WHERE kind < {BASE} UNION ALL SELECT * FROM linked)),
each AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, string_agg(as_text, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base, string_agg(as_text, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN each USING (r)
"""
