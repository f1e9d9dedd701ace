"""Line dedup: lines that many documents share stay in one document only.

A text is cut at "\\n". A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than
`least_chars` code points are never dropped. Lines are exploded with their position and a 128-bit hash of their key; hashes
held by `least_docs` distinct documents or more lose their lines in all documents but the one with the largest id; what
is left of a document is put together by position.

Defined results. A null or empty text is one empty line. A null doc_id is no document: its rows hold no line for others, are not
counted, and lose every dropped line. Rows that share a doc_id are one document, and each row keeps or loses its lines like the
others. Repeated rows come back as often. Ties: ids are compared, not rows, so there are none. An empty table gives an empty result.
Texts are used whole, long ones too. Columns the input has besides pass untouched, whatever their names.

Scale: built-in expressions only. A text gives each hash once, (hash, document) pairs are made distinct first, so that a line in a third
of all documents is counted in many tasks, and then counted with a partial sum in each. What is dropped meets the lines in an equality join that
adaptive execution may split, and only places of dropped lines are gathered, one list a row of the input; no
line's documents are ever gathered. The texts are shuffled once, to meet those lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.text import UPPER, ascii_lower, let, unused
from lodeworks.runtime import cut, table

LEAST_DOCS = 3
LEAST_CHARS = 20
#: Fixed value: the six ASCII white-space characters.
BLANK = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, last: hashes that least_docs distinct ids or more have, and the largest of those. lines: id, h1, h2."""
    each = lines.where("id IS NOT NULL").select("id", "h1", "h2").distinct()
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs).drop("n")


def deduplicated(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """docs with three columns more: the text that is left, how many lines there were, and how many were dropped."""
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    key, whole = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    own = docs.select(key.alias("id"), F.xxhash64(whole).alias("row"), whole.alias("text"))
    lines = own.select("id", "row", F.posexplode(split_lines(F.col("text"))).alias("at", "line")).select("id", "row", "at", F.btrim("line", F.lit(BLANK)).alias("line"))
    lines = lines.where(F.length("line") >= least_chars).select("id", "row", "at", ascii_lower(F.col("line")).alias("line"))
    lines = lines.select("id", "row", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    # cut, so that both sides of the join are shuffled for it and a hot line can be split
    gone = lines.join(cut(shared_lines(lines, least_docs)), ["h1", "h2"]).where("id IS NULL OR id <> last")
    gone = gone.groupBy("id", "row").agg(F.collect_set("at").alias("gone"))
    i, r, g = unused(docs, "id", "row", "gone")
    gone = gone.withColumnsRenamed({"id": i, "row": r, "gone": g})
    met = docs.join(gone, key.eqNullSafe(F.col(f"`{i}`")) & (F.xxhash64(whole) == F.col(f"`{r}`")), "left")
    gone = F.col(f"`{g}`")
    left = lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda at: F.get(parts, at)), "\n")
    kept = F.when(gone.isNull(), F.coalesce(whole, F.lit(""))).otherwise(let(split_lines(whole), left))
    n_dropped = F.when(gone.isNull(), 0).otherwise(F.size(gone))
    new = {names[0]: kept, names[1]: F.size(split_lines(whole)), names[2]: n_dropped}
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), *((c.cast("long") if n != names[0] else c).alias(n) for n, c in new.items()))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12_SQL = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANK_SQL}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT doc_id, pos, line, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
