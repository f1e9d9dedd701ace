import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_retrieval import plain_bm25

from lodeworks import schemas
from lodeworks.operators import generation as g
from lodeworks.operators import nodes as n

BUDGET = 30


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def nodes(spark):
    rows = []
    for d in range(90):
        lines = []
        for i in range(d % 5 + 1):
            words = [f"{a}{'abcdefghij'[(d * 7 + i * 3 + k) % 10]}{'klmno'[(d + i) % 5]}" for k, a in enumerate(("one", "two", "three", "four", "five", "six")[: 3 + (d + i) % 4])]
            lines.append(" ".join(words + [str(d * 10 + i)] * (i % 2)))
        rows.append((d, "\n".join(lines * (1 + d % 3))))
    return n.from_lines(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("parent_item_header", F.when(F.col("node_seq") > 4, "Item 2.")).cache()


def test_chunks_are_packed_greedily(spark):
    counts = [10, 10, 11, 40, 1, 29, 1, 30, 30, 0, 5]
    rows = [("d", s, i, c) for s in ("A", None) for i, c in enumerate(counts, 1 if s else 50)]
    got = g.packed(spark.createDataFrame(rows, "document_id string, parent_item_header string, node_seq int, token_count int"), BUDGET)
    for section, first in (("A", 1), (None, 50)):
        assert [r.chunk for r in got.where(F.col("parent_item_header").eqNullSafe(section)).orderBy("node_seq").collect()] == [0, 0, 1, 2, 3, 3, 4, 5, 6, 6, 7], first


def plain(nodes, sets, most_rounds, more=2):
    """The whole loop in plain Python; every token here is a plain word or number."""
    docs, chunks = {}, {}
    for r in sorted(nodes, key=lambda r: (r.document_id, r.node_seq)):
        docs.setdefault(r.document_id, []).append(r)
    for d, rows in docs.items():
        state = {}
        for r in rows:
            used, chunk = state.get(r.parent_item_header, (0, 0))
            if used and used + r.token_count > BUDGET:
                used, chunk = 0, chunk + 1
            state[r.parent_item_header] = used + r.token_count, chunk
            chunks.setdefault(f"{d}:{md5(r.parent_item_header or '')}:{chunk}", []).append(r)
    quadrant = {c: schemas.QUADRANTS[int(md5(f"{c}:5")[:8], 16) % 4] for c in chunks}
    answer = lambda text: next((w for w in text.split() if any(x.isdigit() for x in w)), text.split()[0])
    total, kept, again, log = sum(sets.values()), {q: [] for q in schemas.QUADRANTS}, {}, []
    for number in range(1, most_rounds + 1):
        lacking = {q: total - len(k) for q, k in kept.items() if len(k) < total}
        if not lacking:
            break
        for q in sorted(lacking):
            free = sorted((c for c in chunks if quadrant[c] == q and c not in {k[1] for k in kept[q]}), key=lambda c: (again.get(c, 0), md5(f"{c}:order")))
            tried = good = 0
            for c in free[: lacking[q] * more]:
                node = chunks[c][(number - 1) % len(chunks[c])]
                text = " ".join(node.content.split()[3:11])
                own = docs[node.document_id]
                scores = plain_bm25([r.content for r in own], text)
                best = max(range(len(own)), key=lambda i: (scores[i], -i))
                tried += 1
                again[c] = again.get(c, 0) + 1
                if text and scores[best] > 0 and own[best].node_id == node.node_id and answer(own[best].content) == answer(node.content):
                    good += 1
                    if len(kept[q]) < total and good <= lacking[q]:
                        kept[q].append((f"{c}#{number}", c, text, answer(node.content), node.node_id))
            if tried:
                log.append((number, q, tried, good))
    names = [s for s, size in sets.items() for _ in range(size)]
    return sorted((names[i], *k[:2], q, k[2], k[3], k[4]) for q, ks in kept.items() for i, k in enumerate(ks)), sorted(log)


@pytest.mark.parametrize("sets,rounds", [({"PQ": 3, "GQ": 1, "JEQ": 1}, 4), (g.SETS, 2)])
def test_rounds_fill_the_quotas(nodes, sets, rounds):
    out, log = g.generated(g.chunks(g.packed(nodes, BUDGET)), nodes, sets=sets, most_rounds=rounds)
    wanted, rows = plain(nodes.collect(), sets, rounds)
    got = [(r.set, r.query_id, r.chunk_id, r.quadrant, r.query_text, r.answer, r.citations[0]) for r in out.collect()]
    assert sorted(got) == wanted and sorted((r.round, r.quadrant, r.tried, r.kept) for r in log.collect()) == rows
    assert len({x[2] for x in got}) == len(got) and {x[0] for x in got} <= set(sets)


def test_a_rejected_chunk_goes_back_and_a_critic_is_blind(spark, nodes):
    pool, asked = g.chunks(g.packed(nodes, BUDGET)), []

    def critic(blind, _):
        assert blind.columns == list(g.BLIND)
        asked.append(sorted(r.query_id for r in blind.collect()))
        ok = F.col("query_id").endswith("#2")
        return blind.where(ok).select("query_id", F.lit("x").alias("answer"), F.array(F.lit("n")).alias("citations"))

    generator = lambda rows: g.propose(rows).withColumns({"answer": F.lit("x"), "citations": F.array(F.lit("n"))})
    out, log = g.generated(pool, nodes, generator, critic, {"PQ": 2}, 5, more=1)
    first, second = ({q.split("#")[0] for q in ids} for ids in asked)
    assert len(asked) == 2 and not first & second and out.count() == 8 and [r.kept for r in log.orderBy("round").collect()] == [0] * 4 + [2] * 4
    with pytest.raises(ValueError, match="sees"):
        g.criticise(generator(pool.withColumn("round", F.lit(1)).select(*g.CHUNK)), nodes)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_generated_sets_of_the_given_tables(spark):
    from lodeworks.jobs import queries as jobs

    rows = jobs.QUERIES["generated_sets"](spark, str(DATA)).collect()
    counts = {}
    for r in rows:
        counts[r.quadrant, r.set] = counts.get((r.quadrant, r.set), 0) + 1
    assert len({r.chunk_id for r in rows}) == len(rows) and all(n <= g.SETS[s] for (_, s), n in counts.items())
    contents = {r.node_id: r.content for r in n.from_lines(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert all(r.citations[0] in contents and r.query_id.startswith(r.chunk_id) for r in rows)
