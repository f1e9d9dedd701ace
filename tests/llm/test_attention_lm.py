import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import attention_lm as a


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    model = a.Model()
    model.vector[:] = rng.normal(0, 0.3, model.SIZE)
    model.p["place"][:, -1] = 0
    x, y, s, _ = a.windows([rng.integers(0, 49_000, 50), rng.integers(0, 49_000, 20)])
    loss, g = model.gradient(x, y, s)
    mean = lambda: -model.log_probabilities(x, y, s).mean()
    assert loss == pytest.approx(mean(), abs=1e-5)
    fixed = {model.SHAPES["in0"][0] * a.WIDTH * a.DIGITS + a.WIDTH * k + a.WIDTH - 1 for k in range(a.LENGTH)}  # the places' last numbers stay nought
    for i in set(rng.integers(0, model.SIZE, 60)) - fixed:
        old = model.vector[i]
        model.vector[i] = old + 1e-2
        up = mean()
        model.vector[i] = old - 1e-2
        down = mean()
        model.vector[i] = old
        assert (up - down) / 2e-2 == pytest.approx(g[i], abs=2e-4)


def test_each_id_is_scored_once_with_its_own_past():
    for n in (0, 1, 2, a.LENGTH - 1, a.LENGTH, a.LENGTH + 1, 5 * a.LENGTH + 3):
        ids = np.arange(n) * 7 + 1
        x, y, s, who = a.windows([np.array([9, 9]), ids, np.array([], np.int64)])
        mine = np.flatnonzero(who == 1)
        assert y[mine][s[mine]].tolist() == ids.tolist()
        before = x[mine][s[mine]].tolist()
        assert before == [a.BEGIN, *ids[:-1].tolist()][: len(ids)]
        place = np.broadcast_to(np.arange(a.LENGTH), s.shape)[mine][s[mine]]
        assert all(p >= min(i, a.CONTEXT) for i, p in enumerate(place.tolist()))


def test_the_future_does_not_matter():
    model = a.Model()
    x, y, s, _ = a.windows([np.arange(100, 130)])
    first = model.log_probabilities(x, y, s)[:10]
    x[:, 15:] = 5
    assert np.allclose(model.log_probabilities(x, y, s)[:10], first, atol=1e-5)


def test_probabilities_add_up():
    model = a.Model()
    model.vector[:] = np.random.default_rng(2).normal(0, 0.5, model.SIZE)
    model.p["place"][:, -1] = 0
    x = np.full((1, a.LENGTH), 11)
    total = 0.0
    for begin in range(0, a.CELLS, 4096):
        ids = np.arange(begin, min(a.CELLS, begin + 4096))
        scored = np.zeros((len(ids), a.LENGTH), bool)
        scored[:, 4] = True
        y = np.zeros((len(ids), a.LENGTH), np.int64)
        y[:, 4] = ids
        total += np.exp(model.log_probabilities(np.repeat(x, len(ids), 0), y, scored)).sum()
    assert total == pytest.approx(1, abs=1e-3)


def ids_of(texts):
    tool = a.Words(a.vocabulary_path())
    return [np.append(tool.ids(tool.numbers(t.encode().lower().split()))[0], a.END).astype(np.int64) for t in texts]


def test_untrained_it_is_the_counted_subwords():
    ids = ids_of(["the cat sat on the mat", "a dog ran", ""])
    counts = np.bincount(np.concatenate(ids), minlength=a.VOCABULARY_SIZE)
    weights = counts + 0.5
    wanted = [np.log10(weights[x] / weights.sum()).sum() for x in ids]
    assert a.scores(a.Model(base=a.shares(counts)), ids) == pytest.approx(wanted, rel=1e-4)


def test_training_beats_counted_subwords_on_texts_held_out():
    texts = [" ".join(w for w in ("the cat sat on the mat", "a dog ran to the park", "the park was green")[i % 3 : i % 3 + 2]) + f" {i}" for i in range(1200)]
    ids = ids_of(texts)
    model = a.Model(base=a.shares(np.bincount(np.concatenate(ids[40:]), minlength=a.VOCABULARY_SIZE)))
    before = a.scores(model, ids[:40]).sum()
    a.train(model, iter(ids[40:]), batch=8)
    assert a.scores(model, ids[:40]).sum() > 0.7 * before


def plain_score(model, ids):
    """One id after the other, with loops over places and digits."""
    p, size, step = {k: v.astype(float) for k, v in model.p.items()}, a.LENGTH, a.LENGTH - a.CONTEXT
    of = lambda i: tuple(i // a.BASE**k % a.BASE for k in (3, 2, 1, 0))
    past, total = [a.BEGIN, *ids[:-1]], 0.0
    for i, y in enumerate(ids):
        begin = 0 if i < size else (i - size) // step * step + step
        window = past[begin : i + 1]
        inp = [sum(p[f"in{d}"][of(x)[d]] for d in range(4)) + p["place"][k] for k, x in enumerate(window)]
        for k, v in enumerate(inp):
            v[-1] = 1 + p["place"][k][-1]
        q = inp[-1] @ p["qk"]
        e = [math.exp(q @ v / 4) for v in inp]
        z = sum(w * v for w, v in zip(e, inp, strict=True))
        h, y = inp[-1] + z / z[-1] @ p["vo"], of(y)
        for d in range(4):
            logits = h @ p["out"][:, 16 * d : 16 * d + 16] + model.base[d][sum(y[e] * 16 ** (d - 1 - e) for e in range(d))]
            total += logits[y[d]] - math.log(sum(map(math.exp, logits)))
    return total / math.log(10)


def test_scores_against_plain_python():
    rng = np.random.default_rng(3)
    model = a.Model(base=a.shares(rng.integers(0, 9, a.VOCABULARY_SIZE)))
    model.vector[:] = rng.normal(0, 0.4, model.SIZE)
    model.p["place"][:, -1] = 0
    many = [rng.integers(0, a.VOCABULARY_SIZE, n) for n in (1, 15, 16, 17, 28, 29, 150)]
    assert a.scores(model, many) == pytest.approx([plain_score(model, m.tolist()) for m in many], rel=1e-4)


TEXTS = [None, "", "The the cat.", "the cat the dog ran far away " * 9, "A  a\tB b\x0bc", "é É ÉÉ ß", "w " * 700] + [f"word{i} the cat word{i % 5}" for i in range(40)]


def test_base_scores_against_plain_python(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "the cat"), (None, None)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    wanted = sorted(((i or -1), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    for head in (4, 100_000):
        got = a.scored(df, a.vocabulary_path(), head=head).collect()
        assert sorted(((r.doc_id or -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == wanted
        assert all(r.score < 0 for r in got)
    assert a.scored(df.limit(0), a.vocabulary_path()).count() == 0


def test_every_id_is_learned_from_once():
    class Counting(a.Model):
        seen: list = []

        def learn(self, x, y, scored, inputs):
            self.seen.extend(y[scored].tolist())

    many = [np.full(n, i) for i, n in enumerate((1, 31, 32, 33, 5_000, 40_000, 0, 7))]
    a.train(Counting(), iter(many))
    assert Counter(Counting.seen) == {i: len(m) for i, m in enumerate(many) if len(m)}


def _rows(spark, texts, parts=1):
    return spark.createDataFrame([(bytearray(a.pack(x)),) for x in ids_of(texts)], "ids binary").repartition(parts)


def test_training_depends_on_every_document(spark):
    def vector(changed):
        return a.trained(_rows(spark, ["quite another text" if i == changed else f"word{i} the cat" for i in range(260)]).coalesce(1))[0]

    same = vector(None)
    assert np.array_equal(same, vector(None))
    assert all(not np.array_equal(same, vector(i)) for i in (0, 203, 231, 259))


def test_averaged_copies_beat_counted_subwords(spark):
    texts = [f"the cat number {i} sat on the mat {i % 7} and the dog ran to the park" for i in range(3000)]
    some = ids_of(texts[:50])
    vector, base = a.trained(_rows(spark, texts, 4))
    assert a.scores(a.Model(vector, base), some).sum() > 0.995 * a.scores(a.Model(base=base), some).sum()


def test_registered_query(spark):
    got = a.op7_attention_lm(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t in docs.items()}
    held = [r for r in rows if r.held_out]
    assert held and all(r.score < 0 for r in held)


def test_words_part_as_the_vocabulary_parts_them():
    tool = a.Words(a.vocabulary_path(), {b"the": 7})
    words = "the cat's (sat) 12,5 \u00e9t\u00e9 \u6f22\u5b57 a\u00a0b a\u2003 \x1c \u0301x <|endoftext|> don't-- \u2028".split(" ")
    own = lambda w: tool.encoding.encode_ordinary(" " + w)
    for _ in range(2):
        for w in words:
            assert tool.ids(tool.numbers([w.encode()]))[0].tolist() == own(w), w
        numbers = tool.numbers([w.encode() for w in words])
        ids, ends = tool.ids(numbers)
        assert ids.tolist() == [i for w in words for i in own(w)] and np.diff(ends, prepend=0).tolist() == [len(own(w)) for w in words]
        assert tool.counts[numbers].tolist() == [7] + [0] * (len(words) - 1)
    assert len(tool.ids(tool.numbers([]))[0]) == 0


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(a, "MEMORY", 1_000)
    tool = a.Words(a.vocabulary_path())
    for i in range(40):
        assert tool.ids(tool.numbers([b"word%d" % i, b"other"]))[0].tolist() == tool.encoding.encode_ordinary(f" word{i} other")


def test_eight_ids_of_context_at_least():
    x, y, s, _ = a.windows([np.arange(200)])
    place = np.broadcast_to(np.arange(a.LENGTH), s.shape)[s]
    assert a.LENGTH == 32 and all(p >= min(i, 8) for i, p in enumerate(place.tolist()))


def test_states_are_worked_out_where_they_are_scored():
    class Counting(a.Model):
        rows = 0

        def _state(self, *args):
            out = super()._state(*args)
            Counting.rows += len(out[-1])
            return out

    model, n = Counting(), a.LENGTH + 50 * (a.LENGTH - a.CONTEXT)
    a.scores(model, [np.arange(n)])
    assert Counting.rows == n


def test_a_window_from_its_context_on_has_the_same_states():
    model = a.Model()
    model.vector[:] = np.random.default_rng(4).normal(0, 0.4, model.SIZE)
    inputs = lambda: model.inputs().take(np.arange(10 * a.LENGTH).reshape(10, -1) * 31, axis=0)
    whole, part = model._state(inputs())[-1], model._state(inputs(), a.CONTEXT)[-1]
    assert np.allclose(whole.reshape(10, a.LENGTH, -1)[:, a.CONTEXT :], part.reshape(10, a.LENGTH - a.CONTEXT, -1), atol=1e-5)


def test_padding_changes_no_gradient():
    model = a.Model()
    model.vector[:] = np.random.default_rng(5).normal(0, 0.3, model.SIZE)
    model.p["place"][:, -1] = 0
    few, many = a.windows([np.arange(5)], 0)[:3], a.windows([np.arange(5)] + [np.arange(a.LENGTH) * 3] * 9, 0)[:3]
    dense, wide = model.gradient(*(m[1:] for m in many)), model.gradient(*many)
    lone = model.gradient(*few)
    share = 5 / (5 + 9 * a.LENGTH)
    assert wide[0] == pytest.approx(share * lone[0] + (1 - share) * dense[0], rel=1e-5)
    assert np.allclose(wide[1], share * lone[1] + (1 - share) * dense[1], atol=1e-5)


def test_words_are_parted_as_python_parts_them():
    import pyarrow as pa

    texts = [None, "", " \t\n", "The the\x0bcat.\x0c", "A\x1cb É é x y  Z\r", "the"]
    for part in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array([None, None], pa.string()), pa.array(texts[1:3]), pa.array([], pa.string())):
        words, which, n_words = a.parted(part)
        own = [(t.as_py() or "").encode().lower().split() for t in part]
        known = words.cast(pa.binary()).to_pylist()
        assert [known[i] for i in which.tolist()] == [w for t in own for w in t]
        assert n_words.tolist() == [len(t) for t in own] and len(set(known)) == len(known) and b"" not in known
