"""The vectors nearest to questions by cosine: every question is compared with every vector of its group, in blocks of matrices inside tasks.

A matrix product finds what is close to a question's k best; only that is scored number by number, in the order in which retrieval.cosine
adds, so that scores, and the order of equal ones, are those of comparing pairs one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores are rounded to six digits; what is this close to a bound is looked at.
SLACK = 2e-6
#: Questions of a group that a task holds; a group with more is met by as many tasks as that takes.
_QUESTIONS = 4_096
#: Questions in a matrix product, and pairs that are scored at once.
_ROWS, _PAIRS = 256, 100_000


def nearest(asked: DataFrame, vectors: DataFrame, k: int | None, by: tuple[str, ...]) -> DataFrame:
    """query_id, *by, node_seq, score (not rounded): of the vectors that share `by` with a question, the k nearest by rounded score and then node_seq; all of them without k.

    asked: query_id, *by, query_vector; vectors: *by, node_seq, vector. Questions come first in a group; they are held, and vectors pass by.
    """
    a, v = asked.schema["query_vector"].dataType, vectors.schema["vector"].dataType
    kind = a.simpleString() if a == v else "array<double>"
    sides = -(-(asked.groupBy(*by).count().agg(F.max("count")).first()[0] or 1) // _QUESTIONS)
    types = {c: vectors.schema[c].dataType.simpleString() for c in (*by, "node_seq")} | {"query_id": asked.schema["query_id"].dataType.simpleString()}
    null = lambda c: F.lit(None).cast(types[c]).alias(c)
    keys = [F.col(c).cast(types[c]).alias(c) for c in by]
    mine = asked.select(*keys, F.pmod(F.xxhash64("query_id"), F.lit(sides)).cast("int").alias("side"), F.lit(False).alias("stored"), "query_id", null("node_seq"), F.col("query_vector").cast(kind).alias("vector"))
    side = F.lit(0) if sides == 1 else F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    theirs = vectors.select(*keys, side.alias("side"), F.lit(True).alias("stored"), null("query_id"), "node_seq", F.col("vector").cast(kind).alias("vector"))
    group = (*by, "side")
    both = mine.unionByName(theirs).dropna(subset=list(by)).repartition(*group).sortWithinPartitions(*group, "stored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, questions, best = None, [], None

        def found() -> pa.RecordBatch:
            ids = pa.concat_arrays([x["query_id"] for x in questions])
            rows = pa.array(best.q)
            shared = [pa.repeat(questions[0][c][0], len(rows)) for c in by]
            return pa.RecordBatch.from_arrays([ids.take(rows), *shared, pa.array(best.seq), pa.array(best.score, mask=best.score == -np.inf)], ["query_id", *by, "node_seq", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.zeros(batch.num_rows, bool)
            for c in group:
                codes = batch[c].dictionary_encode().indices.to_numpy()
                starts[1:] |= codes[1:] != codes[:-1]
            here = tuple(batch[c][0] for c in group)
            starts[0] = here != last
            last = tuple(batch[c][-1] for c in group)
            held = ~batch["stored"].to_numpy(zero_copy_only=False)
            edges = np.unique(np.concatenate([[0], np.flatnonzero(starts), [batch.num_rows]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if starts[lo]:
                    if best is not None:
                        yield found()
                    questions, best = [], None
                middle = lo + int(held[lo:hi].sum())
                if middle > lo:
                    questions.append(batch.slice(lo, middle - lo))
                if middle < hi and questions:
                    if best is None:
                        best = Best(pa.concat_arrays([x["vector"] for x in questions]), k)
                    best.meet(batch["node_seq"].slice(middle, hi - middle).to_numpy(), batch["vector"].slice(middle, hi - middle))
        if best is not None:
            yield found()

    return both.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ("query_id", *by, "node_seq")) + ", score double")


def matrix(vectors: pa.ListArray, size: int) -> np.ndarray:
    """A row a vector; nought for one of another size, or with a null."""
    sizes, values = vectors.value_lengths().fill_null(0).to_numpy(), vectors.flatten()
    fits = sizes == size
    if values.null_count:
        fits[np.repeat(np.arange(len(sizes)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]] = False
    values = values.fill_null(0).to_numpy().astype(np.float64)
    if fits.all():
        return values.reshape(len(sizes), size)
    out = np.zeros((len(sizes), size))
    out[fits] = values[np.repeat(fits, sizes)].reshape(fits.sum(), size)
    return out


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; nought stays nought. No number for what is too long or too short to be measured well."""
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, np.where((size > 1e-150) & (size < 1e150), size, np.nan), out=np.zeros_like(rows), where=~(size <= 0))


def _state(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sizes of vectors, whether one is null or has a null, and whether it is nought."""
    sizes, values = vectors.value_lengths(), vectors.flatten()
    missing, sizes = sizes.is_null().to_numpy(zero_copy_only=False).copy(), sizes.fill_null(0).to_numpy()
    of = np.repeat(np.arange(len(sizes)), sizes)
    missing[of[values.is_null().to_numpy(zero_copy_only=False)]] = True
    numbers = values.fill_null(0).to_numpy().astype(np.float64)
    return sizes, missing, np.bincount(of, numbers * numbers != 0, len(sizes)) == 0


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b))
    return np.divide(_dots(a, b), size, out=np.zeros(len(a)), where=~(size <= 0))


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from nought, as round() in SQL; what is not a number comes first of all."""
    y = np.abs(x) * 1e6
    out = np.copysign(np.floor(y + 0.5), x) / 1e6
    for i in np.flatnonzero(np.abs(y % 1 - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return np.where(np.isnan(x), np.inf, out)  # -inf, for null, comes last


class Best:
    """The k nearest, of the vectors met so far, to each of some questions."""

    def __init__(self, questions: pa.ListArray, k: int | None) -> None:
        sizes, missing, self.nought = _state(questions)
        sizes = np.where(missing, -1, sizes)
        self.k = np.iinfo(np.int64).max if k is None else k
        self.sets = [(n, np.flatnonzero(sizes == n), matrix(questions, max(0, n))[sizes == n]) for n in np.unique(sizes)]
        self.q, self.seq, self.score, self.least = np.zeros(0, np.int64), None, np.zeros(0), np.full(len(sizes), -np.inf)

    @np.errstate(all="ignore")
    def meet(self, seq: np.ndarray, vectors: pa.ListArray) -> None:
        sizes, missing, nought = _state(vectors)
        for n, places, mine in self.sets:
            theirs, flat = matrix(vectors, mine.shape[1]), missing | nought | (n < 0)
            near_theirs, odd = units(theirs), missing | (sizes != n)
            for lo in range(0, len(places), _ROWS):
                some, rows = places[lo : lo + _ROWS], mine[lo : lo + _ROWS]
                near, least = units(rows) @ near_theirs.T, self.least[some]
                given = lambda a, b: np.where(flat[b] | self.nought[some[a]], 0.0, -np.inf)  # noqa: B023, E731  of vectors that are odd; -inf stands for null
                if odd.any():
                    near[:, odd] = given(np.arange(len(some))[:, None], np.flatnonzero(odd)[None, :])
                unsure = np.isnan(near)
                if self.k < len(seq) and (new := least == -np.inf).any():
                    least[new] = np.partition(np.where(unsure[new], -np.inf, near[new]), len(seq) - self.k, axis=1)[:, len(seq) - self.k]
                x, y = np.nonzero((near >= least[:, None] - SLACK) | unsure)
                if self.k < len(seq) and len(x) > 4 * self.k * len(some):
                    x, y = (z[self._needed(seq, np.column_stack([theirs, odd, flat]))[y]] for z in (x, y))
                for p in range(0, len(x), _PAIRS):
                    a, b = x[p : p + _PAIRS], y[p : p + _PAIRS]
                    self._add(some[a], seq[b], np.where(odd[b], given(a, b), _cosines(rows[a], theirs[b])))

    def _needed(self, seq: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Whether a vector is one of the first k of its equals; no other can be among the k nearest to anything."""
        _, code = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
        order = np.lexsort((seq, code))
        out = np.zeros(len(seq), bool)
        out[order] = _places(code[order]) < self.k
        return out

    def _add(self, q: np.ndarray, seq: np.ndarray, score: np.ndarray) -> None:
        if self.seq is not None:
            q, seq, score = np.concatenate([self.q, q]), np.concatenate([self.seq, seq]), np.concatenate([self.score, score])
        as_ranked = rounded(score)
        order = np.lexsort((seq, -as_ranked, q))
        place = _places(q[order])
        order, last = order[place < self.k], order[place == self.k - 1]
        self.least[q[last]] = as_ranked[last]
        self.q, self.seq, self.score = q[order], seq[order], score[order]


def _places(ordered: np.ndarray) -> np.ndarray:
    """The place of each among its equals, from nought."""
    at = np.arange(len(ordered))
    return at - np.maximum.accumulate(np.where(np.diff(ordered, prepend=-1) != 0, at, 0))
