"""LM scoring: a causal self-attention model over subword ids, trained in numpy, and the counts of a word model beside it.

Model. A text's sequence is a begin id, the subword ids of its words, and an end id. A subword id is four digits to base 16.
A position's input is the sum of its digits' vectors and its place's;
one causal self-attention layer with a residual gives its state; the next id's digits are predicted one after the other:
the state's part, plus the logarithm of the digit's share after the digits before it, as counted in the training documents.
So with a state's part of nothing the model is that of counted subwords, and what is trained is what the context adds. A
text is scored in windows of LENGTH inputs that overlap by
CONTEXT: the first scores all of its positions, each later one those after its first CONTEXT, so that each id is scored
once, with that much context at least; windows run through one batched masked attention. log10 probability is the sum
over the ids.

Training. From seeded initial parameters, in `rounds` rounds: a hash deals each training document to one round, in which
each task trains a copy on its own documents, on all of their ids, once each; then the copies are averaged, weighted by
windows, for the next round to start from. All parameters are learned in every round. No document, stretch or id is left out. As copies are averaged by task, the
parameters depend on how the input is split into tasks; README has how little the scores do.

Counts. Words of the training documents are counted in each task, then by grouped aggregation. Words at least as frequent
as a threshold, chosen from the counts' histogram so that at most `head` words pass, are broadcast; the other words of
each document are joined with the counts and summed by row, so no table that grows with the corpus is held by one task.

Words: `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, then one end, counted as a token. A word's subwords are those of a byte-level
vocabulary with a space in front of the word.

Defined results. Null and empty texts have the end only. A null doc_id counts as the id "" in the choice of training
documents. Repeated rows are scored one by one, and counted as often as they occur. Without training documents N and V are 0 and the model is the
untrained one. An empty table gives an empty result. Other columns are not read, whatever their names. Texts are used whole.

Scale: two narrow passes over the texts (words counted; words looked up, and subword ids kept in the shared folder, packed), then
passes over the ids only: their counts, training, scores. Beside them the counts' aggregation and the rare words' join; hot words never leave
their task. What comes to the driver is the head of the counts, the vocabulary's counts and the averaged parameters, all of bounded size.
"""

from __future__ import annotations

import base64
import ctypes
import math
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.runtime import cut, ship, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BASE, DIGITS = 16, 4
CELLS = BASE**DIGITS
#: The vocabulary's ids end before these two.
BEGIN, END = 50_256, 50_257
VOCABULARY_SIZE = 50_258
WIDTH = 16
LENGTH = 32
CONTEXT = 8
HEAD = 400_000
HELD_OUT, FOLDS = 2, 7
RATE = 1e-2
BATCH = 128
ROUNDS = 3
#: Bytes of words and ids a worker remembers.
MEMORY = 192 << 20

_PAST = np.tril(np.ones((LENGTH, LENGTH), np.float32))
#: Sums of each digit's part out of one row of all of them.
_BLOCKS = np.repeat(np.eye(DIGITS, dtype=np.float32), BASE, axis=0)
#: Of each byte, a row of nought with one at its upper digit and, BASE further, at its lower digit.
_HOT = np.concatenate((np.repeat(np.eye(BASE, dtype=np.float32), BASE, axis=0), np.tile(np.eye(BASE, dtype=np.float32), (BASE, 1))), axis=1)
#: Rows of a product over many rows that are multiplied at once.
ROWS = 256


def one_thread() -> None:
    """Matrix products on the task's own core: these are small, and idle threads beside them spin through as much time again."""
    for file in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(file))  # numpy's own, loaded already
        if hasattr(library, "scipy_openblas_set_num_threads64_"):
            library.scipy_openblas_set_num_threads64_(1)


def prefix(ids: np.ndarray, n: int) -> np.ndarray:
    """The first n digits, as one number."""
    return ids >> 4 * (DIGITS - n)


def halves(ids: np.ndarray) -> np.ndarray:
    """The ids' upper and lower bytes, two digits each (ids by 2)."""
    return ids.ravel().astype(">u2").view(np.uint8).reshape(-1, 2)


def over_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many rows of few columns, added up from products of ROWS rows."""
    n = len(a) // ROWS * ROWS
    out = a[n:].T @ b[n:]
    out += (a[:n].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, ROWS, b.shape[1])).sum(axis=0)
    return out


def shares(counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Logarithms of each digit's share after the digits before it, (1 x 16), (16 x 16), (256 x 16), (4096 x 16), from counts by id.

    Each id of the vocabulary counts a half more than it was met; numbers that are no id next to nothing.
    """
    cells = np.full(CELLS, 1e-9)
    cells[:VOCABULARY_SIZE] = 0.5
    if counts is not None:
        cells[: len(counts)] += counts
    out = []
    for k in range(DIGITS):
        here = cells.reshape(BASE**k, BASE, -1).sum(axis=2)
        out.append(np.log(here / here.sum(axis=1, keepdims=True)).astype(np.float32))
    return tuple(out)


class Model:
    """Parameters by name, in one vector, beside the shares; forward and backward passes over windows of ids."""

    # one head as wide as the input: a query's and a key's matrix would only ever be multiplied, as would a value's and an output's
    SHAPES = {f"in{i}": (BASE, WIDTH) for i in range(DIGITS)} | {"place": (LENGTH, WIDTH), "qk": (WIDTH, WIDTH), "vo": (WIDTH, WIDTH), "out": (WIDTH, DIGITS * BASE)}
    SIZE = sum(a * b for a, b in SHAPES.values())

    def __init__(self, vector: np.ndarray | None = None, base: tuple[np.ndarray, ...] | None = None, seed: int = 7) -> None:
        if vector is None:
            vector = np.random.default_rng(seed).normal(0, 0.1, self.SIZE).astype(np.float32)
            self._views(vector)["out"][:] = 0
            self._views(vector)["place"][:, -1] = 0
        self.base = base or shares()
        #: the shares of all digits in one row, for each three digits that an id begins with
        self.rows = np.concatenate([b.take(np.arange(CELLS // BASE) >> 4 * (DIGITS - 1 - i), axis=0) for i, b in enumerate(self.base)], axis=1)
        self.vector = np.ascontiguousarray(vector, np.float32)
        self.p = self._views(self.vector)
        self.moments = np.zeros((2, self.SIZE), np.float32)
        self.steps = 0
        self.table: np.ndarray | None = None  # `inputs`, while they don't change

    def _views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, (a, b) in self.SHAPES.items():
            out[name] = vector[at : at + a * b].reshape(a, b)
            at += a * b
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The sum of its two digits' vectors for each upper and each lower byte.

        The last number of an input is one: a bias, and what rows of exponents add up to where they are multiplied with inputs.
        """
        p = self.p
        upper, lower = ((p[f"in{i}"][:, None] + p[f"in{i + 1}"]).reshape(-1, WIDTH) for i in (0, 2))
        upper[:, -1], lower[:, -1] = 1, 0
        return upper, lower

    def inputs(self) -> np.ndarray:
        """The sum of its digits' vectors for each id."""
        upper, lower = self._pairs()
        return (upper[:, None] + lower).reshape(-1, WIDTH)

    def _state(self, inp: np.ndarray, first: int = 0):
        """inp (windows by LENGTH by WIDTH, places not added yet) and what the layer makes of it at each window's places from `first` on."""
        p = self.p
        inp += p["place"]
        asking = inp[:, first:]
        q = (asking.reshape(-1, WIDTH) @ (p["qk"] * np.float32(WIDTH**-0.5))).reshape(asking.shape)
        e = q @ inp.transpose(0, 2, 1)
        if e.size and e.max() > 60:  # far from what training gives
            e += (_PAST[first:] - 1) * np.float32(1e9)
            e -= e.max(axis=2, keepdims=True)
        np.exp(e, out=e)
        e *= _PAST[first:]
        z = e @ inp
        sums = z[:, :, -1:].copy()
        z /= sums
        h = z.reshape(-1, WIDTH) @ p["vo"]
        h += asking.reshape(-1, WIDTH)
        return inp, q, e, sums, z, h

    def _exponents(self, h: np.ndarray, y: np.ndarray, hits: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
        """For each state: the sum of its target's digits' logits (if `hits`), the exponents of all logits, and their sums by digit; then the targets' places."""
        logits = self.rows.take(y >> 4, axis=0)
        logits += h @ self.p["out"]
        if len(h) and (logits.max() > 60 or h.max() > 1e3):  # far from what training gives
            logits = logits.reshape(-1, DIGITS, BASE)
            logits = (logits - logits.max(axis=2, keepdims=True)).reshape(-1, DIGITS * BASE)
        places = y >> np.arange(4 * (DIGITS - 1), -1, -4)[:, None]
        places &= BASE - 1
        places += np.arange(0, DIGITS * BASE, BASE)[:, None]
        places += np.arange(0, len(h) * DIGITS * BASE, DIGITS * BASE)
        hit = logits.ravel().take(places).sum(axis=0, dtype=np.float64) if hits else None
        np.exp(logits, out=logits)
        return hit, logits, logits @ _BLOCKS, places

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms of the targets y at the scored positions of windows x, in order. table: `inputs`, if at hand."""
        table = self.inputs() if table is None else table
        first = int(scored.any(axis=0).argmax())  # nothing before it is asked for
        some = np.flatnonzero(scored[:, first:])
        hit, _, sums, _ = self._exponents(self._state(table.take(x, axis=0), first)[-1].take(some, axis=0), y[:, first:].ravel().take(some))
        np.log(sums, out=sums)
        return hit - sums @ np.ones(DIGITS, np.float32)

    def gradient(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, inputs: bool = True, losses: bool = True) -> tuple[float | None, np.ndarray]:
        """Mean loss over the scored positions (if `losses`), and its gradient; without `inputs`, nought for the vectors of digits and places."""
        p, grad = self.p, np.zeros(self.SIZE, np.float32)
        g = self._views(grad)
        n = max(1, np.count_nonzero(scored))
        # a few that are not scored weigh nothing; many are left out
        some = slice(None) if 8 * n > 7 * scored.size else np.flatnonzero(scored)
        weight = scored.ravel()[some] / np.float32(n)
        if inputs:
            self.table = None
            own, (upper, lower) = halves(x), self._pairs()
            sums = upper.take(own[:, 0], axis=0)
            sums += lower.take(own[:, 1], axis=0)
        elif self.table is None:
            self.table = self.inputs()
        inp, q, a, total, z, h = self._state(sums.reshape(*x.shape, WIDTH) if inputs else self.table.take(x, axis=0))
        hs = h[some]
        hit, e, sums, places = self._exponents(hs, y.ravel()[some], losses)
        loss = float((np.log(sums) @ np.ones(DIGITS, np.float32) - hit) @ weight) if losses else None
        e *= (weight[:, None] / sums) @ _BLOCKS.T
        e.ravel()[places] -= weight
        g["out"][:] = over_rows(e, hs).T
        dh = e @ p["out"].T
        if len(dh) < len(h):
            part, dh = dh, np.zeros_like(h)
            dh[some] = part
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g["vo"][:] = flat(z).T @ dh
        dz = dh @ p["vo"].T
        # of each row of scores: its own sum of gradient times share, which is the product of dz and z, taken off by the inputs' last number
        dz[:, -1] = 0
        dz[:, -1:] = -((dz * flat(z)) @ np.ones((WIDTH, 1), np.float32))
        dz /= flat(total)
        dz = dz.reshape(z.shape)
        da = dz @ inp.transpose(0, 2, 1)
        da *= a
        dq = flat(da @ inp)
        g["qk"][:] = flat(inp).T @ dq * np.float32(WIDTH**-0.5)
        if not inputs:
            return loss, grad
        dx = dh
        dx += dq @ (p["qk"].T * np.float32(WIDTH**-0.5))
        dx += flat(a.transpose(0, 2, 1) @ dz)
        dx += flat(da.transpose(0, 2, 1) @ q)
        dx[:, -1] = 0
        g["place"][:] = np.ones((1, len(inp)), np.float32).dot(dx.reshape(len(inp), -1)).reshape(LENGTH, WIDTH)
        into = over_rows(_HOT.take(own, axis=0).reshape(-1, DIGITS * BASE), dx)
        for i in range(DIGITS):
            g[f"in{i}"][:] = into[i * BASE : (i + 1) * BASE]
        return loss, grad

    def learn(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, inputs: bool = True, rate: float = RATE) -> None:
        """One step of Adam, the smaller the later."""
        grad = self.gradient(x, y, scored, inputs, losses=False)[1]
        self.steps += 1
        m, s = self.moments
        m += (1 - np.float32(0.9)) * (grad - m)
        s += (1 - np.float32(0.999)) * (grad * grad - s)
        rate /= math.sqrt(1 + self.steps / 400)
        self.vector -= np.float32(rate) * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + np.float32(1e-8))


def windows(sequences: list[np.ndarray], context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, scored (windows by LENGTH) and the sequence of each window. A sequence's ids are all targets, once each."""
    step = LENGTH - context
    sizes = np.array([len(s) for s in sequences], np.int64)
    many = np.where(sizes <= LENGTH, (sizes > 0).astype(np.int64), 1 + -(-(sizes - LENGTH) // step))
    room = np.where(many > 0, (many - 1) * step + LENGTH, 0)  # what a sequence's windows cover, more or less its size
    first = np.cumsum(room) - room
    y, real = np.full(int(room.sum()) + LENGTH, END), np.zeros(int(room.sum()) + LENGTH, bool)
    for at, ids in zip(first.tolist(), sequences, strict=True):
        y[at : at + len(ids)] = ids
        real[at : at + len(ids)] = True
    x = np.concatenate(([BEGIN], y[:-1]))
    x[first[many > 0]] = BEGIN
    x[~real] = END
    who = np.repeat(np.arange(len(sequences)), many)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    starts = first[who] + nth * step
    cut_out = lambda of: np.lib.stride_tricks.sliding_window_view(of, LENGTH)[starts]
    scored = cut_out(real)
    scored[nth > 0, :context] = False
    return cut_out(x), cut_out(y), scored, who


class Words:
    """What is known of lower-cased words, by number: their subword ids (each word with a space in front), and their counts."""

    _last: tuple[str, Words] | None = None

    def __init__(self, path: str, frequent: dict[bytes, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: ids that begin a word, as only a word's first piece has a space in front
        self.begins = np.zeros(BEGIN, bool)
        self.begins[[rank for piece, rank in ranks.items() if piece.startswith(b" ")]] = True
        self.frequent = frequent or {}
        self._clear()

    @classmethod
    def of(cls, path: str, run: str, frequent: dict[bytes, int]) -> Words:
        """One for all of a worker's tasks of a run."""
        if cls._last is None or cls._last[0] != run:
            cls._last = run, cls(path, frequent)
        return cls._last[1]

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool, self.starts, self.sizes, self.counts = np.empty(0, "<u2"), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.held = 0

    def _learn(self, words: list[bytes]) -> None:
        """All in one call: a word begins at each id with a space in front."""
        ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), "<u2")
        starts = np.flatnonzero(self.begins[ids])
        self.number.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, starts + len(self.pool)))
        self.sizes = np.concatenate((self.sizes, np.diff(starts, append=len(ids))))
        self.pool = np.concatenate((self.pool, ids))
        self.counts = np.concatenate((self.counts, np.fromiter(map(self.frequent.get, words, repeat(0)), np.float64, len(words))))
        self.held += sum(map(len, words)) + 150 * len(words) + ids.nbytes

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, until the next call."""
        if self.held > MEMORY:
            self._clear()
        out = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            out[missing] = [self.number[w] for w in new]
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subword ids of words one after another, and where each word's end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: np.ndarray) -> bytes:
    return zstandard.compress(ids.astype("<u2").tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<u2").astype(np.int64)


def scores(model: Model, sequences: list[np.ndarray], table: np.ndarray | None = None, block: int = 128) -> np.ndarray:
    """log10 probability of each sequence of ids. table: the model's `inputs`, if at hand."""
    table = model.inputs() if table is None else table
    x, y, scored, who = windows(sequences)
    out = np.zeros(len(sequences))
    # a sequence's first window is scored from its begin on, all others after their context
    firsts = [np.flatnonzero(scored[:, 0]), np.flatnonzero(~scored[:, 0])]
    for part in (some[i : i + block] for some in firsts for i in range(0, len(some), block)):
        logs = model.log_probabilities(x[part], y[part], scored[part], table)
        out += np.bincount(np.repeat(who[part], np.count_nonzero(scored[part], axis=1)), logs, len(sequences))
    return out / math.log(10)


def train(model: Model, sequences: Iterator[np.ndarray], inputs: bool = True, batch: int = BATCH) -> int:
    """Steps over the sequences, every id once, in batches of windows that don't overlap; how many windows there were."""
    held: list[np.ndarray] = []
    n = size = 0

    def steps() -> int:
        x, y, scored, _ = windows(held, 0)
        for i in range(0, len(x), batch):
            model.learn(x[i : i + batch], y[i : i + batch], scored[i : i + batch], inputs)
        held.clear()
        return len(x)

    for ids in sequences:
        held.append(ids)
        size += len(ids)
        if size > 16 * batch * LENGTH:
            n, size = n + steps(), 0
    return n + (steps() if held else 0)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """rows (at, value) as an array."""
    out = np.zeros(size)
    for r in rows.collect():  # size rows at most, whatever the corpus
        out[r["at"]] = r["value"]
    return out


def trained(rows: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Parameters and shares, from all of rows (ids: packed). rows is read once for the shares and once in each round."""
    spark = rows.sparkSession
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(VOCABULARY_SIZE, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sums += np.bincount(np.concatenate([unpack(blob) for blob in batch.column(0).slice(at, 256).to_pylist()]), minlength=VOCABULARY_SIZE)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["at", "value"])

    ids = rows.select("ids")
    base = shares(_vector(ids.mapInArrow(count, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")), VOCABULARY_SIZE))
    out = Model().vector

    def copy(known):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            model = Model(known.value[0].copy(), known.value[1])
            n = train(model, (unpack(blob) for batch in batches for blob in batch.column(0).to_pylist()))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(Model.SIZE)), pa.array(model.vector.astype(np.float64) * n), pa.array(np.full(Model.SIZE, n))], names=["at", "value", "n"])

        return run

    for k in range(rounds):
        some = ids.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == k)
        copies = some.mapInArrow(copy(spark.sparkContext.broadcast((out, base))), "at long, value double, n long")
        mean = copies.groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value"))
        found = _vector(mean, Model.SIZE)
        out = found.astype(np.float32) if found.any() else out
    return out, base


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, A-Z lower-cased; of all words one after another, which of these each is; and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n_words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    words, which = found.dictionary, found.indices.to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at an end leaves an empty string there
        keep = real[which]
        n_words = np.bincount(np.repeat(np.arange(len(texts)), n_words)[keep], minlength=len(texts))
        words, which = words.filter(pa.array(real)), (np.cumsum(real) - 1)[which[keep]]
    return words, which, n_words


def counted(docs: DataFrame) -> DataFrame:
    """word, c: how often each word occurs in docs (__text)."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (batch.column(0).slice(at, 4096) for batch in batches for at in range(0, batch.num_rows, 4096)):
            words, which, _ = parted(texts)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(which, minlength=len(words)))], names=["word", "c"])

    return docs.select("__text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _looked_up(docs: DataFrame, frequent: dict[bytes, int], path: str) -> DataFrame:
    """Of each row of docs (__id, __held, __text): n_words, n_common and sum of its frequent words, its other words, its packed ids."""
    known, name = docs.sparkSession.sparkContext.broadcast(frequent), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Words.of(path, name, known.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words, which, n_words = parted(part.column(2))
                numbers = tool.numbers(words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
                c, who = tool.counts[numbers][which], np.repeat(np.arange(part.num_rows), n_words)
                ids, ends = tool.ids(numbers[which])
                cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_words)))].tolist()
                packed = [pack(np.append(ids[a:b], END)) for a, b in zip(cuts, cuts[1:], strict=False)]
                other = np.flatnonzero(c == 0)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(who[other], minlength=part.num_rows)))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(which[other])))
                sums = np.bincount(who, np.log10(c + 1), part.num_rows)
                common = n_words - np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(common, pa.int64()), pa.array(sums, pa.float64()), rare, pa.array(packed, pa.binary())],
                    names=["__id", "held_out", "n_words", "n_common", "sum", "rare", "ids"],
                )

    return docs.select("__id", "__held", "__text").mapInArrow(run, "__id long, held_out boolean, n_words long, n_common long, sum double, rare array<string>, ids binary")


def _scored(rows: DataFrame, vector: np.ndarray, base: tuple[np.ndarray, ...]) -> DataFrame:
    """rows with score in place of ids, its last column."""
    known = rows.sparkSession.sparkContext.broadcast((vector, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        model = Model(*known.value)
        table = model.inputs()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = scores(model, [unpack(blob) for blob in part.columns[-1].to_pylist()], table)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=[*part.schema.names[:-1], "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, path: str, head: int = HEAD, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text")).withColumn("__held", fold(F.col("__id")) == HELD_OUT)
    training = rows.where("NOT __held")
    counts = cut(counted(training))
    ends = training.count()
    levels = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("tokens")).collect()
    n_train = sum(r["tokens"] for r in levels) + ends
    distinct = sum(r["n"] for r in levels) + (ends > 0)
    floor, room = 64, head
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["n"]
        if room < 0:
            break
        floor = r["level"]
    frequent = {r["word"].encode("utf-8", "surrogatepass"): r["c"] for r in counts.where(F.col("c") >= F.lit(float(2**floor))).toLocalIterator()}
    seen = cut(_looked_up(rows, frequent, path).withColumn("__row", F.monotonically_increasing_id()))
    vector, base = trained(seen.where("NOT held_out"), rounds)
    rest = counts.where(F.col("c") < F.lit(float(2**floor)))
    met = seen.select("__row", F.explode("rare").alias("word")).join(rest, "word")
    tail = met.groupBy("__row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"))
    out = _scored(seen.select("__row", "__id", "held_out", "n_words", "n_common", "sum", "ids"), vector, base).join(tail, "__row", "left")
    whole = F.col("sum") + F.coalesce("rare_sum", F.lit(0.0)) + math.log10(ends + 1) - (F.col("n_words") + 1) * math.log10(n_train + distinct + 1)
    return out.select(
        F.col("__id").alias("doc_id"), "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), whole.alias("base_score"), "score",
    )


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), vocabulary_path())
