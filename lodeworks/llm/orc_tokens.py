"""Token ids in ORC: tokenized documents as stripes of run-length encoded integers, and digests from reading them back.

Documents are dealt by ranges of doc_id (and a hash of their text, so that rows of one id or none spread) and sorted, tokenized in that order, and written by Spark's ORC writer: integer
run-length encoding (direct, dictionary off for numbers), row indexes every `stride` rows, a Bloom filter on doc_id,
stripes of `stripe` bytes that separate tasks can read, minimum and maximum of doc_id in every stripe's and file's
statistics, so that a search for some documents skips the rest (`find`). Reading back is one map over the stripes, whose digests are kept; the
running start of each document is a sum within a part plus the sums of the parts before.

Texts are tokenized by pieces between spaces and line ends, with a memory of pieces met before, bounded in bytes: the tokenizer's own
rules never join what a space or a line end parts.

Defined results. A null or empty text has only the end id. Documents with a null doc_id come first. Rows that share a
doc_id are ordered by a hash of their text. An empty table gives an empty file and an empty result. Columns the input has
besides are not written. Texts are used whole.

Scale: one shuffle of the texts, by range, none of ids. What is collected is one number for each part written.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from sys import getsizeof
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.runtime import cut, ensure_checkpoint_dir, ship, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
STRIDE = 1_000
STRIPE = 16 << 20
#: Bytes of pieces and ids that a worker remembers, what Python adds to each counted too; longer pieces than LONG are not remembered.
MEMORY = 256 << 20
LONG = 256
#: Words that the tokenizer's rules neither change nor part, and that only have letters of their own.
WORD = re.compile(r"[a-zß-öø-ÿ]+\Z")
#: Marks that close a piece, right after an ASCII letter: the tokenizer never joins them with it. No apostrophe.
MARKS = ".,!?;:|#$%&*()[]{}/+=-"
#: The special token put between pieces that are encoded together, and its id.
BETWEEN, BETWEEN_ID = "<|startoftext|>", 49406


class Encoder:
    """ids(text) as little-endian unsigned 32-bit integers, equal to the tokenizer's own over the whole text."""

    _one: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: for plain words between spaces, which the other's rules leave as they are
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        #: ids of pieces, those among them that others are made of: bodies and closing marks
        self.known: dict[str, bytes] = {"": b""}
        self.held = self.missed = 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self._encode_one(self.tokenizer, t), "<u4").tobytes() for t in texts]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode many pieces in few calls. Plain words stand between spaces: each is one word to the tokenizer, so its ids
        end with the only one that closes a word. Between the others stands a special token, at which it splits first."""
        plain, other, odd = [], [], []
        for p in pieces:
            (plain if p.isascii() and p.isalpha() or WORD.match(p) else odd if BETWEEN in p else other).append(p)
        out = dict(zip(odd, self._encode(odd), strict=True)) if odd else {}
        for tokenizer, some, between in ((self.words, plain, " "), (self.tokenizer, other, BETWEEN)):
            for at in range(0, len(some), 2_000):
                part = some[at : at + 2_000]
                ids = np.array(self._encode_one(tokenizer, between.join(part)), "<u4")
                if between == " ":
                    ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
                    starts = [0, *ends[:-1]]
                else:
                    cuts = (4 * np.flatnonzero(ids == BETWEEN_ID)).tolist()
                    starts, ends = [0, *(x + 4 for x in cuts)], [*cuts, 4 * len(ids)]
                raw = ids.tobytes()
                out.update(zip(part, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        return out

    @staticmethod
    def _encode_one(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        known = self.known
        found = list(map(known.get, pieces))
        try:
            return b"".join(found)
        except TypeError:  # some are not known yet
            pass
        new = dict.fromkeys([p for p, x in zip(pieces, found, strict=True) if x is None], b"")
        parts = list(map(parted, new))
        learnt = self._learn([x for x in dict.fromkeys(chain.from_iterable(parts)) if x not in known])
        got = lambda x: learnt[x] if x in learnt else known[x]
        new = {p: got(body) + got(marks) if marks else got(body) for p, (body, marks) in zip(new, parts, strict=True)}
        out = b"".join([new[p] if x is None else x for p, x in zip(pieces, found, strict=True)])
        learnt.update(new)
        if len(max(learnt, key=len)) > LONG:
            learnt = {p: x for p, x in learnt.items() if len(p) <= LONG}
        size = sum(map(getsizeof, learnt)) + sum(map(getsizeof, learnt.values())) + 100 * len(learnt)
        if self.held + size <= MEMORY:
            self.held += size
            known.update(learnt)
        else:  # full: what came first, the frequent words among it, stays, until as much was missed as is held
            self.missed += size
            if self.missed > MEMORY:
                known.clear()
                known[""] = b""
                self.held = self.missed = 0
        return out


def parted(piece: str) -> tuple[str, str]:
    """What the tokenizer treats alone, so that fewer are distinct: a piece up to its closing marks, and those marks. A
    capital letter of ASCII is lowered, as the tokenizer would do itself; not in what may hold a special token, as those are
    found before letters are lowered. What it returns is its own body."""
    if "<|" in piece:
        return piece, ""
    body = piece.rstrip(MARKS)
    if len(body) == len(piece) or not (body[-1:].isascii() and body[-1:].isalpha()):
        return piece.lower() if piece.isascii() else piece, ""
    return body.lower() if body.isascii() else body, piece[len(body) :]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) in the order of docs."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.ids(t.as_py() or "") + end for t in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                values = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, parts: int | None = None, stride: int = STRIDE, stripe: int = STRIPE, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write docs' ids under folder in ascending doc_id order: file after file, part numbers ascending."""
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = few.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = tokenized(dealt, path, end_id)
    ids = ids.select("doc_id", "ids", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    writer = ids.write.mode("overwrite").option("compression", "zstd").option("orc.row.index.stride", stride).option("orc.stripe.size", stripe)
    writer.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(folder)


def find(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them are skipped by statistics and Bloom filters."""
    return spark.read.orc(folder).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document under folder."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            raw = memoryview(np.ascontiguousarray(values, "<u4")).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    stored = spark.read.schema("doc_id long, ids array<int>, part int, row long").orc(folder)
    rows = stored.select("doc_id", "part", "row", "ids").mapInArrow(run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    return rows


def with_starts(rows: DataFrame) -> DataFrame:
    """rows with start: the n_tokens of all rows before, in order of part and row."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part written: small, whatever the number of documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return out.join(F.broadcast(offsets), F.col("part") == F.col("__part")).withColumn("start", F.col("__offset") + F.col("__within"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/orc-{uuid4().hex}"


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return with_starts(cut(read_digests(spark, folder))).select("doc_id", "start", "n_tokens", "ids_crc32")
