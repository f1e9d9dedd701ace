"""N-best segmentation: forward Viterbi scores as exact heuristics of a backward A* search over the piece lattice.

Spaces become "▁" and one is put in front. The lattice has an edge for each vocabulary piece that matches, and for a
character that no piece covers one edge of its UTF-8 byte pieces. The vocabulary file has merge ranks, not
probabilities, so an edge scores by Zipf's law: minus the logarithm of its piece's rank (a byte edge: of the vocabulary's size, a byte),
in whole millionths, so that sums are exact and ties are real. Equal scores: in the
order of the search, the same each time; between stretches, a departure in a later one first.

No piece has a "▁" after another character, or a line end beside one, so a path passes every such place, and the lattice
falls apart there into stretches. For each distinct stretch a worker works out the best path and the score of the second,
forwards. A text's N best depart from its best path only in the N - 1 stretches where that costs least: a departure
anywhere else has N better ones. The lists of those stretches come from the search: forward best scores to every
position, then A* from the end with those as heuristics, which are exact, so that complete paths leave the queue best first.

Defined results. A null or empty text has no ids, one path of score 0. Fewer paths than N: as many as there are. Repeated
rows are encoded one by one; an empty table gives an empty result; columns the input has besides are kept by
`segmented`, which refuses input that has its result columns. Texts are used whole. Decoding joins pieces and bytes,
drops the space in front, and gives the text back exactly; U+2581 in a text comes back as a space, as the format has it.

Scale: a narrow map, no shuffle. The stretches a worker remembers are bounded in bytes: the first ones, the frequent among them, stay. A stretch
may be as long as a text: edges are looked up when they are needed, not kept, and of a long one only places that some best path can pass are searched.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import product
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.runtime import ship, table

MODEL = "piece_bpe_32k.model"
N_BEST = 4
#: Bytes of stretches that a worker remembers, what Python adds to each counted too; longer stretches than LONG are not remembered.
MEMORY = 208 << 20
LONG = 256
#: From this length on, a stretch's numbers are kept as plain ones, and its search is bounded first.
MANY = 4_096
SPACE = "▁"

STRETCH = re.compile(r"\n| *[^ \n]+| +")

Path = tuple[int, tuple[int, ...]]


class Pieces:
    """The vocabulary: pieces with score and id, the byte pieces, and what decoding needs."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.text) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        plain = [i for i in range(n) if not special[i] and i not in self.byte_of]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        self.edge = {self.text[i]: (-round(1e6 * math.log(rank + 1)), i) for rank, i in enumerate(plain, 1)}
        self.byte_score = -round(1e6 * math.log(n + 1))
        self.longest = max(map(len, self.edge))
        #: score and id of each piece; false for what pieces begin with but is none
        self.walk: dict[str, tuple[int, int] | bool] = {p[:k]: False for p in self.edge for k in range(1, len(p))} | self.edge
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.edge):
            raise ValueError("a piece has a space after another character, or a line end; stretches would not be independent")

    def edges(self, s: str, i: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(end, score, ids) of the edges from position i."""
        out = []
        for j in range(i + 1, len(s) + 1):
            e = self.walk.get(s[i:j])
            if e is None:
                break
            if e:
                out.append((j, e[0], (e[1],)))
        if not out or out[0][0] > i + 1:
            out.append((i + 1, *self.bytes_of(s[i])))
        return out

    def entering(self, s: str, j: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the edges that end at position j, from the longest to the shortest."""
        for i in range(max(0, j - self.longest), j):
            e = self.edge.get(s[i:j])
            if e:
                yield i, e[0], (e[1],)
        if s[j - 1] not in self.edge:
            yield j - 1, *self.bytes_of(s[j - 1])

    def bytes_of(self, char: str) -> tuple[int, tuple[int, ...]]:
        raw = char.encode("utf-8", "surrogatepass")
        return self.byte_score * len(raw), tuple(self.byte_id[b] for b in raw)

    def raw_of(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids) -> str:
        raw = self.raw_of(ids)
        return raw.decode("utf-8", "surrogatepass")[1:]


def _numbers(kind: str, value, n: int):
    """n times value: a list, or, for many, an array, which takes a fifth of the room."""
    return [value] * n if n < MANY else array(kind, [value]) * n


def _forward(s: str, pieces: Pieces) -> list[int] | array:
    """The best score from the start to each position."""
    best = _numbers("q", -(1 << 62), len(s) + 1)
    best[0] = 0
    for i in range(len(s)):
        here = best[i]
        for j, score, _ in pieces.edges(s, i):
            if here + score > best[j]:
                best[j] = here + score
    return best


def _bound(s: str, pieces: Pieces, best, n: int) -> int:
    """A score that the n best paths reach. Each edge has a best path through it; paths of n different scores are n paths."""
    size = len(s)
    back = _numbers("q", -(1 << 62), size + 1)  # the best score from each position to the end
    back[size] = 0
    found: list[int] = []
    for j in range(size, 0, -1):
        for i, score, _ in pieces.entering(s, j):
            back[i] = max(back[i], back[j] + score)
            through = best[i] + score + back[j]
            if (len(found) < n or through > found[0]) and through not in found:
                heapq.heappush(found, through)
                if len(found) > n:
                    heapq.heappop(found)
    return found[0] if len(found) == n else -(1 << 62)


def n_best(s: str, pieces: Pieces, n: int = N_BEST) -> list[Path]:
    """The n best paths through the lattice of s: (score, ids), best first."""
    size = len(s)
    best = _forward(s, pieces)
    floor = _bound(s, pieces, best, n) if size >= MANY else -(1 << 62)
    out: list[Path] = []
    # cost: minus (the score so far, from the end, plus the best score from the start to here), so the queue never errs;
    # of equal costs the place nearest the start goes first, so that ties don't grow the queue
    serial = 0
    queue: list = [(-best[size], size, 0, 0, None)]
    while queue and len(out) < n:
        _, at, _, score, chain = heapq.heappop(queue)
        if at == 0:
            ids: list[int] = []
            while chain is not None:
                begin, end, chain = chain
                e = pieces.edge.get(s[begin:end])
                ids.extend((e[1],) if e else pieces.bytes_of(s[begin])[1])
            out.append((score, tuple(ids)))
            continue
        for start, edge, _ in pieces.entering(s, at):
            whole = best[start] + edge + score
            if whole >= floor:
                serial += 1
                heapq.heappush(queue, (-whole, start, serial, edge + score, (start, at, chain)))
    return out


def best_two(s: str, pieces: Pieces) -> tuple[int, tuple[int, ...], float]:
    """The best path's score and ids, and how much less the second best scores."""
    size, get = len(s), pieces.walk.get
    best, second = _numbers("d", -math.inf, size + 1), _numbers("d", -math.inf, size + 1)
    best[0] = 0.0
    start, last = _numbers("q", 0, size + 1), _numbers("i", -1, size + 1)  # -1: bytes

    for i in range(size):
        here, next_, j, e = best[i], second[i], i + 1, get(s[i])
        if not e:  # no piece is this character alone
            score, _ = pieces.bytes_of(s[i])
            second[j] = max(second[j], min(best[j], here + score), next_ + score)
            if here + score > best[j]:
                best[j], start[j], last[j] = here + score, i, -1
        while e is not None:
            if e:
                score = here + e[0]
                if score > best[j]:
                    second[j] = best[j] if best[j] > next_ + e[0] else next_ + e[0]
                    best[j], start[j], last[j] = score, i, e[1]
                elif score > second[j]:
                    second[j] = score
            j += 1
            if j > size:
                break
            e = get(s[i:j])
    parts, at = [], size
    while at:
        parts.append((last[at],) if last[at] >= 0 else pieces.bytes_of(s[at - 1])[1])
        at = start[at]
    flat = tuple(x for ids in reversed(parts) for x in ids)
    return int(best[size]), flat, best[size] - second[size]


def combine(lists: list[list[Path]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best ways to take one path of each list: (loss against the best, index taken in each)."""
    ways = [(0, ())]
    for some in lists:
        ways = sorted((loss + some[0][0] - some[k][0], taken + (k,)) for (loss, taken), k in product(ways, range(len(some))))[:n]
    return ways


class Segmenter:
    _one: dict[tuple[str, int, int], Segmenter] = {}

    def __init__(self, path: str, n: int, memory: int = MEMORY) -> None:
        self.pieces, self.n, self.memory = Pieces(path), n, memory
        #: for each stretch: ids of its best path as bytes, its score, what departing from it costs (inf: cannot), whether it decodes
        self.known: dict[str, tuple[bytes, int, float, bool]] = {}
        self.held = self.missed = 0

    @classmethod
    def of(cls, path: str, n: int, memory: int = MEMORY) -> Segmenter:
        if (path, n, memory) not in cls._one:
            cls._one[path, n, memory] = cls(path, n, memory)
        return cls._one[path, n, memory]

    def _learn(self, stretch: str) -> tuple[bytes, int, float, bool]:
        score, ids, loss = best_two(stretch.replace(" ", SPACE), self.pieces)
        found = np.array(ids, "<u4").tobytes(), score, loss, self.pieces.raw_of(ids) == stretch.encode("utf-8", "surrogatepass")
        if len(stretch) <= LONG:
            size = getsizeof(stretch) + getsizeof(found[0]) + 250
            if self.held + size <= self.memory:
                self.held += size
                self.known[stretch] = found
            else:
                self.missed += size
                if self.missed > self.memory:
                    self.forget()
        return found

    def forget(self) -> None:
        self.known.clear()
        self.held = self.missed = 0

    def paths(self, text: str) -> tuple[list[tuple[int, bytes]], bool]:
        """The n best paths of the text (score, ids as little-endian unsigned 32-bit integers), and whether the best decodes to it."""
        if not text:
            return [(0, b"")], True
        stretches = split(text)
        found = list(map(self.known.get, stretches))
        if None in found:
            met: dict[str, tuple] = {}
            for i, x in enumerate(found):
                if x is None:
                    s = stretches[i]
                    found[i] = met.get(s) or met.setdefault(s, self._learn(s))
        ids, scores, losses, same = zip(*found, strict=True)
        score, loss = sum(scores), np.array(losses)
        some = least(loss, self.n - 1)
        lists = {i: n_best(stretches[i].replace(" ", SPACE), self.pieces, self.n) for i in some}
        ways = combine(list(lists.values()), self.n)
        out = []
        for less, taken in ways:
            other = list(ids)
            for i, k in zip(some, taken, strict=True):
                other[i] = np.array(lists[i][k][1], "<u4").tobytes()
            out.append((score - less, b"".join(other)))
        return out, all(same)

    def decode(self, ids: bytes) -> str:
        return self.pieces.decode(np.frombuffer(ids, "<u4").tolist()) if ids else ""


def least(loss: np.ndarray, n: int) -> list[int]:
    """Places of the n smallest finite losses, the earlier ones among equals, in order."""
    if len(loss) > n:
        edge = np.partition(loss, n - 1)[n - 1]
        below = np.flatnonzero(loss < edge)
        at = np.sort(np.concatenate((below, np.flatnonzero(loss == edge)[: n - len(below)])))
    else:
        at = np.arange(len(loss))
    return at[np.isfinite(loss[at])].tolist()


def split(text: str) -> list[str]:
    """Line ends, and stretches between them that have spaces only at their beginning; a space is put in front of all."""
    return STRETCH.findall(" " + text.replace(SPACE, " "))


COLUMNS = [T.StructField("best_ids", T.BinaryType()), T.StructField("scores", T.ArrayType(T.LongType())), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("round_trip", T.BooleanType())]


def segmented(docs: DataFrame, path: str, n: int = N_BEST, text: str = "text", drop_text: bool = False, memory: int = MEMORY, keep: bool = True) -> DataFrame:
    """docs with best_ids (little-endian unsigned 32-bit), scores and crcs of the n best paths, and round_trip: whether the best decodes to the text. memory: bytes a worker remembers; keep: from one task to the next."""
    ship(docs.sparkSession)
    if clash := {f.name for f in COLUMNS} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Segmenter.of(path, n, memory)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(part.schema.names.index(text)).to_pylist()]
                found, same = zip(*map(tool.paths, texts), strict=True)
                new = [
                    pa.array([f[0][1] for f in found], pa.binary()), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[zlib.crc32(ids) for _, ids in f] for f in found], pa.list_(pa.int64())),
                    pa.array(same, pa.bool_()),
                ]
                old = {c: part.column(k) for k, c in enumerate(part.schema.names) if not (drop_text and c == text)}
                yield pa.RecordBatch.from_arrays([*old.values(), *new], names=[*old, *(f.name for f in COLUMNS)])
        if not keep:
            tool.forget()

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema if not (drop_text and f.name == text)] + COLUMNS))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segmented(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), drop_text=True)
    n = (F.octet_length("best_ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_ids"), F.sha2("best_ids", 256).alias("ids_sha256"), "scores", "crcs", "round_trip")
