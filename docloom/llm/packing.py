"""Best-fit packing of tokenised documents by exact-complement hashing of lengths.

Documents become token ids and an end id; longer ones are cut into pieces of the capacity,
the first piece taking what is left over. Only the number of pieces of each length matters for
the plan, so the plan is made from that table of at most `capacity` rows: sums of one, two and
three lengths are indexed by their value, and for the longest open piece each combination that
fills its gap exactly is consumed as often as the counts allow. What finds no exact complement
is packed by best fit, again on counts; never in more sequences than best fit alone needs. A plan step says "these lengths, so many times"; pieces
take their places by their rank among pieces of their length, which Spark computes in salted
groups.

Results: a null text is empty and gives the end id alone. Rows that share a doc_id are
documents of their own, told apart by nothing but their place; rows without doc_id are packed too. Texts are
encoded whole, whatever their length, and no piece is dropped. Ties between pieces of one length go by doc_id and
piece. An empty table gives no pieces. Other columns are left behind, so that no name clashes.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle
from .substrings import _batch

CAPACITY = 1024
END = 2
#: Pieces that one group ranks, about.
RANKED = 200_000
#: Entries of the memory of one worker for the ids of words.
REMEMBERED = 400_000

#: Pretokens of the byte-level vocabulary, for texts whose numbers are decimal digits and whose marks are not letters.
_PRETOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters for which `re` and the vocabulary's own classes agree: Latin letters without marks, digits, ASCII.
_PLAIN = re.compile(r"[\x20-\x7e\n\tÀ-ÖØ-öø-ɏ]*")


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes, as the tokenizers file gives them (special tokens in a text included).

    Texts of plain characters are split into words; words met before are looked up, new ones are merged by the
    file's own model. Other texts, and those that hold a special token, go through the file's whole pipeline."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        merge = self.tokenizer.model.tokenize
        for w in words:
            letters = w.encode("utf-8").decode("latin-1").translate(_LETTERS)
            self.known[w] = array("I", [x.id for x in merge(letters)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not _PLAIN.fullmatch(text) or any(x in text for x in self.special):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            words = _PRETOKEN.findall(text)
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self._learn(set(words).difference(self.known))
                out.append(b"".join(map(self.known.__getitem__, words)))
        return out


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printed bytes stand for themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker, so that its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    tail = np.array([end], "<u4").tobytes()
    kinds = _PIECE if with_ids else {k: v for k, v in _PIECE.items() if k != "ids"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n, size, texts = 0, 0, []
                while at + n < batch.num_rows and (not n or size < 1 << 18):
                    texts.append(batch.column("text")[at + n].as_py() or "")
                    size += len(texts[-1])
                    n += 1
                out: list[list] = [[] for _ in kinds]
                for doc, ids in zip(batch.column("doc_id").slice(at, n).to_pylist(), encode(texts)):
                    ids += tail
                    for k, (s, m) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * s : 4 * (s + m)]
                        for x, v in zip(out, (doc, k, s, m, zlib.crc32(part), part)):
                            x.append(v)
                yield _batch(out, kinds)
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


Plan = list[tuple[tuple[int, ...], int]]


def exact_complements(left: np.ndarray, capacity: int) -> Plan:
    """Sequences filled exactly, from the longest piece down: by one, two, then three complements, as often as their
    counts allow. Takes what it uses from left, the number of pieces of each length."""
    steps: Plan = []

    def use(parts: tuple[int, ...]) -> None:
        need = np.bincount(parts, minlength=capacity + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        if n:
            left[:] -= n * need
            steps.append((tuple(sorted(parts, reverse=True)), n))

    def pairs(total: int, least: int = 1) -> list[tuple[int, int]]:
        """Available lengths a >= b >= least of sum `total`, largest a first."""
        a = np.arange(min(total - least, capacity), (total + 1) // 2 - 1, -1)
        b = total - a
        ok = (left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1)) if len(a) else np.zeros(0, bool)
        return list(zip(a[ok].tolist(), b[ok].tolist()))

    use((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if left[length] and left[gap]:
            use((length, gap))
        for a, b in pairs(gap) if left[length] else ():
            if left[length]:
                use((length, a, b))
        for c in range(1, gap // 3 + 1):
            if not left[length]:
                break
            for a, b in pairs(gap - c, c) if left[c] else ():
                if left[length]:
                    use((length, a, b, c))
    return steps


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """All pieces, from the longest down, each into the open sequence with the smallest gap that takes it; on counts."""
    opened: dict[tuple[int, ...], int] = {}
    gaps: list[dict[tuple[int, ...], None]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for gap in range(length, capacity):
            while n and gaps[gap]:
                parts = next(iter(gaps[gap]))
                k = min(n, gap // length)  # what is left of this gap is again the smallest one
                m = min(n // k, opened[parts])
                n -= k * m
                opened[parts] -= m
                if not opened[parts]:
                    del opened[parts], gaps[gap][parts]
                grown = (*parts, *(length,) * k)
                opened[grown] = opened.get(grown, 0) + m
                gaps[gap - k * length][grown] = None
        if n:
            fit = capacity // length
            for k, m in ((fit, n // fit), (n % fit, 1)):
                if k and m:
                    parts = (length,) * k
                    opened[parts] = opened.get(parts, 0) + m
                    gaps[capacity - k * length][parts] = None
    return [(parts, n) for parts, n in opened.items() if n]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(lengths of one sequence, number of such sequences), using every piece once.

    Exact complements are consumed down to some length of the longest piece, the residuals go by best fit. Below that
    length small pieces are worth more as fillers of the residuals, so several are tried, and the fewest sequences win."""
    pieces = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        pieces[length] += n
    left = pieces.copy()
    exact = exact_complements(left, capacity)
    tried = []
    for down_to in (1, capacity // 4, capacity // 2, 3 * capacity // 4, capacity + 1):
        used = [(parts, n) for parts, n in exact if parts[0] >= down_to]
        rest = pieces.copy()
        for parts, n in used:
            np.subtract.at(rest, list(parts), n)
        tried.append(used + best_fit(rest, capacity))
    return min(tried, key=lambda steps: sum(n for _, n in steps))


def _places(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Per length, by rank: (first rank, first sequence, offset) of each stretch of the plan."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for parts, n in steps:
        offset = 0
        for length in parts:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    return out


def place(cut_pieces: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """Pieces with sequence_id and offset. The plan is made from the counts of lengths, `capacity` rows at most."""
    held = settle(cut_pieces, "pieces")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(1, -(-sum(counts.values()) // ranked))
    stretches = _places(plan(counts, capacity))
    tables = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in stretches.items()}
    shared = held.sparkSession.sparkContext.broadcast(tables)  # a few entries per plan step
    held = held.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (held.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n"))
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    own = held.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"])
    own = own.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_salt")
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = length == n
                first, base, at = shared.value[n]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine] = base[k] + rank[mine] - first[k]
                offset[mine] = at[k]
            kept = [c for c in names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "_rank"]
    return own.mapInArrow(run, ", ".join([*kinds, "sequence_id bigint", "offset bigint"]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(pieces(docs, path, capacity, end, with_ids), capacity).select(*columns, *["ids"] * with_ids)
