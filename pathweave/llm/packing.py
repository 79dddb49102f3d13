"""Pack token sequences by vector best fit.

A piece of a document asks for a vector of three sizes: tokens, one document,
and attention cost (the square of its length). A sequence has a capacity in each.
Best fit decreasing puts each piece, longest first, into the open sequence that
holds it under every capacity and scores best, by the weighted norm of what it
would leave (least) or the weighted dot product of piece and room (most).

All three sizes follow from a piece's length, and there are at most as many
lengths as tokens in a sequence. So the fit runs on the histogram of lengths,
over groups of sequences with equal content, and yields a table of slots: pieces
of length l with ranks [first, first + n) go to sequences [base, base + n) at one
offset. The histogram and the slots do not grow with the corpus. Spark counts the
histogram, ranks the pieces of each length and looks up their slots; the fit
is that of the whole corpus, not of blocks of it.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed

MAX_TOKENS = 2048
END_ID = 0
#: A length gets one more salt for so many pieces of the whole input.
ROWS_PER_SALT = 2000
#: Chunks of text whose ids a worker keeps; the store is emptied when full.
KEPT_CHUNKS = 300_000


class ByteBpe:
    """Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit numbers.

    The vocabulary is the one of a tokenizer file of the ``tokenizers`` library, in
    its form as ranks beside it. ``ids`` takes strings of added tokens as ordinary
    text; ``library_ids`` gives their own ids, as the library does by default. The
    pattern of this kind of vocabulary never joins what stands on two sides of
    a single space, so such texts are cut before their spaces and the ids of each
    chunk are kept; texts with runs of white space are encoded in one go.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                   special_tokens={}).encode_ordinary

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = self[chunk] = array("I", encode(" " + chunk)).tobytes()
                return ids

        self.encode, self.chunks = encode, Chunks()
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.added = {a["content"]: array("I", [a["id"]]).tobytes() for a in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest))})" if longest else r"(?!)").split

    def ids(self, text: str) -> bytes:
        if len(" ".join(text.split())) != len(text):  # white space at an end or in runs
            return array("I", self.encode(text)).tobytes()
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))

    def library_ids(self, text: str) -> bytes:
        """Ids with added tokens as such; the texts between them are encoded each on its own."""
        parts = self.split(text)
        if len(parts) == 1:
            return self.ids(text)
        return b"".join(self.added[x] if k % 2 else self.ids(x) for k, x in enumerate(parts) if x)


@cache
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
                 max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its whole text (null: empty), as the library gives them with
    add_special_tokens=False (strings of added tokens have their own ids), and the end id. Longer
    ones are cut so that all pieces but the first are full. Repeated rows give
    repeated pieces; null ids stay null; an empty table gives no pieces.
    """
    kind = docs.schema[id_col].dataType
    fields = [("doc_id", kind.simpleString()), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    fields += [("ids", "binary")] * with_ids
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                data = bpe.library_ids(t.as_py() or "") + end
                n, at, k = len(data) // 4, 0, 0
                view = memoryview(data)
                while at < n:
                    size = (n - 1) % max_tokens + 1 if at == 0 else max_tokens
                    part = view[4 * at:4 * (at + size)]
                    rows.append(i); piece.append(k); start.append(at); length.append(size); crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(bytes(part))
                    at, k = at + size, k + 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [f for f, _ in fields])

    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(cut, ", ".join(f"{f} {k}" for f, k in fields))


def fit(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int = MAX_TOKENS, max_cost: int = MAX_TOKENS**2,
        weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Vector best fit of counted lengths: slots (length, first rank, number, first sequence, offset), and the number of sequences.

    Pieces that exceed a capacity on their own are refused.
    """
    caps = np.array([max_tokens, max_docs, max_cost], float)
    w = np.array(weights)
    room = np.empty((0, 3))  # of each group of like sequences
    number: list[int] = []
    held: list[tuple[tuple[int, int, int], ...]] = []  # of each group: (length, first rank, offset)
    done: list[tuple[int, tuple[tuple[int, int, int], ...]]] = []

    def add(new: list[tuple[np.ndarray, int, tuple]]) -> None:
        nonlocal room
        for r, n, h in new:
            if r.min() <= 0:
                done.append((n, h))
            else:
                room = np.vstack([room, r])
                number.append(n)
                held.append(h)

    def drop(g: int) -> None:
        nonlocal room
        room = np.delete(room, g, axis=0)
        del number[g], held[g]

    for length in sorted(counts, reverse=True):
        item, left, rank = np.array([length, 1.0, float(length) ** 2]), counts[length], 0
        if length < 1 or (item > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = np.flatnonzero((room >= item).all(axis=1))
            if fits.size:
                if score == "dot":
                    order = -((room[fits] / caps) * (item / caps) @ w)
                else:
                    order = (((room[fits] - item) / caps) ** 2) @ w
                g = int(fits[order.argmin()])
                n = min(left, number[g])
                r, h, total = room[g].copy(), held[g], number[g]
                offset = max_tokens - int(r[0])
                drop(g)
                new = [(r - item, n, (*h, (length, rank, offset)))]
                if n < total:  # the rest of the group stays as it is, its ranks further on
                    new.append((r, total - n, tuple((x, y + n, z) for x, y, z in h)))
                add(new)
                left, rank = left - n, rank + n
                continue
            each = int((caps // item).min())
            n = left // each or 1
            k = min(each, left)
            add([(caps - k * item, n, tuple((length, rank + j * n, j * length) for j in range(k)))])
            left, rank = left - n * k, rank + n * k
    slots, base = [], 0
    for n, h in [*done, *zip(number, held, strict=True)]:
        slots += [(length, first, n, base, offset) for length, first, offset in h]
        base += n
    return slots, base


def pack(pieces: DataFrame, order: tuple[str, ...] = ("doc_id", "piece", "start"), length: str = "length",
         max_tokens: int = MAX_TOKENS, **capacities) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is gapless from offset 0.

    ``order`` breaks ties among pieces of equal length; rows that are equal in it
    take places of their own in any order. Columns sequence_id and offset of the
    input are replaced, others stay. An empty table gives an empty table; a null
    length or one below 1 is an error.
    """
    kept = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in kept.groupBy(length).count().collect()}  # at most max_tokens rows
    slots, _ = fit({int(k): n for k, n in counts.items()}, max_tokens, **capacities)
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    shift = 1 << 44  # ranks stay below it
    shared = kept.sparkSession.sparkContext.broadcast((table[:, 0] * shift + table[:, 1], table))

    salts = 1 + sum(counts.values()) // ROWS_PER_SALT
    tie = F.xxhash64(*[F.col(c) for c in order])
    salt: Column = F.pmod(tie, F.lit(salts))
    rows = kept.select(F.struct("*").alias("row"), F.col(length).cast("bigint").alias("l"), tie.alias("h"), salt.alias("salt"),
                       F.concat_ws("/", *[F.col(c).cast("string") for c in order]).alias("t"))
    cells = rows.groupBy("l", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("l").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("l", "salt", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("at"))
    ranked = (rows.withColumn("k", F.row_number().over(Window.partitionBy("l", "salt").orderBy("h", "t")))
              .join(cells, ["l", "salt"]).select("row", "l", (F.col("at") + F.col("k") - 1).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slot = shared.value
        for b in batches:
            l, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            found = slot[np.searchsorted(keys, l * shift + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], ["row", "sequence_id", "offset"])

    spec = f"row {kept.schema.simpleString()}, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, spec).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """Tokenize, cut and pack documents (doc_id, text): token_pieces, written once, then pack."""
    return pack(checkpointed(token_pieces(docs, path)), **options)
