"""Best-fit packing: bounded-space online best fit over token pieces.

Documents become token ids with an end id; longer ones are cut from the back into full pieces, so that only the first
piece is shorter. Full pieces are sequences of their own. The other pieces stream through tasks that each keep a fixed
number of open bins: a bitset has one bit per free space that some open bin has, its lowest set bit at or above a
piece's length is the best fit. Where none fits, a new bin opens, and if all places are taken the fullest bin closes
first. Bins that a task leaves open are pieces of the next round with fewer tasks, so that little space is lost at ends.

Defined results: a null text is empty and gives one piece that holds the end id alone. Repeated rows and repeated or
null ids are packed each for itself. An empty table gives an empty result."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import checked_broadcast, durable, query, small_batches

LENGTH = 1024
OPEN_BINS = 1024
#: Pieces that one packing task takes.
TASK_PIECES = 200_000
#: Tasks of one round whose open bins meet in a task of the next round.
FAN_IN = 16
TOKENIZER = "byte_bpe_50k"
END_ID = 2
#: Characters up to which the faster tokenizer is used.
FAST_CHARS = 100_000


#: The vocabulary's special token and its id; the tokenizer reads its string in a text as the token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@lru_cache(1)
def encoder(name: str = TOKENIZER) -> Callable[[str], list[int]]:
    """Ids as the JSON file's tokenizer gives them without added special tokens.

    The rank file gives the same ids in a fifth of the time for what stands between special tokens. Very long parts go to
    the JSON file's tokenizer, as the faster one can run out of stack on them."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = lru_cache(1)(lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))

    def plain(part: str) -> list[int]:
        return fast.encode_ordinary(part) if len(part) < FAST_CHARS else full().encode(part, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        first, *others = text.split(SPECIAL)
        ids = plain(first)
        for part in others:
            ids += [SPECIAL_ID, *plain(part)]
        return ids

    return encode


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: all full but the first."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


_PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]))


@F.pandas_udf(_PIECES)
def piece_digests(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    encode = encoder()
    for part in parts:
        out = []
        for text in part:
            ids = np.array([*encode(text or ""), END_ID], "<u4")
            out.append([{"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s:s + n].tobytes())} for i, (s, n) in enumerate(cuts(len(ids)))])
        yield pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def piece_ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The token ids of each piece, for writers of training shards."""
    encode = encoder()
    for part in parts:
        texts = ([*encode(text or ""), END_ID] for text in part)
        yield pd.Series([[ids[s:s + n] for s, n in cuts(len(ids))] for ids in texts])


class Packer:
    """Best fit with a fixed number of open bins; `place` gives (bin, offset)."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.limit = length, open_bins
        self.free: list[list[int]] = [[] for _ in range(length + 1)]  # open bins by free space
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, space: int) -> int:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        return found

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            at, space = self.made, self.length
            self.made += 1
            self.open += 1
        rest = space - size
        if rest:
            self.free[rest].append(at)
            self.bits |= 1 << rest
        else:
            self.open -= 1
        return at, self.length - space

    def left(self) -> dict[int, int]:
        """Open bins with what they hold."""
        return {b: self.length - space for space, bins in enumerate(self.free) for b in bins}


def _pack(level: int, into: str, outer: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's pieces in the order they come; rows of bins that stay open say what the bin holds."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = (level << 56) + (TaskContext.get().partitionId() << 32)
        packer, seen = Packer(), []
        for part in parts:
            spots = [packer.place(int(n)) for n in part[outer]]
            part[into] = np.array([first + b for b, _ in spots], np.int64)
            part["spot"] = np.array([o for _, o in spots], np.int64)
            seen.append(part)
        left = packer.left()
        for part in seen:  # at most TASK_PIECES narrow rows
            held = [left.get(b - first, 0) for b in part[into]]
            yield part.assign(held=np.array(held, np.int64))
    return run


def _round(rows: DataFrame, level: int, into: str, size: str, tasks: int) -> DataFrame:
    """Every row gets a bin of this level; rows are dealt evenly, whatever their ids."""
    schema = rows.schema.simpleString()[len("struct<"):-1] + f",{into}:long,spot:long,held:long"
    return durable(rows.repartition(tasks).mapInPandas(_pack(level, into, size), schema))


def pack(pieces: DataFrame) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows that have a `length` of 1 to LENGTH."""
    full = pieces.filter(F.col("length") >= LENGTH).withColumns({
        "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = pieces.filter(F.col("length") < LENGTH)
    tasks = max(1, -(-short.count() // TASK_PIECES))
    short = _round(short, 1, "sequence_id", "length", tasks)
    last, merged = short, []
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        still = last.filter("held > 0").groupBy(F.col("sequence_id").alias("bin")).agg(F.max("held").alias("size"))
        last = _round(still, 2 + len(merged), "sequence_id", "size", tasks)
        merged.append(last.select("bin", F.col("sequence_id").alias("into"), F.col("spot").alias("base")))
    out = short.withColumnRenamed("spot", "offset").drop("held")
    if merged:
        moves = merged.pop()
        while merged:
            later = moves.select(F.col("bin").alias("into"), F.col("into").alias("end"), F.col("base").alias("more"))
            moves = merged.pop().join(later, "into", "left").select(
                "bin", F.coalesce("end", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        moves = durable(moves).withColumnRenamed("bin", "sequence_id")
        out = out.join(checked_broadcast(moves, moves.count()), "sequence_id", "left").withColumns({
            "offset": F.col("offset") + F.coalesce("base", F.lit(0)), "sequence_id": F.coalesce("into", "sequence_id")}).drop("base", "into")
    return out.unionByName(full)


def packed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    docs = small_batches(docs.select("doc_id", "text"))
    pieces = docs.select("doc_id", F.explode(piece_digests("text")).alias("p")).select("doc_id", "p.*")
    return pack(durable(pieces)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_packing")
def _op2(table):
    return packed_documents(table("documents"))
