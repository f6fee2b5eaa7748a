"""Best-fit packing planned over a histogram of lengths.

Documents become token ids and an end id; longer ones are cut into full pieces, the first of which takes the remainder.
The plan is made over counts by length, at most ``width`` numbers: longest first, each length goes to the open
sequences with the least room that still holds it, many at once. Pieces then take planned slots by joining on their
rank within their length.

Defined results: null and empty texts are one piece that holds the end id alone; a null or repeated doc_id is an
ordinary row; identical rows are interchangeable; no rows give no rows; other columns are never looked at.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldgauge.llm.common import query, table, texts_of
from fieldgauge.sources.workspace import materialise

WIDTH = 1024
END_ID = 2
SALTS = 1024
BATCH_BYTES = 4 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("salt", pa.int32())])
_PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"


def byte_bpe(json_path: str, ranks_path: str, pattern: str, special: dict[str, int]):
    """An encoder that gives the ids of the JSON tokenizer. The rank file holds the same vocabulary and is several times
    faster; the few texts whose pattern search needs too deep a stack go to the JSON tokenizer itself."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
    return encode


def public_bpe():
    import public_tokenizers as P

    return byte_bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


def pieces(docs: DataFrame, encoder=public_bpe, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One narrow row per piece; ids stay in the task."""
    def run(batches):
        encode = encoder()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for doc_id, raw in zip(ids, texts_of(batch)):
                tokens = np.append(encode(raw.decode()), end_id).astype("<u4")
                first = len(tokens) % width or width
                cuts = [0, *range(first, len(tokens) + 1, width)]
                salt = zlib.crc32(b"%d" % (doc_id or 0)) % SALTS
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, i, a, b - a, zlib.crc32(tokens[a:b].tobytes()), salt))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECES)], schema=_PIECES)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _PIECES_DDL)


def plan(counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, offset) by best fit, longest first. Sequences alike in what
    they hold form a run of numbers, and a length fills a run at a time, so the work depends on lengths, not on
    documents."""
    slots: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, how many)
    rooms: list[int] = []                                       # heap of rooms that have runs
    made = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        set_aside = []
        while left:
            while rooms and (rooms[0] < length or not runs[rooms[0]]):
                room = heapq.heappop(rooms)
                if runs[room]:
                    set_aside.append(room)
            if not rooms:
                each = width // length
                whole, rest = divmod(left, each)
                for n, fill in ((whole, each), (1 if rest else 0, rest)):
                    for k in range(fill if n else 0):
                        slots.append((length, rank, rank + n, made, k * length))
                        rank += n
                    if n and width - fill * length:
                        runs[width - fill * length].append((made, n))
                        heapq.heappush(set_aside, width - fill * length)
                    made += n
                break
            room = rooms[0]
            first, n = runs[room].pop()
            take = min(n, left)
            slots.append((length, rank, rank + take, first, width - room))
            if take < n:
                runs[room].append((first + take, n - take))
            if room - length:
                runs[room - length].append((first, take))
                heapq.heappush(rooms, room - length)
            rank, left = rank + take, left - take
        for room in set_aside:
            heapq.heappush(rooms, room)
    return slots


def pack(docs: DataFrame, encoder=public_bpe, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and offset. Texts are read and encoded once; ranks come from slices of each
    length, which are counted first, so a length that a third of all pieces share is split too."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, encoder, width, end_id))
    tallies = materialise(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= width rows
    slots = F.broadcast(spark.createDataFrame(plan(counts, width), "_length bigint, _from bigint, _to bigint, _first bigint, _offset bigint"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = tallies.select(F.col("length").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (cut.withColumn("_row", F.row_number().over(inner) - 1)
              .join(starts, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s")))
              .withColumn("_rank", F.col("_before") + F.col("_row")))
    placed = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
