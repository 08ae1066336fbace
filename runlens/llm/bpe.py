"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into overlapping chunks of characters.  Each chunk is
pre-tokenised on its own, in any task.  Two neighbouring scans are stitched at
the first position in their overlap where both begin a pre-token: matching goes
from left to right without looking back, so from a common boundary on both find
the same pre-tokens.  The pieces between the stitches are encoded in parallel
and their ids joined in order.  A text of one chunk needs no stitch and is
encoded where it is read.

A scan that begins inside a pre-token is trusted only after its first hard
boundary: one that every scan has, because no pre-token holds a letter followed
by something else, a number followed by something else, or a character followed
by white space.  Chunks whose overlap has no common boundary (a run of one kind
of character, longer than the overlap) are joined to the piece before them.

Nulls count as empty; an empty text has no ids.  Repeated rows each give a row.
Long texts are keyed by two hashes of their content, so equal ones are encoded
once.  Extra columns are not read; only the named two are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, list_array, saved

CHUNK = 32_768
OVERLAP = 2_048
#: No pre-token that ends this far before the end of a chunk depends on what follows the chunk.
AHEAD = 3
HARD = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def boundaries(text: str, pattern: str, begin: int, size: int, overlap: int, first: bool, last: bool):
    """(head, tail): where pre-tokens of a chunk begin, as places in the whole text.

    head: in the overlap with the chunk before.  tail: in the overlap with the
    chunk after, as far as the scan can be trusted.
    """
    import regex

    starts = np.fromiter((m.start() for m in regex.finditer(pattern, text)), np.int64)
    head = starts[starts <= overlap] if not first else starts[:0]
    tail = starts[:0]
    if not last:
        hard = 0 if first else next((m.start() for m in regex.finditer(HARD, text)), len(text))
        tail = starts[(starts >= max(size, hard)) & (starts <= len(text) - AHEAD)]
    return head + begin, tail + begin


def _encode_batches(batches: Iterator[pa.RecordBatch], keys: list[str], path: str, pattern: str):
    enc = encoding(path, pattern)
    for whole in batches:
        for batch in byte_slices(whole, "text"):
            ids = [np.asarray(enc.encode_ordinary(t or ""), np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), list_array(ids, pa.int32())], [*keys, "ids"]
            )


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids_col: str, out: str):
    table = token_bytes(path)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            rows = batch.slice(start, 512)
            texts = []
            for ids in rows.column(ids_col):
                values = ids.values
                try:
                    texts.append(
                        None
                        if values is None
                        else b"".join(
                            b"".join(map(table.__getitem__, values.slice(i, 1 << 20).to_pylist()))
                            for i in range(0, len(values), 1 << 20)
                        )
                    )
                except KeyError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], [*rows.schema.names, out])


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: bool = False,
) -> DataFrame:
    """(id_col, ids array<int>), one row for each row of ``docs``.

    ``decoded`` adds what ``decode`` adds.  A text of one chunk is then encoded and its ids
    decoded by one Python worker: two steps in one stage keep two workers for each core,
    which stay in memory and take part in whatever the session runs next.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    long = F.char_length("text") > chunk + overlap

    def encode_by(*keys):
        return lambda batches: _encode_batches(batches, list(keys), ranks_path, pattern)

    def round_trip(batches):
        return _decode_batches(encode_by("id")(batches), ranks_path, "ids", "bytes")

    short = rows.where(~long).mapInArrow(
        round_trip if decoded else encode_by("id"), f"id {id_type}, ids array<int>" + ", bytes binary" * decoded
    )
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text")).alias("k2")]
    texts = rows.where(long).select(*key, "text").dropDuplicates(["k1", "k2"])
    n = F.ceil((F.char_length("text") - overlap) / chunk).cast("int")
    part = lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + overlap))
    chunks = saved(
        texts.select(
            "k1", "k2", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), part)).alias("c", "text")
        ),
        "chunks",
    )

    def scan(batches):
        for batch in batches:
            heads, tails = [], []
            for text, c, n in zip(*(batch.column(x).to_pylist() for x in ("text", "c", "n"))):
                head, tail = boundaries(text, pattern, c * chunk, chunk, overlap, c == 0, c == n - 1)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("k1", "k2", "c")), list_array(heads, pa.int64()), list_array(tails, pa.int64())],
                ["k1", "k2", "c", "head", "tail"],
            )

    scans = saved(chunks.mapInArrow(scan, "k1 long, k2 long, c int, head array<long>, tail array<long>"), "scans")
    after = scans.select("k1", "k2", "c", "head")
    before = scans.select("k1", "k2", (F.col("c") + 1).alias("c"), "tail")
    stitches = after.join(before, ["k1", "k2", "c"]).select(
        "k1", "k2", "c", F.array_min(F.array_intersect("tail", "head")).alias("cut")
    )
    text_order = Window.partitionBy("k1", "k2").orderBy("c")
    begin = F.when(F.col("c") == 0, F.lit(0).cast("long")).otherwise(F.col("cut"))
    stride = F.col("c").cast("long") * chunk
    low = F.coalesce(F.col("begin"), stride)
    high = F.coalesce(F.col("next"), stride + chunk)
    own = F.when(
        F.col("c") == F.col("n") - 1, F.expr("substring(text, int(low - stride) + 1)")
    ).otherwise(F.expr("substring(text, int(low - stride) + 1, int(high - low))"))
    pieces = (
        chunks.join(stitches, ["k1", "k2", "c"], "left")
        .withColumn("begin", begin)
        .withColumn("next", F.lead("begin").over(text_order))
        .withColumn("piece", F.max(F.when(F.col("begin").isNotNull(), F.col("c"))).over(text_order))
        .withColumn("stride", stride)
        .withColumn("low", low)
        .withColumn("high", high)
        .select("k1", "k2", "piece", "c", own.alias("text"))
        .groupBy("k1", "k2", "piece")
        .agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(c, text))), x -> x.text)"), "").alias("text"))
    )
    encoded = pieces.mapInArrow(encode_by("k1", "k2", "piece"), "k1 long, k2 long, piece int, ids array<int>")
    joined = encoded.groupBy("k1", "k2").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(piece, ids))), x -> x.ids))").alias("ids")
    )
    of_long = rows.where(long).select("id", *key).join(joined, ["k1", "k2"]).select("id", "ids")
    if decoded:
        of_long = decode(of_long, ranks_path)
    return short.unionByName(of_long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """Add the bytes that the ids stand for, one after the other; null where an id is unknown."""

    def run(batches):
        return _decode_batches(batches, ranks_path, ids_col, out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, `{out}` binary")


def digests(ids_col: str = "ids", bytes_col: str = "bytes"):
    """The columns that sum up ids and bytes."""
    ids = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(bytes_col), 256).alias("decoded_sha256"),
    ]
