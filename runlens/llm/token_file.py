"""Token-id files: fixed-width bit packing with block offsets.

A file set is a Parquet folder of blocks.  A block holds the ids of whole
documents, each id in the fewest bits the vocabulary needs, little-endian bit
order, and says where in it each document begins.  ``shard`` and ``block`` order
the blocks; documents are in ascending order of their id over all of them.  The
Parquet writer commits whole tasks, so a lost executor leaves no half file, and
its column statistics give random access by document.

A block is closed once it has ``BLOCK_IDS`` ids; a longer document is a block of
its own, as its text was one cell of the input.

Nulls and empty texts are documents of the end id alone.  Repeated document ids
stay separate rows, ordered by their text; a null id comes first.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, joinable, list_array, saved

BLOCK_IDS = 1 << 16
#: Parts of texts kept from batch to batch, and how long they may be.
KEPT_PARTS = 300_000
KEPT_LENGTH = 64
#: Bytes of text worked on at once.
SLICE = 2 << 20

BLOCKS = (
    "shard int, block int, n_docs int, n_ids long, first_doc long, last_doc long, "
    "docs array<long>, ends array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, one after the other."""
    if not len(ids):
        return b""
    if int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):  # whole bytes: the same layout without work on bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    parts = []
    for start in range(0, len(ids), 1 << 20):  # a multiple of 8 ids ends on a byte
        part = ids[start : start + (1 << 20)].astype("<u4")
        flat = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
        parts.append(np.packbits(flat, bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; touches only the bytes that hold them."""
    if not count:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first = start * bits
    low, high = first >> 3, (first + count * bits + 7) >> 3
    raw = np.frombuffer(payload, np.uint8, high - low, low)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    at = (first & 7) + bits * np.arange(count, dtype=np.int64)
    byte = at >> 3
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on.

    Fixed values: tokenizer files of this kind write their bytes so.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Words of Latin letters alone, which normalisation leaves as they are but for their case (the dotted capital I
#: becomes two characters, so it isn't one of them), and marks behind them, which are parted from letters.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_MARKS = r"[!-&(-/:;=?@\[\\\]^`{}~]+"
_MARKED = re.compile(f"({_LATIN.pattern})({_MARKS})")
#: The last letter of a part, and the marks behind it up to the part's end (the same classes for Arrow).
_PARTED = f"({_LATIN.pattern[:-1]})({_MARKS})( |$)"


def _merge_inputs(words: list[str]) -> list[str]:
    """What the merges see of words of Latin letters, all in one go: lower case, a letter for each byte."""
    letters = {b: c for b, c in enumerate(byte_letters()) if b != 10}
    return "\n".join(words).lower().encode().decode("latin-1").translate(letters).split("\n")


def _word(part: str) -> tuple[str, str]:
    """A part as (word, mark): one mark after a letter or digit is a token of its own, and case is dropped in ASCII."""
    if part.isascii():
        part = part.lower()
        if len(part) > 1 and part[-1] in ",.;:!?" and part[-2].isalnum():
            return part[:-1], part[-1]
    return part, ""


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without Python's search for cycles: words and ids make none, but so many objects that it ran all the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _encode_parts(parts: list[str], model, known: dict[str, bytes]) -> dict[str, bytes]:
    """Ids of distinct parts that aren't known, as bytes."""
    merges = model.model
    latin = [p for p in parts if _LATIN.fullmatch(p)]
    own = set(latin)
    marked = {p: m for p in parts if p not in own and (m := _MARKED.fullmatch(p))}
    # the word before a mark may be a part as well, here or earlier
    more = list({m[1] for m in marked.values()} - own)
    words = latin + [w for w in more if w not in known]
    # words that differ in case alone share their ids, which are known by the word in lower case
    folded = "\n".join(words).lower().split("\n") if words else []
    fresh = list(set(folded).difference(known))
    seen = _merge_inputs(fresh) if fresh else []
    once = {w: array("I", [t.id for t in merges.tokenize(x)]).tobytes() for w, x in zip(fresh, seen)}
    found = {p: once[w] if w in once else known[w] for p, w in zip(words, folded)}
    # tokens of special strings don't fold; a part that may hold one is encoded as it is
    cut = {p: (p, "") if "<|" in p else _word(p) for p in parts if p not in own and p not in marked}
    hard = list({w for pair in cut.values() for w in pair if w} | {m[2] for m in marked.values()})
    ids = {"": b""}
    for start in range(0, len(hard), 10_000):
        some = hard[start : start + 10_000]
        ids.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, model.encode_batch_fast(some, add_special_tokens=False)))
    out = once
    out.update((p, found[p]) for p in latin if p not in once)
    out.update((p, (found[m[1]] if m[1] in found else known[m[1]]) + ids[m[2]]) for p, m in marked.items())
    out.update((p, ids[w] + ids[mark]) for p, (w, mark) in cut.items())
    return out


def encode_texts(texts: list[str | None] | pa.Array, path: str) -> list[np.ndarray]:
    """Ids of whole texts.

    A text is cut at spaces and line ends: this kind of tokenizer drops white
    space before its merges, so nothing it does reaches across.  It also parts
    letters from the marks after them.  Each distinct part is encoded once for a
    batch, and a bounded number of parts is kept.  Arrow cuts the texts and
    numbers their parts; Python only sees the distinct ones.
    """
    with _uncollected():
        return _encode_column(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""), path)


def _encode_column(column: pa.Array, path: str) -> list[np.ndarray]:
    model, known = tokenizer(path)
    for blank in "\n\t":
        column = pc.replace_substring(column, blank, " ")
    split = pc.split_pattern(pc.replace_substring_regex(column, _PARTED, r"\1 \2\3"), " ")
    coded = split.values.dictionary_encode()
    parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = list(map(known.get, parts))
    fresh = _encode_parts([p for p, b in zip(parts, ids) if b is None], model, known)
    if len(known) + len(fresh) > KEPT_PARTS:
        # the parts of this batch stay: common ones are among them
        known.clear()
        known.update((p, b) for p, b in zip(parts, ids) if b is not None)
    ids = [fresh[p] if b is None else b for p, b in zip(parts, ids)]
    known.update((p, b) for p, b in fresh.items() if len(p) <= KEPT_LENGTH and len(known) < KEPT_PARTS)
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
    table = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4")))
    flat = table.take(coded.indices)
    # where each part's ids begin, and of those where each text's do
    starts = flat.offsets.to_numpy()[split.offsets.to_numpy()]
    values = flat.values.to_numpy()
    return [values[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _check_kind(path: str) -> None:
    """The shortcuts hold for tokenizers that fold case and part words as this kind does; others are refused."""
    model, _ = tokenizer(path)
    probe = ["Fern", "sch\u00d6n", "\u01c4abc", "end."]
    whole = model.encode("Fern  sch\u00d6n\n\u01c4abc\tend.", add_special_tokens=False).ids
    parts = _encode_parts(probe, model, {})
    if b"".join(parts[p] for p in probe) != array("I", whole).tobytes():
        raise ValueError(f"{path} is not a tokenizer of the kind that this writer knows")


def vocabulary(path: str) -> int:
    return tokenizer(path)[0].get_vocab_size(with_added_tokens=True)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode, append the end id, and write blocks in ascending order of the document id."""
    _check_kind(tokenizer_path)
    bits = bits_for(vocabulary(tokenizer_path))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .withColumn("shard", F.spark_partition_id())
    )

    def run(batches):
        held: list[tuple[int | None, np.ndarray]] = []
        size, block, shard = 0, 0, 0

        def close():
            ids = np.concatenate([x for _, x in held])
            names = [d for d, _ in held]
            ends = np.cumsum([len(x) for _, x in held])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([len(held)], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([names[0]], pa.int64()),
                    pa.array([names[-1]], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    list_array([ends], pa.int64()),
                    pa.array([pack(ids, bits)], pa.binary()),
                ],
                ["shard", "block", "n_docs", "n_ids", "first_doc", "last_doc", "docs", "ends", "payload"],
            )

        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                shard = batch.column("shard")[0].as_py()
                for doc, ids in zip(batch.column("id").to_pylist(), encode_texts(batch.column("text"), tokenizer_path)):
                    if held and size + len(ids) >= BLOCK_IDS:
                        yield close()
                        held, size, block = [], 0, block + 1
                    held.append((doc, np.concatenate([ids, end])))
                    size += len(ids) + 1
                pa.default_memory_pool().release_unused()
        if held:
            yield close()

    rows.mapInArrow(run, BLOCKS).withColumn("bits", F.lit(bits)).write.parquet(out)
    return out


def _read(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    """What ``run`` makes of the blocks: (docs, ends, payload, bits), and begin, the ids of all blocks before."""
    blocks = spark.read.schema(f"{BLOCKS}, bits int").parquet(path)
    # one row for each block, and of those one for each shard, pass through these windows
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(shards.select("shard", before.alias("before")), "shard")
        .select("shard", "block", (F.col("before") + F.col("inside")).alias("begin"))
    )

    return (
        blocks.select("shard", "block", "docs", "ends", "payload", "bits")
        .join(joinable(saved(starts, "starts"), 24), ["shard", "block"])
        .mapInArrow(run, schema)
    )


def _documents(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids of some documents, where each of these begins and the last one ends, and their tokens from the first on."""
    for batch in batches:
        for docs, ends, begin, payload, bits in zip(
            *(batch.column(c).to_pylist() for c in ("docs", "ends", "begin", "payload", "bits"))
        ):
            bounds = np.array([0, *ends], np.int64)
            for k in range(0, len(docs), 256):
                some = bounds[k : k + 257]
                ids = unpack(payload, bits, int(some[0]), int(some[-1] - some[0]))
                yield pa.array(docs[k : k + 256], pa.int64()), some + begin, ids


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files; start counts the ids of all documents before."""

    def run(batches):
        for docs, bounds, ids in _documents(batches):
            lists = np.split(ids, (bounds - bounds[0])[1:-1])
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(bounds[:-1]), list_array(lists, pa.int32())], ["doc_id", "start", "ids"]
            )

    return _read(spark, path, run, "doc_id long, start long, ids array<int>")


def read_crc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, as ``crc`` of ``read_documents``: no ids leave the task that reads them."""

    def run(batches):
        for docs, bounds, ids in _documents(batches):
            yield _sums(docs, pa.array(bounds[:-1]), ids, bounds - bounds[0])

    return _read(spark, path, run, SUMS)


def read_span(spark: SparkSession, path: str, doc_id: int, start: int = 0, count: int | None = None) -> list[int]:
    """Ids ``start`` to ``start + count`` of one document, read from its block only."""
    blocks = spark.read.schema(f"{BLOCKS}, bits int").parquet(path)
    row = blocks.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).where(
        F.array_contains("docs", F.lit(doc_id))
    ).first()
    if row is None:
        return []
    at = row.docs.index(doc_id)
    low = row.ends[at - 1] if at else 0
    most = row.ends[at] - low - start
    n = max(0, most if count is None else min(count, most))
    return unpack(row.payload, row.bits, low + start, n).tolist()


SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _sums(docs: pa.Array, starts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Rows of ``SUMS``; the ids of a document are those between its bounds."""
    import zlib

    values = ids.astype("<u4")
    sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [docs, starts, pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"],
    )


def crc(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read from files."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            yield _sums(batch.column("doc_id"), batch.column("start"), ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy())

    return documents.mapInArrow(run, SUMS)
