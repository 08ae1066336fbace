"""Token counts: Arrow functions that encode in batches and give back lengths only.

Batches are balanced by bytes, and a text is cut at safe boundaries before it
is encoded: before a space that follows something else.  The model writes a
space as a mark, no piece holds that mark after another character, so no piece
crosses such a cut, and the counts of the parts add up to that of the text.
(The check of that property reads the whole vocabulary; a model without it is
refused.)  Parts repeat much more than texts do, so each distinct part of a batch
is encoded once, and a bounded memory of parts is kept from batch to batch.

Nulls and empty texts have 0 bytes and 0 tokens.  Every row gives one row.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Parts kept from batch to batch, and how long they may be.
KEPT_PARTS = 1_000_000
KEPT_LENGTH = 64
MARK = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("pieces of this model cross words: texts can't be cut before a space")
    return model, {}


def parts_of(text: str) -> list[str]:
    """The parts of a text, each without the one space that the model puts before every text it encodes."""
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    parts, spaces = [], 0
    for word in text.split(" "):
        if word:
            parts.append(" " * spaces + word)
            spaces = 0
        else:
            spaces += 1
    if spaces and parts:
        parts[-1] += " " * spaces
    return parts or [text]


def count_texts(texts: list[str | None], path: str) -> list[int]:
    model, known = processor(path)
    # the mark itself in a text is the same to the model as a space
    split = [parts_of(t.replace(MARK, " ")) if t else [] for t in texts]
    new = list({p for parts in split for p in parts if p not in known})
    sizes = dict(zip(new, map(len, model.encode(new, num_threads=1)))) if new else {}
    both = {**known, **sizes} if len(known) < len(sizes) else None
    if both is None:
        counts = [sum(known[p] if p in known else sizes[p] for p in parts) for parts in split]
    else:
        counts = [sum(map(both.__getitem__, parts)) for parts in split]
    if len(known) + len(sizes) > KEPT_PARTS:
        known.clear()
    known.update((p, n) for p, n in sizes.items() if len(p) <= KEPT_LENGTH)
    return counts


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20
) -> DataFrame:
    """(id_col, n_bytes, n_tokens), one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", batch_bytes):
                texts = batch.column("text")
                sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
                counts = count_texts(texts.to_pylist(), model_path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), sizes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
