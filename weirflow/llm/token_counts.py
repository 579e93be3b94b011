"""Token counts: lengths only, from Arrow batches balanced by bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.bpe import runs
from weirflow.llm.tokenizer import Vocabulary, default_path, encoder

#: A place where a pre-token always ends: white space after something else. Special tokens hold no white space.
BOUNDARY = re.compile(r"(?<=\S)(?=\s)")


def safe_pieces(text: str, limit: int) -> list[str]:
    """Cut a long text where pre-tokens end, so that the pieces' tokens are the text's tokens.

    A piece is longer than ``limit`` only if no boundary follows for so long.
    """
    out, start = [], 0
    while len(text) - start > limit:
        m = BOUNDARY.search(text, start + limit)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = 512, batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """Bytes and tokens of every whole text: ``id_col``, n_bytes, n_tokens, over_limit.

    One row out for each row in, repeated rows included; no shuffle. A null text counts as empty (0 bytes,
    0 tokens). An empty table gives an empty table; other columns are not read, so their names can't clash.
    Texts are taken in runs of about ``batch_bytes``; those over ``piece_chars`` are cut at safe boundaries. A worker holds
    an Arrow batch and the pieces of one run, so it takes memory for the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(tokenizer or default_path()).text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in runs(sizes, batch_bytes):
                pieces, owner = [], []
                for k, text in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist(), lo):
                    for piece in safe_pieces(text or "", piece_chars):
                        pieces.append(piece)
                        owner.append(k)
                np.add.at(n, owner, enc.lengths(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.struct(F.col(id_col).alias("k"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b")).alias("id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(count, f"id struct<k:{kind},b:bigint>, n_tokens bigint")
    return out.select(F.col("id.k").alias(id_col), F.col("id.b").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
