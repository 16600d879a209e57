"""Token counts: batch encoding that returns lengths only.

Each call gets about ``BATCH_BYTES`` of texts, and texts are split where a pre-tokenizer always
cuts, so that no call depends on how long a single text is.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); null and repeated ids and repeated
rows give one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.bpe import BATCH_BYTES, PieceEncoder
from callweave.llm.common import slices, tidy, utf8


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit for every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]):
        encoder = PieceEncoder(path)
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                _, at = utf8(part.column("text"))
                n = encoder.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(count), f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
