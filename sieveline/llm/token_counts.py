"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved on the driver with the library. A pre-token among them counts as
one at once; only the rest are merged, and each worker remembers the counts of the parts it has seen.

Nulls count as empty texts, a null doc_id stays null, repeated rows give repeated rows, an empty table gives an empty one,
and other columns of the input are not read.
"""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sieveline.llm.bpe import broadcast_bpe, worker_bpe
from sieveline.llm.common import map_rows


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs."""
    sent = broadcast_bpe(docs.sparkSession, tokenizer_path)

    def make():
        count = worker_bpe(*sent.value).count

        def step(batch):
            text = batch.column("text")
            n = [count(t) if t else 0 for t in text.to_pylist()]
            return {"doc_id": batch.column("doc_id"), "n_bytes": pc.fill_null(pc.binary_length(text.cast("large_binary")), 0).cast("int64"), "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
