"""Document chunks for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions.text import collapse, let


def chunks(documents: DataFrame, key: str, text: Column | str, size: int = 200, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the one before.

    Works within a row, so it needs no shuffle; an empty text has no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap

    def windows(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, F.lit(size)))
        return F.when(F.size(words) > 0, cut)

    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    return documents.select(key, F.posexplode(let(words, windows)).alias("chunk_index", "_part")).select(
        key, "chunk_index", F.array_join("_part", " ").alias("content"), F.size("_part").alias("token_count")
    )
