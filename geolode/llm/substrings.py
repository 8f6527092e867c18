"""Removal of word passages that appear earlier, by matching statistics over a compressed FM-index per shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import documents
from geolode.llm.repeats import keyed, repeated_spans, without_spans

WINDOW = 20
GRAM = 6


def earlier_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to rows (_row, cut): each input row, and what is left without words of windows that start earlier.

    A window is ``window`` consecutive words of one document; earlier is a smaller id, or the same document and
    an earlier start. Null ids come first. Rows with one id and different texts are ordered by a hash of the
    text; repeated rows (id and text) count as one document, so neither is earlier than the other. Null and
    empty texts, and texts of fewer words than a window, lose nothing. An empty table gives an empty result.
    Columns of any name pass through inside ``_row``.
    """
    spans = repeated_spans(keyed(docs, id_col, text_col), window, gram, True, "EarlierWindows")
    return without_spans(docs, spans, True, id_col, text_col)


def op4_fm_substrings(spark, sf_dir: str) -> DataFrame:
    out = earlier_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("cut.n").alias("n_words"),
        F.col("cut.n_removed").alias("n_removed"),
        F.sha2(F.col("cut.kept"), 256).alias("kept_sha256"),
    )
