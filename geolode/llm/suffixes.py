"""Removal of byte strings that appear elsewhere, by induced sorting and permuted common prefixes per shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import documents
from geolode.llm.repeats import keyed, repeated_spans, without_spans

WINDOW = 400
GRAM = 32


def repeated_strings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to rows (_row, cut): each input row, and what is left without bytes of strings that also start elsewhere.

    A string is ``window`` bytes of one document's UTF-8 text. Every place of a repeated string goes, the first
    too, overlapping ones of one document included; a repeated row (id and text) is another place. What is left
    is bytes, as cuts may fall within a character. Null and empty texts, and texts shorter than a window, lose
    nothing. An empty table gives an empty result. Columns of any name pass through inside ``_row``.
    """
    spans = repeated_spans(keyed(docs, id_col, text_col), window, gram, False, "RepeatedStrings")
    return without_spans(docs, spans, False, id_col, text_col)


def op6_suffix_arrays(spark, sf_dir: str) -> DataFrame:
    out = repeated_strings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("cut.n").alias("n_bytes"),
        F.col("cut.n_removed").alias("n_removed"),
        F.col("cut.n_spans").alias("n_spans"),
        F.sha2(F.col("cut.kept"), 256).alias("kept_sha256"),
    )
