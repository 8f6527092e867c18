"""SentencePiece encoding and decoding: the n best segmentations, by forward Viterbi and backward A-star search."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm import vocabulary
from geolode.llm.common import documents, kernel_udf, text_bytes

UNIT = 1 << 20
N_BEST = 4


def _fixed(x: float) -> int:
    return round(x * UNIT) if x > -math.inf else -(1 << 50)


def functions(spark, n: int = N_BEST, vocab_path: str = vocabulary.PATH) -> tuple[str, str]:
    """Names of two SQL functions: text bytes to struct(scores, ids), and packed ids to text bytes."""
    v = vocabulary.load(vocab_path)
    encode, decode = f"geolode_nbest_{n}_{abs(hash(vocab_path))}", f"geolode_decode_{abs(hash(vocab_path))}"
    kernel_udf(
        spark, encode, "NBest", "struct<scores:array<bigint>,ids:array<binary>>",
        blob=v.blob, weights=struct.pack(f">{v.size}q", *map(_fixed, v.log_p)), singles=struct.pack(">256q", *[_fixed(v.byte_log_p)] * 256), first_byte=v.first_byte, k=n,
    )
    kernel_udf(spark, decode, "Decode", "binary", blob=v.blob, first_byte=v.first_byte)
    return encode, decode


def encoded(docs: DataFrame, n: int = N_BEST, vocab_path: str = vocabulary.PATH, text_col: str = "text") -> DataFrame:
    """``docs`` to rows (_row, scores, ids, texts): up to ``n`` segmentations of each whole text, best first.

    ``scores`` are natural-log weights in units of 2^-20, compared as whole numbers, so ties are exact; equal
    ones come in a fixed order. ``ids`` are packed big-endian 4-byte piece numbers, ``texts`` what they decode to.
    Blanks are marks and one mark stands before the text; characters without a piece are spelled in bytes, so any text comes
    back as it was. Null counts as empty; an empty text has one segmentation, of no pieces. Columns of any
    name pass through inside ``_row``. An empty table gives an empty result.
    """
    encode, decode = functions(docs.sparkSession, n, vocab_path)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    found = whole.select("_row", F.call_udf(encode, text_bytes(F.col(f"_row.`{text_col}`"))).alias("found"))
    return found.select("_row", "found.scores", "found.ids", F.call_udf(decode, F.col("found.ids")[0]).cast("string").alias("text_back"))


def op8_nbest_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_best, best_score, last_score, ids_sha256 (the best), nbest_sha256 (all), decoded_ok."""
    out = encoded(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        F.col("_row.doc_id").alias("doc_id"),
        (F.length(F.col("ids")[0]) / 4).cast("bigint").alias("n_tokens"),
        F.size("ids").alias("n_best"),
        (F.col("scores")[0] / UNIT).alias("best_score"),
        (F.element_at("scores", -1) / UNIT).alias("last_score"),
        F.sha2(F.col("ids")[0], 256).alias("ids_sha256"),
        F.sha2(F.concat_ws(",", F.transform("ids", lambda x: F.sha2(x, 256))), 256).alias("nbest_sha256"),
        (F.col("text_back") == F.coalesce(F.col("_row.text"), F.lit(""))).alias("decoded_ok"),
    )
