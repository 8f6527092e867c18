"""What both searches for repeated passages share.

A window is a run of ``window`` units (words or bytes). Each window belongs to the key that is the least hash
of its k-grams, so equal windows, wherever they stand, belong to the same key. Grams that are common in the whole
table come last in that order: a window that reaches out of a passage that many documents share has a gram of its own, and so a
key of its own. Neighbouring windows with one key form a stretch. Keys only say which stretches have to meet: where a key has several
places, the texts of all of them are fetched, and compared byte by byte. Each task searches its own pieces with an index first, and
hands each different text on once, so a passage that a third of all documents share sends one row a task; the rest
meets in shards of whole keys, with an index each. Whatever is reported as repeated is found by an index. A key with more
different texts than a shard holds is dealt anew by longer grams, and in the end by whole windows, so that no task has to hold all of a key's texts.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import kernel_map, kernel_udf, text_bytes
from geolode.shared import release, stored

COMMON = 1000
COMMON_LIST = 1 << 20
#: Units of different texts that a shard holds, and bits of the hashes that deal windows out; neither changes a result.
FULL, BITS = 1 << 20, 64
STRETCH = "key bigint, id bigint, th bigint, start int, len int, kind int"
FOUND = "id bigint, th bigint, start int, len int, key bigint"
PIECE = "key bigint, id bigint, th bigint, start int, len int, n int, piece binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): a document is its id and a hash of its text, so equal ids with different texts stay apart."""
    text = text_bytes(F.col(text_col))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def common_grams(docs: DataFrame, gram: int, by_word: bool) -> bytes:
    """Packed hashes of grams that stand COMMON times or more in all texts.

    No more than COMMON_LIST can be listed, as each has that share of all grams at least. The list decides which of a window's grams is its
    key and nothing else: whatever it holds, equal windows have equal keys, and results are the same.
    """
    met = kernel_map(docs.select("text"), "CommonGrams", "gram bigint, n bigint", gram=gram, words=int(by_word))
    sums = stored(met.groupBy("gram").agg(F.sum("n").alias("n")))
    everything = -(sums.filter("n < 0").agg(F.min("n")).first()[0] or 0)
    least = max(COMMON, everything // COMMON_LIST)
    found = [r.gram for r in sums.filter(F.col("n") >= least).select("gram").collect()]
    release(sums)
    return struct.pack(f">{len(found)}q", *found)


def repeated_spans(docs: DataFrame, window: int, gram: int, by_word: bool, search: str) -> DataFrame:
    """``docs`` (id, th, text) to the spans (id, th, start, len) that repeated windows cover; spans may overlap."""
    conf = {"window": window, "words": int(by_word), "bits": BITS, "full": FULL}
    cut = kernel_map(docs, "Stretches", STRETCH, gram=gram, common=common_grams(docs, gram, by_word), **conf)
    cut = cut.repartition(F.when(F.col("kind") == 2, F.xxhash64("id", "start")).otherwise(F.col("key"))).sortWithinPartitions("key")
    found = kernel_map(cut, "Compare", FOUND)
    asked = found.groupBy("id", "th").agg(F.collect_set(F.struct("key", "start", "len")).alias("asked"))
    pieces = kernel_map(docs.join(asked, ["id", "th"]).select("id", "th", "text", "asked"), search, PIECE, gram=window + 1, fetch=1, **conf)
    spans = None
    for longer in ((gram + 3 * window) // 4, window, window + 1):
        pieces = pieces.repartition("key").sortWithinPartitions("key")
        out = stored(kernel_map(pieces, search, PIECE, gram=longer, fetch=0, **conf))
        found = out.filter("piece IS NULL").select("id", "th", "start", "len")
        spans = found if spans is None else spans.unionByName(found)
        pieces = out.filter("piece IS NOT NULL")
        if longer > window or not pieces.limit(1).count():
            return spans


def without_spans(docs: DataFrame, spans: DataFrame, by_word: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``cut``: struct of n, n_removed, n_spans, kept (joined units), rest (the text less its spans)."""
    spark = docs.sparkSession
    name = f"geolode_cut_{'words' if by_word else 'bytes'}"
    kernel_udf(spark, name, "Cut", "struct<n:bigint,n_removed:bigint,n_spans:bigint,kept:binary,rest:binary>", words=int(by_word))
    per = spans.groupBy("id", "th").agg(F.collect_set(F.shiftleft(F.col("start").cast("bigint"), 32).bitwiseOR(F.col("len").cast("bigint"))).alias("spans"))
    per = per.select(F.struct("id", "th").alias("_k"), "spans")
    text = text_bytes(F.col(text_col))
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs[id_col].cast("bigint"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text).alias("_th"))
    both = left.join(per, (left._id == F.col("_k.id")) & (left._th == F.col("_k.th")), "left")
    return both.select("_row", F.call_udf(name, text_bytes(F.col(f"_row.`{text_col}`")), F.col("spans")).alias("cut"))
