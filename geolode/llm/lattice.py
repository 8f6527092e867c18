"""Language-model scores: the probability of a text over all its segmentations into vocabulary pieces."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm import vocabulary
from geolode.llm.common import documents, id_crc, kernel_map, text_bytes
from geolode.shared import stored

HOT_SHARE = 2e-6
PRIOR = 1000.0
ROUNDS = 4


def _doubles(values) -> bytes:
    return struct.pack(f">{len(values)}d", *values)


def row_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with a column ``_rid`` that names each row: the id where ids are unique and none is null, else a number given once."""
    counted = docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull())
    if not counted.limit(1).count():
        return docs.withColumn("_rid", F.col(id_col).cast("bigint"))
    return stored(docs.withColumn("_rid", F.monotonically_increasing_id()))


def word_counts(texts: DataFrame) -> DataFrame:
    """``texts`` (text as bytes) to (word, n): lower-cased words and how often they stand, combined within each task."""
    return kernel_map(texts, "WordCounts", "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, vocab: vocabulary.Vocabulary, n_texts: int, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[list[float], list[float], float]:
    """Log weights of pieces, of bytes and of a text's end, fitted to (word, n).

    Starts from the vocabulary's own weights. Each round takes expected counts over all segmentations of all
    words (forward and backward sums) and mixes them with the vocabulary's weights as ``prior`` further
    counts. What reaches the driver is one number a piece, however large the corpus is.
    """
    pieces, single = list(vocab.log_p), [vocab.byte_log_p] * 256
    end = math.log(0.01)
    scale = math.log(0.99)
    base_p, base_b = [x + scale for x in pieces], [x + scale for x in single]
    pieces, single = base_p, base_b
    for _ in range(rounds):
        expected = kernel_map(counts, "ExpectedPieces", "piece int, n double", blob=vocab.blob, pieces=_doubles(pieces), bytes=_doubles(single))
        got = {r.piece: r.n for r in expected.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        total = math.log(sum(got.values()) + n_texts + prior)
        fresh = lambda i, old: math.log(got.get(i, 0.0) + prior * math.exp(old)) - total if old > -math.inf else -math.inf
        pieces = [fresh(i, x) for i, x in enumerate(base_p)]
        single = [fresh(i - 256, x) for i, x in enumerate(base_b)]
        end = math.log(n_texts + prior * 0.01) - total
    return pieces, single, end


def lattice_scores(docs: DataFrame, train, vocab_path: str = vocabulary.PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to one row each: id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a condition on ``docs``; rows that meet it are learned from. A-Z is lower-cased, words stand between white
    space, and each text ends with one end token. ``score`` is the log10 of the text's probability: its words,
    each with a mark before it, are spelled by pieces and bytes in every way there is, and all ways are added up.
    ``base_score`` is that of a word model with half a count added. Null and empty texts have the end token
    only. With nothing to learn from, N and V are 0 and the vocabulary's own weights are used. Repeated rows and
    rows with null ids each get their own result. An empty table gives an empty result. Other columns are ignored.

    Words with more than HOT_SHARE of all training tokens, at most 1 / HOT_SHARE of them however large the
    corpus is, travel to the scoring tasks; all other words meet their counts in a join, where no word is hot.
    """
    vocab = vocabulary.load(vocab_path)
    spark = docs.sparkSession
    rows = row_ids(docs, id_col)
    learn = rows.filter(train)
    counts = stored(word_counts(learn.select(text_bytes(F.col(text_col)).alias("text"))))
    n_texts = learn.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + n_texts, total.v + (n_texts > 0)
    pieces, single, end = fit_pieces(counts, vocab, n_texts)
    hot = counts.filter(F.col("n") > max(1.0, n * HOT_SHARE)).collect()
    blob = b"".join(struct.pack(">I", len(r.word)) + bytes(r.word) for r in hot)
    scored = kernel_map(
        rows.select("_rid", text_bytes(F.col(text_col)).alias("text")),
        "ScoreTexts",
        "key binary, refs binary, rid bigint, tokens bigint, score double, base double, known bigint",
        blob=vocab.blob, pieces=_doubles(pieces), bytes=_doubles(single), end=float(end), hot=blob,
        counts=struct.pack(f">{len(hot)}q", *(r.n for r in hot)),
    )
    cold = counts.filter(F.col("n") <= max(1.0, n * HOT_SHARE)).select(F.col("word").alias("key"), "n")
    met = scored.join(cold, "key", "left").select("refs", "rid", "tokens", "score", "base", "known", "n")
    parts = kernel_map(met, "GatherScores", "rid bigint, tokens bigint, score double, base double, known bigint")
    sums = parts.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("tokens", "score", "base", "known")])
    whole = F.lit(math.log10(n + 0.5 * (v + 1)))
    end_log = math.log10((n_texts if n_texts else 0) + 0.5)
    out = sums.select(
        F.col("rid").alias("_rid"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.lit(1 if n_texts else 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.lit(end_log) - F.col("tokens") * whole).alias("base_score"),
        "score",
    )
    held = rows.select("_rid", F.col(id_col).alias("doc_id"))
    return held.join(out, "_rid").drop("_rid")


def op1_lattice_lm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = lattice_scores(docs, F.coalesce(id_crc() % 5, F.lit(0)) != 1)
    held = F.coalesce(id_crc() % 5, F.lit(0)) == 1
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
