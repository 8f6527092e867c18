"""A training-data pipeline of five stages, each calling one of the operators in ``geolode.llm``.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of ``documents``; the last gives
their token ids. ``run`` writes what each stage gives to the shared folder as Parquet, and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm import contamination, language, nbest, simhash, substrings
from geolode.shared import kept, scratch, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter (``und``: null, empty and letterless texts too) go. A missing label gets the prediction, or
    stays missing where no row has a label to learn from; other values stay as they are.

    Texts of any length are read whole. Rows with null or equal ids and repeated rows are judged each by its own text, alike for equal texts. An empty table gives an empty
    result, and columns of any name pass through.
    """
    if not docs.filter("lang is not null and text is not null").limit(1).count():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, F.lit(True)).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*[F.coalesce(F.col("_row.lang"), F.col("lang_pred")).alias(c) if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of shingle sets (five words) that are 0.8 alike; null ids come last, then a hash of the text decides.

    Rows are told apart by a number of their own, so those of equal or null ids stay wherever their texts are in different groups; of repeated rows
    one stays. What is kept on disk for the result is ids and text hashes only, and the rows are read again. Null, empty and wordless texts have one shingle set, so one such row stays; texts under five words are compared as a whole, very long ones by all their
    shingles. Ties go to the row that is met first. An empty table gives an empty result, and columns of any name pass through.
    """
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # a struct, as nulls in it equal each other
    named = whole.withColumn("name", F.struct(F.col("_row.doc_id").alias("id"), F.md5(F.col("_row.text").cast("binary")).alias("text")))
    with scratch():
        rows = stored(named.select("row", "name", F.col("_row.text").alias("text")))
        order = F.struct(F.col("name.id").isNull().alias("unnamed"), F.col("name.id").alias("id"), F.xxhash64("text").alias("hash"), F.col("row").alias("row"))
        groups = simhash.similar_rows(rows.select("row", order.alias("doc_id"), "text"))
        stay = rows.select("row", "name").join(groups.filter("row = component_id.row").select("row"), "row", "left_semi")
        several = rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
        stay = kept(stay.join(several, "name", "left").select("name", F.col("n").isNotNull().alias("again")))
    out = named.join(stay.filter("NOT again"), "name", "left_semi").select("_row.*")
    if not stay.filter("again").limit(1).count():
        return out
    # dealt by a struct of the name, so Spark can split the rows of one name
    again = named.join(stay.filter("again"), "name", "left_semi").groupBy(F.struct("name").alias("_k")).agg(F.min_by("_row", "row").alias("_row"))
    return out.unionByName(again.select("_row.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the words of passages (20 words) that start earlier; documents of which nothing is left go, by that rule or because they were null, empty or wordless.

    What is left keeps its white space, and ``n_chars`` follows; other texts stay as they are. Earlier is a smaller id, null ids first, then a hash of the text; repeated rows (id and text) are one
    document, so neither loses words to the other. Texts of any length are searched whole. An empty table gives an empty result, and columns of any name pass through.
    """
    out = substrings.earlier_passages(docs).filter(F.col("cut.n_removed") < F.greatest(F.col("cut.n"), F.lit(1)))
    changed = F.col("cut.n_removed") > 0
    text = F.when(changed, F.col("cut.rest").cast("string")).otherwise(F.col("_row.text"))
    out = out.select("_row", changed.alias("changed"), text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text").cast("bigint")).otherwise(F.col("_row.n_chars"))}
    return out.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item stands, up to its error budget (items under 20 characters: as whole words, without an edit).

    Null and empty texts hold no item and stay; null and empty items are in no text. Rows with null or equal ids and repeated rows are judged each by its own text, whole, however
    long it is. An empty table of documents or of items gives the documents as they are, and columns of any name pass through.
    """
    return contamination.without_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (big-endian 4-byte piece numbers of the best segmentation), score, margin over the next.

    Null counts as empty, and an empty text has no pieces, a score of 0 and no margin (null), as has any text with one segmentation only. Among equal scores a fixed order decides.
    Every row gets its own result, whatever its id; equal texts get equal ones. Texts of any length are encoded whole. An empty table gives an empty
    result; columns beside those of ``documents`` are left out.
    """
    out = nbest.encoded(docs)
    unit = F.lit(float(nbest.UNIT))
    return out.select(
        *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "lang", "source")],
        (F.length(F.col("ids")[0]) / 4).cast("bigint").alias("n_tokens"),
        F.col("ids")[0].alias("token_ids"),
        (F.col("scores")[0] / unit).alias("score"),
        ((F.col("scores")[0] - F.get("scores", F.lit(1))) / unit).alias("margin"),
        (F.col("text_back") == F.coalesce(F.col("_row.text"), F.lit(""))).alias("decoded_ok"),
    )


STAGES = [
    ("language ID", keep_languages),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding", encode_pieces),
]

#: No SQL: a trained classifier and a search over a lattice; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
