"""SimHash near-duplicates, found through hierarchical indexes over fingerprints in Gray order."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import connected_components, documents, kernel_map, kernel_udf, summed, text_bytes
from geolode.shared import stored

BLOCKS = (11, 11, 11, 11, 10, 10)
#: A neighbourhood's sets are compared part by part: of so many sets, in so many parts at most while a part's texts have no more than so many bytes.
PART_SETS, PARTS, PART_BYTES = 256, 16, 16 << 20
#: Shingle sets of fewer have wide fingerprints by finer weights.
SMALL = 64


def fingerprint(spark, text: Column, width: int = 4, seed: int = 42) -> Column:
    """The 64-bit SimHash of lower-cased words in shingles of ``width``; null, empty and wordless texts give 0."""
    name = f"geolode_simhash_{width}_{seed}"
    kernel_udf(spark, name, "SimHash", "bigint", width=width, seed=seed)
    return F.call_udf(name, text)


def band_keys(code: Column, limit: int = 4) -> Column:
    """Keys of which two codes within ``limit`` bits share one: all choices of the blocks that must then agree.

    With one block each, ``limit`` differing bits spoil at most that many of the six blocks; the others agree.
    """
    if not 0 <= limit <= 5:
        raise ValueError("limit must be between 0 and 5")
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    part = [F.shiftrightunsigned(code, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, BLOCKS, strict=True)]
    agree = min(2, len(BLOCKS) - limit)
    keys = []
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), agree)):
        key = F.lit(k).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, 11).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def link_codes(codes: DataFrame, limit: int = 4) -> DataFrame:
    """``codes`` (distinct, column ``code``) to links (a, b) at ``limit`` or fewer differing bits.

    Every pair in range meets under some band key; in each key's group an index in Gray order is searched.
    Links that join nothing new within a group are left out, so a group of n codes gives n - 1 at most and
    the components are those of all links.
    """
    dealt = codes.select(F.explode(band_keys(F.col("code"), limit)).alias("key"), "code")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return kernel_map(dealt, "GrayLinks", "a bigint, b bigint", limit=limit)


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, limit: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents to (id, fingerprint, component_id), the component of links at ``limit`` or fewer bits.

    One row per input row. ``component_id`` is the smallest non-null id that can be reached. Null and empty
    texts have fingerprint zero and link like any other. Rows with equal ids keep their own fingerprints.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    marked = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint(spark, text_bytes(F.col(text_col)), width, seed).alias("code")))
    codes = marked.groupBy("code").agg(F.min("doc_id").alias("least"))
    return _grouped(marked, codes, link_codes(codes.select("code"), limit)).withColumnRenamed("code", "fingerprint")


def differing_bits(similarity: float, bits: int, allowance: float = 2.0) -> int:
    """How many of ``bits`` may differ for sets of that Jaccard similarity: the expected share, and some deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    return int(bits * share + allowance * math.sqrt(bits * share * (1 - share)))


def banding(n: int, similarity: float, missed: float = 0.03) -> tuple[int, int]:
    """Bits a key and tables, for n codes: groups of about 64, and a chance of ``missed`` that a pair of that similarity never meets."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 6)
    alike = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, math.ceil(math.log(missed) / math.log(1 - alike**bits))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to (doc_id, code, component_id): groups of texts whose shingle sets are that similar, or linked through others that are.

    Four bits of 64 are far less than a similarity of 0.8 moves (ten, give or take three), and ten of 64 also join strangers.
    So this form takes fingerprints of ``words`` times 64 bits over distinct shingles of ``width`` words (of finer weights for sets under SMALL, and of both kinds for those
    little larger), and draws into one
    neighbourhood those that differ in no more bits than the similarity lets expect, plus two deviations: 178 of 1,024 at 0.8. Codes meet
    in as many groups, by as many of their bits, as ``banding`` says for their number, and in each group an index in Gray order is searched.
    Within a neighbourhood the shingle sets themselves are compared, each with each, and linked at a Jaccard
    similarity of ``similarity`` or more; so no text is in a group without a partner that similar. Texts of similarity 0.8 meet
    with a probability of 0.95, of 0.85 with 0.99; equal shingle sets always are one vertex. ``code`` names the shingle set. Otherwise as ``near_duplicates``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return similar_rows(stored(rows), width, similarity, seed, words).select("doc_id", "code", "component_id")


def similar_rows(rows: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, words: int = 16) -> DataFrame:
    """``similar_groups`` of stored rows (row, doc_id, text) to (row, doc_id, code, component_id); ``row`` is unique, and the same whenever it is read."""
    spark = rows.sparkSession
    code, shingles = f"geolode_wide_{width}_{seed}_{words}_{similarity}".replace(".", "_"), f"geolode_shingles_{width}_{seed}"
    kernel_udf(spark, code, "WideSimHash", "binary", width=width, seed=seed, words=words, small=SMALL, most=math.ceil(SMALL / similarity))
    kernel_udf(spark, shingles, "ShingleSet", "binary", width=width, seed=seed)
    text, short = text_bytes("text"), lambda c: F.unhex(F.md5(c))
    whole = 8 * words
    marked = stored(rows.select("row", "doc_id", F.call_udf(code, text).alias("codes"), short(F.call_udf(shingles, text)).alias("code"), F.length(text).cast("bigint").alias("size")))
    marked = marked.withColumns({"wide": F.substring("codes", 1, whole), "fine": F.when(F.length("codes") > whole, F.substring("codes", whole + 1, whole))}).drop("codes")
    two = marked.filter("fine IS NOT NULL").select("wide", "fine").distinct()
    wide = marked.select("wide").unionByName(two.select(F.col("fine").alias("wide"))).distinct()
    bits, tables = banding(marked.agg(F.approx_count_distinct("wide")).first()[0], similarity)
    dealt = kernel_map(wide, "WideKeys", "key bigint, code binary", tables=tables, bits=bits)
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    near = kernel_map(dealt, "WideLinks", "a binary, b binary", limit=differing_bits(similarity, 64 * words))
    near = near.unionByName(two.toDF("a", "b"))
    near = connected_components(near.select(short(F.col("a")).alias("a"), short(F.col("b")).alias("b")))

    sets = marked.groupBy("code").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.min("size").alias("size"), F.min(short(F.col("wide"))).alias("wide"))
    sets = stored(sets.join(near, sets.wide == near.vertex, "left").select("code", "least", "row", "size", F.coalesce("root", "wide").alias("root")))
    several = summed(sets, "root", F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    parts = F.greatest(F.least(F.lit(PARTS), F.ceil(F.col("n") / PART_SETS)), F.ceil(F.col("bytes") / PART_BYTES)).cast("int")
    compared = sets.join(several.select("root", parts.alias("parts")), "root").select("row", "code", "root", "parts", F.pmod(F.xxhash64("code"), "parts").cast("int").alias("part"))
    compared = rows.select("row", "text").join(compared, "row").select("code", "root", "parts", "part", F.call_udf(shingles, text).alias("set"))
    compared = compared.select("code", "root", "part", "set", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    key = F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("key")
    side = F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int")).alias("side")
    compared = compared.select(key, side, "code", "set").repartition("key").sortWithinPartitions("key")
    links = kernel_map(compared, "SetLinks", "a binary, b binary", similarity=similarity)
    return _grouped(marked, sets.select("code", "least"), links, "row")


def _grouped(marked: DataFrame, codes: DataFrame, links: DataFrame, *others: str) -> DataFrame:
    roots = connected_components(links)
    owner = codes.join(roots, codes.code == roots.vertex, "left").select("code", F.coalesce("root", "code").alias("root"), "least")
    owner = stored(owner)
    smallest = summed(owner, "root", F.min("least").alias("component_id"))
    of_code = owner.join(smallest, "root").select("code", "component_id")
    return marked.join(of_code, "code").select(*others, "doc_id", "code", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
