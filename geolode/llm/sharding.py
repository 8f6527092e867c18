"""Byte-balanced shards of indivisible groups, by Karmarkar-Karp differencing in two levels."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolode.llm.common import documents, text_bytes
from geolode.shared import stored

GROUPS_A_BUCKET = 100_000
PARTS_A_STEP = 10_000
ROWS_A_CELL = 100_000


def differencing(parts: list[tuple[int, ...]]) -> np.ndarray:
    """Which final subset each slot of each part goes to: a matrix of len(parts) by k.

    A part is k sums. The two parts with the largest spread are combined again and again, the largest sums of one with
    the smallest of the other, until one is left.
    """
    k = len(parts[0])
    heap, below, slots = [], [None] * len(parts), []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda s: -sums[s])
        slots.append(order)
        sums = [sums[s] for s in order]
        heap.append((sums[-1] - sums[0], i, [s - sums[-1] for s in sums]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [x[i] + y[k - 1 - i] for i in range(k)]
        order = sorted(range(k), key=lambda i: -sums[i])
        low = sums[order[-1]]
        below.append((a, b))
        slots.append(order)
        heapq.heappush(heap, (low - sums[order[0]], len(below) - 1, [sums[i] - low for i in order]))
    out = np.empty((len(parts), k), np.int64)
    going = {heap[0][1]: list(range(k))}
    for node in range(len(below) - 1, -1, -1):
        target = going.pop(node)
        if below[node] is None:
            for place, slot in enumerate(slots[node]):
                out[node, slot] = target[place]
            continue
        a, b = below[node]
        to_a = [0] * k
        for place, i in enumerate(slots[node]):
            to_a[i] = target[place]
        going[a] = to_a
        going[b] = to_a[::-1]
    return out


def _in_bucket(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "th", "crc"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        empty = (0,) * (shards - 1)
        pdf["label"] = differencing([(int(w), *empty) for w in pdf["weight"]])[:, 0].astype("int32")
        return pdf

    return run


def _step(shards: int):
    """Rows (bucket, label, w, up): the sums of some parts, differenced; each gets the place ``to`` in the part that they become."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "label"]).reset_index(drop=True)
        names, at = np.unique(pdf["bucket"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(names), shards), np.int64)
        sums[at, pdf["label"]] = pdf["w"]
        pdf["to"] = differencing([tuple(map(int, s)) for s in sums])[at, pdf["label"]].astype("int32")
        return pdf

    return run


def _final(labels: DataFrame, buckets: int, shards: int) -> DataFrame:
    """(bucket, label, shard): the buckets' parts differenced in steps of PARTS_A_STEP at most, until one part is left; none reaches the driver."""
    level, steps = labels.groupBy("bucket", "label").agg(F.sum("weight").alias("w")), []
    while True:
        groups = max(1, -(-buckets // PARTS_A_STEP))
        dealt = level.withColumn("up", F.pmod("bucket", F.lit(groups)))
        steps.append(stored(dealt.groupBy("up").applyInPandas(lambda pdf: _step(shards)(pdf), "bucket bigint, label int, w bigint, up bigint, to int")))
        if groups == 1:
            break
        level, buckets = steps[-1].groupBy(F.col("up").alias("bucket"), F.col("to").alias("label")).agg(F.sum("w").alias("w")), groups
    final = steps[-1].select("bucket", "label", F.col("to").alias("shard"))
    for below in reversed(steps[:-1]):
        final = below.join(final.select(F.col("bucket").alias("up"), F.col("label").alias("to"), "shard"), ["up", "to"]).select("bucket", "label", "shard")
    return final


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to (doc_id, size, text_crc32, shard, slot); rows with equal texts are a group and stay together.

    Size is the text's UTF-8 bytes (null: none) plus 1. Groups are weighed after combining within each task, dealt to
    buckets by hash, and differenced within each bucket; each bucket then counts as one part of ``shards`` sums, and the
    parts are differenced in turn, 10,000 in a task, as often as it takes to leave one. Slots number each
    shard's rows from 0 without gaps, in cells of a hash of the id, so no task sorts a whole shard. Null and empty texts form one group;
    repeated rows and null ids each get a slot of their own. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_bytes(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("th"),
    )
    key = ["th", "crc", "size"]
    groups = stored(rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("weight", F.col("n") * F.col("size")))
    total = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    buckets, cells = (max(1, -(-a // b)) for a, b in ((total.groups, GROUPS_A_BUCKET), (total.rows, ROWS_A_CELL)))
    schema = "th bigint, crc bigint, size bigint, weight bigint, bucket bigint, label int"
    dealt = groups.select(*key, "weight", F.pmod(F.xxhash64("th", "crc"), F.lit(buckets)).alias("bucket"))
    labels = stored(dealt.groupBy("bucket").applyInPandas(lambda pdf: _in_bucket(shards)(pdf), schema=schema))
    final = _final(labels, buckets, shards)
    of_group = labels.join(final, ["bucket", "label"]).select(*key, "shard")
    placed = stored(rows.join(of_group, key).withColumn("cell", F.pmod(F.xxhash64("doc_id", "th"), F.lit(cells))))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "th", "crc", "size"))
    out = placed.withColumn("rank", within).join(offsets, ["shard", "cell"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))


def op3_differencing_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
