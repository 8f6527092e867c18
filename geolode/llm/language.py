"""Language identification: a text's language family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolode.llm.common import documents, id_crc, kernel_udf, text_bytes

DIMS = 2048
SAMPLE = 6000
UNKNOWN = "und"
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa si ur",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@dataclass(frozen=True)
class Model:
    """What ``fit`` learned: language names, and the packed classifiers as the kernel reads them."""

    languages: tuple[str, ...]
    members: bytes
    family: bytes
    pair: bytes


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss on some rows of x, by dual coordinate descent; y is +1 or -1 for each of them."""
    w, alpha = np.zeros(x.shape[1] + 1, x.dtype), np.zeros(len(rows))
    slack = 0.5 / cost
    norm = np.array([float(x[r] @ x[r]) + 1 + slack for r in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own = x[rows[i]]
            g = y[i] * float(own @ w[:-1] + w[-1]) - 1 + slack * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(alpha[i] - g / norm[i], 0.0)
            moved = max(moved, abs(new - alpha[i]))
            step = x.dtype.type((new - alpha[i]) * y[i])
            w[:-1] += step * own
            w[-1] += step
            alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype("<f4")


def fit(labelled: DataFrame, sample: int = SAMPLE, dims: int = DIMS, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learns from a sample of ``labelled`` rows: ``sample`` distinct texts at most, as many of each language as there are or an equal share.

    Of each language those with the smallest hashes are drawn, each text once, so the draw is the same wherever rows lie and however
    often a text is repeated; rows without a letter teach nothing. The driver gets ``sample`` vectors of ``dims`` numbers at most, however large the table is.
    """
    spark = labelled.sparkSession
    name = f"geolode_grams_{dims}"
    kernel_udf(spark, name, "GramVector", "binary", dims=dims)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col), F.lit(5)).alias("h"), F.col(text_col).alias("text"))
    counts = {r[0]: r[2] for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return Model((), b"", b"", b"")
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (2 * each + 50) / n))])  # more than needed, whatever the estimate's error
    place = F.pmod("h", F.lit(1 << 30))
    few = rows.filter(place / F.lit(float(1 << 30)) < share[F.col("lang")]).select("lang", "h").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    drawn = F.broadcast(few.withColumn("first", first).filter(F.col("first") <= each).select("lang", "h"))
    texts = rows.join(drawn, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = sorted(texts.select("lang", "h", F.call_udf(name, text_bytes("text")).alias("v")).collect(), key=lambda r: (r.lang, r.h))
    if not got:
        return Model((), b"", b"", b"")
    lang = np.array([r.lang for r in got])
    x = np.empty((len(got), dims), "<f4")
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r.v, "<f4")
        got[i] = None
    languages = tuple(sorted(set(lang)))
    families: dict[str, list[int]] = {}
    for i, code in enumerate(languages):
        base = code.lower().replace("_", "-").split("-")[0]
        families.setdefault(FAMILY_OF.get(base, "=" + code), []).append(i)
    groups = [families[k] for k in sorted(families)]
    number = {code: i for i, code in enumerate(languages)}
    of = np.array([number[c] for c in lang])
    family = b"".join(svm(x, np.arange(len(of)), np.where(np.isin(of, g), 1.0, -1.0)).tobytes() for g in groups) if len(groups) > 1 else b""
    pair = []
    for g in groups:
        for k, a in enumerate(g):
            for b in g[k + 1 :]:
                own = np.flatnonzero((of == a) | (of == b))
                pair.append(svm(x, own, np.where(of[own] == a, 1.0, -1.0)).tobytes())
    members = b"".join(struct.pack(f">{len(g) + 1}i", len(g), *g) for g in groups)
    return Model(languages, members, family, b"".join(pair))


def predict(spark, model: Model, text: Column, dims: int = DIMS) -> Column:
    """struct(lang_pred, score) of a text; null texts, texts without a letter and an empty model give ``und`` and 0."""
    name = "geolode_lang_" + hashlib.sha256(model.family + model.pair + model.members + repr(model.languages).encode()).hexdigest()[:16]
    kernel_udf(spark, name, "Discriminate", "struct<pick:int,score:double>", dims=dims, family=model.family, pair=model.pair, members=model.members)
    found = F.call_udf(name, text_bytes(text))
    names = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array().cast("array<string>")
    return F.struct(F.coalesce(F.get(names, found.pick), F.lit(UNKNOWN)).alias("lang_pred"), found.score.alias("score"))


def identify(docs: DataFrame, train, sample: int = SAMPLE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` to rows (_row, lang_pred, score), learned from the rows that meet ``train``.

    Only texts are inputs of a prediction, and all of each text. Null, empty and letterless texts give ``und`` with score 0; so
    does everything where no row can be learned from. A single learned language is always predicted.
    Repeated rows get equal results. Columns of any name pass through inside ``_row``.
    """
    model = fit(docs.filter(train), sample, lang_col=lang_col, text_col=text_col)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    found = whole.select("_row", predict(docs.sparkSession, model, F.col(f"_row.`{text_col}`")).alias("found"))
    return found.select("_row", "found.lang_pred", "found.score")


def op2_hierarchical_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(id_crc() % 3, F.lit(0)) == 1
    out = identify(docs, ~held)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held.alias("held_out"), "lang_pred", "score")
