"""Empty tables and extra columns with clashing names."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geolode.llm import contamination, language, lattice, licenses, matroska, nbest, registry, sharding, simhash, substrings, suffixes
from geolode.shared import shared_dir

CLASH = "_id _rid _k code vertex root row component_id n_removed cut _row found key id th start len kind word refs rid pos code label shard cell data n".split()


def operators(bench):
    return {
        "lattice": lambda d: lattice.lattice_scores(d, F.lit(True)),
        "language": lambda d: language.identify(d, F.lit(True)),
        "sharding": sharding.shard_by_bytes,
        "substrings": substrings.earlier_passages,
        "simhash": simhash.near_duplicates,
        "wide": simhash.similar_groups,
        "suffixes": suffixes.repeated_strings,
        "licenses": licenses.scan,
        "nbest": nbest.encoded,
        "leaks": lambda d: contamination.leaks(d, bench),
        "without_leaks": lambda d: contamination.without_leaks(d, bench),
        "matroska": matroska.stored_payloads,
    }


NAMES = list(operators(None))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, frame, name):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert operators(bench)[name](frame([])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_nulls(spark, frame, corpus, name):
    bench = spark.createDataFrame([(1, "nothing of the kind stands in any of these texts"), (None, None)], "item_id bigint, text string")
    docs = frame(corpus[-20:])
    for c in CLASH:
        docs = docs.withColumn(c, F.lit(1))
    got = operators(bench)[name](docs).count()
    assert got == (0 if name == "leaks" else 20)


@pytest.mark.parametrize("k", range(4))
def test_stages_pass_columns_of_any_name(spark, frame, corpus, as_tables, k):
    """Values of clashing columns stay with their rows, and the result does not change."""
    folder = as_tables([], [(1, "nothing of the kind stands in any of these texts"), (None, None), (2, "")])
    stage = corpus_pipeline.STAGES[k][1]
    docs = frame(corpus[-24:]).withColumn("extra", F.xxhash64("doc_id", "text"))
    odd = docs
    for c in CLASH:
        odd = odd.withColumn(c, F.concat(F.lit(c), F.col("extra").cast("string")))
    plain, out = stage(spark, docs, folder), stage(spark, odd, folder)
    assert out.columns == odd.columns
    got = out.collect()
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, out.select(*docs.columns).collect())) and got
    assert all(r[c] == f"{c}{r.extra}" for r in got for c in CLASH)
    assert stage(spark, odd.limit(0), folder).count() == 0


def test_registered_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_pipeline(spark, as_tables, corpus):
    item = "the tioning erly whand ingthe edtion erand lytheing whtion anded erwh lying edand tionthe"
    folder = as_tables(corpus + [(900, f"before {item} after all of this", "en", None, None)], [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, folder))
        if k < 4:
            assert out.columns == columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if k == 0:
            assert not ids & {300, 301, 302, 303}
        if k == 1:
            assert 41 in ids and not ids & {200, 201, 202, 203, 204, 205} and len(ids & {50, *range(220, 228)}) == 1
        if k == 2:
            changed = {r.doc_id for r in out.exceptAll(docs).select("doc_id").collect()}
            assert 305 in changed and changed & set(range(9, 120, 9)) and 0 not in changed
        if k == 3:
            assert 900 not in ids and {r.doc_id for r in docs.select("doc_id").collect()} - ids == {900}
        docs = out
        seen.append(out.count())
    assert seen == sorted(seen, reverse=True)
    assert docs.filter("NOT decoded_ok").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == seen[-1]


def test_pipeline_on_an_empty_table(spark, as_tables):
    assert corpus_pipeline.run(spark, as_tables([])).count() == 0


def test_near_duplicates_of_equal_and_null_ids(spark, frame, corpus):
    """One row of each group stays, whatever its id; other texts under the same id are no duplicates."""
    texts = [corpus[i][1] for i in (1, 50, 2, 3, 45, 6)]  # unlike each other
    copy = corpus[-20][1]  # a near copy of row 50
    assert corpus[-20][0] == 221
    rows = [(None, texts[0]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[1]), (8, copy), (9, texts[0])]
    out = corpus_pipeline.drop_near_duplicates(spark, frame([(i, t, "en", "x", k) for k, (i, t) in enumerate(rows)]), "")
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert len(got) == 6
    assert [x for x in got if x[0] != 8] == sorted([(0, texts[2]), (0, texts[3]), (7, texts[4]), (7, texts[5]), (9, texts[0])])
    assert [x[1] in (texts[1], copy) for x in got if x[0] == 8] == [True]


def test_null_ids_are_not_one_document(spark, frame, corpus):
    rows = [(None if i % 3 else i, corpus[i][1], "en", "x", None) for i in range(60) if len(corpus[i][1].split()) > 20]
    assert corpus_pipeline.drop_near_duplicates(spark, frame(rows), "").count() == len({t for _, t, *_ in rows})


def test_languages_of_an_unlabelled_table(spark, frame, corpus):
    out = corpus_pipeline.keep_languages(spark, frame([(i, t, None, s, n) for i, t, _, s, n in corpus]), "")
    assert out.count() == sum(any(ch.isalpha() for ch in t or "") for _, t, *_ in corpus)
    assert out.filter("lang is not null").count() == 0


def test_near_duplicates_leave_no_texts_behind(spark, frame):
    """Files that a stage leaves are on disk while the next ones run: names of rows may stay, texts and fingerprints may not."""
    r = random.Random(5)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(1500)) for _ in range(60)]
    rows = [(i, t, "en", "x", None) for i, t in enumerate(texts)] + [(3, texts[3], "en", "y", None), (None, texts[4], "en", "x", None), (None, texts[4] + " more", "en", "x", None)]
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.rglob("*.parquet"))
    out = corpus_pipeline.drop_near_duplicates(spark, frame(rows), "")
    assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before) < 0.05 * sum(map(len, texts))
    for _ in range(2):  # the result can be read again
        assert sorted((x.doc_id, x.text) for x in out.collect()) == list(enumerate(texts))
