import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    """Rows with null and empty texts, ties, repeated rows, null ids, a long text, copies, near copies and shared passages."""
    r = random.Random(3)
    syllables = {"en": "the ing er tion and wh ly ed".split(), "de": "sch ung ein ich der keit ge".split(), "fr": "eau oui ent que les ment".split(), "es": "ción mente que los ar ie".split()}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3)))
    passage = " ".join(word("en") for _ in range(60))
    rows = []
    for i in range(120):
        lang = list(syllables)[i % 4]
        words = [word(lang) for _ in range(r.randint(1, 160) if i != 50 else 150)]
        if i % 9 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((i, " ".join(words).capitalize(), lang, f"src{i % 3}", None))
    base = rows[41][1]
    rows += [(200 + k, base, "en", "src0", None) for k in range(6)]
    for k in range(8):
        w = rows[50][1].split()
        w[17 * k + 3] = "changed"  # one word of 150: five shingles of 146, a similarity of 0.93
        rows.append((220 + k, " ".join(w), "de", "src1", None))
    rows += [
        (300, None, None, None, None), (301, "", "en", None, 0), (302, " \n\t ", None, "x", 3), (303, "!!! 123 ???", "en", "x", 11), (304, "é", "fr", "x", 1), (305, "ab " * 400, "en", "x", 1200),
        (306, " ".join(word("fr") for _ in range(6000)), "fr", "x", None), (307, "a\tb\nc  d ▁ e f 🗺️ caffè", "en", "x", None), (308, "x" * 3000, "en", "x", None),
        (None, "null id one two three", "en", "x", None), (None, "null id one two three", "en", "x", None), (5, rows[5][1], "de", "src2", None), (7, "another text under the id of a document", "en", "x", None),
    ]
    return rows


@pytest.fixture(scope="session")
def unique(corpus):
    """The same with unique ids that are not null."""
    seen = set()
    return [x for x in corpus if x[0] is not None and not (x[0] in seen or seen.add(x[0]))]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def as_tables(spark, tmp_path_factory):
    """A folder with documents (and benchmark) as a query finds them."""

    def make(rows, items=()):
        folder = tmp_path_factory.mktemp("tables")
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        return str(folder)

    return make
