"""Each query against a plain Python version of its contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from geolode.llm import contamination, lattice, licenses, matroska, repeats, sharding, simhash, substrings, suffixes

WORD = r"[^\x20\x09-\x0D]+"
lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})


def by_id(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_op1(spark, unique, as_tables):
    got = by_id(lattice.op1_lattice_lm(spark, as_tables(unique)))
    tokens = {i: [*re.findall(WORD, lower(t)), None] for i, t, *_ in unique}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert got.keys() == tokens.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_op3(spark, corpus, as_tables):
    rows = sharding.op3_differencing_shards(spark, as_tables(corpus)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    shards, homes = {}, {}
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < 8
        shards.setdefault(r.shard, []).append(r.slot)
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(len(h) == 1 for h in homes.values())


def test_op3_in_steps(spark, corpus, as_tables, monkeypatch):
    """Many buckets, differenced in several steps: groups stay whole, slots have no gaps, and sums are as near as with one bucket."""
    folder = as_tables([(i, t and t[: 40 + 7 * k % 300], *rest) for k, (i, t, *rest) in enumerate(corpus) if i != 306])
    spread = []
    for groups, parts in ((100_000, 10_000), (4, 3)):
        monkeypatch.setattr(sharding, "GROUPS_A_BUCKET", groups)
        monkeypatch.setattr(sharding, "PARTS_A_STEP", parts)
        rows = sharding.op3_differencing_shards(spark, folder).collect()
        sums, slots, homes = Counter(), {}, {}
        for r in rows:
            sums[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
            homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert len(rows) == len(corpus) - 1 and all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        spread.append(max(sums.values()) - min(sums.values()))
    assert len(sums) == 8 and spread[0] <= 50 and spread[1] <= 400


def test_differencing_is_tight():
    import random

    r = random.Random(1)
    weights = [r.randint(1, 5000) for _ in range(400)]
    to = sharding.differencing([(w, *[0] * 7) for w in weights])[:, 0]
    sums = [sum(w for w, s in zip(weights, to, strict=True) if s == k) for k in range(8)]
    assert max(sums) - min(sums) <= 4


def test_op4(spark, unique, as_tables):
    got = by_id(substrings.op4_fm_substrings(spark, as_tables(unique)))
    seen = set()
    for i, t, *_ in sorted(unique):
        w = re.findall(WORD.encode(), (t or "").encode())
        gone = bytearray(len(w))
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = b"\1" * 20
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_op4_without_ties_in_the_same_document(spark, corpus, as_tables):
    """Repeated rows are one document: neither goes; rows of one id with other texts stay apart."""
    rows = substrings.op4_fm_substrings(spark, as_tables(corpus)).collect()
    assert len(rows) == len(corpus)
    assert len({(r.n_removed, r.kept_sha256) for r in rows if r.doc_id == 5}) == 1


def test_op5(spark, corpus, as_tables):
    rows = simhash.op5_simhash(spark, as_tables(corpus)).collect()

    def code(t):
        w = re.findall(WORD, lower(t))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), seed=42) for k in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    nodes = [(i, code(t)) for i, t, *_ in corpus]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a][1] ^ nodes[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((i is None, i or 0, f"{c:016x}", least.get(find(k))) for k, (i, c) in enumerate(nodes))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in rows) == want


def test_op6(spark, corpus, as_tables):
    rows = suffixes.op6_suffix_arrays(spark, as_tables(corpus)).collect()
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus]
    counts = Counter(b[k : k + 400] for _, b in texts for k in range(len(b) - 399))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if counts[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i is None, i or 0, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(want)


def test_common_grams_change_no_result(spark, corpus, as_tables, monkeypatch):
    """Whatever counts as common, the same words and bytes go."""
    folder = as_tables(corpus)
    want = [sorted(map(repr, f(spark, folder).collect())) for f in (substrings.op4_fm_substrings, suffixes.op6_suffix_arrays)]
    monkeypatch.setattr(repeats, "COMMON", 4)
    texts = spark.createDataFrame([(t,) for _, t, *_ in corpus], "text string").select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).coalesce(1)
    assert len(repeats.common_grams(texts, suffixes.GRAM, False)) > 8
    assert [sorted(map(repr, f(spark, folder).collect())) for f in (substrings.op4_fm_substrings, suffixes.op6_suffix_arrays)] == want


def test_keys_and_shards_change_no_result(spark, corpus, as_tables, monkeypatch):
    """Whatever the hashes that deal windows out, and however few texts a shard holds, the same words and bytes go: indexes find them, not hashes."""
    folder = as_tables(corpus)
    run = lambda: [sorted(map(repr, f(spark, folder).collect())) for f in (substrings.op4_fm_substrings, suffixes.op6_suffix_arrays)]
    want = run()
    for bits, full in ((64, 64), (2, 1 << 20), (3, 3000)):
        monkeypatch.setattr(repeats, "BITS", bits)
        monkeypatch.setattr(repeats, "FULL", full)
        assert run() == want


def test_op7(spark, as_tables, corpus):
    own = [
        (1000, "Some words. All rights reserved.\nCC-BY 4.0, cc by; ALL RIGHTS RESERVED", "en", None, None), (1001, "This work is licensed under the GNU General Public License, version 3.", "en", None, None),
        (1002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files", "en", None, None), (1003, "cc\nbyé cc é by", "en", None, None), (1004, "all r\u0130ghts reserved \u212a\u00c9 cc-by", "en", None, None),
    ]
    rows = licenses.op7_diagonal_licenses(spark, as_tables(corpus + own)).collect()
    assert len(rows) == len(corpus) + len(own)
    got = {r.doc_id: r for r in rows}
    for i, t, *_ in own:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            for k in range(len(words)):
                if words[k : k + len(phrase.split())] == phrase.split():
                    at.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    assert got[1001].labels == "gpl,gpl-3.0" and got[1002].labels == "mit" and 0.9 <= got[1002].score < 1
    assert (got[1003].labels, got[1003].score) == ("", 0.0)


def test_license_spans_are_verified(frame):
    """Each label against plain edit distances of all spans of a text, in words."""
    marks = set(licenses.MARKS)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def plain(words):
        labels = set()
        for t, label in licenses.TEMPLATES.items():
            t = t.split()
            e = licenses.edits(len(t))
            for a in range(len(words)):
                for n in range(len(t) - e, len(t) + e + 1):
                    span = words[a : a + n]
                    if label not in labels and set(span) & marks == set(t) & marks and distance(span, t) <= e:
                        labels.add(label)
        return labels | {label for p, label in licenses.BASE.items() if f" {p} " in f" {' '.join(words)} "}

    mit = "released under the mit license"
    texts = [
        mit, mit + " mit license" * 3, "mit license " * 4 + mit, "really " + mit, "released under the nice mit license", "released under the bsd license", "released under the mit bsd license", "under the mit license",
        "licensed under the apache software license version 2 0", "licensed under the apache license version 1 0", "licensed under the gnu lesser general public license version 2", "this work is licensed under the gnu general public license version 2",
        "x y you can redistribute it and modify it under the strict terms of the gnu general public license as published by the free software foundation z", "permission to use copy modify and distribute this software for any purpose without fee is hereby granted now",
        "is free and unencumbered software released into the public", "licensed under cc by sa 4 0 and licensed under cc by nc 4 0", "the license under the license under the license",
    ]
    got = {r.doc_id: r for r in licenses.scan(frame([(i, t, "en", "x", None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i].labels == ",".join(sorted(plain(t.split()))), t
    assert [got[i].labels for i in (0, 1, 2, 3, 4, 5, 8)] == ["mit"] * 5 + ["", "apache-2.0"]
    assert got[0].score == got[1].score == 1.0 and got[4].score == 0.8


def test_op9(spark, unique, as_tables):
    item = "the tioning erly whand ingthe edtion erand lytheing whtion anded erwh lying edand tionthe"
    off = item.replace("whand", "whend").replace("lying", "lyng")
    far = " ".join(w[::-1] for w in item.split())
    own = [(900, f"before {item} after", "en", None, None), (901, f"Before\n{off.upper()}  after", "en", None, None), (902, f"x {far} y", "en", None, None)]
    got = contamination.op9_pigeonhole_leaks(spark, as_tables(unique + own, [(1, item), (2, None), (3, "shorter"), (4, item)])).collect()
    assert sorted((r.doc_id, r.item_id, r.n_errors) for r in got) == [(900, 1, 0), (900, 4, 0), (901, 1, 2), (901, 4, 2)]


def test_op9_against_all_places(spark, frame, unique):
    """Every item against every text, by a plain table of edit distances; short items as whole words."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(r.randint(8, 30)))) for k in range(12)] + [(20, "ab cd"), (21, "Solo"), (22, " "), (23, None)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 60))]
        if i % 2:
            item = list(r.choice(items[:12])[1])
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice(["", "z", item[at] + "y"])
            text.insert(r.randint(0, len(text)), "".join(item))
        if i % 7 == 0:
            text.append(r.choice(["ab  cd", "xab cdx", "solo", "soloist", "(SOLO)"]))
        docs.append((i, " ".join(text), "en", "x", None))

    def plain(p, t):
        row, best = list(range(len(p) + 1)), len(p)
        for b in t:
            new = [0]
            for i, a in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (a != b)))
            row = new
            best = min(best, row[-1])
        return best

    want = set()
    for i, text, *_ in docs:
        text = " ".join(text.lower().split())
        for k, item in items:
            item = " ".join((item or "").lower().split())
            if len(item) >= 20:
                if (d := plain(item, text)) <= int(len(item) * 0.05):
                    want.add((i, k, d))
            elif item and re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", text):
                want.add((i, k, 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination.leaks(frame(docs), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_errors) for r in got) == sorted(want) and {k for _, k, _ in want} >= {20, 21} and any(d for *_, d in want)
    kept = contamination.without_leaks(frame(docs), bench).collect()
    assert {r.doc_id for r in kept} == {x[0] for x in docs} - {i for i, *_ in want}


def test_myers_is_edit_distance():
    import random

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    r = random.Random(5)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(1, 90), r.randint(0, 120)))
        assert contamination.myers(p, t)[0] == plain(p, t)


def test_op10(spark, corpus, as_tables):
    rows = matroska.op10_matroska(spark, as_tables(corpus)).collect()
    want = []
    for i, t, *_ in corpus:
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        want.append((i is None, i or 0, len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    facts = {}
    for r in rows:
        assert facts.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
