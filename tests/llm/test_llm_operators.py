"""The ten operators against brute force on small fixtures with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe_codec, components, flac, hpylm, licenses, mixing, ngram_join, quality, rpforest, suffix_dedup, token_count
from loomspark.llm.words import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DRAW = np.random.default_rng(4)
VOCAB = ["the", "of", "Alpha", "beta", "gämma", "delta,", "eps", "zeta.", "eta", "theta"]


def prose(n):
    return " ".join(VOCAB[i] for i in DRAW.integers(0, len(VOCAB), n))


BASE = [prose(120) for _ in range(6)]
LONG = prose(30_000)
TEXTS = [
    None, "", "   \n\t ", "one", "two words", "Two  WORDS", *BASE, BASE[0], BASE[0] + " tail of it", BASE[1][:500] + " x " + BASE[1][500:],
    LONG, "a" * 5_000, "é" * 900, "\0\0 \x85x y", "<|endoftext|> and <|startoftext|>", "日本語 テキスト 😀 ½²", "x\r\n\r\n  y  \t z ",
    BASE[2] + "\n" + BASE[3], BASE[3] + "\n" + BASE[4], "Licensed under the Apache License, Version 2.0.\n" + BASE[5],
]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated rows, extra columns named like inner ones."""
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "clash", i) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, BASE[4], None, "k", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def all_rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_token_counts(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = sorted(((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in all_rows(docs)), key=repr)
    assert pairs(token_count.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_count.count_tokens(empty, path).count() == 0


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted(((i, t.encode(x, add_special_tokens=False).ids, t.decode(t.encode(x, add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in all_rows(docs)), key=repr)
    assert pairs(bpe_codec.round_trip(docs, path), "doc_id", "ids", "decoded") == want
    assert bpe_codec.round_trip(empty, path).count() == 0


def sets_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def test_ngram_join(docs, empty):
    assert pairs(ngram_join.link_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(all_rows(docs))
    assert ngram_join.link_components(empty).count() == 0


def near_copies(spark, n=90):
    words, rows = prose(60).split(), []
    for i in range(n):
        own = list(words)
        for k in DRAW.integers(0, len(own), i % 5):
            own[k] = f"w{i}"
        rows.append((i, " ".join(own) + (" " + prose(8) if i % 3 else "")))
    rows += [(n + i, prose(40)) for i in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_ngram_join_deals_out_large_groups(spark, monkeypatch):
    rows, docs = near_copies(spark)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 10)
    monkeypatch.setattr(ngram_join, "HOT_IN_SPAN", 2)
    want = brute_components(rows)
    assert pairs(ngram_join.link_components(docs), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(ngram_join, "HOT_IN_SPAN", 1_000)
    monkeypatch.setattr(ngram_join, "NARROW_ROWS", 50)
    assert pairs(ngram_join.link_components(docs), "doc_id", "n_shingles", "component_id") == want


def test_asked_for_keeps_every_id_asked_for(spark, monkeypatch):
    rows = spark.range(-2_000, 2_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    wanted = rows.where("doc_id % 10 = 0").select("doc_id")
    for bits in (1 << 26, 64):
        monkeypatch.setattr(ngram_join, "BITS", bits)
        held = ngram_join._asked_for(rows, wanted)
        assert held.columns == ["doc_id", "text"]
        assert wanted.exceptAll(held.select("doc_id")).isEmpty()
        assert held.count() == 4_000 if bits == 64 else held.count() < 410


def test_asked_for_broadcasts_few_rows(spark, monkeypatch):
    rows = spark.range(400_000).selectExpr("id AS doc_id", "'' AS text")
    seen, broadcast = [], ngram_join.F.broadcast
    monkeypatch.setattr(ngram_join.F, "broadcast", lambda df: seen.append(df) or broadcast(df))
    held = ngram_join._asked_for(rows, rows.where("doc_id % 2 = 0").select("doc_id"))
    assert sum(df.count() for df in seen) <= 1 << 13
    assert held.where("doc_id % 2 = 0").count() == 200_000 and held.count() < 206_000


def test_ngram_join_of_sizes_at_the_bound(spark):
    """Each text is the start of the next, so that their sizes alone decide which of them link."""
    words = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(words[: n + 4])) for n in (30, 39, 40, 60, 75, 79, 100, 133, 134, 178)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(ngram_join.link_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_divide_skip_counts_like_brute_force():
    for _ in range(200):
        lists = [sorted(set(DRAW.integers(0, 40, DRAW.integers(1, 30)).tolist())) for _ in range(DRAW.integers(1, 14))]
        t = int(DRAW.integers(1, len(lists) + 1))
        count = collections.Counter(x for y in lists for x in y)
        assert sorted(ngram_join.divide_skip(lists, t)) == sorted((k, v) for k, v in count.items() if v >= t)


def test_shingles_keep_order_of_words():
    data = np.frombuffer(b"a b c d eb a c d e", np.uint8)
    _, _, sizes = shingles(data, np.array([0, 9, 18]))
    value, _, _ = shingles(data, np.array([0, 9, 18]))
    assert sizes.tolist() == [1, 1] and value[0] != value[1]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(20, 60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{x: 7 for x in range(20, 60)}}


def test_components_of_short_tables_take_two_writes(spark, monkeypatch):
    written, durable = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df, name: written.append(name) or durable(df, name))
    found = components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long"))
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, 0) for i in range(41)} and len(written) == 2


def test_components_in_parts_and_steps(spark, monkeypatch):
    steps, alternated = [], components._alternated
    monkeypatch.setattr(components, "_alternated", lambda edges, n: steps.append(n) or alternated(edges, n))
    dense = [(int(a), int(a) // 300 * 300 + int(b)) for a, b in DRAW.integers(0, 300, (4_000, 2)) + DRAW.integers(0, 3, (4_000, 1)) * [[300, 0]]]
    path = [(int(a), int(a) + 1) for a in DRAW.permutation(400)]
    for most, pairs_, stepped in ((2_000_000, dense, False), (1_000, dense, False), (100, path, True), (150, dense, True)):
        monkeypatch.setattr(components, "EDGES", most)
        steps.clear()
        near = collections.defaultdict(set)
        for a, b in pairs_:
            near[a].add(b)
            near[b].add(a)
        want = {}
        for node in sorted(near):
            todo = [] if node in want else [node]
            while todo:
                if (x := todo.pop()) not in want:
                    want[x] = node
                    todo += near[x]
        found = components.components(spark.createDataFrame([*pairs_, (5_000, 5_000)], "src long, dst long").repartition(5)).collect()
        assert {r["node"]: r["component"] for r in found} == {k: v for k, v in want.items() if len(near[k] - {k}) > 0} and len(found) == len({r["node"] for r in found})
        assert bool(steps) == stepped


def test_quality(spark, docs, empty):
    good = [(i, prose(int(DRAW.integers(20, 200)))) for i in range(400)]
    bad = [(400 + i, " ".join(w + "###" for w in prose(int(DRAW.integers(20, 200))).split())) for i in range(200)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(600)] + [(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_quality(table, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((r["doc_id"] < 400) == bool(r["predicted"]) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.score_quality(docs, labels).count() == docs.count()
    assert quality.score_quality(empty, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_isotonic_is_monotone_and_keeps_totals():
    n, p = DRAW.integers(0, 5, 50).astype(float), np.zeros(50)
    p = np.array([DRAW.integers(0, int(k) + 1) for k in n], float)
    fit = quality.isotonic(n, p)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * n).sum() - p.sum()) < 1e-9


def test_flac_round_trip(docs, empty):
    rows = flac.decode(flac.encode(docs)).collect()
    assert len(rows) == docs.count()
    want = sorted(((i, x.encode() + b"\xff" * (max(1, -(-len(x.encode()) // 576)) * 576 - len(x.encode()))) for i, x in all_rows(docs)), key=repr)
    assert sorted(((r["doc_id"], bytes(r["pcm"])) for r in rows), key=repr) == want
    assert flac.decode(flac.encode(empty)).count() == 0
    row = max(rows, key=lambda r: len(r["pcm"]))
    assert flac.read_samples(bytes(row["media"]), 1000, 3000) == bytes(row["pcm"])[1000:4000]
    block = flac.pcm_blocks(flac.encode(docs.where("doc_id = 15"))).orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in block) == bytes(next(r for r in rows if r["doc_id"] == 15)["pcm"])


def test_flac_finds_damage_and_follows_long_codes():
    x = DRAW.integers(0, 256, 576 * 200).astype(np.uint8)
    x[: 576 * 40] = np.where(DRAW.random(576 * 40) < 0.02, 255, 97)
    x[576 * 50 : 576 * 51] = 9
    media, at = flac.encode_streams(x, np.array([0, 576 * 200]))
    out, _ = flac.decode_streams([media.tobytes()])
    assert (out == x).all()
    broken = media.copy()
    broken[len(broken) // 2] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([broken.tobytes()])


def test_flac_frame_numbers():
    assert flac.frame_header(5)[4:-1] == b"\x05"
    for n in (0x80, 0x7FF, 0x800, 0xD7FF, 0xFFFF, 0x10000):
        assert flac.frame_header(n)[4:-1] == chr(n).encode("utf-8")


def tokens_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) + [None]


def test_language_model(docs, empty, spark):
    rows = all_rows(docs)
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    count = collections.Counter(w for ok, (_, t) in zip(train, rows, strict=True) if ok for w in tokens_of(t))
    total, size = sum(count.values()), len(count)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["held_out"]) for r in hpylm.score_texts(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        own = tokens_of(t)
        want.append((i, len(own), sum(count[w] > 0 for w in own), total, round(float(sum(np.log10((count[w] + 1) / (total + size + 1)) for w in own)), 6), i is not None and zlib.crc32(str(i).encode()) % 7 == 2))
    assert got == sorted(want, key=repr)
    assert hpylm.score_texts(empty).count() == 0
    alone = hpylm.score_texts(spark.createDataFrame([(None, "no training here")], "doc_id long, text string")).collect()
    assert alone[0]["train_tokens"] == 0 and alone[0]["n_known"] == 0


def test_language_model_is_the_same_for_hot_and_joined_words(spark, monkeypatch):
    text = prose(400)
    words = sorted(set(tokens_of(text)[:-1]))
    docs = spark.createDataFrame([(0, text), *((-1 - i, w) for i, w in enumerate([*words, "unseen", ""]))], "doc_id long, text string")
    scores = []
    for hot in (4, 65_536):
        monkeypatch.setattr(hpylm, "HOT_WORDS", hot)
        scores.append({r["doc_id"]: r["score"] for r in hpylm.score_texts(docs).collect()})
    assert scores[0].keys() == scores[1].keys() and all(v < 0 for v in scores[0].values())
    assert all(abs(scores[0][k] - scores[1][k]) < 1e-4 * abs(scores[0][k]) for k in scores[0])


def test_every_training_word_is_a_context(spark):
    """40 words, none more frequent than the others: each is always followed by the same partner."""
    lines = [" ".join(f"a{i} b{i}" for i in DRAW.permutation(40)) for _ in range(30)]
    docs = spark.createDataFrame([*((100 + i, t) for i, t in enumerate(lines)), *((-1 - i, f"a{i} b{i}") for i in range(40)), *((-101 - i, f"a{i} b{(i + 1) % 40}") for i in range(40))], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in hpylm.score_texts(docs).collect()}
    assert all(score[-1 - i] > score[-101 - i] + 0.5 for i in range(40))


def test_draws_depend_on_the_key_alone():
    n, p = np.array([7, 400, 90_000, 50]), np.array([0.3, 0.9, 0.2, 0.0])
    key = np.arange(4, dtype=np.uint64) + np.uint64(77)
    got = hpylm.seat(n, np.full(4, 5.0), 0.5, hpylm.Draws(key, n))
    assert all(hpylm.seat(n[i : i + 1], np.full(1, 5.0), 0.5, hpylm.Draws(key[i : i + 1], n[i : i + 1]))[0] == got[i] for i in range(2))
    many = hpylm.Draws(np.arange(4_000, dtype=np.uint64), np.ones(4_000))
    for m, q in zip(n, p, strict=True):
        x = many.binomial(np.full(4_000, m), np.full(4_000, q))
        assert abs(x.mean() - m * q) <= 5 * np.sqrt(m * q * (1 - q) / 4_000) and (x >= 0).all() and (x <= m).all()


def test_seating_stays_in_range():
    n = np.array([1, 2, 5, 40, 5_000, 100_000])
    t = hpylm.seat(n, np.full(6, 0.3), 0.7, np.random.default_rng(0))
    assert (t >= 1).all() and (t <= n).all() and t[0] == 1


def test_mixing(docs, empty):
    first, again = (pairs(mixing.mix(docs), "doc_id", "size", "source", "source_size", "target", "taken") for _ in range(2))
    assert first == again and len(first) == docs.count()
    by = collections.defaultdict(list)
    for r in first:
        by[r[2]].append(r)
    for s, rows in by.items():
        assert sum(r[1] for r in rows) == rows[0][3]
        assert abs(sum(r[5] for r in rows) - rows[0][4]) <= max(r[1] for r in rows), s
        assert all(r[5] in (0, r[1], 2 * r[1]) for r in rows)
    total = sum(r[1] for r in first)
    assert abs(sum(rows[0][4] for rows in by.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(empty).count() == 0


def test_mixing_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, prose(int(DRAW.integers(1, 30))), "a" if i % 3 else "b") for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 300
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30


def test_capped_targets():
    got = mixing.capped_targets([("b", 100), ("a", 10), (None, 1000)])
    assert got["a"] == 20 and abs(sum(got.values()) - 1.5 * 1110) < 1e-9 and got["b"] <= 200


def brute_nearest(rows, k):
    out = []
    for i, q in rows:
        if i % 20:
            continue
        near = sorted(((-float(np.dot(np.array(q, float), np.array(v, float))), j) for j, v in rows if j != i))[:k]
        out += [(i, r, j, round(-s, 9)) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def test_forest(spark):
    x = DRAW.normal(size=(600, 8)).astype(np.float32)
    x[300:340] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (1080, [1.0, 2.0]), (1100, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = pairs(rpforest.search(df, recall=1.0), "query_id", "rank", "vec_id", "score")
    want = brute_nearest([*rows, (1080, [1.0, 2.0] + [0.0] * 6)], 20)  # a short vector has zeros behind its end
    assert sorted((a, b, round(s, 5)) for a, b, _, s in got) == sorted((a, b, round(s, 5)) for a, b, _, s in want)
    ids = collections.defaultdict(set)
    for a, _, c, _ in got:
        ids[a].add(c)
    truth = collections.defaultdict(set)
    for a, _, c, _ in want:
        truth[a].add(c)
    assert sum(len(ids[a] & truth[a]) for a in truth) / sum(map(len, truth.values())) > 0.99
    assert rpforest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_forest_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = {(a, c) for a, _, c, _ in brute_nearest(rows, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in rpforest.search(df).collect()}
    assert len(want & got) / len(want) >= 0.9
    assert all(n == 20 for n in collections.Counter(q for q, _ in got).values())


def test_forest_takes_doubles_short_vectors_and_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "PART", 40)
    monkeypatch.setattr(rpforest, "ASKED", 3)
    rows = [(i, DRAW.normal(size=3 if i % 9 == 4 else 6).tolist()) for i in range(200)] + [(200 + i, [1.0, 0.1 + 1e-12, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    df = spark.createDataFrame([(i, x, i, x) for i, x in rows], "vec_id long, embedding array<double>, first long, vector array<double>")
    want = brute_nearest([(i, x + [0.0] * (6 - len(x))) for i, x in rows], 20)
    got = rpforest.search(df, recall=1.0, leaf=16).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_licenses(docs, empty, spark):
    got = {r["doc_id"]: r["notices"] for r in licenses.scan(docs).collect() if r["doc_id"] is not None}
    last = len(TEXTS) - 1
    assert [x["family"] for x in got[last]] == ["Apache-2.0"] and got[last][0]["start"] == 0
    assert all(not v for k, v in got.items() if k != last)
    assert licenses.scan(empty).count() == 0
    lines = [("MIT", "Released under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("CC-BY", "Licensed under CC BY 4.0.")]
    table = spark.createDataFrame([(i, prose(30) + "\n" + t + "\n" + prose(20)) for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    found = {r["doc_id"]: [x["family"] for x in r["notices"]] for r in licenses.scan(table).collect()}
    assert found == {i: [f] for i, (f, _) in enumerate(lines)}


def test_versions_and_denials_of_licenses(spark):
    texts = [
        (["GPL-2.0"], "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."),
        (["GPL-3.0"], "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or"),
        (["BSD-2"], "Licensed under the BSD 2-Clause License."), (["BSD"], "Licensed under the BSD 3-Clause License."), (["Apache-1.1"], "The Apache Software License, Version 1.1"),
        (["Apache-2.0"], "Licensed under the Apache License, Version 2.0"), (["MIT"], "Licensed under the MIT License."), ([], "This work is not licensed under the MIT License."), ([], "The code was never released under the Apache License 2.0."),
    ]
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100 + i, prose(40) + "\n\n" + t + "\n\n" + prose(30)) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: (r["n_paragraphs"], [x["family"] for x in r["notices"]]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: f for i, (_, f) in got.items()} == {i + k: f for i, (f, _) in enumerate(texts) for k in (0, 100)}
    assert {n for i, (n, _) in got.items()} == {1, 3}


def test_wrapped_and_inner_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n#\n# 1. Redistributions of source code must retain the above copyright notice"
    gpl = " * This program is free software: you can redistribute it and/or modify\r\n * it under the terms of the GNU General Public License as published by\r\n * the Free Software Foundation, either version 3 of the License, or\r\n * (at your option) any later version."
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    apart = "\n\n".join(mit.split("\n"))
    texts = [(["MIT"], mit), (["BSD"], bsd), (["GPL-3.0"], gpl), (["LGPL"], lgpl), ([], apart)]
    texts = [(f, prose(30) + "\n\n" + t + "\n\n" + prose(20)) for f, t in texts]
    texts += [(["Apache-2.0"], prose(300) + " Licensed under the Apache License, Version 2.0. " + prose(300)), (["CC-BY-NC"], prose(90) + " Licensed under CC BY-NC 4.0. " + prose(90)), ([], prose(900))]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["notices"] for r in licenses.scan(table).collect()}
    assert {i: [x["family"] for x in n] for i, n in got.items()} == {i: f for i, (f, _) in enumerate(texts)}
    place = got[0][0]
    assert texts[0][1].encode()[place["start"] : place["end"]].decode().startswith("Permission is hereby") and place["match"] == 1
    assert texts[5][1].encode()[got[5][0]["start"] : got[5][0]["end"]].decode() == "Licensed under the Apache License, Version 2.0"


def brute_repeats(rows, length):
    count = collections.Counter(b[i : i + length] for _, t in rows for b in [t.encode()] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=repr)


def test_suffix_dedup(docs, empty):
    short = docs.where("doc_id is null or doc_id <> 15")
    assert removed(suffix_dedup.remove_repeats(short)) == brute_repeats(all_rows(short), 400)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("shard", [3, 2_000])
def test_suffix_dedup_shards_and_periods(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_PIECES", shard)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3_000)
    passage = prose(90)[:460]
    rows = [(i, prose(int(DRAW.integers(1, 60))) + passage[: 460 - i % 50] + prose(int(DRAW.integers(1, 60)))) for i in range(40)]
    rows += [(100, "ab" * 700), (101, "abc" * 400), (102, "x" * 401), (103, "x" * 400), (104, "q" * 399), (105, passage * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(suffix_dedup.remove_repeats(table)) == brute_repeats(rows, 400)


def test_suffix_array_is_sorted():
    for _ in range(20):
        parts = [bytes(DRAW.integers(97, 99, DRAW.integers(1, 60)).astype(np.uint8)) for _ in range(6)]
        data, lens = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(lens), lens)
        order = suffix_dedup.suffix_array(data, ends)
        rests = [data[i : ends[i]].tobytes() for i in order]
        assert rests == sorted(rests) and sorted(order) == list(range(len(data)))


def test_text_buffers_take_slices_and_nulls():
    from loomspark.llm.common import text_buffers

    data, offsets = text_buffers(pa.array(["ab", None, "c", ""]).slice(1))
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 1, 1]


def test_repeats_and_bpe_hold_little_memory():
    """Counting cells takes steps of bounded size, and the pieces that an encoder has merged go with its task."""
    import gc
    import tracemalloc

    from loomspark.llm import bpe

    text = " ".join(prose(4_000) for _ in range(40)).encode()[:1_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()] * 2)], ["text"])
    tracemalloc.start()
    cells = list(suffix_dedup._cells(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    data = np.frombuffer(text * 2, np.uint8)
    want = collections.Counter((suffix_dedup.grams(data) >> np.uint64(64 - suffix_dedup.CELL_BITS)).tolist())
    got = dict(zip(cells[0]["cell"].to_pylist(), cells[0]["n"].to_pylist(), strict=True))
    assert len(cells) == 1 and got == {c: n for c, n in want.items() if n >= suffix_dedup.CELL_IN_CHUNK}
    docs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert next(bpe_codec._encoded(path)(iter([docs]))).num_rows == 1
    gc.collect()
    assert not [x for x in gc.get_objects() if isinstance(x, bpe.Encoder)]
