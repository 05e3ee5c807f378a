"""Each operator against a plain version of what it must give, and its defined results on awkward rows."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCS, documents, prose, table

from gradeloom.llm import _text as X
from gradeloom.llm import embedding_dedup, license_scan, minhash_dedup, mixing, packing, quality_classifier, quality_rules, sharding, toxicity, url_filter
from gradeloom.llm.components import connected_components
from gradeloom.llm._shared import Scratch

VOCABULARY = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark):
    rows = documents()
    got = minhash_dedup.near_duplicates(table(spark, rows).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(1)))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_components(rows)


def test_near_duplicates_in_a_crowd(spark):
    base = prose(5, 60).split(" ")
    rows = []
    for i in range(160):  # copies with several words changed: many pairs lie about the threshold
        w = list(base)
        r = np.random.default_rng(i)
        for k in r.choice(60, 1 + i % 4, replace=False):
            w[k] = f"w{r.integers(50)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = minhash_dedup.near_duplicates(table(spark, rows), how=minhash_dedup.Signature(local=8), block_bytes=2000)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_components(rows)


def test_near_duplicates_odd_tables(spark):
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    odd = table(spark, [(None, "a b c d e f", None, None, None), (5, None, None, None, None), (6, "", None, None, None), (7, "a b c d e f", None, None, None), (7, "a b c d e f", None, None, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 7, True), (7, 2, 7, True)], key=str)


def test_signature_index_keeps_its_promise():
    how = minhash_dedup.Signature()
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, (200, how.positions)).astype("<u2")
    b = a.copy()
    for row in b:
        row[r.choice(how.positions, 2 * (how.positions // how.chunk) - 1, replace=False)] ^= 1
    ka, kb = how.keys(a)[0], how.keys(b)[0]
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (3, 9), (10, 10), (20, 21), (21, 22), (22, 23), (23, 24), (24, 9)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.id: r.component for r in got.collect()} == {2: 1, 3: 1, 9: 1, 7: 6, **{i: 1 for i in range(20, 25)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_text_windows(monkeypatch):
    import pyarrow as pa

    texts = ["one two  three", None, "", "x" * 300 + " y", " lead", "é è ü", "a\tb\nc\x0bd\x0ce\rf\x85g"]
    data, offsets = X.utf8(pa.array(texts))
    whole = X.words(data, offsets)
    monkeypatch.setattr(X, "WINDOW", 7)
    small = X.words(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    assert np.bincount(whole[1], minlength=len(texts)).tolist() == [len((t or "").encode().split()) for t in texts]


def test_mixing(spark):
    rows = [(i, prose(i, 40) if i % 3 else " ".join(f"wort{(i * k) % 9}" for k in range(30)), "en" if i % 3 else "de", None, None) for i in range(90)] + [(900, None, None, None, None), (901, "", "xx", None, None)]
    docs = table(spark, rows)
    mixed, fit = mixing.mix_to_targets(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"en": 0.3, "de": 0.7})
    got = mixed.collect()
    t = np.array([r.mix_tokens for r in got], float)
    p = np.array([r.mix_posterior for r in got])
    rate = np.array([r.mix_rate for r in got])
    reached = (t * rate) @ p / t.sum()
    assert abs(reached - [0.3, 0.7]).max() < 1e-3 and rate.min() >= 0
    assert all(abs(x - 1) < 1e-9 for x in p.sum(1))
    by = {r.doc_id: r for r in got}
    assert (by[900].mix_tokens, by[900].mix_rate, by[900].mix_copies) == (0, 1.0, 1)
    right = [max(range(2), key=lambda k: r.mix_posterior[k]) == (0 if r.lang == "en" else 1) for r in got if r.doc_id < 900]
    assert np.mean(right) > 0.98
    cover, fit = mixing.mix_to_targets(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"en": 0.3, "de": 0.7}, cover=True, least=1.0)
    assert cover.agg(F.min("mix_rate")).first()[0] >= 1 and fit.wanted[0] >= fit.shares[0] - 1e-9
    none, fit = mixing.mix_to_targets(empty(spark), empty(spark).select("doc_id", F.col("lang").alias("domain")), {"en": 1.0})
    assert none.count() == 0 and fit.steps == []


def brute_table(shards, size):
    order = {s: [(sharding.preference(s, size)[0] + sharding.preference(s, size)[1] * j) % size for j in range(size)] for s in shards}
    table: dict[int, str] = {}
    while len(table) < size:
        for s in shards:
            free = [x for x in order[s] if x not in table]
            if free:
                table[free[0]] = s
    return [table[i] for i in range(size)]


def test_mixing_against_plain_version(spark):
    import xxhash

    names = ["en", "de"]
    texts = {"en": "the river and the stone", "de": "der Fluss und der Stein"}
    rows = [(i, " ".join([texts[names[i % 2]]] * (1 + i % 3) + (["stone"] if i % 5 == 0 else [])), names[i % 2], None, None) for i in range(40)]
    rows += [(3, rows[3][1], "de", None, None), (100, None, None, None, None), (101, " \n", "en", None, None), (102, "the " * 500, None, None, None)]
    docs = table(spark, rows).withColumn("mix_rate", F.lit("clash")).withColumn("mix_copies", F.lit("clash"))
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).where("doc_id < 30").distinct()
    targets = {"en": 0.7, "de": 0.3}
    got, fit = mixing.mix_to_targets(docs, labelled, targets)
    bucket = lambda w: int(np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42)))) % mixing.BUCKETS
    words = lambda t: (t or "").lower().split()
    counts = {d: collections.Counter() for d in names}
    for i, t, d, *_ in rows:
        if i < 30:
            counts[d].update(map(bucket, words(t)))
    log = {d: (lambda b, d=d: float(f"{math.log((counts[d][b] + 0.5) / (sum(counts[d].values()) + 0.5 * mixing.BUCKETS)):.3f}")) for d in names}
    tokens, posterior = [], []
    for _, t, *_ in rows:
        w = words(t)
        s = np.array([sum(log[d](bucket(x)) for x in w) for d in names]) * (min(len(w), 20) / max(len(w), 1))
        e = np.exp(s - s.max())
        tokens.append(len(w))
        posterior.append(e / e.sum())
    tokens, posterior = np.array(tokens, float), np.array(posterior)
    want = np.array([0.7, 0.3]) * tokens.sum()
    rate = np.ones(len(rows))
    for _ in range(2000):  # projected gradient with a small step
        error = want - (rate * tokens) @ posterior
        rate = np.where(tokens > 0, np.maximum(0, rate + posterior @ error / (tokens.sum() * 4)), 1.0)
    out = got.collect()
    seen = collections.defaultdict(list)
    for i, (r, *_rest) in enumerate(rows):
        seen[r].append((int(tokens[i]), posterior[i]))
    for r in out:
        n, p = seen[r.doc_id][0]
        assert r.mix_tokens == n and np.allclose(r.mix_posterior, p, atol=1e-9) and r.mix_copies in (math.floor(r.mix_rate), math.floor(r.mix_rate) + 1)
    assert len(out) == len(rows) and len({r.mix_copies for r in out if r.doc_id == 3}) == 1
    reached = sum(r.mix_rate * r.mix_tokens * np.array(r.mix_posterior) for r in out)
    assert np.allclose(reached, want, rtol=1e-3) and np.allclose((rate * tokens) @ posterior, want, rtol=1e-3) and np.allclose(np.array(fit.reached) * tokens.sum(), want, rtol=1e-3)


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    filled = sharding.fill_table(shards, 101)
    assert filled == brute_table(shards, 101)
    counts = collections.Counter(filled).values()
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill_table(shards[:-1], 101)
    moved = sum(a != b for a, b in zip(filled, fewer, strict=True) if a != "s6")
    assert moved < 101 // 3
    heavy = collections.Counter(sharding.fill_table({"a": 3, "b": 1}, 101))
    assert heavy["a"] == 76
    for bad in ((shards, 100), ([], 101), (["a", "a"], 101), (shards, 5)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)
    rows = table(spark, [(1, "a", None, None, None), (1, "b", None, None, None), (None, "c", None, None, None)]).withColumn("slot", F.lit("clash"))
    got = sharding.assign_shards(rows, shards, size=101).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.assign_shards(empty(spark), shards, size=101).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*documents(), (None, "no id", None, None, None), (800, "a \n \n b  ", None, None, None), (801, "<|endoftext|> it's", None, None, None), (802, "a <|endoftext|> b<|endoftext|>", None, None, None)]
    encode = Tokenizer.from_file(VOCABULARY)
    want = {i: np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    clash = table(spark, rows).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("offset", F.lit(2))
    got = packing.pack(clash, VOCABULARY, size=256, max_open=4).collect()
    seen, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert bytes(r.ids) == want[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        assert sum(n for _, n in seen[i]) == len(ids) and len(set(seen[i])) == len(seen[i])
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and (at & (at - 1)) == 0
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


def test_packer_chooses_by_sum_of_squares():
    p = packing.LevelPacker(8, 0)
    p.count[[2, 3, 5]] = [4, 1, 1]
    costs = {}
    for h in (0, 2, 3, 5):
        n = p.count.copy()
        if h:
            n[h] -= 1
        if h + 3 < 8:
            n[h + 3] += 1
        costs[h] = int((n[1:8] ** 2).sum())
    assert costs[p.level_for(3)] == min(costs.values())


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    vectors = [v for v in base] + [base[0]] * 3 + [base[1] + 0.05 * r.standard_normal(16) for _ in range(30)] + [base[2] + 0.13 * r.standard_normal(16) for _ in range(20)]
    rows = [(i, [float(x) for x in v], i % 2 if i < 40 else 1) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[0][1], None), (505, rows[0][1][:8], 0), (506, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    good = {i: (np.asarray(v, np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = collections.defaultdict(set)
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a].add(b)
    want = {}
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - reach:
                reach.add(k)
                todo.append(k)
        want[i] = (len(links[i]), min(reach), min(reach) == i)
    got = embedding_dedup.near_vectors(df, room=4, most=8, tables=4, block=16)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embeddings_links_between_dense_groups(spark):
    r = np.random.default_rng(3)
    d, n = 32, 90
    one = np.zeros(d)
    one[0] = 1.0
    two = np.zeros(d)
    two[:2] = 0.955, math.sqrt(1 - 0.955**2)
    x = np.concatenate([c + 0.1 / math.sqrt(d) * r.standard_normal((n, d)) for c in (one, two)])
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.93
    assert near[:n, n:].any() and (unit[:n] @ unit[:n].T).min() > (unit[:n] @ unit[n:].T).max()  # all cross links lie behind those inside
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(df, room=4, most=16, tables=2, block=2048)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {i: (int(near[i].sum()) - 1, 0) for i in range(2 * n)}


def test_embeddings_audit_weighs_groups(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([np.tile(r.standard_normal(16), (300, 1)) + 0.01 * r.standard_normal((300, 16)), np.repeat(r.standard_normal((3, 16)), 2, axis=0) + 0.01 * r.standard_normal((6, 16))])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    points = spark.createDataFrame([(i, "a", 16, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "id long, label string, size int, x binary")
    component = spark.createDataFrame([(i, 0) for i in range(1, 300)], "id long, component long")  # the three pairs are missed
    scratch = embedding_dedup.Scratch(spark, "audit-test")
    recall, missed = embedding_dedup.audit(points, component, 0.93, scratch, "audit", first=2)
    assert recall == 1 / 7
    assert {frozenset((m.a, m.b)) for m in missed.collect()} == {frozenset((300 + 2 * i, 301 + 2 * i)) for i in range(3)}


def test_licenses(spark):
    rows = [
        (1, "Intro\nLicensed under the Apache License, Version 2.0.\nmore", None, None, None), (2, "nothing here", None, None, None), (3, None, None, None, None), (4, "GNU general\npublic LICENSE and MIT license, mit license", None, None, None),
        (5, "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation", None, None, None), (6, "cc byé cc by", None, None, None), (6, "cc byé cc by", None, None, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, rows).withColumn("labels", F.lit(3))).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].license_score, got[1].n_base) == ("apache,apache-2.0", "apache", 1.0, 1)
    b = got[1].blocks[0]
    assert rows[0][1][b.first : b.last].strip() == "Licensed under the Apache License, Version 2.0."
    assert (got[2].labels, got[2].license_score, got[2].first_word) == ("", 0.0, None)
    assert (got[3].n_words, got[3].labels) == (0, "")
    assert (got[4].base_labels, got[4].n_base, got[4].first_word, got[4].last_word) == ("gpl,mit", 3, 0, 7)
    assert got[5].base_labels == "" and got[5].labels == "mit-grant" and 0.9 <= got[5].license_score < 1
    assert (got[6].n_base, got[6].first_word, got[6].n_words) == (1, 2, 4)
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "# Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted provided that the following conditions\r\n# are met:\r\n"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3"
    words = license_scan.TEMPLATES["mit-grant"].split()
    filler = " ".join(f"w{i}" for i in range(9))
    texts = [f"Intro line\n\n{mit}\nmore", bsd, gpl, "\n".join(words), "\n".join(f"{w} {filler}" for w in words), mit + "\n\nabc\n" + mit, " ".join(words) + "\n" + mit]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i].labels for i in range(7)] == ["mit-grant", "bsd-grant", "gpl,gpl-any", "mit-grant", "", "mit-grant", "mit-grant"]
    assert [got[i].license_score for i in (0, 1, 3, 4)] == [1.0, 1.0, 1.0, 0.0]
    b = got[0].blocks[0]
    assert texts[0][b.first : b.last].strip().startswith("Permission is") and texts[0][b.first : b.last].endswith("to deal")
    assert [len(got[i].blocks) for i in (0, 3, 5, 6)] == [1, 1, 2, 2]


def test_license_join_is_exact():
    r = np.random.default_rng(2)
    words = sorted({w for t in license_scan.TEMPLATES.values() for w in license_scan.template_words(t)})
    frequencies = {w: int(r.integers(0, 50)) for w in words}
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, frequencies, 0.7)
    sets = {label: frozenset(license_scan.template_words(t)) for label, t in license_scan.TEMPLATES.items()}
    for _ in range(300):
        base = list(sets[index.labels[int(r.integers(len(index.labels)))]])
        block = {w for w in base if r.random() < 0.8} | set(r.choice(words, 5).tolist())
        ranks = sorted(int(index.rank[index.vocabulary.words.index(w)]) for w in block)
        want = {label for label, s in sets.items() if len(s & block) >= math.ceil(0.7 * len(s) - 1e-9)}
        assert {index.labels[t] for t, _ in index.matches(ranks)} == want


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/1?q"), (2, "https://x.example.com/en/"), (3, "https://example.com/de"), (4, "https://notexample.com/en/"), (5, None), (6, "no scheme"), (7, "https://a.net/es/x#y"), (8, "https://net/fr/"), (9, "https://spam-farm.org/"),
        (14, "http://a b.example.com/en/x"), (15, "http://a\nb.example.com/en/\nx"), (16, "https://casino/"), (17, "https://a.org/CASINO.html"), (18, "https://" + "x" * 70000 + ".net/fr/" + "y" * 70000),
        (10, "https://a.net"), (11, "a://b://c.com/"), (12, ""), (1, "HTTP://WWW.Example.COM/en/1?q"), (13, "https://example.com:80/en/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect())
    want = collections.Counter()
    places = [(v, *n.partition("/")) for v, n in url_filter.PLACES]
    for i, u in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((len(h + s + p), h + s + p, v) for v, h, s, p in places if (host == h or host.endswith("." + h)) and path.startswith(s + p)), default=None)
        verdict = fit[2] if fit else "block" if any(w in re.split(r"[^a-z0-9]+", f"{host} {path}".lower()) for w in url_filter.BAD_WORDS) else "allow"
        want[i, host, path, fit[1] if fit else None, verdict] += 1
    assert got == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    rules = [url_filter.UrlRule("any", "block", r"/e?n/", (), 5), url_filter.place_rule("example.com", "allow")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got[2] == ("example.com", "allow") and got[4] == ("any", "block") and got[13] == ("any", "block") and got[5] == (None, "allow")
    rare = url_filter.rarest_tokens(spark.createDataFrame([("a.net", "/b"), ("a.net", "/c")], "host string, path string"), [url_filter.UrlRule("r", "block", "b", ("net", "b"), 1)])
    assert rare == {"b": [0]}


def test_quality_rules(spark):
    rows = documents()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows += [(300, "a b\nA b\na b\n\n\na b", None, None, None), (301, " ".join(map(str, range(9))) + " x " + " ".join(map(str, range(9))), None, None, None), (302, "### $$$ é|" * 30, None, None, None), (303, "ALL SHOUTED WORDS HERE AND NOW " * 5, None, None, None)]
    got = quality_rules.apply_quality_rules(table(spark, rows).withColumn("kept", F.lit("clash")), figures=names)
    n = 0
    for r in got.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = collections.defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        cover = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        assert tuple(r[c] for c in names) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        if len(w) < 20 or 100 * len(cover) > 30 * len(w):
            assert not r.kept
        assert r.kept == (r.rejected_by is None)
        n += 1
    assert n == len(rows)
    a = quality_rules.apply_quality_rules(table(spark, rows), quality_rules.BASE_RULES + quality_rules.MORE_RULES, ordered=True)
    b = quality_rules.apply_quality_rules(table(spark, rows), (quality_rules.BASE_RULES + quality_rules.MORE_RULES)[::-1], ordered=True)
    assert sorted((r.doc_id, r.kept) for r in a.collect()) == sorted((r.doc_id, r.kept) for r in b.collect())
    assert quality_rules.apply_quality_rules(empty(spark)).count() == 0


def test_quality_classifier(spark):
    rows = [(i, prose(i, 50) if i % 2 else " ".join(w + "$$$" for w in prose(i, 50).split()), None, None, None) for i in range(200)] + [(900, None, None, None, None), (901, "", None, None, None)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(None, 1, None), (777, None, None)], "doc_id long, quality int, toxic int")
    out = quality_classifier.score_quality(docs, quality_classifier.train(docs, labels)).collect()
    held = [r for r in out if r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([(r.quality_score >= 0.3) == bool(r.doc_id % 2) for r in held]) > 0.95
    assert all(0 <= r.quality_score <= 1 for r in out) and len(out) == len(rows)
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.quality_score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}


def plain_features(text):
    """The features of a text, worked out word by word."""
    top = 1 << 64

    def mix(x):
        return int(X.mix(np.array([x % top], X.U))[0])

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [int(X.words(*X.utf8(__import__("pyarrow").array([w])))[0][0]) for w in words]
    shapes = []
    for i, w in enumerate(words):
        b = w.encode()
        kind = [quality_classifier._KIND[c] for c in b]
        lower, upper = kind.count(0), kind.count(1)
        n = 0 if not upper else 1 if lower else 2 if upper == 1 else 3
        for more, base in ((kind.count(2) > 0, 2), (min(kind.count(3), 3), 4), (min(kind.count(4), 3), 4), (kind.count(5) > 0, 2), (1 + sorted(b".,;:!?").index(b[-1]) if b[-1] in b".,;:!?" else 0, 8), (sum(len(b) >= x for x in (2, 9, 20)), 4), (i > 0 and hashes[i] == hashes[i - 1], 2)):
            n = n * base + int(more)
        shapes.append(mix(n))
    out = set()
    for seq, sizes, bits, base in ((shapes, (1, 2, 3), quality_classifier.SHAPE_BITS, 0), (hashes, (1, 2), quality_classifier.WORD_BITS, 1 << quality_classifier.SHAPE_BITS)):
        for n in sizes:
            for i in range(len(seq) - n + 1):
                out.add(base + (mix(sum(h * int(X._COEF[k]) for k, h in enumerate(seq[i : i + n]))) >> (64 - bits)))
    return out


def test_quality_features_ratios_and_margins():
    import pyarrow as pa

    texts = ["One two, two two THREE! 4ever $$$ (x) " + "q" * 25, "", None, "é. É Aa AA a9;", prose(3, 40)]
    found = {i: set() for i in range(len(texts))}
    for a, _, rows, values in quality_classifier.features(pa.array(texts)):
        for r, v in zip(rows.tolist(), values.tolist(), strict=True):
            found[a + r].add(v)
    want = {i: plain_features(t or "") for i, t in enumerate(texts)}
    assert found == want
    rows, y = [np.array(sorted(want[i]), np.int64) for i in range(len(texts))], np.array([1, 0, 0, 1, 0])
    ratio, size = quality_classifier.log_count_ratios(rows, y, quality_classifier.SIZE, 1), quality_classifier.SIZE
    good, bad = collections.Counter(f for i in (0, 3) for f in want[i]), collections.Counter(f for i in (1, 2, 4) for f in want[i])
    plain = {f: math.log((good[f] + 1) / (sum(good.values()) + size)) - math.log((bad[f] + 1) / (sum(bad.values()) + size)) for f in good | bad}
    middle = float(np.median(list(plain.values())))
    assert all(math.isclose(ratio[f], v - middle, abs_tol=1e-9) for f, v in plain.items()) and np.count_nonzero(ratio) <= len(plain)
    model = quality_classifier.QualityModel(ratio, 0.25, (0.5, 2.0))
    for margin, score, f in zip(model.margins(pa.array(texts)), model.scores(pa.array(texts)), rows, strict=True):
        m = sum(ratio[v] for v in f) / math.sqrt(max(len(f), 1)) + 0.25
        assert math.isclose(margin, m, abs_tol=1e-9) and math.isclose(score, 1 / (1 + math.exp(-0.5 - 2 * m)), abs_tol=1e-9)


def test_dual_coordinate_descent_solves_its_problem():
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(40)]
    y = np.where(r.random(40) < 0.5, 1.0, -1.0)
    cost = np.full(40, 0.7)
    w, b = quality_classifier.dual_coordinate_descent(rows, np.ones(12), y, cost, epochs=3000)
    x = np.zeros((40, 12))
    for i, v in enumerate(rows):
        x[i, v] = 1 / math.sqrt(max(len(v), 1))

    def loss(w, b):
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best = loss(w, b)
    assert all(loss(w + 0.02 * r.standard_normal(12), b + 0.02 * r.standard_normal()) >= best - 1e-6 for _ in range(300))


def test_toxicity(spark):
    bad = ["you are an idiot", "what a moron he is", "worthless scum", "grottig person"]
    rows = [(i, prose(i, 30) + (f". {bad[i % 4]}. " if i % 5 == 0 else ". ") + prose(i + 999, 20), None, None, None) for i in range(300)] + [(900, None, None, None, None), (901, "", None, None, None)]
    docs = table(spark, rows).withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert any(k.startswith("grott") for k in model.strengths)
    out = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in out if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.toxicity >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(r.toxicity < 0.5 for r in out if r.doc_id >= 900)
    plain = toxicity.learn(docs, labels.limit(0))
    assert len(toxicity.score_toxicity(empty(spark), plain).collect()) == 0


def plain_weights(text, strengths):
    """(clauses, sum, greatest weight of a clause) by the grammar's rules, said without machines."""
    clauses, weights, seen = 0, [], collections.Counter()
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        kinds = []
        for w in words:
            names = ((toxicity.THREATS, "threat"), (toxicity.TARGETS, "target"), (toxicity.NEGATIONS, "not"), (toxicity.REPORTS, "said"), (toxicity.INTENTS, "will"))
            kinds.append("insult" if w in strengths else next((k for v, k in names if w in v), ""))
        weight, hit = 0.0, False
        for i, (w, k) in enumerate(zip(words, kinds)):
            if k not in ("insult", "threat"):
                continue
            hit = True
            before, behind = kinds[:i], "target" in kinds[i + 1 : i + 4]
            soft = next((x for x in range(1, 4) if i >= x and kinds[i - x] == "not"), None) is not None
            told = any(i >= x and kinds[i - x] == "said" for x in range(1, 7))
            if soft or told:
                factor = 0.4 if soft else 0.6
                factor *= 1.25 if "target" in before else 1.0
            elif k == "insult":
                factor = 1.25 if "target" in before or behind else 1.0
            else:
                meant = "will" in before
                factor = (2.0 if meant else 1.25) if behind else 0.8 if meant else 0.5 if "target" in before else 0.3
            seen[w] += 1
            weight += (strengths.get(w) or 2.0) * factor / seen[w]
        if hit:
            clauses += 1
            weights.append(weight)
    return clauses, sum(weights), max(weights, default=0.0)


def test_grammar():
    import pyarrow as pa

    lexicon, machine = toxicity.Lexicon({"idiot": 6.0, "gro*": 4.0}), toxicity.grammar()
    texts = ["he is idiot", "idiot", "not an idiot", "she said idiot", "will kill", "you kill", "fine words", None, "grob", "idiot. idiot", "not here. idiot", "I will kill you", "you kill time", "idiots like you", "idiot like you", "kill you", "kill"]
    counts, clauses, total, top = toxicity.clause_scores(pa.array(texts), lexicon, machine)
    assert total[0] > total[1] > total[3] > 0 and total[1] > total[2] > 0
    assert total[6] == total[7] == 0 and total[8] == 4.0 and clauses[9] == 2 and total[9] < 2 * total[1] and total[10] == total[1] and counts[0] == 3
    assert total[11] > total[15] > total[4] > total[12] == total[5] > total[16] > 0 and total[14] > total[1]


def test_grammar_against_plain_rules():
    import pyarrow as pa

    r = np.random.default_rng(3)
    pool = ["idiot", "scum", "kill", "hurt", "you", "them", "not", "never", "said", "called", "will", "gonna", "the", "tree", "walks", "."]
    texts = [" ".join(r.choice(pool, r.integers(1, 14))) for _ in range(1500)] + [None, "", "idiot"]
    strengths = {"idiot": 6.0, "scum": 3.5}
    counts, clauses, total, top = toxicity.clause_scores(pa.array(texts), toxicity.Lexicon(strengths), toxicity.grammar())
    for i, t in enumerate(texts):
        n, whole, most = plain_weights(t, strengths)
        assert clauses[i] == n and math.isclose(total[i], whole, abs_tol=1e-9) and math.isclose(top[i], most, abs_tol=1e-9), t


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", toxicity.held_out("doc_id").alias("h"))
    for r in df.collect():
        assert r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_one_id_with_several_texts(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(5, a, None, None, None), (5, b, None, None, None), (7, a, None, None, None), (9, b, None, None, None), (3, b, None, None, None), (8, c, None, None, None), (None, a, None, None, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 3, False), (8, 8, True), (None, None, True)}


def test_classifier_keeps_clashing_columns(spark):
    docs = table(spark, documents()[:20]).withColumn("quality_score", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("h", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.score_quality(docs, model)
    assert out.columns[-1] == "quality_score" and {"y", "h"} <= set(out.columns) and out.count() == 20
    assert quality_classifier.score_quality(empty(spark), model).count() == 0
    few = quality_classifier.train(docs, labels, max_features=10)  # less than one document has: that one alone
    assert quality_classifier.score_quality(docs, few).count() == 20


def pipeline_tables(spark, folder, rows, labels):
    table(spark, rows).withColumn("kept", F.lit("own")).withColumn("toxicity", F.lit("own")).withColumn("id", F.lit("own")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    pipeline_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    text = prose(50, 60)
    rows = [*documents(), (200, text, "en", "s", 1), (200, text, "en", "s", 1), (200, prose(51, 60), "de", "s", 1), (None, text, "fr", None, None), (None, None, None, None, None)]
    pipeline_tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(60)] + [(None, 1, 1)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.Scratch(spark, "t").keep(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == before.columns and docs.where("kept <> 'own' or toxicity <> 'own' or id <> 'own'").count() == 0, name
        if name == "MinHash near-dedup":
            assert docs.where("doc_id = 200").count() == 2 and docs.where("doc_id is null").count() == before.where("doc_id is null").count()


def test_spread_over_the_driver_tables(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    rules = {r.doc_id for r in quality_rules.apply_quality_rules(docs).where("kept").collect()}
    scored = toxicity.score_toxicity(docs.where(F.col("doc_id").isin(list(rules))), toxicity.learn(docs.where(F.col("doc_id").isin(list(rules))), spark.read.parquet(f"{sf}/labels.parquet")))
    clean = [(r.doc_id, r.text) for r in scored.where("toxicity < 0.5").collect()]
    assert kept == {i for i, (_, root, own) in brute_components([(i, t) for i, t in clean]).items() if own}
