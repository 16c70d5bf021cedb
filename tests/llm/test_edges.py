"""Odd rows for every operator: nulls, empty and long texts, ties, repeats, clashing names, empty tables; brute force where SQL cannot."""

import random

import numpy as np
import pytest

import corpus_pipeline
from termloom.llm import decontam, hnsw, html_extract, license_scan, line_dedup, mixing, pii_crf, quality, secret_ledger, simhash_golay
from termloom.llm.common import ready

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, doc string, slot string, maybe string, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    long = "\n".join(prose(k, 40) for k in range(60))
    texts = [None, "", "  \n ", "one", prose(1, 80), prose(1, 80), prose(2, 80) + " password=abcdef123456 x@y.example +1 (234) 555-7890", long, "Released under the MIT License.\n" + prose(3, 30), prose(9, 60) + "\n" + prose(10, 60)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), 5, 6, "d", "s", "m", "k") for i, t in enumerate(texts)]
    rows += [rows[4], (None, prose(4, 30), None, None, None, 1, 1, "d", "s", "m", "k"), (20, prose(9, 60)[:-1] + "!\n" + prose(11, 60), "en", "a", 1, 1, 1, "d", "s", "m", "k")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def tables(spark):
    bench = spark.createDataFrame([(1, prose(7, 15)), (2, "two words"), (3, None), (4, ""), (5, prose(7, 15))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(99, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return bench, labels


def test_every_operator_takes_odd_rows(docs, tables):
    bench, labels = tables
    n = docs.count()
    for made in (simhash_golay.op2(docs), mixing.op5(docs), pii_crf.op6(docs), line_dedup.op7(docs), secret_ledger.op8(docs), decontam.op9(docs, bench), quality.op10(docs, labels), license_scan.op4(docs)):
        assert made.count() == n


def test_every_operator_takes_empty_tables(docs, tables):
    none, (bench, labels) = docs.limit(0), tables
    for made in (simhash_golay.op2(none), mixing.op5(none), pii_crf.op6(none), line_dedup.op7(none), secret_ledger.op8(none), decontam.op9(none, bench), quality.op10(none, labels.limit(0)), license_scan.op4(none)):
        assert made.count() == 0
    assert decontam.op9(docs, bench.limit(0)).where("contaminated").count() == 0


def test_stages_keep_the_columns(spark, docs, tables):
    bench, labels = tables
    for out in (quality.classify(docs, labels), line_dedup.dedup_lines(docs), simhash_golay.one_of_each(docs), decontam.decontaminate(docs, bench)):
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert simhash_golay.one_of_each(docs).where("doc_id = 4").count() == 1 and simhash_golay.one_of_each(docs).where("doc_id = 5").count() == 0


def test_lines_within_two_edits_are_removed(docs):
    got = {r["doc_id"]: r for r in line_dedup.op7(docs.where("doc_id in (9, 20)")).collect()}
    assert got[9]["n_removed"] == 0 and got[20]["n_removed"] == 1


def test_golay_links_equal_brute_force(spark):
    ready(spark)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set(base.tolist())
    for v in base.tolist():
        for k in (1, 2, 3, 4, 5):
            x = v
            for b in rng.choice(64, k, replace=False):
                x ^= 1 << int(b)
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in simhash_golay.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert got == want


def test_knapsack_meets_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(40):
        size = np.unique(rng.integers(1, 30, 5))
        count = rng.integers(1, 4, len(size))
        budget = int(rng.integers(0, int((size * count).sum()) + 3))
        take = mixing._knapsack(size, count, budget)
        sums = {0}
        for s, c in zip(size.tolist(), count.tolist()):
            sums = {x + k * s for x in sums for k in range(c + 1) if x + k * s <= budget}
        assert (take <= count).all() and int((take * size).sum()) == max(sums)


def test_automaton_finds_what_windows_find():
    rng = random.Random(3)
    items = [(i, [str(rng.randrange(4)).encode() for _ in range(rng.choice((2, 5, 12, 20)))]) for i in range(12)]
    machine = decontam.Automaton(items, window=6)
    for _ in range(50):
        words = [str(rng.randrange(5)).encode() for _ in range(40)]
        hit, found = set(), set()
        for i, item in items:
            n = min(6, len(item))
            for s in range(len(item) - n + 1):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == item[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(i)
        spans, items_found = machine.match(words)
        assert {k for s, e in spans for k in range(s, e)} == hit and items_found == found


def test_leaks_over_several_shards(spark, docs):
    ready(spark)
    items = [(i, prose(100 + i, 30)) for i in range(40)] + [(None, prose(9, 60)), (77, None), (78, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, prose(500 + i, 20) + " " + items[i % 41][1] + " " + prose(600 + i, 5)) for i in range(60)] + [(99, prose(8, 50)), (98, None)]
    found = spark.createDataFrame(texts, "doc_id long, text string")
    one, several = (sorted(map(str, decontam.hits(found, bench, shard_words=n).collect())) for n in (1 << 20, 300))
    assert decontam.automata(bench, shard_words=300).count() >= 3 and decontam.automata(bench).count() == 1
    assert one == several and decontam.op9(found, bench).where("contaminated").count() == 60
    unnamed = decontam.op9(found.where("doc_id = 40"), bench).first()
    assert unnamed["contaminated"] and unnamed["n_items"] == 0


def test_nearest_with_copies_and_bad_vectors(spark):
    ready(spark)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 400)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [1.0, None] + [1.0] * 6), (None, [1.0] * 8)]
    got = hnsw.op3(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows[:400]]
    hits = 0
    for q, v in good[::20]:
        want = [i for _, i in sorted((-float(v @ w), i) for i, w in good if i != q)[:20]]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 20
        hits += len(set(mine) & set(want))
    assert hits >= 0.9 * 20 * 20 and {r["query_id"] for r in got} == set(range(0, 400, 20))


def test_skip_links_carry_a_label_to_another_form():
    # mentions come again, and so do numbers that are none
    base = [f"call +1 (234) 555-{k:04d} now, room 4{k:03d} of {k % 7} floors, room 4{k:03d}, or +1 (234) 555-{k:04d} later" for k in range(200)]
    base += [f"mail name{k}@mail.example.com for part 12{k:03d} or part 12{k:03d}, again name{k}@mail.example.com" for k in range(200)]
    model = pii_crf.learn(base)
    for text, second in (("call +1 (234) 555-7890 now or 234-555-7890 later", "234-555-7890"), ("mail ann.lee@mail.example.com or ann.lee@localhost now", "ann.lee@localhost")):
        known, every = pii_crf.all_spans(text, model)
        added = [x for x in every if x not in known]
        assert len(known) == 1 and [text[s:e] for s, _, e in added] == [second] and added[0][1] == known[0][1]
        alone = "now or " + second + " later"
        assert pii_crf.all_spans(alone, model)[0] == []
    # bare digits look like any number, yet the other mention speaks for them
    weight = lambda text: pii_crf.infer(*pii_crf.described(text)[1:], model)[-1, 4]
    assert weight("call +1 (234) 555-7890 now or 12345557890 later") > 10 * weight("call +1 (234) 555-7891 now or 12345557890 later")
    # a number that ends otherwise shares no potential
    spans, _, _, skip, similar = pii_crf.described("call +1 (234) 555-7890 now or 234-555-7891 later")
    assert set(skip) == set(similar) == {-1}


def test_the_middle_of_a_long_token_counts():
    ends = "a1" * 40
    assert pii_crf.shape(ends + "@" + ends) != pii_crf.shape(ends + "#" + ends) and pii_crf.shape(ends + "-" + ends)[0] != pii_crf.shape(ends + "/" + ends)[0]


def test_pages_without_markup_or_text(spark):
    ready(spark)
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>Some text,<br> and more of it.</article><footer>foot</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain & simple"), (5, "u", "<p <b> unclosed <!-- x")] + [(i, "u", page) for i in range(6, 40)]
    got = {r["page_id"]: r for r in html_extract.op1(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\nSome text, and more of it." and got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])
    assert html_extract.op1(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ready(spark)
    docs = spark.createDataFrame([(1, "token = abcdef123456ABC"), (2, "token = abcdef123456ABC"), (3, None)], "doc_id long, text string")
    at, rules = str(tmp_path / "ledger"), {k: secret_ledger.RULES[k] for k in ("assign", "hex")}
    secret_ledger.findings(docs, at, rules).collect()
    again = {r["doc_id"]: r["found"] for r in secret_ledger.findings(docs, at).collect()}
    assert again[1]["assign@1"] == again[2]["assign@1"] == "0:23" and set(again[3]) == {"assign@1", "access@1", "hex@1", "pem@1"}
    parts = spark.read.parquet(at)
    assert sorted(len(r["rules"]) for r in parts.collect()) == [2, 2, 2, 2]


def test_licences_come_from_the_nearest_directory(spark):
    ready(spark)
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "a/b/NOTICE", "Licensed under the Apache License, Version 2.0."), (4, "z/y.py", None), (5, None, "x")] + [(k, f"q/{k}.txt", prose(k, 5)) for k in range(10, 60)]
    got = {r["id"]: (r["license"], r["origin"]) for r in license_scan.licences(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got[2] == ("Apache-2.0", "inherited") and got[1] == ("MIT", "own") and got[4] == (None, "none") and got[5] == (None, "none")


def test_licences_found_in_many_files_are_licences(spark):
    ready(spark)
    notices = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "Proprietary": "All rights reserved."}
    rows = [(k, f"{name}/{k}.txt", text if k % 3 == 0 else prose(k, 5)) for name, text in notices.items() for k in range(60)]
    for files in (rows, [(0, "a/x", notices["Apache-2.0"]), (1, "a/y", notices["Apache-2.0"]), (2, "b/z", "code")]):
        for r in license_scan.licences(spark.createDataFrame(files, "id long, path string, text string")).collect():
            text = next(t for _, p, t in files if p == r["path"])
            want = next(((n, "own") for n, x in notices.items() if x == text), (r["path"].split("/")[0], "inherited") if r["path"] != "b/z" else (None, "none"))
            assert (r["license"], r["origin"]) == (want if want[0] != "a" else ("Apache-2.0", "inherited"))


def test_licences_with_other_words_and_over_lines(spark):
    ready(spark)
    texts = {
        1: ("Proprietary", "Copyright 2024 Acme Inc. All rights reserved."),
        2: ("MIT", "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and\n# associated documentation files (the Software), to deal"),
        3: ("Apache-2.0", "Licensed under Apache License Version 2.0 by Quux"),
        4: ("MIT", "The MIT License\n\nCopyright Foo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it"),
        5: (None, "the licence of this work is with the author and of no use"),
    }
    rows = [(i, f"{i}/f.txt", t) for i, (_, t) in texts.items()] + [(9, "l/LICENSE", texts[4][1]), (10, "l/x", "code")]
    rows += [(k, f"q/{k}.txt", "Licensed under the Apache License, Version 2.0." if k % 50 == 0 else "All rights reserved." if k % 51 == 0 else prose(k, 5)) for k in range(100, 1100)]
    got = {r["id"]: r for r in license_scan.licences(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {i: got[i]["own"] for i in texts} == {i: name for i, (name, _) in texts.items()} and (got[10]["license"], got[10]["origin"]) == ("MIT", "inherited")
    assert len(got) == len(rows)


def test_licence_scores_do_not_fall_with_the_table(spark):
    vocabulary = {w for _, t in license_scan.TEMPLATES for w in license_scan.terms(t.encode())}
    for text in (b"Licensed under Apache License Version 2.0 by Quux", b"Copyright 2024 Acme Inc. All rights reserved."):
        scores = [license_scan.Matcher({w: n // 100 for w in vocabulary}, n).file(text)[1] for n in (10**4, 10**6, 3 * 10**7)]
        assert min(scores) >= license_scan.SIMILAR and max(scores) - min(scores) < 0.01


def test_licences_joined_with_frequencies_equal_brute_force(spark):
    ready(spark)
    rng = random.Random(8)
    words = [w.decode() for w in sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.terms(t.encode())})]
    rows = []
    for k in range(400):
        name, text = rng.choice(license_scan.TEMPLATES)
        tokens = [rng.choice(words + WORDS) if rng.random() < 0.2 else w for w in text.split()]
        tokens = [x for w in tokens for x in ([w, rng.choice(WORDS)] if rng.random() < 0.15 else [w])]
        rows.append((k, f"d{k % 7}/{'LICENSE' if k % 9 == 0 else k}", prose(k, 6) + "\n" + "".join(w + rng.choice("  \n") for w in tokens) + prose(k + 1, 3)))
    held = [set(license_scan.terms(t.encode())) for _, _, t in rows]
    matcher = license_scan.Matcher({w: sum(w in h for h in held) for w in set().union(*held) | {w.encode() for w in words}}, len(rows))
    got = {r["id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    for i, path, text in rows:
        own, score, line = matcher.file(text.encode(), path.endswith("LICENSE"))
        assert (got[i]["own"], got[i]["own_line"]) == (own, line) and abs(got[i]["own_score"] - score) < 1e-9


def test_quality_sees_the_whole_of_long_words(spark):
    ready(spark)
    rng = random.Random(5)
    word = bytes(rng.randrange(33, 256) for _ in range(150_000))
    assert np.concatenate(list(quality.long_buckets(word))).tolist() == quality.buckets_of(word)
    ids, counts = quality.features(b"a " + word + b" " + word + b" " + word[:200])
    every = sum(([quality.REPEAT_BUCKETS, quality.buckets_of(b"a"), quality.buckets_of(word) * 2, quality.buckets_of(word[:200])]), [])
    assert (ids.tolist(), counts.tolist()) == tuple(x.tolist() for x in np.unique(every, return_counts=True))
    # texts of one word that differ in their middle only
    body = lambda k: "".join(rng.choice("天地玄黃宇宙洪荒" if k % 2 else "日月盈昃辰宿列張") for _ in range(300))
    docs = spark.createDataFrame([(k, "始" * 30 + body(k) + "終" * 30) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = quality.op10(docs, labels).where("held_out").collect()
    assert len(got) > 20 and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got)
