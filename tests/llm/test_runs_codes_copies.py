"""Runs of words, vector codes and the MinHash join next to brute force, and on odd rows."""

import hashlib
import random

import numpy as np
import pytest

from termloom.llm import minhash_join, vector_codes, word_runs
from termloom.llm.common import ready

ODD = "doc_id long, text string, n long, row long, node long, words string, value string, key string, k long, label string"


def odd(spark, rows):
    ready(spark)
    return spark.createDataFrame([(i, t, 1, 2, 3, "w", "v", "k", 4, "l") for i, t in rows], ODD)


# runs of words


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repeating(rng, most):
    words = []
    while len(words) < most:
        unit = [f"w{rng.randrange(rng.choice((1, 2, 3, 9)))}" for _ in range(rng.randrange(1, 9))]
        words += unit * rng.randrange(1, 8)
        if rng.random() < 0.3:
            words += words[-rng.randrange(1, len(words) + 1) :]
    return words


def test_runs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [(k, "  ".join(repeating(rng, rng.randrange(0, 90))) + "\n") for k in range(400)]
    got = {r["doc_id"]: r for r in word_runs.periodic_runs(odd(spark, texts), ["doc_id"]).collect()}
    seen = 0
    for i, text in texts:
        words = text.split()
        want = brute_runs(words)
        assert list(zip(got[i]["starts"], got[i]["lengths"], got[i]["periods"])) == want
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert got[i]["collapsed"] == " ".join(w for k, w in enumerate(words) if k not in gone) and got[i]["n_words"] == len(words)
        seen += len(want)
    assert seen > 400


def test_run_query_on_odd_rows(spark):
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (7, "é É é É é É é É x"), (None, "b c " * 30)]
    rows += [(8, "x " * 60_000), (9, " ".join(f"{k % 700}" for k in range(50_000)))]
    out = [r for r in word_runs.op11(odd(spark, rows)).collect()]
    assert len(out) == len(rows)
    of = lambda i: [r for r in out if r["doc_id"] == i]
    empty = hashlib.sha256(b"").hexdigest()
    for i in (1, 2, 3):
        assert of(i)[0]["n_runs"] == 0 and of(i)[0]["start"] is None and of(i)[0]["runs_sha256"] == of(i)[0]["collapsed_sha256"] == empty
    assert of(4)[0]["n_runs"] == 0 and len(of(5)) == 2 and [(r["length"], r["period"], r["exponent_milli"]) for r in of(5)] == [(6, 1, 6000)] * 2
    assert of(7)[0]["runs_sha256"] == hashlib.sha256(b"0,8,2\n").hexdigest() and of(7)[0]["collapsed_sha256"] == hashlib.sha256("é É x".encode()).hexdigest()
    assert of(8)[0]["n_runs"] == of(9)[0]["n_runs"] == 1 and of(8)[0]["exponent_milli"] == 60_000_000 and of(9)[0]["period"] == 700
    assert sorted(r["n_runs"] for r in of(None)) == [0, 1]
    assert word_runs.op11(odd(spark, [])).count() == 0


# vector codes


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    data = [[int(np.floor(4096 * x)) for x in v] for _, v in vectors]
    dims = len(data[0])
    cuts = [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]
    first = sorted(range(len(vectors)), key=lambda k: vectors[k][0])[:entries]
    books = [[data[k][a:b] for k in first] for a, b in cuts]
    nearest = lambda part, book: min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            held = {}
            for v in data:
                held.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    out = {}
    for (i, _), v in zip(vectors, data):
        got = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out[i] = ("".join(f"{k:02x}" for _, k in got), min(sum(e for e, _ in got), vector_codes.LONGEST))
    return out, ",".join(str(x) for book in books for e in book for x in e)


@pytest.mark.parametrize("wide", [0.3, 3e6])
def test_codes_equal_brute_force(spark, wide):
    ready(spark)
    rng = np.random.default_rng(3)
    vectors = [(int(i), (rng.normal(size=16) * wide).round(4).tolist()) for i in rng.permutation(150)]
    vectors += [(200 + k, vectors[0][1]) for k in range(20)]
    bad = [(300, None), (301, []), (302, [float("nan")] * 16), (303, [float("inf")] + [0.0] * 15), (304, [None] + [0.0] * 15), (305, [0.5] * 8)]
    rows = [(i, v, None if i % 5 == 0 else i % 3, "c", 1) for i, v in vectors + bad]
    got = vector_codes.op12(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, codes string, part int").repartition(7)).collect()
    want, book = brute_codes(vectors)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(vectors)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(book.encode()).hexdigest()}
    total = {}
    for i, (_, e) in want.items():
        label = None if i % 5 == 0 else i % 3
        total[label] = min(total.get(label, 0) + e, vector_codes.LONGEST)
    assert all(r["label_error"] == total[None if r["vec_id"] % 5 == 0 else r["vec_id"] % 3] for r in got)


def test_few_repeated_and_huge_vectors(spark):
    ready(spark)
    kind = "vec_id long, embedding array<float>, label string"
    assert vector_codes.op12(spark.createDataFrame([], kind)).count() == 0 and vector_codes.op12(spark.createDataFrame([(1, None, "a")], kind)).count() == 0
    rows = [(1, [1.0] * 8, None), (1, [1.0] * 8, None), (None, [2.0] * 8, "x"), (2, [3e38] * 8, "x")]
    got = vector_codes.op12(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 4 and all(r["error"] == 0 for r in got) and sum(r["vec_id"] is None for r in got) == 1
    rows = vector_codes.kept(spark.createDataFrame([(k, [float(k)] * 16, "a") for k in range(40)], kind))
    books = vector_codes.learn(rows)
    back = vector_codes.decode(vector_codes.encode(rows, books), books).collect()
    assert all(len(r["embedding"]) == 16 and abs(r["embedding"][0] - r["vec_id"]) ** 2 * 16 <= r["error"] / 4096**2 + 1e-6 for r in back)


# near-duplicates


def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, root = sorted(sets), {}
    for i in ids:
        if i in root:
            continue
        root[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and sets[a] and sets[b]:
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        root[b] = i
                        todo.append(b)
    return {i: (len(sets[i]), root[i]) for i in ids}


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("long", [256, 8])
def test_near_copies_equal_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(minhash_join, "LONG", long)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join(edited(rng, base, rng.random() * 0.08)) for _ in range(220)]
    for _ in range(25):  # copies of copies, off the centre
        far = edited(rng, base, 0.05)
        texts += [" ".join(edited(rng, far, 0.01)) for _ in range(3)]
    texts += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]) for _ in range(60)]
    texts += [" ".join(base[:n]) for n in (1, 2, 4, 5, 6, 120, 128, 149)] + ["", None, " \t", "b0  B1", "b0 b1", "É a b c d e", "é a b c d e", texts[3].upper(), texts[3]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_join.op13(odd(spark, rows).repartition(5)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(rows).items()}


def test_copies_on_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A B  C d e\nf"), (None, None), (9, None), (None, "only here"), (11, "long " + " ".join(f"{k}" for k in range(50_000)))]
    got = minhash_join.op13(odd(spark, rows)).collect()
    assert len(got) == len(rows) and sorted((r["component_id"] for r in got if r["n_shingles"] == 2)) == [5] * 4
    assert [r["component_id"] for r in got if r["doc_id"] == 9] == [9] and all(not r["kept"] for r in got if r["doc_id"] is None)
    assert minhash_join.op13(odd(spark, [])).count() == 0


def test_pairs_of_the_threshold_are_hardly_missed():
    least = minhash_join.matches()
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for _ in range(200):
        rng.shuffle(pool)
        a, b = np.unique(pool[:370]), np.unique(pool[30:400])
        assert (minhash_join.signature(a) == minhash_join.signature(b)).sum() >= least
