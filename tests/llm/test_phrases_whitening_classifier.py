"""Phrase mining, whitening and the quality classifier: brute force, odd inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.test_llm import CLASH, LONG, ODD
from tools.oracle_check import compare, duck
from utxolens.llm import oracle, phrases, queries, quotient, whitening, wordvectors
from utxolens.llm.common import table

# --- counting quotient filters

@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("bits", [1, 7, 16, 31])
def test_permutation_is_undone(n, bits):
    shape, rng = quotient.Shape(n, bits), np.random.default_rng(n * bits)
    columns = [rng.integers(0, 2 ** bits, 500) for _ in range(n)]
    back = shape.unpack(*shape.pack(columns))
    assert all((a == b).all() for a, b in zip(columns, back))
    assert all(int(h.max()) < 2 ** w for h, w in zip(shape.pack(columns), (shape.left, shape.right)))


@pytest.mark.parametrize("n,bits,shard_bits", [(2, 3, 0), (2, 16, 3), (3, 20, 5), (4, 31, 9), (4, 9, 18)])
def test_filters_lose_nothing_and_merge(n, bits, shard_bits):
    shape, rng = quotient.Shape(n, bits), random.Random(bits)
    near = [[rng.randrange(2 ** min(bits, 4)) for _ in range(n)] for _ in range(40)]
    rows = [rng.choice(near) for _ in range(3000)] + [[rng.randrange(2 ** bits) for _ in range(n)] for _ in range(500)]
    rows += [near[0]] * 1000                                   # a counter beyond one byte
    want = Counter(map(tuple, rows))
    counter = quotient.Counter(shape, shard_bits, most=600)    # hands on many filters
    made = []
    for at in range(0, len(rows), 700):
        part = np.array(rows[at:at + 700]).T
        made += list(counter.add(list(part)))
    made += list(counter.filters())
    got: Counter = Counter()
    for shard in {s for s, _ in made}:
        c = quotient.merge(shape, [quotient.from_filter(shape, b, s, shard_bits) for s, b in made if s == shard])
        for *words, k in zip(*shape.unpack(c.left, c.right), c.count):
            assert tuple(map(int, words)) not in got
            got[tuple(map(int, words))] = int(k)
        again = quotient.from_filter(shape, quotient.to_filter(shape, c, shard_bits), shard, shard_bits)
        assert (again.left == c.left).all() and (again.right == c.right).all() and (again.count == c.count).all()
    assert got == want


# --- phrases

def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i:i + k])
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = []
    for (lang, ws), a in cand.items():
        score, k, l, r = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k,
                              f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        inside = [b for (o, big), b in cand.items() if o == lang and len(big) > len(ws)
                  and any(big[i:i + len(ws)] == ws for i in range(len(big) - len(ws) + 1))]
        if not any(100 * b >= 80 * a for b in inside):
            out.append((lang, " ".join(ws), a, l, r, n[lang], score))
    rows, place = [], Counter()
    for lang, p, a, l, r, total, s in sorted(out, key=lambda x: (x[0], -x[6], -x[2], x[1].encode())):
        place[lang] += 1
        if place[lang] <= top:
            rows.append((lang, place[lang], p, a, l, r, total, s))
    return sorted(rows)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "é", "x-y", "#", "日本", "a" * 70, "b\x0eb", "to"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", " ", ". ", ",", "\n", "!? "])
                       for _ in range(rng.randrange(40)))
        rows.append((text + rng.choice(["", "New York of the", " the of"]), rng.choice(["en", "en", "fr", None])))
    return rows + [(None, "en"), ("", "de"), (" .\n;", "de"), ("solo", "it")]


@pytest.mark.parametrize("seed,hot,top", [(0, 200_000, 2000), (1, 3, 5), (2, 0, 2000)])
def test_phrases_equal_brute_force(spark, seed, hot, top):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = phrases.collocations(df, least=5, top=top, hot=hot)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 5, top)


def test_slices_of_long_texts(spark, monkeypatch):
    rows = corpus(5)
    text = " ".join(t or "" for t, _ in rows)
    whole = list(phrases._slices([text.encode()]))
    monkeypatch.setattr(phrases, "SLICE", 50)
    parts = list(phrases._slices([text.encode()]))
    assert len(parts) > len(whole)
    flat = [w for p in parts for w in p]
    assert [w for w in flat if w != b"."] == [w for p in whole for w in p if w != b"."]
    one = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(one, least=5).collect())) == brute_phrases([(text, "en")], 5, 2000)


def test_counts_that_pass_64_bits(spark):
    grams = spark.createDataFrame([([1, 2], 2 ** 62)], "words array<bigint>, a bigint")
    words = spark.createDataFrame([(1, "en", "a", 2 ** 62), (2, "en", "b", 2 ** 63 - 1)],
                                  "id bigint, lang string, word string, n bigint")
    r = phrases.scores(grams, words).first()
    assert r.score == 2_000_000 * 2 ** 62 // (2 ** 62 + 2 ** 63 - 1)


def test_phrases_of_odd_and_empty_tables(spark):
    df = spark.createDataFrame([r[:3] for r in ODD] * 40, "doc_id bigint, text string, lang string")
    for c in CLASH + ["id", "a", "l", "r", "n", "score", "rank", "phrase", "words", "longer"]:
        df = df.withColumn(c, F.lit("clash"))
    short = [r for r in ODD if r[1] != LONG] * 40
    got = phrases.collocations(df.where("doc_id is null or doc_id <> 6"))
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[1], r[2]) for r in short], 30, 2000)
    none = phrases.collocations(df.limit(0))
    assert none.count() == 0 and none.columns == got.columns


def test_op12_equals_its_sql(spark):
    got = queries.op12_phrases(spark, SF_SMALL)
    con = duck(SF_SMALL)
    want = con.execute(oracle.oracle_sql()["op12_phrases"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    assert rows == sorted(want.fetchall()) and callable(compare)


# --- whitening

def brute_white(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)).astype(object) + 100_000
    x = np.array([[int(v) for v in r] for r in x], object)
    n, sums = len(x), x.sum(axis=0)
    dev = ((x * n - sums) ** 2).sum(axis=1)
    c = (x - np.array([float(s) / n for s in sums])).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    keep = [i for i in range(min(k, len(e))) if e[i] > 1e-12 * max(e[0], 1e-300)]
    return n, dev, (c @ u[:, keep]) / np.sqrt(e[keep]), e[keep] / e.sum()


def check_white(got, ids, vectors, k):
    n, dev, w, share = brute_white(vectors, k)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == w.size == len(got)
    for j in range(w.shape[1]):
        mine = np.array([rows[i, j + 1].whitened for i in ids])
        assert min(np.abs(mine - w[:, j]).max(), np.abs(mine + w[:, j]).max()) < 1e-7, j
        for i, d in zip(ids, dev):
            r = rows[i, j + 1]
            assert (r.n, int(r.deviation)) == (n, d) and abs(r.explained - share[j]) < 1e-9
            assert r.identity_error < 1e-8


SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("n,d,k", [(200, 5, 8), (7, 64, 8), (400, 100, 8)])
def test_whitening_equals_brute_force(spark, n, d, k):
    rng = np.random.default_rng(n + d)
    v = (rng.standard_normal((n, d)) * np.linspace(2, 0.5, d)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], SCHEMA).repartition(3)
    check_white(whitening.whiten(df, k=k).collect(), list(range(n)), v, k)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((50, 6)).astype(np.float32)
    short = rng.standard_normal((20, 3)).astype(np.float32)
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6),
           (904, [float("inf")] + [0.0] * 5)]
    good = [(i, r.tolist()) for i, r in enumerate(v)] + [(100 + i, r.tolist()) for i, r in enumerate(short)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    for c in CLASH + ["x", "d", "id", "n", "component", "block", "part"]:
        df = df.withColumn(c, F.lit("clash"))
    got = whitening.whiten(df, k=4).collect()
    check_white([r for r in got if r.vec_id < 100], list(range(50)), v, 4)
    check_white([r for r in got if r.vec_id >= 100], [100 + i for i in range(20)], short, 4)
    # one vector, constant vectors and none: no direction has any spread
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], []):
        none = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert none.count() == 0 and "identity_error" in none.columns
    twice = spark.createDataFrame([(i % 5, r.tolist()) for i, r in enumerate(v[:, :3])]
                                  + [(None, v[0, :3].tolist())], SCHEMA)
    assert whitening.whiten(twice, k=2).count() == 102
    huge = spark.createDataFrame([(1, [1e30, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="exact range"):
        whitening.whiten(huge).count()


def test_near_equal_and_repeated_eigenvalues():
    rng = np.random.default_rng(8)
    u = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for values in (np.r_[10.0, 10.0, 10.0, np.linspace(9.99, 1, 77)], np.r_[np.linspace(5.02, 5, 80)],
                   np.r_[1e9, 1e3, np.full(78, 1.0)], np.r_[3.0, 2.0, np.zeros(78)], np.ones(80),
                   np.r_[1.0, np.zeros(79)], np.r_[1e6, np.linspace(2, 1, 79)]):
        class Plain:
            passes = 0

            def __call__(self, q):
                self.passes += 1
                return u @ (values[:, None] * (u.T @ q))
        s = whitening.leading(Plain(), 80, 8)
        want = values[:8][values[:8] > 1e-12 * values[0]]
        assert np.allclose(s.values, want, rtol=1e-9, atol=1e-12 * values[0]), values[:9]
        assert np.abs(s.vectors.T @ s.vectors - np.eye(len(want))).max() < 1e-12


def test_deviation_is_exact_beyond_64_bits():
    rng = random.Random(1)
    for most in (10 ** 3, 10 ** 9, 10 ** 14):
        x = np.array([[rng.randrange(-most, most) for _ in range(5)] for _ in range(8)], np.int64)
        for n in (3, 10 ** 5, 10 ** 10):
            sums = np.array([int(c.sum()) * (n // 3) for c in x.astype(object).T], object)
            want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x]
            assert whitening._deviation(x, n, sums) == want


def test_op13_on_the_small_table(spark):
    df = table(spark, SF_SMALL, "embeddings")
    rows = sorted((r.vec_id, list(r.embedding)) for r in df.collect())
    check_white(queries.op13_whitening(spark, SF_SMALL).collect(), [i for i, _ in rows], [v for _, v in rows], 8)


# --- quality classifier

def test_forms_of_words():
    def of(w):
        core, shape = wordvectors.letters_and_form(w.encode())
        return core.decode(), shape.decode()
    assert of("Hello,") == ("hello", "Xx,") and of("HELLO!!") == ("hello", "XX!!")
    assert of("x###") == ("x", "x###") and of("|") == ("", "|") and of("A") == ("a", "Xx")
    assert of("don't") == ("dont", "x") and of("42%") == ("42", "9%") and of("iPad") == ("ipad", "xX")
    assert of("Élan,") == ("élan", "Xx,") and of("ÉLAN") == ("élan", "XX") and of("****x") == ("x", "***x")


def brute_vectors(texts):
    index = wordvectors.index_vectors().astype(int)
    total, n = np.zeros((wordvectors.ROWS, wordvectors.DIMS)), np.zeros((wordvectors.ROWS, 1))
    for t in texts:
        rows = [[zlib.crc32(a) % wordvectors.ROWS, zlib.crc32(b, 0x5EED) % wordvectors.ROWS]
                for a, b in map(wordvectors.letters_and_form, (t or "").encode().split())]
        own = [index[a] + index[b] for a, b in rows]
        for p, pair in enumerate(rows):
            around = 2 * own[p] + (own[p - 1] if p else 0) + (own[p + 1] if p + 1 < len(own) else 0)
            for row in pair:
                total[row] += around
                n[row] += 1
    v = total - n * (total.sum(axis=0) / max(1, n.sum()))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def test_word_vectors_and_pooling_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The", "of,", "É!", "###", "42", "日本", "OF"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    v = wordvectors.word_vectors(df)
    want = brute_vectors(texts)
    assert np.abs(v - want).max() < 1e-5
    got = wordvectors.Pool(v)([None if t is None else t.encode() for t in texts])
    for t, x in zip(texts, got):
        pairs = [wordvectors.letters_and_form(w) for w in (t or "").encode().split()]
        if not pairs:
            assert not x.any()
            continue
        a = np.array([v[zlib.crc32(c) % wordvectors.ROWS] for c, _ in pairs])
        b = np.array([v[zlib.crc32(s, 0x5EED) % wordvectors.ROWS] for _, s in pairs])
        mine = np.concatenate([a.mean(0), b.mean(0), a.std(0), [np.log1p(len(pairs))]])
        assert np.abs(mine - x).max() < 2e-3


def test_long_texts_pool_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((wordvectors.ROWS, wordvectors.DIMS)).astype(np.float32)
    texts = [LONG.encode(), b"a b c", b"x" * 5000, None]
    whole = wordvectors.Pool(v)(texts)
    monkeypatch.setattr(wordvectors, "SLICE", 3000)
    assert np.abs(wordvectors.Pool(v)(texts) - whole).max() < 1e-3


def test_classifier_on_odd_tables(spark):
    df = spark.createDataFrame([r[:3] for r in ODD], "doc_id bigint, text string, lang string")
    for c in CLASH + ["id", "y", "hash", "x", "block", "part"]:
        df = df.withColumn(c, F.lit("clash"))
    schema = "doc_id bigint, quality int"
    for rows in ([], [(None, 1), (77, 1), (4, None)], [(4, 1)], [(4, 1), (4, 0), (6, 0)],
                 [(i, i % 2) for i in range(1, 13)], [(4, 1), (9, 0)]):
        model = wordvectors.fit(df, spark.createDataFrame(rows, schema))
        got = model.score(df).select("doc_id", "score").collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got), rows
    assert wordvectors.fit(df, spark.createDataFrame([], schema)).constant == 0.5
    assert model.score(df.limit(0)).count() == 0
    empty = wordvectors.fit(df.limit(0), spark.createDataFrame([(4, 1), (9, 0)], schema))
    assert empty.constant == 0.5


def test_scores_do_not_depend_on_other_columns_or_place(spark):
    df = table(spark, SF_SMALL, "documents")
    model = wordvectors.fit(df, table(spark, SF_SMALL, "labels"))
    a = {r.doc_id: r.score for r in model.score(df).collect()}
    other = df.select((F.col("doc_id") + 0).alias("doc_id"), "text", F.lit("xx").alias("lang"),
                      F.lit("s").alias("source")).repartition(7)
    b = {r.doc_id: r.score for r in model.score(other).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_op11_held_out_accuracy_and_calibration(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op11_classifier(spark, sf).collect()}
    assert len(got) == table(spark, sf, "documents").count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)
    marks = [(r.quality, got[r.doc_id].score) for r in table(spark, sf, "labels").collect()
             if r.doc_id in got and got[r.doc_id].held_out]
    y, p = np.array([m for m, _ in marks]), np.array([s for _, s in marks])
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    auc = (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.98 and ((p >= 0.7) == (y == 1)).mean() > 0.95
    loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    assert loss < 0.12 and abs(p.mean() - y.mean()) < 0.03           # calibrated
