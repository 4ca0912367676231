"""Exact top-k against all inner products, and held-out accuracy of the language profiles."""

import re

import numpy as np
from pyspark.sql import functions as F

from readmill.llm import language_id as L
from readmill.llm import queries as Q
from readmill.llm.language_id import Vectors, held_out, learn, op5_language_id, predict
from readmill.llm.topk_search import Block, search


def plain(v, q, k, own):
    s = sorted((-int(v[i].astype(object) @ q.astype(object)), i) for i in range(len(v)) if i != own)
    return [(-a, i) for a, i in s[:k]]


def test_blocks_are_exact():
    rng = np.random.default_rng(0)
    for n, dims, high in ((300, 8, 3), (3000, 16, 200), (500, 4, 1 << 28), (200, 3, 1 << 40), (5, 2, 9), (400, 6, 1)):
        v = rng.integers(-high, high, (n, dims))
        v[n // 2 :: 7] = v[0]  # ties
        b = Block(v)
        for own in range(0, n, max(1, n // 9)):
            got = sorted((-s, i) for i, s in b.search(v[own], 5, own))[:5]
            assert [(-a, i) for a, i in got] == plain(v, v[own], 5, own)


def test_search_cases(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.9, 0.1]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, []), (7, [float("inf"), 0.0]), (50, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank", "3 as row")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank", "score").collect()]
    d = lambda a, b: sum(int(np.floor(256 * np.float64(np.float32(x)))) * int(np.floor(256 * np.float64(np.float32(y)))) for x, y in zip(a, b))
    a, b, c = [1.0, 0.5], [0.9, 0.1], [0.1, 0.1]
    assert [x for x in got if x[0] == 0] == sorted([(0, 1, 0, d(a, a)), (0, 2, 1, d(a, b)), (0, 3, 50, d(a, c))] * 2, key=lambda x: (x[1], x[3]))
    assert [x for x in got if x[0] == 50] == [(50, 1, 0, d(a, c)), (50, 2, 0, d(a, c)), (50, 3, 1, d(b, c))]
    assert search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert search(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_by_sql_and_blocks(spark, sf, same_as_sql):
    same_as_sql(Q.queries()["op3_topk_search"](spark, sf), Q.oracle_sql()["op3_topk_search"])
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    same_as_sql(search(e, F.col("vec_id") % 50 == 0, block_rows=60), Q.oracle_sql()["op3_topk_search"])


def test_vectors_bind_bundle_and_count():
    v = Vectors(256, 3, 7)
    want = np.roll(v.letter("a"), 2) * np.roll(v.letter("b"), 1) * v.letter("c")
    assert (v.gram("abc") == want).all() and set(np.unique(want)) == {-1, 1}
    assert v.counts("Ab, 12 cd") == {" ab": 1, "ab ": 1, " cd": 1, "cd ": 1} and v.counts("12 !") == {} and v.counts("") == {}
    assert (v.bundle({"abc": 2, " ab": 1}) == 2 * v.gram("abc").astype(float) + v.gram(" ab")).all()
    v.REMEMBERED = 2
    many = v.counts("the quick brown fox jumps 中文字符 über")
    assert (v.bundle(many) == sum(n * v.gram(g).astype(int) for g, n in many.items())).all()


def test_pieces_of_a_text_count_as_the_whole(monkeypatch):
    """Words across the bounds of pieces, and words longer than a piece, against n-grams of each padded word."""
    rng = np.random.default_rng(3)
    for piece in (3, 5, 64):
        monkeypatch.setattr(L, "_PIECE", piece)
        for n in (2, 3, 4):
            for _ in range(60):
                text = "".join(rng.choice(list("abc def12_é中 "), rng.integers(0, 50)))
                want = {}
                for w in re.findall(r"[^\W\d_]+", text.lower()):
                    for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)):
                        want[g] = want.get(g, 0) + 1
                assert Vectors(16, n, 7).counts(text) == want, text


def test_prediction_is_the_nearest_prototype(spark, sf):
    """The query's languages and scores against plain sums of n-gram vectors."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in docs.collect() if len(r.text or "") < 1500][:40]
    p = learn(docs.where(~held_out()))
    v, langs = Vectors(1024, 3, 7), sorted(p)
    want = {}
    for r in rows:
        x = np.zeros(1024)
        for w in re.findall(r"[^\W\d_]+", r.text.lower()):
            for i in range(len(w)):
                x += v.gram(f" {w} "[i : i + 3])
        cos = [float(p[k] @ x / (np.linalg.norm(x) or 1)) for k in langs]
        want[r.doc_id] = (langs[int(np.argmax(cos))], max(cos)) if x.any() else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op5_language_id(spark, sf).where(F.col("doc_id").isin(*want)).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_language_cases(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("nothing", None), (None, "fr")] * 3)], "doc_id long, text string, lang string")
    p = learn(train)
    assert sorted(p) == ["de", "en"]
    rows = [(1, "the dog"), (2, "und der"), (3, None), (4, ""), (5, "12 %"), (None, "the cat"), (1, "the dog"), (6, "the cat and " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lang_pred", "2 as score", "'x' as t")
    got = sorted((repr(r.doc_id), r.lang_pred) for r in predict(df, p).collect())
    assert got == sorted([("1", "en"), ("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "en"), ("None", "en")])
    assert predict(df.limit(0), p).count() == 0 and {r.lang_pred for r in predict(df, {}).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = op5_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = r.count(), r.where("lang = lang_pred").count()
    assert n > 30 and right / n > 0.95
    one = docs.withColumn("held", held_out()).where("held").select("doc_id").first().doc_id
    import zlib

    assert zlib.crc32(str(one).encode()) % 3 == 1


def test_numerals_are_no_letters(spark):
    model = learn(spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(9)], "doc_id long, text string, lang string"))
    rows = [(1, "½ ² ①"), (2, "Ⅷ"), (3, "٣ 7 _"), (4, "½ dog"), (5, "ﬁ")]
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {i for i, (x, _) in got.items() if x == "und"} == {1, 2, 3} and not any(s for i, (_, s) in got.items() if i < 4)
