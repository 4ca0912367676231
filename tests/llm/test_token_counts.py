"""Token counts against the library, for whole texts and for texts cut into chunks."""

import random

import pytest

from readmill.llm.token_counts import SPACE, CountTransducer, _normalised, count_tokens

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def transducer():
    return CountTransducer.from_model(MODEL)


def strange_texts(n, seed=1):
    rng = random.Random(seed)
    letters = list("abcdefgthe  \n\t▁éß中文😀012.,'-_Ax=(){}") + ["<s>", "</s>", "<unk>", "<0x0A>", "the ", "ing", "aaaa"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_strange_texts(library, transducer):
    for t in strange_texts(3000):
        assert transducer.count(_normalised(t)) == len(library.encode(t)), t


def test_chunks_compose_in_any_way(library, transducer):
    rng = random.Random(2)
    for t in strange_texts(1500, 3):
        n = _normalised(t)
        cuts = sorted(rng.randrange(len(n) + 1) for _ in range(3))
        maps = [transducer.chunk_map(n[a:b]) for a, b in zip([0, *cuts], [*cuts, len(n)])]
        want = len(library.encode(t))
        assert transducer.finish(transducer.scan(maps)) == want
        left = maps[0]
        for m in maps[1:]:
            left = transducer.compose(left, m)
        assert transducer.finish(left) == want


def test_forgetting_changes_nothing(library):
    t = CountTransducer.from_model(MODEL)
    t.STATES = 20
    assert [t.run(SPACE + w) for w in ("hello", "tokenizer", "straße") * 3] == [len(library.encode(w)) for w in ("hello", "tokenizer", "straße") * 3]


def test_cases(spark, library):
    long = "ab cd\n" * 700 + "x" * 5000 + "é" * 300
    rows = [(1, None), (2, ""), (3, " "), (4, "a  b"), (None, "null id"), (5, "same"), (5, "same"), (6, long), (7, "<s>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as t", "3 as n_tokens", "4 as row")
    for chunk in (1 << 17, 100):
        got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, MODEL, chunk_chars=chunk, limit=100).collect())
        assert got == sorted((repr(i), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in rows)
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id])) for r in count_tokens(docs, MODEL).collect())
