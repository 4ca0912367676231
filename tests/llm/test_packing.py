"""Packing: every id in one piece, checksums, gapless sequences, little padding, neighbours by BM25."""

import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from readmill.llm.packing import GRID, Encoder, Shard, crc_after, encoded, pack, term_counts, with_shards

P = pytest.importorskip("public_tokenizers")
FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, ids, window):
    """ids: for each id, lists of the ids of its rows."""
    at, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        same = ids[r.doc_id]
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in same)
        at[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, x in ids.items():
        assert sum(n for _, n in at[k]) == sum(map(len, x))
        if len(x) == 1:
            end = 0
            for a, n in sorted(at[k]):
                assert a == end and n > 0
                end += n
    for s in sequences.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= window
    return sum(window - sum(n for _, n in s) for s in sequences.values()) / max(1, len(sequences) * window)


def test_encoder_is_the_library(library):
    texts = ["Don't l'homme 'tis it's IT'S", "a1b22  ½ x_y--z ### \n\n İstanbul ǅ", "<|endoftext|> a", "naïve café “q” ’s", "中文 mixed", "", "\x85\x1c\t", "ß ẞ Σας", "a" * 3000, "'''s 'll'd", "tab\there"]
    e = Encoder(FILE)
    e.REMEMBERED = 8
    for _ in range(2):
        assert [x.tolist() for x in e.ids(texts, 50)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_checksum_of_a_tail():
    data = bytes(range(256)) * 9
    for a in (0, 1, 64, 700, len(data)):
        assert crc_after(zlib.crc32(data), zlib.crc32(data[:a]), len(data) - a) == zlib.crc32(data[a:])


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: [ids_of(library, r.text)] for r in docs.collect()}
    assert check(pack(docs, FILE).collect(), ids, 4096) < 0.03
    assert check(pack(docs, FILE, window=256, shard_tokens=20_000).collect(), ids, 256) < 0.15


def test_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (None, "null id"), (5, "same text"), (5, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as t", "3 as k1", "4 as terms")
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(ids_of(library, t))
    check(pack(df, FILE).collect(), ids, 4096)
    assert pack(df.limit(0), FILE).count() == 0
    with pytest.raises(ValueError):
        pack(df, FILE, window=100)


def test_the_best_neighbour_joins_its_seed():
    terms, at = np.array([1, 2, 3, 7, 8, 1, 2, 9, 7, 5], np.uint32), np.array([0, 3, 5, 8, 10])
    idf = np.full(10, 2.0, np.float32)
    rest = np.array([3 * GRID, 3 * GRID, GRID, GRID])
    got = list(Shard(rest, rest.astype(np.float32), terms, np.ones(10, np.uint32), at, idf, 40.0, 8).pack(4 * GRID))
    assert [[d for d, *_ in s] for s in got] == [[0, 2], [1, 3]]


def test_of_equal_neighbours_the_first_joins():
    terms, at = np.array([1, 2, 1, 2, 1, 2, 5], np.uint32), np.array([0, 2, 4, 6, 7])
    rest = np.array([3 * GRID, GRID, GRID, 3 * GRID])
    got = list(Shard(rest, rest.astype(np.float32), terms, np.ones(7, np.uint32), at, np.full(6, 2.0, np.float32), 40.0, 8).pack(4 * GRID))
    assert [[d for d, *_ in s] for s in got] == [[0, 1], [3, 2]]


def test_only_the_known_steps_are_imitated(library):
    from tokenizers import Tokenizer, normalizers

    assert Encoder.imitated(library)
    other = Tokenizer.from_file(FILE)
    other.normalizer = normalizers.NFC()
    assert not Encoder.imitated(other)


def test_shards_are_bounded_and_related_rows_meet(spark):
    """Rows with the same rare term lie in one shard; a term with more ids than a shard holds gets several."""
    rng = np.random.default_rng(7)
    groups = [" ".join(f"common{rng.integers(0, 9)} rarity{g}x" for _ in range(30)) for g in range(40)]
    rows = [(100 * g + i, f"{t} tail{i}") for g, t in enumerate(groups) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = encoded(df, FILE, 2, 4096, "doc_id", "text").cache()
    df_ = np.zeros(50_000, np.int64)
    counts = term_counts(r).toPandas()
    df_[counts["term"]] = counts["df"]
    total = r.agg({"rest": "sum"}).first()[0]
    dealt, shards = with_shards(r, df_, total // 8)
    mass = [x[1] for x in dealt.groupBy("shard").sum("rest").collect()]
    assert shards >= 8 and max(mass) <= 2 * total / 8
    few, n = with_shards(r, df_, 200)
    assert n >= total // 200 and max(x[1] for x in few.groupBy("shard").sum("rest").collect()) < 6 * 400


def test_long_texts_ties_and_many_shards(spark, library):
    rows = [(i, f"same words here {i % 3}") for i in range(50)] + [(90, "x" * 70_000), (91, "word " * 30_000), (None, None)]
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(ids_of(library, t))
    check(pack(spark.createDataFrame(rows, "doc_id long, text string"), FILE, window=64, shard_tokens=50).collect(), ids, 64)


def plain_pack(shard, window):
    """One pick after the other, each over all leftovers."""
    rest, start, out = shard.rest.copy(), np.zeros(len(shard.rest), np.int64), []
    for seed in np.argsort(-rest, kind="stable").tolist():
        if rest[seed] <= 0:
            continue
        pieces, room = [], window
        picks = [(seed, int(rest[seed]))]
        score = shard.scores(seed)
        while picks:
            d, n = picks.pop()
            pieces.append((d, int(start[d]), n))
            start[d], rest[d], room = start[d] + n, rest[d] - n, room - n
            if room < GRID:
                break
            left = [(-score[i], i) for i in np.flatnonzero(rest > 0).tolist() if score[i] > 0]
            if fits := [x for x in left if rest[x[1]] <= room]:
                picks.append((min(fits)[1], int(rest[min(fits)[1]])))
            elif left:
                picks.append((min(left)[1], room // GRID * GRID))
            elif (rest > 0).any():
                d = [i for i in np.argsort(-shard.whole, kind="stable").tolist() if rest[i] > 0][-1]
                picks.append((d, int(rest[d]) if rest[d] <= room else room // GRID * GRID))
            if left and not fits:  # the cut ends the window
                d, n = picks.pop()
                pieces.append((d, int(start[d]), n))
                start[d], rest[d] = start[d] + n, rest[d] - n
                break
        out.append(pieces)
    return out


def a_shard(n, voc, sizes, seed):
    r = np.random.default_rng(seed)
    rest = r.choice(sizes, n).astype(np.int64)
    k = np.minimum(np.minimum(rest, r.integers(1, 12, n)), voc)
    terms = np.concatenate([np.sort(r.choice(voc, int(x), replace=False)) for x in k]).astype(np.int32)
    shard = Shard(rest, rest.astype(np.float32), terms, r.integers(1, 4, len(terms)), np.concatenate([[0], np.cumsum(k)]), r.random(voc).astype(np.float32) + 0.1, float(rest.mean()), 4)
    shard.whole = rest.copy()
    return shard


def test_many_small_leftovers():
    for t, sizes in enumerate(([1, 2, 3], [1, 5, 40, 100, 700], [32, 64, 900, 3000], [1])):
        for voc in (3, 200):
            assert list(a_shard(150, voc, sizes, t).pack(1024)) == plain_pack(a_shard(150, voc, sizes, t), 1024)
    shard = a_shard(200_000, 1, [1], 9)
    began = time.monotonic()
    windows = list(shard.pack(4096))
    assert sum(map(len, windows)) == 200_000 and time.monotonic() - began < 30
