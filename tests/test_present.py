"""Distinct short k-mers by bits, and cells without divisions."""

import numpy as np
from pyspark.sql import functions as F

from readmill.operators import kmers as K
from readmill.operators import sketches as X


def test_distinct_kmers_by_bits(spark):
    reads = spark.createDataFrame([(1, "ACGTTGCAACGTAGGTNACGATTA"), (2, "acgttgcaacg"), (3, None), (4, ""), (5, "TTTTTTTTTTTT"), (6, "ACGTTGCAACGTAGGTN" * 9)], "read_id long, seq string").repartition(3)
    for k in (3, 5, 12):
        rows = K.kmer_rows(reads, k, coded=True).where("not has_n").select(K.decoded(F.col("canon"), k).alias("canon")).distinct()
        got = X.present(reads, k)
        from readmill.functions import sequences as S

        assert sorted(r.canon for r in got.select(S.decoded(got.code, k).alias("canon")).collect()) == sorted(r.canon for r in rows.collect())
    found = X.estimates(reads, 12, 4, 1 << 16)
    assert "minimizer" not in found._jdf.queryExecution().toString()  # no k-mer is shuffled


def test_cells_without_divisions():
    x = np.concatenate([np.arange(5), np.random.default_rng(1).integers(0, 1 << 62, 1000), [(1 << 31) - 2, (1 << 31) - 1, 1 << 31, (1 << 62) - 1]])
    for row in range(4):
        for cells in (1 << 16, 1000):
            p = (1 << 31) - 1
            want = [((int(v) % p) * (1103515245 + 12345 * row) % p + 7919 * (row + 1)) % p % cells for v in x]
            assert X._cells(x, row, cells).tolist() == want
