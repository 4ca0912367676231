"""The jobs: against SQL, over growing input, run again, replayed, and from the command line."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import classify_new_reads as N
from jobs import queries as Q
from jobs import score_tools as T
from jobs.common import config


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, sf, same_as_sql, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.partitionOverwriteMode")}
    same_as_sql(Q.queries()[name](spark, sf), Q.oracle_sql()[name])
    assert before == {k: spark.conf.get(k, None) for k in before} and not [t for t in spark.catalog.listTables() if t.name.startswith("index_")]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


def folder(spark, sf, at, parts):
    """A copy of the small tables, with documents in so many files, none of them in place yet."""
    at.mkdir()
    for t in ("benchmark", "nation", "region", "labels"):
        shutil.copy(f"{sf}/{t}.parquet", at / f"{t}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(parts, "doc_id").write.parquet(str(at / "all"))
    (at / "documents.parquet").mkdir()
    return sorted((at / "all").glob("part-*"))


@pytest.fixture(scope="module")
def whole(spark, sf, tmp_path_factory):
    """The output of one run over all files."""
    out = str(tmp_path_factory.mktemp("whole"))
    N.run(spark, sf, out)
    return rows(N.output(spark, out))


def test_new_reads_only(spark, sf, whole, tmp_path):
    files = folder(spark, sf, tmp_path / "in", 4)
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    n = [spark.read.parquet(str(f)).count() for f in files]
    for f in files[:2]:
        shutil.copy(f, tmp_path / "in" / "documents.parquet" / f.name)
    assert N.run(spark, tables, out, files_a_batch=1) == {"reads": n[0] + n[1], "batches": 2}
    first = rows(N.output(spark, out))
    index = sorted(x.name for x in (tmp_path / "out" / "index-31-13-16").glob("part-*"))
    assert N.run(spark, tables, out) == {"reads": 0, "batches": 0} and rows(N.output(spark, out)) == first
    for f in files[2:]:
        shutil.copy(f, tmp_path / "in" / "documents.parquet" / f.name)
    assert N.run(spark, tables, out)["reads"] == sum(n[2:])
    assert rows(N.output(spark, out)) == whole
    assert sorted(x.name for x in (tmp_path / "out" / "index-31-13-16").glob("part-*")) == index  # opened, not made again
    assert sum(r["tax_reads"] for r in first if r["part"] == "report") == n[0] + n[1]


def test_a_replayed_batch_changes_nothing(spark, sf, whole, tmp_path):
    files = folder(spark, sf, tmp_path / "in", 2)
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    for f in files:
        shutil.copy(f, tmp_path / "in" / "documents.parquet" / f.name)
    N.run(spark, tables, out, files_a_batch=1)
    (last,) = (tmp_path / "out" / "checkpoint" / "commits").glob("1")
    last.unlink()  # as if the run had ended before its last batch was committed
    (tmp_path / "out" / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert N.run(spark, tables, out, files_a_batch=1)["batches"] == 1
    assert rows(N.output(spark, out)) == whole


def test_any_rows(spark, sf, tmp_path):
    folder(spark, sf, tmp_path / "in", 1)
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert N.run(spark, tables, out) == {"reads": 0, "batches": 0} and rows(N.output(spark, out)) == []
    text = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 3").first().text
    odd = [(1, None, "a"), (None, text, "a"), (2, "", None), (3, text, ""), (3, text, ""), (4, text, "a"), (5, "x " * 5000, "a")]
    spark.createDataFrame(odd, "doc_id long, text string, source string").selectExpr("*", "1 as taxid", "2 as hits", "3 as batch").write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    N.run(spark, tables, out)
    calls = [(r["source"], r["read_id"], r["taxid"] > 1) for r in rows(N.output(spark, out)) if r["part"] == "call"]
    assert sorted(calls) == [("a", 1, False), ("a", 4, True), ("a", 5, False), ("none", 2, False), ("none", 3, True), ("none", 3, True)]
    report = {(r["source"], r["taxid"]): (r["reads"], r["percent"]) for r in rows(N.output(spark, out)) if r["part"] == "report"}
    assert report["none", 0] == (1, 33.333333) and report["none", 1] == report["none", 103] == (2, 66.666667) and report["a", 0][0] == 2


def test_scores_of_some_datasets(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    all_ = T.run(spark, sf, out)
    want = rows(T.output(spark, out))
    assert all_["metrics"] == sum(r["part"] == "metrics" for r in want) > 0 and T.run(spark, sf, out) == all_ and rows(T.output(spark, out)) == want
    some = str(tmp_path / "some")
    names = sorted({r["dataset"] for r in want if r["part"] == "metrics"})
    T.run(spark, sf, some, datasets=names[:1])
    T.run(spark, sf, some, datasets=names[1:])
    assert rows(T.output(spark, some)) == want  # the first one's partition stayed
    folders = sorted(x.name for x in (tmp_path / "out" / "metrics").glob("dataset=*"))
    assert folders == [f"dataset={n}" for n in names]


def test_rows_without_keys_and_repeated_ones(spark, sf, tmp_path):
    docs = spark.createDataFrame([(2, "t", "en", 100), (2, "t", "en", 400), (4, "t", "en", 200), (None, "t", "en", 9), (6, None, "en", 9), (8, "t", None, 9), (10, "t", "en", None)], "doc_id long, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (4, None, None), (None, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "in" / "labels.parquet"))
    assert T.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))["tools"] == 1
    m = {r["level"]: (r["precision"], r["recall"], r["tp"], r["fp"], r["fn"]) for r in rows(T.output(spark, str(tmp_path / "out"))) if r["part"] == "metrics"}
    assert m == {"genus": (1.0, 1.0, 1, 0, 0), "species": (0.0, 0.0, 0, 0, 1)}  # the larger of two predictions of a taxon counts
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert T.run(spark, str(tmp_path / "none"), str(tmp_path / "nothing"))["metrics"] == 0


def test_settings(tmp_path):
    assert config("score_tools")["abundance_unit"] == 50
    (tmp_path / "c.json").write_text(json.dumps({"k": 21}))
    assert config("classify_new_reads", str(tmp_path / "c.json"))["k"] == 21
    (tmp_path / "c.json").write_text(json.dumps({"kk": 21}))
    with pytest.raises(ValueError):
        config("classify_new_reads", str(tmp_path / "c.json"))


def test_command_lines(spark, sf, tmp_path, monkeypatch, caplog):
    """The session is the tests' own, which must not be stopped."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    with caplog.at_level("INFO", "readmill.jobs"):
        for job in (N, T):
            job.main(["--tables", sf, "--out", str(tmp_path / job.NAME)])
            assert job.output(spark, str(tmp_path / job.NAME)).where(F.col("part").isNotNull()).count() > 0
    assert "read 200 reads" in caplog.text and "wrote index" in caplog.text and "rows of metrics" in caplog.text


def test_means_half_way_dont_depend_on_the_order(spark):
    values = [0.098419, 0.511555, 0.029725, 0.936711]  # their mean is 0.3941025; summed as doubles it is below in some orders
    for order in (values, values[::-1], values[2:] + values[:2], [values[i] for i in (1, 3, 0, 2)]):
        wide = spark.createDataFrame([("t", str(i), *[x] * len(T.VALUES)) for i, x in enumerate(order)], "tool string, dataset string, " + ", ".join(f"{v} double" for v in T.VALUES)).coalesce(1)
        (row,) = T.summed(wide).collect()
        assert row.genus_f1_mean == 0.394103 and row.n_datasets == 4
