import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import catalog, classifier, minhash, rules, stages
from ledgerlark.llm.decontamination import find_passages
from ledgerlark.llm.tables import text_key
from tests.llm.helpers import ODD, SMALL, documents
from tests.llm.test_packing import check

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, marks, bench = docs.columns, spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    wanted = {
        "quality_rules": lambda d: {r[0] for r in rules.quality_rules(d, marks)[0].where("kept").select("doc_id").collect()},
        "quality_classifier": lambda d: {r[0] for r in classifier.quality_scores(d, marks).where("predicted = 1").select("doc_id").collect()},
        "minhash_near_dedup": lambda d: {r[0] for r in minhash.near_duplicates(d).where("kept").select("doc_id").collect()},
        "benchmark_decontamination": lambda d: {r[0] for r in d.select("doc_id").collect()} - {r[0] for r in find_passages(d, bench).select("doc_id").collect()},
    }
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == [*wanted, "best_fit_packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        keep = wanted[name](docs)
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} == keep
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check(packed, texts)
    whole = corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_rows_are_judged_and_not_ids(spark):
    good, other = (spark.read.parquet(f"{SMALL}/documents.parquet").where(F.length("text") > 900).select("text").limit(2).collect())
    bad = "bad " * 200
    rows = [(1, good[0]), (1, bad), (None, bad), (None, other[0]), (None, None), (2, good[0]), (2, good[0]), (2, good[0])]
    by_rules = stages.keep_by_rules(spark, documents(spark, rows), SMALL)
    left = sorted(((r["doc_id"], r["text"]) for r in by_rules.collect()), key=str)
    assert left and not {t for _, t in left} & {bad, None} and by_rules.columns == documents(spark, rows).columns
    by_score = stages.keep_by_score(spark, documents(spark, rows), SMALL)
    scores = {(r["doc_id"], r["text_key"]): r["predicted"] for r in classifier.quality_scores(documents(spark, rows), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    keyed = [(r["doc_id"], r["text"], r["k"]) for r in documents(spark, rows).withColumn("k", text_key(F.col("text"))).collect()]
    wanted = sorted(((i, t) for i, t, k in keyed if scores[i, k] == 1), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in by_score.collect()), key=str) == wanted
    repeated = [(5, good[0]), (5, good[0]), (5, good[0]), (6, good[0]), (7, other[0]), (None, "a b"), (None, "a b"), (None, "c d"), (None, None), (None, None)]
    one = stages.keep_one_of_each_group(spark, documents(spark, repeated), SMALL)
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == sorted([(5, good[0]), (7, other[0]), (None, "a b"), (None, "c d"), (None, None)], key=str)


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_stages_stand_odd_documents(spark, rows):
    for name, stage in corpus_pipeline.STAGES:
        docs = documents(spark, rows)
        found = stage(spark, docs, SMALL)
        if name != "best_fit_packing":
            assert found.columns == docs.columns
        assert found.count() <= max(len(rows) * 40, 0)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    wanted = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = catalog.QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(map(str, (tuple(r) for r in found.select(*columns).collect())))
    assert rows == sorted(map(str, wanted.fetchall()))


def test_library_works_without_the_text_operators():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "ledgerlark.llm" or name.startswith("ledgerlark.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
print(len(e.queries()), sorted(n for n in e.queries() if n.startswith("op") or n == "pipeline"))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.strip().endswith("[]"), done.stderr
