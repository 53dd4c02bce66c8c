import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm.classifier import CUT, isotonic, quality_scores
from ledgerlark.llm.rules import Condition, Rule, decision, quality_rules
from tests.llm.helpers import ODD, documents, labels, words


def corpus(n=400, seed=3):
    """Prose, and junk that a learned rule can tell by its symbols."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(rng.choice(vocabulary) + ("$$" if bad and k % 3 == 0 else "") for k in range(rng.randrange(60, 120)))
        rows.append((100 + i, text))
        marks.append((100 + i, 0 if bad else 1, 0))
    return rows, marks


@pytest.fixture(scope="module")
def judged(spark):
    rows, marks = corpus()
    marks += [(5000, None, 0), (None, 1, 0), (3, 1, 0), (9999, 0, 0)]
    found, rules = quality_rules(documents(spark, rows + ODD), labels(spark, marks))
    return found.collect(), rules


def test_rules_find_junk_and_leave_prose_alone(judged):
    found, rules = judged
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert rules and len(found) == 400 + len(ODD)
    prose = [by_id[i] for i in range(100, 500) if i % 5]
    junk = [by_id[i] for i in range(100, 500) if i % 5 == 0]
    assert all(r["kept"] for r in prose if not r["base_failed"])
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)


def test_base_rule_of_odd_texts(judged):
    found, _ = judged
    texts = dict(t for t in ODD if t[0] == 6 or t[0] == 12)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] == 6:
            assert (r["n_words"], r["n_repeat_words"]) == (len(words(texts[6])),) * 2
    assert sum(r["doc_id"] == 7 for r in found) >= 2


def test_decision_list_takes_the_first_rule(spark):
    rules = [Rule((Condition("x", True, 0.5), Condition("y", False, 1.0))), Rule((Condition("x", True, 0.2),))]
    rows = spark.createDataFrame([(0.6, 0.0), (0.6, 2.0), (0.1, 0.0)], "x double, y double")
    assert [r[0] for r in rows.select(decision(rules)).collect()] == ["x >= 0.5 and y < 1", "x >= 0.2", None]
    assert rows.select(decision([])).first()[0] is None


@pytest.mark.parametrize("marks", [[], [(1, None, None)], [(i, 1, 0) for i in range(5)]])
def test_without_lessons_nothing_is_rejected_but_by_the_base_rule(spark, marks):
    docs = documents(spark, ODD)
    found, rules = quality_rules(docs, labels(spark, marks))
    assert not rules and all(r["kept"] != r["base_failed"] for r in found.collect())
    scores = quality_scores(docs, labels(spark, marks)).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)


def test_empty_tables(spark):
    docs, none = documents(spark, []), labels(spark, [])
    assert quality_rules(docs, none)[0].count() == 0 and quality_scores(docs, none).count() == 0


def test_scores_separate_unseen_labels(spark):
    rows, marks = corpus(600, 8)
    found = quality_scores(documents(spark, rows + ODD), labels(spark, marks)).collect()
    assert len(found) == 600 + len(ODD)
    label = {i: q for i, q, _ in marks}
    held = [r for r in found if r["doc_id"] is not None and r["held_out"] and r["doc_id"] in label]
    for r in found:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= CUT)
    own = [r for r in held if r["doc_id"] >= 100]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in own) >= 0.95 * len(own)


def test_scores_of_the_test_table_on_held_out_labels(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, marks).join(marks, "doc_id").where("held_out")
    right, total = scored.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right >= 0.9 * total


def test_isotonic_is_the_best_rising_fit():
    steps = [(0.1, 1, 4), (0.2, 0, 4), (0.3, 3, 4), (0.4, 2, 4), (0.5, 4, 4)]
    found = isotonic(steps)
    assert [round(x, 3) for x in found.shares] == [0.125, 0.625, 1.0]
    assert list(found.of([-1.0, 9.0])) == [0.125, 1.0]
