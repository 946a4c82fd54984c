"""Model calls, counted by the lines that the model writes to a file of its own."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.operators.answers import Ledger
from newsloom.session import scratch_path


def counting(folder, fail_on=None, die_on=None):
    """A model that notes every text it is given."""
    os.makedirs(folder, exist_ok=True)

    def model(texts):
        with open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        if die_on in texts and not os.path.exists(f"{folder}.died"):
            open(f"{folder}.died", "w").close()
            os._exit(1)  # the worker is lost, with its task
        if fail_on in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    return model


def calls(folder):
    return sorted(line.strip() for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


@pytest.fixture
def ledger(spark):
    return Ledger(spark, scratch_path(spark, "ledger"), "upper-1")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def answers(df):
    return [r["answer"] for r in df.orderBy("id").collect()]


def test_equal_inputs_are_one_question(spark, ledger, tmp_path):
    seen = str(tmp_path / "calls")
    df = table(spark, ["a", "b", "a", None, "", "a"])
    found = ledger.answered(df, "text", counting(seen), "answer")
    assert answers(found) == ["A", "B", "A", None, "", "A"]
    assert calls(seen) == ["", "a", "b"]


def test_a_repeated_run_asks_only_what_is_new(spark, ledger, tmp_path):
    seen = str(tmp_path / "calls")
    ledger.answered(table(spark, ["a", "b"]), "text", counting(seen), "answer")
    found = ledger.answered(table(spark, ["b", "c", "a"]), "text", counting(seen), "answer")
    assert answers(found) == ["B", "C", "A"] and calls(seen) == ["a", "b", "c"]
    assert answers(ledger.answered(table(spark, ["a", "z"]), "text", None, "answer")) == ["A", None]
    other = Ledger(spark, ledger.folder, "upper-2")  # another model's results are its own
    assert answers(other.answered(table(spark, ["a"]), "text", None, "answer")) == [None]


def test_failures_spoil_no_other_and_are_asked_again(spark, ledger, tmp_path):
    seen = str(tmp_path / "calls")
    df = table(spark, ["a", "bad", "c"])
    assert answers(ledger.answered(df, "text", counting(seen, fail_on="bad"), "answer")) == ["A", None, "C"]
    assert answers(ledger.answered(df, "text", counting(seen), "answer")) == ["A", "BAD", "C"]


def test_a_lost_task_asks_only_what_it_had_not_finished(spark, ledger, tmp_path):
    """The worker dies in the middle; what was dealt before it is on disk. A local session does not retry, a cluster does."""
    seen = str(tmp_path / "calls")
    df = table(spark, [f"t{i:02d}" for i in range(40)])
    model = counting(seen, die_on="t25")
    with pytest.raises(Exception):  # noqa: B017 - the job is lost with its only attempt
        ledger.ask(df, "text", model, batch_size=4)
    before = len(calls(seen))
    found = ledger.answered(df, "text", model, "answer", batch_size=4)
    assert answers(found) == [f"T{i:02d}" for i in range(40)]
    assert len(calls(seen)) <= 40 + 4 and len(calls(seen)) - before < 40  # the batch under way is asked twice


def test_vectors(spark, tmp_path):
    ledger = Ledger(spark, scratch_path(spark, "ledger"), "lengths", "array<float>")
    df = table(spark, ["aa", "b", None])
    found = ledger.answered(df, "text", lambda texts: [[float(len(t)), 1.0] for t in texts], "answer")
    assert answers(found) == [[2.0, 1.0], [1.0, 1.0], None]
    assert ledger.results().where(F.col("result").isNull()).count() == 0
