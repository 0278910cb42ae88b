"""Answer maps against the questions of their exam, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.semantics import unicode_trim
from quillon.operators.relational import ordinal


def last_entries(text: Column) -> Column:
    """Entries (key, value) of a JSON map of texts; of equal keys the last one. Null where the text is no map."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    latest_first = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("at"), e["value"].alias("value"))))
    heads = F.transform(latest_first, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), ((i == 0) | (F.get(latest_first, i - 1)["key"] != e["key"])).alias("head")))
    return F.transform(F.filter(heads, lambda e: e["head"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def given_answers(attempts: DataFrame, answers: str = "answers_json") -> DataFrame:
    """The attempts' other columns with ``idx`` and ``given``, a row for each usable answer.

    Null, empty, malformed texts and other shapes than a map give no rows. An entry whose key isn't a
    number from 0, or whose value is null, is left out; the others of its attempt stay.
    """
    kept = [c for c in attempts.columns if c != answers]
    rows = attempts.select(*kept, F.explode(last_entries(F.col(answers))).alias("__e"))
    rows = rows.select(*kept, F.expr("try_cast(trim(__e.key) AS int)").alias("idx"), F.col("__e.value").alias("given"))
    return rows.where("idx >= 0 AND given IS NOT NULL")


def differs(given: Column, correct: Column) -> Column:
    """Answers are compared without white space around them and without case."""
    return F.upper(unicode_trim(given)) != F.upper(unicode_trim(correct))


def positioned(questions: DataFrame, exam: str = "exam_id", key: str = "id") -> DataFrame:
    """Questions with ``idx``, their place in their exam by id."""
    return questions.withColumn("idx", ordinal([exam], [key]).cast("int"))


def wrong(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers of attempts(exam_id, answers_json, ...) that differ from questions(id, exam_id, correct_answer, subject, ...).

    An index behind the exam's last question meets none.
    """
    answers = given_answers(attempts)
    return answers.join(positioned(questions), ["exam_id", "idx"]).where(differs(F.col("given"), F.col("correct_answer")))
