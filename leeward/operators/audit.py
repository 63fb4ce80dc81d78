"""Requests and answers: alias resolution, refusals, audits of numbers and limits, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leeward.functions.text import fold, numbers_in

# The sentence every contamination answer must carry, in both languages.
LIMITATIONS = ("comparative tool, not a crisis forecast", "narzędzie porównawcze, nie prognoza kryzysowa")

# Cue words by intent, English and Polish.
NUMBER_CUES = ("how likely", "probability", "percent", "which cities", "how many", "contaminate", "jak szybko",
               "jakie prawdopodobieństwo", "które miasta", "skazi", "ile")
METHOD_CUES = ("what does", "what is", "why", "how is", "explain", "method", "class", "threshold mean",
               "co oznacza", "dlaczego", "jak liczy", "wyjaśnij", "metoda", "klasa")


def city_aliases(cities: DataFrame, name: str = "city_name", aliases: str | None = None) -> DataFrame:
    """(alias_key, city_id): folded names and aliases; a key that several cities share has no id."""
    names = F.array(F.col(name))
    if aliases:
        names = F.concat(names, F.coalesce(F.split(F.col(aliases), ","), F.array().cast("array<string>")))
    keys = cities.select("city_id", F.explode(names).alias("alias")).select("city_id", fold(F.col("alias")).alias("alias_key"))
    shared = keys.filter(F.col("alias_key") != "").groupBy("alias_key").agg(
        F.min("city_id").alias("low"), F.max("city_id").alias("high"))
    return shared.select("alias_key", F.when(F.col("low") == F.col("high"), F.col("low")).alias("city_id"))


def resolve_alias(requests: DataFrame, aliases: DataFrame, column: str = "city_alias") -> DataFrame:
    """Requests with the ``city_id`` their spelling stands for, and ``alias_status``: found, ambiguous or unknown."""
    known = aliases.withColumn("__known", F.lit(True))
    out = requests.withColumn("alias_key", fold(F.col(column))).join(known, "alias_key", "left")
    status = F.when(F.col("city_id").isNotNull(), "found").when(F.col("__known"), "ambiguous").otherwise("unknown")
    return out.withColumn("alias_status", status).drop("alias_key", "__known")


def not_modelled(requests: DataFrame, gold: DataFrame, keys=("site_no", "city_id")) -> DataFrame:
    """Requests about something the gold table does not hold."""
    return requests.join(gold.select(*keys).distinct(), list(keys), "left_anti")


def answerable(requests: DataFrame, gold: DataFrame, keys=("site_no", "city_id")) -> DataFrame:
    """``answer_status``: modelled, or not_modelled, which must be said instead of guessed."""
    known = gold.select(*keys).distinct().withColumn("__known", F.lit(True))
    return requests.join(known, list(keys), "left").withColumn(
        "answer_status", F.when(F.col("__known"), "modelled").otherwise("not_modelled")).drop("__known")


def unsupported_numbers(answers: DataFrame, results: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """(key, number) for numbers in an answer that its query result does not hold.

    Numbers are rows on both sides, so a result of any size is never gathered for one answer.
    """
    said = answers.select(key, F.explode(numbers_in(F.col(text))).alias("number")).distinct()
    return said.join(results.select(key, F.col("value").alias("number")), [key, "number"], "left_anti")


def audited(answers: DataFrame, results: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """Answers with the count of unsupported numbers; any makes the answer ``rejected``."""
    wrong = unsupported_numbers(answers, results, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("n_unsupported"))
    return (answers.join(wrong, key, "left").withColumn("n_unsupported", F.coalesce("n_unsupported", F.lit(0)))
            .withColumn("verdict", F.when(F.col("n_unsupported") > 0, "rejected").otherwise("accepted")))


def has_limitation(text: Column) -> Column:
    out = F.lit(False)
    for sentence in LIMITATIONS:
        out = out | F.contains(F.lower(text), F.lit(sentence))
    return out


def missing_limitation(answers: DataFrame, text: str = "answer") -> DataFrame:
    return answers.filter(~F.coalesce(has_limitation(F.col(text)), F.lit(False)))


def intent(questions: DataFrame, text: str = "question") -> DataFrame:
    """``intent`` in numbers, method, mixed, other from cue words."""
    def score(cues) -> Column:
        total = F.lit(0)
        for cue in cues:
            total = total + F.contains(F.lower(F.col(text)), F.lit(cue)).cast("int")
        return total
    df = questions.withColumn("number_score", score(NUMBER_CUES)).withColumn("method_score", score(METHOD_CUES))
    return df.withColumn("intent", F.when((F.col("number_score") > 0) & (F.col("method_score") > 0), "mixed")
                         .when(F.col("number_score") > 0, "numbers").when(F.col("method_score") > 0, "method")
                         .otherwise("other"))


def eval_join(expected: DataFrame, produced: DataFrame, key: str = "question_id", tolerance: float = 1e-6) -> DataFrame:
    """Expected and produced answers side by side. A refusal is right only where one is expected."""
    out = expected.join(produced, key, "left")
    both_refuse = F.col("expects_refusal") & F.coalesce("refused", F.lit(False))
    close = F.abs(F.col("value") - F.col("expected_value")) <= tolerance
    right = ~F.col("expects_refusal") & ~F.coalesce("refused", F.lit(True)) & F.coalesce(close, F.lit(False))
    return out.withColumn("is_right", both_refuse | right)


def execution_accuracy(joined: DataFrame, by: list[str]) -> DataFrame:
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_questions"), F.count_if("is_right").alias("n_right"),
        F.avg(F.col("is_right").cast("double")).alias("accuracy"))
