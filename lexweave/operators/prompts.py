"""Questions from articles and answers to questions, with model replies as a table.

A reply row answers a pair of prompts. ``ask`` makes such rows from a callable of the user's;
none is built in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexweave.functions.text import parse_questions, utc_seconds
from lexweave.operators.ranges import numbered
from lexweave.plans.schemas import REPLY
from lexweave.sources.config import ModelConfig

QUESTION_SYSTEM = "Write questions that people could ask a search engine. Give the questions alone, each on a line of its own."
QUESTION_HEAD = "Write {count} questions to which the article below has the answer. Use everyday words and don't mention the article.\n\nARTICLE:\n"
ANSWER_SYSTEM = "Answer questions of the general public from what you know, briefly and directly. Don't ask back and don't send people to a website."

#: Finish reasons that leave an answer usable.
GOOD_FINISH = ["STOP", "MAX_TOKENS"]


class ReplyError(Exception):
    """A model reply is missing or unusable; nothing of the stage is written."""


def question_prompts(articles: DataFrame, config: ModelConfig) -> DataFrame:
    """``articles`` with ``article_index``, system_prompt and user_prompt; needs ``ordinal``."""
    head = QUESTION_HEAD.replace("{count}", str(config.questions_per_article))
    return numbered(articles, "ordinal", "article_index").withColumns(
        {"system_prompt": F.lit(QUESTION_SYSTEM), "user_prompt": F.concat(F.lit(head), F.col("text"))}
    )


def answer_prompts(questions: DataFrame) -> DataFrame:
    """``questions`` with the prompts of the answering stage: the question and nothing else."""
    return questions.withColumns({"system_prompt": F.lit(ANSWER_SYSTEM), "user_prompt": F.col("question")})


def usable_replies(raw: DataFrame, config: ModelConfig) -> DataFrame:
    """Replies with an ``error`` column: null where usable.

    ``raw`` may have status, block_reason, finish_reason and call_error; text is stripped, and the served
    model falls back to the requested one.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    error = F.lit(None).cast("string")
    if "finish_reason" in raw.columns:
        error = F.when(~F.coalesce("finish_reason", F.lit("STOP")).isin(GOOD_FINISH), F.concat(F.lit("the answer was filtered: "), "finish_reason")).otherwise(error)
    error = F.when(F.col("text").isNotNull() & (text == ""), "the model returned no text").otherwise(error)
    error = F.when(F.col("text").isNull(), "no candidate").otherwise(error)
    if "block_reason" in raw.columns:
        error = F.when(F.col("block_reason").isNotNull(), F.concat(F.lit("the prompt was blocked: "), "block_reason")).otherwise(error)
    if "status" in raw.columns:
        code = F.col("status")
        said = F.when(code == 429, "rate limited").when(code.isin(401, 403), "the key was rejected").otherwise(F.concat(F.lit("the service returned "), code.cast("string")))
        error = F.when(code != 200, said).otherwise(error)
    if "call_error" in raw.columns:
        error = F.coalesce("call_error", error)
    return raw.withColumns(
        {"error": error, "text": text, "model_served": F.coalesce("model_served", "model_requested", F.lit(config.model)), "model_requested": F.coalesce("model_requested", F.lit(config.model))}
    )


def ask(prompts: DataFrame, call: Callable[[str, str], tuple[str, str]], config: ModelConfig) -> DataFrame:
    """Reply rows for distinct prompts: ``call(system, user)`` returns text and served model id.

    A call that raises gives a row without text whose ``call_error`` says what was raised; the others go on.
    """
    model = config.model
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in REPLY.fields), StructField("call_error", StringType())])

    def reply(system, user):
        try:
            text, served = call(system, user)
        except Exception as error:
            return system, user, None, model, model, f"the call failed: {type(error).__name__}: {error}"
        return system, user, text, model, served or model, None

    def each(batches):
        import pandas as pd

        for batch in batches:
            rows = [reply(s, u) for s, u in zip(batch["system_prompt"], batch["user_prompt"])]
            yield pd.DataFrame(rows, columns=schema.fieldNames(), dtype=object)

    return prompts.select("system_prompt", "user_prompt").distinct().mapInPandas(each, schema)


def _replied(prompts: DataFrame, replies: DataFrame, config: ModelConfig, by: str | None = None) -> DataFrame:
    own = [F.col(by).alias("_by")] if by else []
    usable = usable_replies(replies, config).select(
        F.col("system_prompt").alias("_s"), F.col("user_prompt").alias("_u"), *own, F.col("text").alias("reply"), "model_requested", "model_served", "error"
    )
    same = (F.col("system_prompt") == F.col("_s")) & (F.col("user_prompt") == F.col("_u"))
    if by:
        same = same & F.col(by).eqNullSafe(F.col("_by"))
    return prompts.join(usable, same, "left").drop("_s", "_u", "_by")


def _refuse(replied: DataFrame, bad, what: str) -> None:
    first = replied.where(bad).select(F.coalesce("error", F.lit(what)).alias("e"), "user_prompt").first()
    if first:
        raise ReplyError(f"{first['e']}: {first['user_prompt'][:80]!r}")


def generate_questions(articles: DataFrame, replies: DataFrame, config: ModelConfig, by: str | None = None) -> DataFrame:
    """Question rows of every article, or :class:`ReplyError` if any reply is missing, unusable or without a question.

    ``by``: a column of both that says which article a reply is for, where articles of one text have replies of their own.
    """
    replied = _replied(question_prompts(articles, config), replies, config, by)
    found = replied.withColumn("_q", parse_questions(F.col("reply"), config.questions_per_article))
    _refuse(found, F.col("error").isNotNull() | F.col("reply").isNull() | (F.size("_q") <= 0), "no question in the reply")
    return found.select("*", F.posexplode("_q").alias("_pos", "question")).select(
        F.format_string("q%03d-%d", "article_index", "_pos").alias("id"), F.col("url").alias("article_url"), "question", "system_prompt", "user_prompt",
        "model_requested", "model_served", utc_seconds().alias("created_at"),
    )


def answer_questions(questions: DataFrame, replies: DataFrame, config: ModelConfig) -> DataFrame:
    """Answer rows of every question, or :class:`ReplyError` if any reply is missing or unusable."""
    prompts = answer_prompts(questions.drop("system_prompt", "user_prompt", "model_requested", "model_served"))
    replied = _replied(prompts, replies, config)
    _refuse(replied, F.col("error").isNotNull() | F.col("reply").isNull(), "no reply")
    return replied.select(
        F.col("id").alias("question_id"), "article_url", "question", F.col("reply").alias("answer"), "system_prompt", "user_prompt",
        "model_requested", "model_served", utc_seconds().alias("created_at"),
    )
