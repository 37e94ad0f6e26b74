"""Record types as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _record(text: str, long: str = "", double: str = "", boolean: str = "") -> T.StructType:
    kinds = {**dict.fromkeys(long.split(), T.LongType()), **dict.fromkeys(double.split(), T.DoubleType()), **dict.fromkeys(boolean.split(), T.BooleanType())}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType()), False) for n in text.split()])


ARTICLE = _record("url title text text_sha256 fetched_at")
QUESTION = _record("id article_url question system_prompt user_prompt model_requested model_served created_at")
ANSWER = _record("question_id article_url question answer system_prompt user_prompt model_requested model_served created_at")
REPLY = _record("system_prompt user_prompt text model_requested model_served")
RESULT = _record(
    "question_id article_url article_title article_sha256 question answer score matched_ngrams total_ngrams scorable"
    " scoring_version model_requested model_served answer_system_prompt answer_user_prompt answered_at scored_at",
    long="matched_ngrams total_ngrams", double="score", boolean="scorable",
)
LABELLED = _record("question_id source_url source_title question answer score reproduces_source")
