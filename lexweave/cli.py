"""Command line: fetch, questions, answer, report, sample, agreement.

    python -m lexweave report --results-dir results

Each stage reads what the one before it stored. An expected failure is one line and exit 1.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave.operators import agreement as agree
from lexweave.operators.overlap import score_answers
from lexweave.operators.prompts import ReplyError, answer_questions, generate_questions
from lexweave.operators.report import format_summary
from lexweave.operators.sampling import labelled_set, stratified_sample
from lexweave.plans import schemas
from lexweave.sources import files
from lexweave.sources.config import CONFIG_DIR, ConfigError, ModelConfig, ScoringConfig, SourceConfig, read_url_list
from lexweave.sources.pages import fetch_pages

EXPECTED = (ConfigError, files.RecordError, files.FetchError, ReplyError, agree.NoLabels)


def _session() -> SparkSession:
    return SparkSession.builder.appName("lexweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _source(args):
    config = SourceConfig.load(args.config_dir / "source.yaml")
    path = args.config_dir / config.url_list
    read_url_list(path)
    return config, path


def fetch(args) -> int:
    spark = _session()
    config, path = _source(args)
    urls = files.url_table(spark, str(path))
    folder = str(args.cache_dir / "articles")
    try:
        cached = files.read_cache(spark, folder, urls).drop("ordinal").distinct()
    except files.FetchError:
        cached = spark.createDataFrame([], schemas.ARTICLE)
    _, misses = files.split_cached(urls, cached)
    pages = spark.read.parquet(args.pages) if args.pages else fetch_pages(misses, config).cache()
    articles, failures = files.read_through(urls, cached, pages, config)
    files.write_cache(articles.dropDuplicates(["url"]), folder)
    for row in failures.toLocalIterator():
        print(f"warning: {row['url']}: {row['error']}", file=sys.stderr)
    n = articles.count()
    print(f"{n} article(s) available in {folder}")
    if not n:
        print("error: no article could be fetched", file=sys.stderr)
    return 0 if n else 1


def _replies(spark, args):
    return files.read_records(spark, str(args.results_dir / "replies.json"), "replies", schemas.REPLY).drop("ordinal")


def questions(args) -> int:
    spark = _session()
    _, path = _source(args)
    model = ModelConfig.load(args.config_dir / "model.yaml")
    articles = files.read_cache(spark, str(args.cache_dir / "articles"), files.url_table(spark, str(path)))
    out = args.results_dir / "questions.json"
    n = files.write_records(generate_questions(articles, _replies(spark, args), model).orderBy("id"), str(out))
    print(f"{n} question(s) written to {out}")
    return 0


def answer(args) -> int:
    spark = _session()
    model = ModelConfig.load(args.config_dir / "model.yaml")
    asked = files.read_records(spark, str(args.results_dir / "questions.json"), "questions", schemas.QUESTION)
    out = args.results_dir / "answers.json"
    n = files.write_records(answer_questions(asked.drop("ordinal"), _replies(spark, args), model).orderBy("question_id"), str(out))
    print(f"{n} answer(s) written to {out}")
    return 0


def report(args) -> int:
    spark = _session()
    _, path = _source(args)
    rule = ScoringConfig.load(args.config_dir / "scoring.yaml")
    articles = files.read_cache(spark, str(args.cache_dir / "articles"), files.url_table(spark, str(path)))
    answers = files.read_records(spark, str(args.results_dir / "answers.json"), "answers", schemas.ANSWER)
    results = score_answers(answers, articles, rule).cache()
    out = args.results_dir / "results.json"
    n = files.write_records(results, str(out), order="ordinal")
    print(format_summary(results, rule))
    print(f"\n{n} result(s) written to {out}")
    return 0


def sample(args) -> int:
    spark = _session()
    results = files.read_records(spark, str(args.results or args.results_dir / "results.json"), "results", schemas.RESULT)
    if results.where("scorable").isEmpty():
        raise files.RecordError("no scorable result to sample")
    out = args.out or args.results_dir / "labelled_set.csv"
    n = files.write_csv(labelled_set(stratified_sample(results, "question_id", args.rows, args.seed)), str(out))
    print(f"{n} row(s) written to {out}; fill reproduces_source with yes or no")
    return 0


def agreement(args) -> int:
    rule = ScoringConfig.load(args.scoring or args.config_dir / "scoring.yaml")
    rows = files.read_csv(_session(), str(args.labels or args.results_dir / "labelled_set.csv"))
    print(agree.format_agreement(rows.withColumn("score", F.col("score").cast("double")), rule))
    return 0


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config-dir", type=Path, default=CONFIG_DIR)
    common.add_argument("--cache-dir", type=Path, default=Path("cache"))
    common.add_argument("--results-dir", type=Path, default=Path("results"))
    top = argparse.ArgumentParser(prog="python -m lexweave", description="Measure how much of a source's wording answers repeat.")
    stages = top.add_subparsers(dest="stage", required=True)
    for run, about in ((fetch, "take pages and extract articles"), (questions, "questions from articles"), (answer, "answers to questions"), (report, "score answers and print a table"), (sample, "rows to label by hand"), (agreement, "threshold against labels")):
        stage = stages.add_parser(run.__name__, help=about, parents=[common])
        stage.set_defaults(run=run)
        if run is fetch:
            stage.add_argument("--pages", help="a Parquet table (url, html) instead of HTTP")
        if run is sample:
            stage.add_argument("--out", type=Path)
            stage.add_argument("--results", type=Path, help="scored results from elsewhere")
            stage.add_argument("--rows", type=int, default=20)
            stage.add_argument("--seed", type=int, default=0)
        if run is agreement:
            stage.add_argument("--labels", type=Path)
            stage.add_argument("--scoring", type=Path, help="a scoring rule from elsewhere")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except EXPECTED as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
