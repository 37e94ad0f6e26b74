import csv
import json
import re
import math

import pytest

from lexweave.cli import main
from lexweave.operators.agreement import agreement
from lexweave.operators.prompts import ReplyError, answer_prompts, answer_questions, ask, generate_questions, question_prompts, usable_replies
from lexweave.operators.sampling import stratified_sample
from lexweave.plans import schemas
from lexweave.sources import files
from lexweave.sources.config import ModelConfig, SourceConfig
from lexweave.sources.pages import fetch_pages, pause, robots_for

MODEL = ModelConfig("asked", 10, 2)
SITE = SourceConfig("n", "urls.txt", "agent", 2.0, 1.0, "")


def scored(spark, values):
    return spark.createDataFrame([(f"q{i}", float(v), v is not None) for i, v in enumerate(values)], "question_id string, score double, scorable boolean")


def test_sample(spark):
    values = [0.0] * 50 + [i / 100 for i in range(50)]
    rows = stratified_sample(scored(spark, values), "question_id", 10, 0).collect()
    assert len(rows) == 10 and {r["band"] for r in rows} == set(range(10)) and [r["score"] for r in rows] == sorted(r["score"] for r in rows)
    assert rows == stratified_sample(scored(spark, values), "question_id", 10, 0).collect()
    assert len(stratified_sample(scored(spark, [0.5] * 8), "question_id", 5, 1).collect()) == 5
    assert len(stratified_sample(scored(spark, [0.1, 0.9]), "question_id", 5, 1).collect()) == 2
    assert stratified_sample(scored(spark, [1.0]).limit(0), "question_id").count() == 0


def test_agreement(spark):
    rows = [("0.5", " Yes "), ("0.5", "no"), ("0.0", "N"), ("0.0", "1"), ("0.03", "true"), ("0.2", ""), ("0.2", None), ("0.1", "maybe")]
    a = agreement(spark.createDataFrame(rows, "score string, reproduces_source string"), 0.03).first()
    assert (a["tp"], a["fp"], a["tn"], a["fn"], a["labelled"], a["unlabelled"]) == (2, 1, 1, 1, 5, 3)
    assert a["accuracy"] == 0.6 and a["precision"] == pytest.approx(2 / 3) and a["kappa"] == pytest.approx((0.6 - 0.52) / 0.48)
    b = agreement(spark.createDataFrame([("0.0", "no")], "score string, reproduces_source string"), 0.03).first()
    assert all(math.isnan(b[k]) for k in ("precision", "recall", "kappa")) and b["accuracy"] == 1.0


def test_prompt_stages(spark):
    articles = spark.createDataFrame([(5, "u2", "t", "100% text {x}"), (3, "u1", "t", "first")], "ordinal long, url string, title string, text string")
    replies = ask(question_prompts(articles, MODEL), lambda s, u: ("1. one?\n2. two?\n3. three?", "served"), MODEL)
    asked = generate_questions(articles, replies, MODEL)
    got = {(r["id"], r["article_url"], r["question"], r["model_requested"], r["model_served"]) for r in asked.collect()}
    assert got == {("q000-0", "u1", "one?", "asked", "served"), ("q000-1", "u1", "two?", "asked", "served"), ("q001-0", "u2", "one?", "asked", "served"), ("q001-1", "u2", "two?", "asked", "served")}
    answers = answer_questions(asked, ask(answer_prompts(asked), lambda s, u: (" because " + u, ""), MODEL), MODEL)
    assert {r["answer"] for r in answers.collect()} == {"because one?", "because two?"} and answers.columns == schemas.ANSWER.fieldNames()
    with pytest.raises(ReplyError):
        generate_questions(articles, ask(question_prompts(articles, MODEL), lambda s, u: ("\n - \n", ""), MODEL), MODEL)
    with pytest.raises(ReplyError):
        answer_questions(asked, replies.limit(0), MODEL)


def test_failing_call_is_a_row(spark):
    prompts = spark.createDataFrame([("s", "good"), ("s", "bad")], "system_prompt string, user_prompt string")

    def call(system, user):
        if user == "bad":
            raise TimeoutError("too slow")
        return "fine", "served"

    rows = {r["user_prompt"]: r for r in usable_replies(ask(prompts, call, MODEL), MODEL).collect()}
    assert rows["good"]["error"] is None and rows["good"]["text"] == "fine"
    assert rows["bad"]["error"] == "the call failed: TimeoutError: too slow"


def test_reply_errors(spark):
    raw = spark.createDataFrame(
        [("a", 200, None, "STOP"), ("b", 429, None, "STOP"), ("c", 401, None, "STOP"), ("d", 200, "bad", "STOP"), ("e", 200, None, "SAFETY"), (" ", 200, None, "MAX_TOKENS"), (None, 200, None, None)],
        "text string, status int, block_reason string, finish_reason string",
    ).selectExpr("*", "'s' system_prompt", "'u' user_prompt", "cast(null as string) model_requested", "cast(null as string) model_served")
    rows = usable_replies(raw, MODEL).collect()
    assert [r["error"] for r in rows] == [None, "rate limited", "the key was rejected", "the prompt was blocked: bad", "the answer was filtered: SAFETY", "the model returned no text", "no candidate"]
    assert rows[0]["model_served"] == "asked"


def test_fetching(spark):
    urls = spark.createDataFrame([(i, f"https://h{i % 2}.org/p{i}") for i in range(4)] + [(9, "https://h0.org/private")], "ordinal long, url string")

    def get(url, agent, timeout):
        if url.endswith("robots.txt"):
            return (200, "User-agent: *\nDisallow: /private\nCrawl-delay: 5") if "h0" in url else (404, "")
        if url.endswith("p3"):
            raise OSError("no route")
        return (500, "") if url.endswith("p1") else (200, f"<p>page {url}</p>")

    rows = {r["ordinal"]: r for r in fetch_pages(urls, SITE, get, clock=lambda: 0.0, sleep=lambda s: None).collect()}
    assert rows[0]["html"].startswith("<p>") and rows[1]["error"] == "returned HTTP 500" and "no route" in rows[3]["error"] and "robots" in rows[9]["error"]
    assert pause(2.0, None) == 2.0 and pause(2.0, 5) == 5.0 and robots_for(500, "User-agent: *\nDisallow: /").can_fetch("a", "https://x/y")


def test_read_through(spark):
    urls = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "ordinal long, url string")
    cached = spark.createDataFrame([("a", "T", "text", "h", "t")], "url string, title string, text string, text_sha256 string, fetched_at string")
    pages = spark.createDataFrame([("b", "<article><p>prose</p></article>"), ("c", "<nav>x</nav>")], "url string, html string")
    good, bad = files.read_through(urls, cached, pages, SITE)
    assert {(r["ordinal"], r["text"]) for r in good.collect()} == {(0, "text"), (1, "prose")}
    assert {(r["url"], r["error"]) for r in bad.collect()} == {("c", "page has no extractable prose"), ("d", "could not fetch")}


def test_command_line(spark, tmp_path, capsys):
    conf, cache, out = tmp_path / "conf", tmp_path / "cache", tmp_path / "out"
    conf.mkdir()
    from lexweave.sources.config import CONFIG_DIR

    for name in ("scoring.yaml", "source.yaml", "model.yaml", "stopwords.txt"):
        (conf / name).write_text((CONFIG_DIR / name).read_text())
    (conf / "urls.txt").write_text("u1\nu2\n")
    base = ["--config-dir", str(conf), "--cache-dir", str(cache), "--results-dir", str(out)]
    assert main(["report", *base]) == 1 and "error: no articles" in capsys.readouterr().err
    spark.createDataFrame([("u1", "<article><h1>Gulls</h1><p>grey gulls circle above seven torn nets today</p></article>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    assert main(["fetch", *base, "--pages", str(tmp_path / "pages")]) == 0 and "warning: u2" in capsys.readouterr().err
    assert main(["report", *base]) == 1 and "no answers found" in capsys.readouterr().err
    out.mkdir()
    row = dict.fromkeys(schemas.ANSWER.fieldNames(), "x") | {"question_id": "q1", "article_url": "u1", "answer": 'grey gulls circle above seven torn "nets",\ntoday'}
    (out / "answers.json").write_text(json.dumps([row]))
    assert main(["report", *base]) == 0 and "1 result(s)" in capsys.readouterr().out
    result = json.loads((out / "results.json").read_text())[0]
    assert result["score"] == 1.0 and list(result) == schemas.RESULT.fieldNames()
    assert main(["sample", *base]) == 0
    rows = list(csv.DictReader((out / "labelled_set.csv").open(newline="")))
    assert rows[0]["answer"] == row["answer"] and rows[0]["reproduces_source"] == ""
    assert main(["agreement", *base]) == 1 and "no label" in capsys.readouterr().err
    text = (out / "labelled_set.csv").read_text().rstrip("\n")
    (out / "labelled_set.csv").write_text(text + "yes\n")
    assert main(["agreement", *base]) == 0 and re.search(r"accuracy\.+1\.000", capsys.readouterr().out)
    (out / "answers.json").write_text(json.dumps([{"answer": "x"}]))
    assert main(["report", *base]) == 1 and "lack" in capsys.readouterr().err


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['lexweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=100)
    from lexweave.plans.queries import queries

    assert said.stdout.split() == [str(len(queries())), "True"], said.stderr


def test_files_in_odd_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\n"), (0, "a")], "ordinal long, text string")
    for to in (tmp_path / "with space % é" / "r.json", f"file://{tmp_path}/plain/r.json"):
        assert files.write_records(rows, str(to), order="ordinal") == 2
        assert json.loads(open(str(to).removeprefix("file://"), encoding="utf-8").read()) == [{"text": "a"}, {"text": "é\n"}]
