import dataclasses

import pytest

from lexweave.functions.text import clean_space, normalise_space, parse_questions, short_label, tokens
from lexweave.operators.overlap import score_answers, with_overlap
from lexweave.operators.report import format_summary, summarise
from lexweave.sources.config import ConfigError, ModelConfig, ScoringConfig, SourceConfig, read_url_list

RULE = ScoringConfig.load()
STORY = "Gulls circled above the old harbour while seven fishermen mended torn nets. Rain drifted across the stone pier before noon."


def words(spark, text, rule=RULE):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), rule)).first()[0]


def scores(spark, pairs, rule=RULE):
    rows = with_overlap(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, s string"), "a", "s", rule)
    return {r["i"]: (r["score"], r["matched_ngrams"], r["total_ngrams"], r["scorable"]) for r in rows.collect()}


def plain_score(answer, source, rule=RULE):
    import re
    import unicodedata

    def grams(text):
        text = unicodedata.normalize("NFC", text).replace("’", "'").casefold()
        w = [t for t in re.findall(r"[^\W_]+(?:'[^\W_]+)*", text) if t not in rule.stopwords]
        return [tuple(w[i : i + rule.ngram_size]) for i in range(len(w) - rule.ngram_size + 1)]

    a, s = grams(answer), set(grams(source))
    hit = sum(g in s for g in a)
    return (hit / len(a) if a else 0.0, hit, len(a), bool(a))


def test_rule_loads():
    assert (RULE.version, RULE.ngram_size, RULE.reuse_threshold, len(RULE.stopwords)) == ("v1", 4, 0.03, 146)
    assert SourceConfig.load().request_delay_seconds == 2.0 and ModelConfig.load().questions_per_article == 3


def test_config_errors(tmp_path):
    with pytest.raises(ConfigError, match="not found"):
        ScoringConfig.load(tmp_path / "none.yaml")
    (tmp_path / "s.yaml").write_text("version: v1\n")
    with pytest.raises(ConfigError, match="ngram_size"):
        ScoringConfig.load(tmp_path / "s.yaml")
    (tmp_path / "u.txt").write_text("# none\n\n")
    with pytest.raises(ConfigError):
        read_url_list(tmp_path / "u.txt")
    (tmp_path / "u.txt").write_text("b\n# c\n a \nb\n")
    assert read_url_list(tmp_path / "u.txt") == ["b", "a", "b"]


def test_tokens(spark):
    assert words(spark, "The cat's paw, and DON’T you_know!") == ["cat's", "paw", "know"]
    assert words(spark, "Straße") == words(spark, "STRASSE") == ["strasse"]
    assert words(spark, "Käse") == words(spark, "Käse") == ["käse"]
    assert words(spark, "ΟΔΟΣ ﬁnd µm") == ["οδοσ", "find", "μm"]
    assert words(spark, None) == [] and words(spark, "") == []
    assert words(spark, "Käse", dataclasses.replace(RULE, strip_diacritics=True)) == ["kase"]


def test_scores_match_plain_python(spark):
    twice = STORY + " " + STORY
    pairs = [(STORY, STORY), ("Completely different words about distant mountain railways here", STORY), ("", STORY), ("three short words", STORY), (twice, STORY),
             (STORY, twice), ("x " * 40 + STORY, STORY), ("a b c d e f g h a b c d zz a b c d", "a b c d"), (STORY, "the and of"), (STORY[:60], STORY)]
    got = scores(spark, pairs)
    for i, p in enumerate(pairs):
        assert got[i] == pytest.approx(plain_score(*p)), p
    assert got[0][0] == 1.0 and got[2] == (0.0, 0, 0, False) and got[4][2] == 2 * got[0][2] + RULE.ngram_size - 1


def test_null_texts(spark):
    assert scores(spark, [(None, STORY), (STORY, None)]) == {0: (0.0, 0, 0, False), 1: (0.0, 0, plain_score(STORY, "")[2], True)}


@pytest.fixture(scope="module")
def results(spark):
    articles = spark.createDataFrame([(0, "u1", "First", "old text", "h0"), (1, "u2", "", STORY, "h1"), (2, "u1", "Last", STORY, "h2")], "ordinal long, url string, title string, text string, text_sha256 string")
    rows = [(0, "q0", "u2", STORY), (1, "q1", "gone", STORY), (2, "q2", "u1", STORY), (3, "q3", "u1", "too short")]
    answers = spark.createDataFrame([(o, q, u, "?", a, "s", "p", "m", "m2", "t") for o, q, u, a in rows], "ordinal long, question_id string, article_url string, question string, answer string, system_prompt string, user_prompt string, model_requested string, model_served string, created_at string")
    return score_answers(answers, articles, RULE).cache()


def test_join_last_wins_and_drops_unknown(results):
    got = {r["question_id"]: r for r in results.collect()}
    assert set(got) == {"q0", "q2", "q3"} and got["q2"]["article_sha256"] == "h2" and got["q2"]["score"] == 1.0 and not got["q3"]["scorable"]
    assert len(results.columns) == 18


def test_summary(results):
    rows = summarise(results, RULE).orderBy("is_total", "first_ordinal").collect()
    assert [(r["label"], r["n"], r["scored"], r["mean_score"], r["over"], r["unscorable"]) for r in rows] == [("u2", 1, 1, 1.0, 1, 0), ("Last", 2, 1, 1.0, 1, 1), ("ALL", 3, 2, 1.0, 2, 1)]
    text = format_summary(results, RULE)
    total = lambda text: next(x for x in text.splitlines() if x.startswith("ALL")).split()
    assert total(text) == ["ALL", "3", "2", "1.000", "1.000", "2"] and f"fewer than {RULE.ngram_size} content words: 1." in text
    only = format_summary(results.where("not scorable"), RULE)
    assert total(only) == ["ALL", "1", "0", "-", "-", "-"]
    assert format_summary(results.limit(0), RULE) == "No results to report."


SPACES = [("  a   b ", "a b"), ("a\n\n  b\t c", "a\n\nb c"), ("x y​z", "x yz"), ("", ""), ("ü", "ü"), (" a  b\x1c", "a b"), (" \n a \n ", "a")]


@pytest.mark.parametrize("raw,want", SPACES)
def test_space(spark, raw, want):
    from pyspark.sql import functions as F

    assert clean_space(raw) == want
    assert spark.createDataFrame([(raw,)], "t string").select(normalise_space(F.col("t"))).first()[0] == want


def test_questions_and_labels(spark):
    from pyspark.sql import functions as F

    reply = "1. What is it?\n\n - Who came?   • Why?\r\n2) When?\x1eWhere?"
    assert spark.createDataFrame([(reply,)], "t string").select(parse_questions(F.col("t"), 4)).first()[0] == ["What is it?", "Who came?", "Why?", "When?"]
    rows = spark.createDataFrame([("", "u" * 41), ("t" * 40, "u"), (None, "u")], "t string, u string").select(short_label(F.col("t"), F.col("u"))).collect()
    assert [r[0] for r in rows] == ["u" * 37 + "...", "t" * 40, "u"]


def test_half_even(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.bround(F.lit(1 / 128), 6)).first()[0] == 0.007812


def test_stream(spark, tmp_path):
    from lexweave.streaming.scoring import score_stream

    folder = str(tmp_path / "in")
    spark.createDataFrame([("q", "u", STORY), ("r", "none", STORY)], "question_id string, article_url string, answer string").write.json(folder)
    stream = spark.readStream.schema("question_id string, article_url string, answer string").json(folder)
    articles = spark.createDataFrame([(0, "u", STORY)], "ordinal long, url string, text string")
    query = score_stream(stream, articles, RULE).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["question_id"], r["score"]) for r in spark.table("scored").collect()] == [("q", 1.0)]


def test_mean_does_not_depend_on_the_split(spark):
    """Six-decimal scores whose sum as doubles depends on its order."""
    scores = [0.1, 0.2, 0.3, 0.000001, 0.7, 0.333333] * 50
    rows = [(i, f"u{i % 3}", "", x, True) for i, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "ordinal long, article_url string, article_title string, score double, scorable boolean")
    seen = {tuple(sorted((r["label"], r["mean_score"]) for r in summarise(df.repartition(n), RULE).collect())) for n in (1, 3, 7)}
    assert len(seen) == 1
    from fractions import Fraction

    exact = Fraction(sum(round(x * 1_000_000) for x in scores), 1_000_000 * len(scores))
    assert dict(next(iter(seen)))["ALL"] == float(exact)


def test_last_article_is_defined_for_ties(spark):
    from lexweave.operators.overlap import last_per_url

    rows = [("u", 1, "old"), ("u", 2, "a"), ("u", 2, "b"), ("u", 2, "b"), ("v", None, "no place"), (None, 1, "no url"), ("w", 0, "w")]
    df = spark.createDataFrame(rows, "url string, ordinal long, text string")
    seen = {tuple(sorted(map(tuple, last_per_url(df.repartition(n)).collect()))) for n in (1, 2, 5)}
    assert len(seen) == 1 and [r[0] for r in next(iter(seen))] == ["u", "w"] and next(iter(seen))[0][2] in "ab"


def test_long_texts_are_compared_in_parts(spark, monkeypatch):
    """Counts of long pairs are those of short ones, and come from several tasks."""
    import random

    from lexweave.operators import overlap as O

    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["ka", "lo", "mi", "nu", "po"]) + rng.choice("xyz") for _ in range(n))
    text = {"long": say(3000), "short": say(50), "both": say(2000)}
    articles = [(i, u, u, text[u], f"h{i}") for i, u in enumerate(text)] + [(-1, "long", "older", say(3000), "h9")]
    said = [("long", say(40)), ("long", text["long"][500:9000]), ("short", say(4000)), ("short", text["short"]), ("both", text["both"]), ("both", ""), ("both", None), ("gone", say(9)), ("long", say(40))]
    said.append(said[0])
    answers = spark.createDataFrame([(i, f"q{i}", u, "?", a, "s", "p", "m", "m2", "t") for i, (u, a) in enumerate(said)], "ordinal long, question_id string, article_url string, question string, answer string, system_prompt string, user_prompt string, model_requested string, model_served string, created_at string")
    known = spark.createDataFrame(articles, "ordinal long, url string, title string, text string, text_sha256 string")
    columns = ["question_id", "article_url", "article_title", "answer", "matched_ngrams", "total_ngrams", "score", "scorable"]
    want = sorted(map(repr, score_answers(answers, known, RULE).select(columns).collect()))
    monkeypatch.setattr(O, "LONG_BYTES", 1500)
    assert O._long_urls(answers, known).count() == 3
    assert sorted(map(repr, score_answers(answers, known, RULE).select(columns).collect())) == want and len(want) == 9
