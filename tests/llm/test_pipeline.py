"""The corpus pipeline, stage by stage, and language profiles, against plain Python."""

import collections
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import PATH, WS, brute_components, plain_ids, words

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "etaoinshr", "de": "enisratüß", "fr": "esaitnéàr"}


def plain_grams(text):
    """All n-grams of one to three characters, words padded by a blank, none of blanks alone."""
    runs, word = [], ""
    for c in text:
        if unicodedata.category(c)[0] == "L":
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            runs.append(word)
            word = ""
    runs += [word] if word else []
    return [g for w in runs for k in (1, 2, 3) for g in [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)] if g.strip()], runs


def plain_ranks(counts, size):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    # words share the blank between them, so runs of two words never meet in an n-gram
    return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}


def plain_languages(train, texts, size):
    by = collections.defaultdict(collections.Counter)
    for lang, text in train:
        if lang is not None and text is not None and plain_grams(text)[0]:
            by[lang].update(plain_grams(text)[0])
    profiles = {lang: plain_ranks(c, size) for lang, c in by.items()}
    out = []
    for t in texts:
        own = plain_ranks(collections.Counter(plain_grams(t or "")[0]), size)
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for lang, p in profiles.items()}
        lang = min(sorted(away), key=away.get)
        out.append((lang, 1 - away[lang] / (size * len(own))))
    return out


def made_up(seed=8, n=90):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 8)))
    rows = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        text = " ".join(word(lang) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang, rng.choice(["web", "web", "web", "books", None])))
    for i in range(n, n + 40):
        _, text, lang, _ = rng.choice(rows[:20])
        w = text.split()
        if rng.random() < 0.5 and len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w), lang, "copies"))
    rows += [(n + 40, None, "en", "web"), (n + 41, "", None, "web"), (n + 42, "12 345", "de", None), (n + 43, "日本語 の", None, "web"), (None, "nobody owns this text", "en", "web"), (5, "an id that is used again", "en", "web")]
    return [(d, t, lang, src, len(t or "")) for d, t, lang, src in rows]


def test_profiles_by_brute_force(spark):
    from lexweave.llm.language_id import identify, learn

    rows = made_up() + [(1000, "ab " * 40000 + "ÄÖ", "de", "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for size in (30, 400):
        got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in identify(docs.select("doc_id", "text"), learn(docs, size)).collect()}
        want = plain_languages([(r[2], r[1]) for r in rows], [r[1] for r in rows], size)
        for r, (lang, score) in zip(rows, want):
            assert got[(r[0], r[1])] == (lang, pytest.approx(score, abs=1e-12))


def plain_mixed(rows):
    """Rows that calibrated sampling takes, with the module's default targets."""
    from lexweave.llm import mixing as M

    topics = [plain_topic(r[1]) for r in rows]
    cells = [(r[3] or M.NONE, r[2] or M.NONE, t) for r, t in zip(rows, topics)]
    n = [len(words(r[1])) for r in rows]
    mass = collections.Counter()
    for c, k in zip(cells, n):
        mass[c] += k
    mass = {c: float(m) for c, m in mass.items() if m}
    targets = []
    for d in range(3):
        sums = collections.Counter()
        for c, m in mass.items():
            sums[c[d]] += m
        total = sum(m**M.TEMPER for m in sums.values())
        targets.append({v: m**M.TEMPER / total for v, m in sums.items()})
    share = dict(mass)
    for _ in range(2000):
        for d in range(3):
            sums = collections.Counter()
            for c, s in share.items():
                sums[c[d]] += s
            share = {c: s * targets[d][c[d]] / sums[c[d]] for c, s in share.items()}
    total = sum(mass.values())
    weight = {c: share[c] * total / mass[c] for c in mass}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(m * min(1, weight[c] * mid) for c, m in mass.items()) < total * M.BUDGET else (low, mid)
    out = []
    for r, c in zip(rows, cells):
        p = min(1.0, weight[c] * low) if c in weight else M.BUDGET
        h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), seed=42 if r[0] is None else xxhash.xxh64_intdigest(int(r[0]).to_bytes(8, "little", signed=True), seed=42))
        out.append((p, (h >> 11) / (1 << 53)))
    return out


def plain_topic(text):
    import re

    whole, n = text or "", len(words(text))
    symbols = len(re.sub(r"(?:[^\W_]|[.,]|[ \t\n\x0b\f\r])+", "", whole))
    if not n:
        return "empty"
    if symbols * 8 > len(whole):
        return "symbolic"
    if not any(c.islower() for c in whole) and any(c.isupper() for c in whole):
        return "capitals"
    return "note" if n < 100 else "article" if n < 1000 else "long"


def test_stages_and_run(spark, tmp_path):
    rows = made_up()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]

    def held(df):
        assert df.columns == columns
        return sorted(map(tuple, df.collect()), key=str)

    # language: texts in a language that the corpus has stay
    want = [r for r, (lang, score) in zip(rows, plain_languages([(r[2], r[1]) for r in rows], [r[1] for r in rows], 400)) if lang != "und" and score >= pipeline.LEAST_SCORE]
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert held(kept) == sorted(want, key=str) and len(want) == len(rows) - 4
    # exact: one of each group, most characters, then the smallest id
    groups = collections.defaultdict(list)
    for r in want:
        groups["".join(c for c in r[1] or "" if c not in WS)].append(r)
    best = lambda r: (-len(r[1] or ""), math.inf if r[0] is None else r[0])
    want = [min(g, key=best) for g in groups.values()]
    kept = stages["exact_dedup"](spark, spark.createDataFrame(held(kept), SCHEMA), str(tmp_path))
    assert held(kept) == sorted(want, key=str)
    # near: the smallest id of each component; ids are unique but for 5, whose two texts are unlike
    numbered = [(i, r[1]) for i, r in enumerate(sorted(want, key=lambda r: (r[0] is None, r[0] or 0)))]
    order = sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    want = [order[i] for i, (_, least) in brute_components(numbered).items() if least == i]
    kept = stages["near_dedup"](spark, spark.createDataFrame(held(kept), SCHEMA), str(tmp_path))
    assert held(kept) == sorted(want, key=str) and len(want) < len(order)
    # mixing: a row's chance against its cell's probability
    chances = plain_mixed(want)
    assert all(abs(p - h) > 1e-4 for p, h in chances)  # none so close that the fit's tolerance decides
    want = [r for r, (p, h) in zip(want, chances) if h < p]
    kept = stages["mixing"](spark, spark.createDataFrame(held(kept), SCHEMA), str(tmp_path))
    assert held(kept) == sorted(want, key=str) and want
    # packing: binary pieces of what is left, and run() gives the same
    pieces = []
    for r in want:
        ids, at = plain_ids(r[1]) + [1], 0
        lengths = [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]
        for k in lengths:
            pieces.append((r[0], at, k, zlib.crc32(np.array(ids[at : at + k], "<u4").tobytes()), len(ids)))
            at += k
    for out in (stages["packing"](spark, spark.createDataFrame(want, SCHEMA), str(tmp_path)), pipeline.run(spark, str(tmp_path))):
        got = out.collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(pieces, key=str)
        assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert PATH and F
