"""Each operator against a brute-force form, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
WS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string"


def words(text):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(lower).split()


def corpus(seed=5, n=60):
    """Random texts with exact copies, near copies, a common passage, nulls and empties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    base = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        w = list(base) if kind < 0.4 else [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if kind < 0.4:
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.6:
            w += passage
        rows.append((i, rng.choice([" ", " ", "\n"]).join(w) + rng.choice(["", " ", "\t\t"])))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "one"), (n + 5, "a b c d"), (n + 6, "A b\nC d"), (n + 7, "x" * 5000), (n + 8, "la " * 4000), (None, "one")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "k", 2.0) for d, t in rows], DOCS + ", key long, class string, score double").repartition(3).cache()


def test_exact_dedup(spark, docs, rows):
    from lexweave.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    groups = collections.defaultdict(list)
    for d, t in rows:
        groups["".join(c for c in t or "" if c not in WS)].append((-len(t or ""), math.inf if d is None else d, d))
    want = {}
    for body, members in groups.items():
        best = min(members)
        for n, _, d in members:
            want[d] = (best[2], len(members), d == best[2], hashlib.sha256(body.encode()).hexdigest())
    for capacity in (4096, 2):  # 2: many directory rounds
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(docs, capacity).collect()}
        assert got == want
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if w[2]}
    twice = drop_exact_duplicates(docs.unionByName(docs))
    assert twice.count() == len(groups)
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_goes_through_the_directory(docs, monkeypatch):
    """Buckets own what the directory names for them; a directory that names nothing finds nothing."""
    from lexweave.llm import exact_dedup as X
    from lexweave.llm.common import whole_text

    text = X.normalised()
    keys = docs.select("doc_id", X.key_of(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha"), F.length(whole_text()).alias("n_chars")).cache()
    index, buckets = X.build_index(docs.select("doc_id", "text"), keys, 2)
    held = {(r["bits"], r["prefix"], r["key"] % 2**64 >> (64 - r["bits"])) for r in index.collect()}
    named = {(r["bits"], r["prefix"]) for r in buckets.collect()}
    assert {(b, p) for b, p, _ in held} <= named and all(p == own for _, p, own in held) and len(named) > 16
    assert index.groupBy("bits", "prefix").count().agg(F.max("count")).first()[0] <= 2  # no bucket holds more slots than it may
    whole, copies = X.directory, lambda: X.exact_duplicates(docs, 2).where("group_size > 1").count()
    found = copies()
    monkeypatch.setattr(X, "directory", lambda slots, capacity: whole(slots, capacity).where("prefix % 2 = 0"))
    assert 0 < copies() < found


def test_exact_dedup_null_and_repeated_ids(spark):
    from lexweave.llm.exact_dedup import drop_exact_duplicates

    rows = [
        (None, "one text"), (None, "two texts"), (None, "two texts"), (None, None),  # null ids: three groups
        (5, "three texts"), (5, "four texts"), (5, "four  texts"),  # one id: the longer copy of two
        (6, "five"), (7, "five"), (7, "six"),  # 7 stays for "six" only
    ]
    got = drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, "one text"), (None, "two texts"), (None, None), (5, "three texts"), (5, "four  texts"), (6, "five"), (7, "six")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_dedup_drops_by_row_and_keeps_clashing_columns(spark):
    from lexweave.llm.exact_dedup import drop_exact_duplicates

    rows = [(3, "aa  ", 1), (5, "a a", 2), (5, "unique b", 3), (7, "z", 4), (8, "tie", 9), (8, "tie", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, suspect int").withColumns({"row": F.lit("r"), "kept": F.lit(False), "_of_doc_id": F.lit(1), "stays": F.lit(0), "bits": F.lit(2), "attrs": F.create_map(F.lit("k"), F.lit(1))})
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["suspect"]) for r in got.collect()) == [(3, "aa  ", 1), (5, "unique b", 3), (7, "z", 4), (8, "tie", 6)]


def test_near_dedup_drops_by_row(spark):
    from lexweave.llm.ngram_join import drop_near_duplicates

    t = "one two three four five six seven"
    rows = [(3, t), (5, t.upper()), (5, "other words are here and stay there"), (6, ""), (6, None), (None, t), (9, "a b"), (9, "a  b"), (None, "lone"), (None, "lone")]
    got = drop_near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("class", F.lit(1))).collect()
    want = [(3, t, 1), (5, rows[2][1], 1), (6, "", 1), (6, None, 1), (9, "a  b", 1), (None, "lone", 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_index_chains_colliding_texts(spark, docs, rows):
    from lexweave.llm.exact_dedup import exact_duplicates

    plain = {tuple(r) for r in exact_duplicates(docs).collect()}
    for key_bits in (0, 3):  # every text in one slot, or in eight
        assert {tuple(r) for r in exact_duplicates(docs, 4, key_bits).collect()} == plain


def test_exact_index_is_laid_out_by_its_directory(spark, docs):
    from lexweave.llm import exact_dedup as E
    from lexweave.llm.common import stored

    text = E.normalised()
    keys = stored(docs.select("doc_id", E.key_of(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars")), "keys")
    owners = {}
    for capacity in (4096, 4):
        index, buckets = E.build_index(docs, keys, capacity)
        live = {(r["bits"], r["prefix"]) for r in buckets.collect()}
        entries = index.withColumn("file", F.input_file_name()).collect()
        assert {r["key"] for r in entries} == {r["key"] for r in keys.collect()}
        assert sum(r["rows"] for r in entries) == keys.count()
        for r in entries:
            assert (r["bits"], r["prefix"]) in live and (r["key"] & (1 << 64) - 1) >> (64 - r["bits"]) == r["prefix"]
            assert f"/bits={r['bits']}/prefix={r['prefix']}/" in r["file"]
        owners[capacity] = {r["key"]: (r["bits"], r["prefix"]) for r in entries}
    assert max(b for b, _ in owners[4].values()) > 4  # a split gives its slots other owners
    assert sum(owners[4][k] != owners[4096][k] for k in owners[4]) > 0


def test_directory_splits(spark):
    from lexweave.llm.exact_dedup import directory

    keys = [i * 7919 << 20 for i in range(500)] + [(1 << 60) + i for i in range(40)]
    found = directory(spark.createDataFrame([(k,) for k in keys], "key long"), 8).collect()
    for bits, prefix, n in found:
        own = [k for k in keys if (k & (1 << 64) - 1) >> (64 - bits) == prefix]
        assert len(own) == n and (n <= 8 or bits == 48)
    assert sum(r["slots"] for r in found) == len(keys)


def brute_components(rows):
    sets = [(d, frozenset(zip(*(words(t)[i:] for i in range(5)))) if len(words(t)) >= 5 else frozenset([tuple(words(t))] if words(t) else [])) for d, t in rows]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(least.get(top(i), math.inf), d)
    return {d: (len(s), least.get(top(i), d)) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize("seed", [5, 6])
def test_ngram_join(spark, seed):
    from lexweave.llm.ngram_join import drop_near_duplicates, jaccard_components

    rows = corpus(seed, 150)
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], DOCS + ", class string, n int").repartition(3)
    want = brute_components(rows)
    assert len({v[1] for v in want.values()}) < len(want) - 10
    assert {r[0]: (r[1], r[2]) for r in jaccard_components(docs).collect()} == want
    if seed == 5:
        kept = drop_near_duplicates(docs)
        assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, v in want.items() if v[1] == d)
        assert jaccard_components(docs.limit(0)).count() == 0


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_word_encoder():
    from lexweave.llm.tokens import WordEncoder

    rng = random.Random(3)
    pool = [chr(i) for i in range(1, 0x300)] + ["é", "<|", "'s", "'ll", " ", "\n", "日", "́", "Σ", "<|endoftext|>"]
    texts = ["", "ΑΣ ﬁ İ don't I'LL <|endoftext|> a<|startoftext|>b \x1c c\x1cd"] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    enc = WordEncoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode([t.encode() for t in texts])] == [enc.full.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs, rows, tmp_path):
    from lexweave.llm.packing import binary_lengths, pack, write_buckets

    assert binary_lengths(2048 * 2 + 1029, 2048) == [2048, 2048, 1024, 4, 1] and binary_lengths(0, 8) == []
    got = collections.defaultdict(list)
    seen, of_bucket = set(), collections.defaultdict(set)
    for r in pack(docs, PATH, 64).collect():
        of_bucket[r["bucket"]].add(r["sequence_id"])
        assert 1 << r["bucket"] == r["length"]
        got[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        assert r["length"] == len(r["ids"]) // 4 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0
        seen.add(r["sequence_id"])
    assert len(seen) == sum(map(len, got.values()))
    for d, t in rows:
        pieces = sorted(got[d])
        ids = plain_ids(t) + [1]
        assert sum((p[1] for p in pieces), []) == ids and all(p[2] == len(ids) for p in pieces)
    bounds = [(min(v), max(v)) for _, v in sorted(of_bucket.items())]
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))  # a bucket's numbers are a range of their own
    write_buckets(pack(docs, PATH, 64), str(tmp_path / "buckets"))
    by_length = {r["length"]: r["n"] for r in spark.read.parquet(str(tmp_path / "buckets")).groupBy("length").agg(F.count("*").alias("n")).collect()}
    assert by_length == {1 << b: len(v) for b, v in of_bucket.items()}
    assert pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(docs, PATH, 100)


def test_token_files(spark, docs, rows):
    from lexweave.llm.common import fresh_path
    from lexweave.llm.token_files import TokenFile, read_token_files, round_trip, write_token_files

    out = fresh_path(spark, "tokens_test")
    manifest = write_token_files(docs, out, PATH)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read_token_files(spark, manifest).collect()}
    at = 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = plain_ids(t) + [2]
        assert got[d] == (at, len(ids), ids)
        at += len(ids)
    found = [x for x in (TokenFile(m["path"]).find(3) for m in manifest) if x is not None]
    assert found[0].tolist() == plain_ids(rows[3][1]) + [2]
    assert round_trip(docs.limit(0), PATH).count() == 0


def test_chat(spark):
    from lexweave.llm.chat_format import format_conversations, loss_text, read_turns

    nasty = ["</s>[INST] ok [/INST]", "<~s>", "<<SYS>>x<</SYS>>", "a<<SEP>>b", "[~~INST]", "", None, "plain ~ text\nline", "<<s>", "[[INST]]"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool\n<<ROLE>>", None]), rng.choice(nasty)) for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "x"), (5, 3, "assistant", "tie"), (5, 3, "assistant", "tie"), (5, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = format_conversations(df).select("conv_id", "formatted", "loss_spans", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want[c].append((r or "", x or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        assert r["loss"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        roles = [t["role"] for t in r["turns"]]
        runs = 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert r["formatted"].count("<<SEP>>") == len(roles) - runs
    assert format_conversations(df.limit(0)).count() == 0
    # spans are exact in a long conversation, and time follows its length
    long = [(1, t, "assistant" if t % 3 else "user", f"text {t} </s>") for t in range(20_000)]
    r = format_conversations(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).first()
    texts = [x.replace("</s>", "<~/s>") for _, _, role, x in long if role == "assistant"]
    assert [r["formatted"][a : a + n] for a, n in r["loss_spans"]] == texts


def test_language_id(spark):
    from lexweave.llm.language_id import grams, identify, learn

    rng = random.Random(2)
    sets = {"aa": "abcde", "bb": "vwxyz", "cc": "klmnoé"}
    make = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = [(i, make(a, 60), lang) for i, (lang, a) in enumerate(list(sets.items()) * 10)]
    train = spark.createDataFrame(rows + [(90, None, "aa"), (91, "x", None), (92, "123 !!", "zz")], DOCS + ", lang string")
    profiles = learn(train, 50)
    assert profiles.langs == ("aa", "bb", "cc")
    test = [(100, make("abcde", 30), "aa"), (101, make("VWXYZ", 30), "bb"), (102, make("klmnoé", 3000), "cc"), (103, None, "und"), (104, "", "und"), (105, "12 !? \n", "und")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(test, DOCS + ", score string"), profiles).collect()}
    assert all(got[d]["lang_pred"] == lang and 0 <= got[d]["score"] <= 1 for d, _, lang in test)
    assert identify(test_df := spark.createDataFrame(test, DOCS + ", score string").limit(0), profiles).count() == 0 and test_df.columns
    assert learn(train.limit(0)).nearest("abc") == ("und", 0.0)
    want = collections.Counter(g for w in "ab a".split() for k in (1, 2, 3) for g in [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)] if g != " ")
    assert sorted(collections.Counter(grams("Ab, a!").tolist()).values()) == sorted(want.values())


def test_lm(spark, docs, rows):
    from lexweave.llm.lm_scoring import learn, score

    train = [r for r in rows if r[0] is not None and r[0] % 7 != 2]
    count = collections.Counter(w for _, t in train for w in words(t) + [b"\0end"])
    n, v = sum(count.values()), len(count)
    model = learn(docs.where("doc_id % 7 <> 2"))
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w = words(t) + [b"\0end"]
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert got[d]["score"] < 0
    assert score(docs.limit(0), model).count() == 0 and score(docs, learn(docs.limit(0))).count() == len(rows)


def test_lm_trains_on_every_token(spark):
    from lexweave.llm import language_model as L
    from lexweave.llm.lm_scoring import learn

    texts = [" ".join(f"w{d}x{i}" for i in range(n)) for d, n in enumerate((700, 90, 3))]
    model = learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), warm_docs=0)
    ids = L.word_ids([t.encode() for t in texts])[0]
    symbols = np.unique(model.vocabulary.look_up(ids)[1])
    assert len(symbols) == 700 + 90 + 3 + 1
    changed = (model.network["x"] != L.new_model()["x"]).any(axis=1)
    assert np.flatnonzero(changed).tolist() == symbols.tolist()


def test_trainer_uses_last_steps_and_carries_state(monkeypatch):
    from lexweave.llm import language_model as L

    lengths = np.array([100, 37, 5, 1])
    symbols = np.random.default_rng(2).integers(0, L.SYMBOLS, lengths.sum())
    model = L.new_model(3)
    L.seeded_biases(model, 1e6 / np.arange(1, L.SYMBOLS + 1))  # symbols differ much
    want = L.score_documents(model, symbols, lengths, 7).sum() / lengths.sum()
    monkeypatch.setattr(L.Trainer, "_update", lambda *a: None)
    for lanes in (1, 3, 64):  # without updates, the mean is what scoring says of all symbols
        monkeypatch.setattr(L, "LANES", lanes)
        assert L.Trainer(model).documents(symbols, lengths, 7) == pytest.approx(want, rel=1e-4)


def test_network_sums_to_one_and_carries_state():
    from lexweave.llm import language_model as L

    model = L.new_model(3)
    states = np.random.default_rng(0).uniform(-1, 1, (1, L.HIDDEN)).astype(np.float32)
    every = np.arange(L.SYMBOLS)
    assert (10 ** L.log10_of(model, np.repeat(states, L.SYMBOLS, 0), every)).sum() == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(1)
    lengths = np.array([5, 200, 1, 70])
    symbols = rng.integers(0, L.SYMBOLS, lengths.sum())
    together = L.score_documents(model, symbols, lengths, 7)
    first = np.cumsum(lengths) - lengths
    alone = [L.score_documents(model, symbols[a : a + k], np.array([k]), 7)[0] for a, k in zip(first, lengths)]
    assert together == pytest.approx(alone, rel=1e-4)
    h, total = np.zeros((1, L.HIDDEN), np.float32), 0.0
    for x, y in zip([7, *symbols[5:204]], symbols[5:205]):
        h = L._step(model, np.array([x]), h)[0]
        total += L.log10_of(model, h, np.array([y]))[0]
    assert together[1] == pytest.approx(total, rel=1e-4)


def test_gradients_by_differences(monkeypatch):
    """What the trainer subtracts against differences of its own loss, through state, classes and words."""
    from lexweave.llm import language_model as L

    lengths = np.array([9, 5, 3])
    symbols = np.random.default_rng(4).integers(0, L.SYMBOLS, lengths.sum())
    symbols[::3] = symbols[0]
    model = {k: v.astype(np.float64) for k, v in L.new_model(5).items()}
    found = {}

    def keep(self, name, grad, rows=None):
        full = np.zeros_like(model[name])
        full[... if rows is None else rows] = grad
        found[name] = full

    monkeypatch.setattr(L.Trainer, "_update", keep)
    L.Trainer(model).documents(symbols, lengths, 7)
    loss = lambda: -L.score_documents(model, symbols, lengths, 7).sum() * np.log(10) / len(lengths)
    rng = np.random.default_rng(6)
    for name, grad in found.items():
        large = np.argsort(-np.abs(grad).ravel())[:200]
        for i in rng.choice(large, 12, replace=False):
            flat, step = model[name].reshape(-1), 1e-4
            was = flat[i]
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert grad.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5), name


def test_one_very_long_text_takes_memory_by_its_own_length():
    import tracemalloc

    from lexweave.llm import language_model as L

    lengths = np.array([300_000, *[20] * 400])
    symbols = np.random.default_rng(2).integers(0, L.SYMBOLS, lengths.sum())
    tracemalloc.start()
    lanes = L.Lanes(symbols, lengths, L.LANES)
    for t0 in range(0, 2000, 16):
        lanes.window(t0, 16)
    assert tracemalloc.get_traced_memory()[1] < 60 * lengths.sum() and lanes.steps == 300_000
    tracemalloc.stop()


def test_a_long_text_is_scored_in_few_windows(monkeypatch):
    from lexweave.llm import language_model as L

    lengths = np.array([20_000, *[20] * 400])
    symbols = np.random.default_rng(2).integers(0, L.SYMBOLS, lengths.sum())
    model, calls, plain = L.new_model(3), [], L.log10_of
    monkeypatch.setattr(L, "log10_of", lambda m, states, target: calls.append(len(states)) or plain(m, states, target))
    together = L.score_documents(model, symbols, lengths, 7)
    assert len(calls) < 40 and sum(calls) == len(symbols) and max(calls) <= L.SCORE_LANES * L.SCORE_WINDOW
    assert together[1:3] == pytest.approx([L.score_documents(model, symbols[a : a + 20], np.array([20]), 7)[0] for a in (20_000, 20_020)], rel=1e-4)


def test_rows_add_up_by_symbol_and_crowded_words_are_found():
    from lexweave.llm import language_model as L

    rng = np.random.default_rng(3)
    for n in (1, 7, 4096):
        x, rows = np.minimum(rng.geometric(0.02, n), L.SYMBOLS - 1), rng.standard_normal((n, 6)).astype(np.float32)
        sums, symbols = L._by_symbol(rows, x)
        assert sorted(symbols.tolist()) == sorted(set(x.tolist()))
        assert all(s == pytest.approx(rows[x == k].sum(axis=0), abs=1e-3) for s, k in zip(sums, symbols))
    crowded = np.arange(1 << 40, (1 << 40) + 50, dtype=np.uint64)  # all share their first bits
    ids = np.unique(np.concatenate((crowded, [L.END], rng.integers(0, 1 << 64, 500, dtype=np.uint64))))
    words = L.Vocabulary(ids, np.ones(len(ids), int), np.full(len(ids), -1), np.zeros(L.TAILS), 0.0, 0)
    asked = np.concatenate((ids, ids + np.uint64(1), [np.uint64(0), np.uint64((1 << 64) - 1)]))
    place = {int(w): i for i, w in enumerate(ids)}
    assert words.look_up(asked)[0].tolist() == [place.get(int(w), -1) for w in asked]


def test_training_learns_and_words_hash_apart():
    from lexweave.llm import language_model as L

    texts = ["the cat sat on the mat".encode() * 1, b"", " ÄB äb AB ab x\x85y\tz".encode()]
    ids, lengths = L.word_ids(texts)
    flat = [w for t in texts for w in words(t.decode()) + [None]]
    assert lengths.tolist() == [7, 1, 7] or lengths.tolist() == [len(words(t.decode())) + 1 for t in texts]
    assert len(set(ids.tolist())) == len(set(flat)) and all((a == b) == (x == y) for a, x in zip(ids, flat) for b, y in zip(ids, flat))
    model = L.new_model()
    symbols = np.tile([3, 9, 70, 200, 2050], 400)
    trainer = L.Trainer(model)
    said = [trainer.documents(symbols, np.full(20, 100), 5) for _ in range(3)]
    assert said[0] < said[-1] and said[-1] > -0.5


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="needs the given tables")
def test_network_beats_counts_on_held_out_documents(spark):
    """Scores of whole held-out documents, a token, against the base model, however rows are split."""
    from lexweave.llm.lm_scoring import learn, score

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    said = []
    for parts in (1, 4):
        scored = score(docs.where(held), learn(docs.where(~held).repartitionByRange(parts, "doc_id")))
        said.append(scored.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first())
    assert all(network > base + 0.15 for network, base in said) and abs(said[0][0] - said[1][0]) < 0.05


def edited(rows):
    order = sorted(rows, key=lambda r: r[0])
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        yield d, t, t[: len(t) - k] + nxt[:k], nxt


def plain_signature(text):
    """Order MinHash of a text without Spark: (bin, tuple hash) of each bin that has k-mers."""
    import xxhash

    def chained(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p, seed=h)
        return h

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    kmers = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [[" ".join(w)]] if w else []
    times, placed = collections.Counter(), []
    for pos, k in enumerate(kmers):
        top = chained(x.encode() for x in k) >> 30
        if times[top]:
            times[top] += 1
            top = chained([top.to_bytes(8, "little"), (times[top] - 1).to_bytes(4, "little")]) >> 30
        else:
            times[top] = 1
        placed.append((top, pos))
    signed = lambda v: (v[0] - (1 << 34) if v[0] >> 33 else v[0], v[1])
    placed.sort(key=signed)
    out = {}
    for i, (top, _) in enumerate(placed):
        if not i or placed[i - 1][0] >> 28 != top >> 28:
            chosen = [placed[(i + j) % len(placed)] for j in range(min(2, len(placed)))]
            parts = [h >> 1 for h, _ in sorted(chosen, key=lambda v: (v[1], v[0] >> 1))]
            out[top >> 28] = chained(p.to_bytes(8, "little") for p in parts) & 0xFFFFFFFF
    return {f"{b:02x}{h:08x}" for b, h in out.items()}


def test_order_minhash(spark, docs, rows):
    from lexweave.llm.order_minhash import fingerprints

    some = [r for r in rows if r[0] is not None]
    got = {r["doc_id"]: r for r in fingerprints(docs.where("doc_id is not null")).collect()}
    cut = lambda s: {s[i : i + 10] for i in range(0, len(s), 10)}

    def alike(a, b):
        bins = {x[:2] for x in a | b}
        return len(a & b) / len(bins) if bins else 1.0

    for d, t, e, nxt in edited(some):
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        own, other = plain_signature(t), plain_signature(e)
        assert cut(r["fingerprint"]) == own and cut(r["edited_fingerprint"]) == other
        assert r["near_edited"] == pytest.approx(alike(own, other)) and r["near_next"] == pytest.approx(alike(own, plain_signature(nxt)))
    long = [d for d, t in some if t and 40 < len(t.split()) < 1000]
    assert sum(got[d]["near_edited"] for d in long) > 2 * sum(got[d]["near_next"] for d in long)
    a, b = "a b c d e f g h i j k l m n o p".split(), None
    b = a[8:] + a[:8]
    swapped = fingerprints(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "u v w x"), (4, "x u v w x")], DOCS)).collect()
    shared = {tuple(a[i : i + 3]) for i in range(14)} & {tuple(b[i : i + 3]) for i in range(14)}
    assert swapped[0]["near_next"] < len(shared) / 16  # less than the overlap of sets: order counts in short texts, too
    assert fingerprints(docs.limit(0)).count() == 0 and fingerprints(docs).count() == len(rows)
    # many ranges, ties, null and repeated ids
    many = [(d, f"t{i} u v") for i, d in enumerate([None, None, 1, 1, 5, 5, 5, *range(6, 300)])]
    out = fingerprints(spark.createDataFrame(many, DOCS).repartition(7)).collect()
    assert len(out) == len(many) and len({r["edited_sha256"] for r in out}) > 290


def test_mixing(spark):
    from lexweave.llm.mixing import DIMENSIONS, ContradictingTargets, cell_table, mix, rake

    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("aaab"), rng.choice(["x", "y", None]), rng.choice("pq")) for i in range(400)] + [(900, None, "c", "x", "p"), (901, "w", None, "y", "q")]
    docs = spark.createDataFrame(rows, DOCS + ", source string, lang string, topic string").withColumn("weight", F.lit("clash"))
    share = {"source": {"a": 0.5, "b": 0.4, "(none)": 0.1}, "lang": {"x": 0.2, "y": 0.5, "(none)": 0.3}, "topic": {"p": 0.3, "q": 0.7}}
    targets = {d: spark.createDataFrame(list(v.items()), "value string, share double") for d, v in share.items()}
    base = docs.select(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " ")).cast("long").alias("n_tokens"), *[F.coalesce(d, F.lit("(none)")).alias(d) for d in DIMENSIONS])
    fit = {(r["source"], r["lang"], r["topic"]): r for r in rake(cell_table(base.where("source <> 'c'")), targets).collect()}
    w = {k: r["mass"] for k, r in fit.items()}
    for _ in range(300):
        for i, d in enumerate(DIMENSIONS):
            sums = collections.defaultdict(float)
            for k, x in w.items():
                sums[k[i]] += x
            w = {k: x * share[d][k[i]] / sums[k[i]] for k, x in w.items()}
    assert all(fit[k]["share"] == pytest.approx(x, rel=1e-3) for k, x in w.items())
    mixed = mix(docs, budget=0.5)
    out = mixed.collect()
    assert len(out) == len(rows) and all(0 <= r["probability"] <= 1 for r in out)
    tokens = sum(r["n_tokens"] for r in out)
    assert sum(r["n_tokens"] * r["probability"] for r in out) == pytest.approx(0.5 * tokens, rel=1e-6)
    assert 0.3 * tokens < sum(r["n_tokens"] for r in out if r["sampled"]) < 0.7 * tokens
    assert {r["doc_id"]: r["sampled"] for r in out} == {r["doc_id"]: r["sampled"] for r in mix(docs, budget=0.5).collect()}
    assert mix(docs.limit(0)).count() == 0
    clash = mix(docs.withColumns({"_source": F.lit("own"), "cell_lang": F.lit("own")}), targets)
    assert {(r["_source"], r["cell_lang"]) for r in clash.collect()} == {("own", "own")}
    # source a is all of x and b all of y, so no weights give a half and x a third
    apart = spark.createDataFrame([("a", "x", "p", 5.0), ("b", "y", "p", 5.0)], "source string, lang string, topic string, mass double")
    one = lambda **v: spark.createDataFrame(list(v.items()), "value string, share double")
    against = {"source": one(a=0.5, b=0.5), "lang": one(x=0.3, y=0.7), "topic": one(p=1.0)}
    with pytest.raises(ContradictingTargets):
        rake(apart, against)
    with pytest.warns(UserWarning):
        assert rake(apart, against, strict=False).count() == 2


PAGE = """<html><head><title>t</title><script>x("</p>")</script></head><body><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><div class="cookie-notice"><p>We use cookies here. Accept them.</p></div>
<article><h1>A &lt;title&gt;</h1><p>First   paragraph of\n text &amp; more. It goes on for a while.<br><p>Second one is here. It is also long enough.</article>
<section id="comments"><p>I agree with all of this. Nice text!</p></section><form><p>Sign up for letters now.</p></form><footer>&copy; us. All rights.</footer></body></html>"""


def test_html(spark):
    from lexweave.llm import html_extract as H

    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<!-- x --><script>1</script>"), (4, "x", "<p>" + "long words. " * 20000)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    want = "A <title>\nFirst paragraph of text & more. It goes on for a while.\nSecond one is here. It is also long enough."
    texts = collections.Counter((r["page_id"], r["text"]) for r in got)
    assert texts[(1, want)] == 2 and texts[(2, "")] == 1 and texts[(None, "")] == 1 and texts[(3, "")] == 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    from lexweave.llm.html_extract import minimum_cut

    rng = random.Random(0)
    for _ in range(60):
        n = rng.randint(1, 8)
        s, t = [[rng.randint(0, 9) for _ in range(n)] for _ in range(2)]
        e = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(rng.randint(0, 10))]
        e = [x for x in e if x[0] != x[1]]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in e if side[a] != side[b])
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(s, t, e)) == best


def test_classifier_on_unseen_pages():
    from lexweave.llm import html_extract as H

    weights, rng, wrong, total = H.train(), random.Random(12345), 0, 0
    for _ in range(150):
        page = H._made_up_page(rng)
        kept = collections.Counter(H.main_text(page, weights)[0].split("\n"))
        for b in H.blocks_of(page):
            total += 1
            wrong += (b.text in kept) != any(w[:1].lower() == "q" for w in b.text.split())
    assert wrong < 0.03 * total


def test_query_columns_match_contract():
    from lexweave.llm.queries import oracle_sql, queries

    assert [q.split("_")[0] for q in queries()] == [f"op{n}" for n in range(1, 14)] and set(oracle_sql()) <= set(queries())
