"""Delta Lloyd, tandem runs and decontamination against brute-force forms."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lloyd(rows, clusters=16, rounds=3):
    """(vec_id, cluster, distance) and the last centroids, every vector compared with every centroid."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept] if centroids else []

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for (_, v), (_, k) in zip(kept, nearest()):
            members[k].append(v)
        for k, own in members.items():
            centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, k, d) for (i, _), (d, k) in zip(kept, nearest())], centroids


def vectors(n, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, 64))
    rows = [(i, (centres[i % 20] + spread * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n, None), (n + 1, [1.0] * 63), (n + 2, [1.0] * 63 + [None]), (n + 3, [1.0] * 63 + [float("nan")]), (n + 4, [float("-inf")] * 64), (None, [0.5] * 64), (None, [0.5] * 64), (7, rows[7][1])]


def clustered(spark, rows):
    from lexweave.llm.delta_lloyd import cluster_vectors

    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, vector string").repartition(3)
    return cluster_vectors(table).collect()


@pytest.mark.parametrize("n", [300, 9, 0])
def test_delta_lloyd(spark, n):
    rows = vectors(n) if n else []
    want, centroids = lloyd(rows)
    got = clustered(spark, rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    sums = collections.Counter()
    for _, k, d in want:
        sums[k] += d
    for r in got:
        digest = hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (sums[r["cluster"]], sum(sums.values()), digest)


def test_delta_rounds_compare_only_what_changed():
    from lexweave.llm import delta_lloyd as D

    rng = np.random.default_rng(1)
    v = rng.integers(-40, 40, (500, D.DIMENSIONS))
    centroids = v[:8].copy()
    owner, distance = D.assigned(v, np.full(500, -1), np.zeros(500, np.int64), centroids, np.arange(8))
    assert (owner == D.distances(v, centroids).argmin(axis=1)).all()
    centroids[[2, 5]] += rng.integers(-9, 9, (2, D.DIMENSIONS))
    seen = []
    plain, D.distances = D.distances, lambda a, c: seen.append((len(a), len(c))) or plain(a, c)
    try:
        again, far = D.assigned(v, owner, distance, centroids, np.array([2, 5]))
    finally:
        D.distances = plain
    lost = int(np.isin(owner, [2, 5]).sum())
    assert seen == [(lost, 8), (500 - lost, 2)]
    whole = D.distances(v, centroids)
    assert (again == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
    moved = again != owner
    by_transfer = D.transferred(v, np.full(500, -1), owner, 8) + D.transferred(v[moved], owner[moved], again[moved], 8)
    assert (by_transfer == D.transferred(v, np.full(500, -1), again, 8)).all()
    assert D.Clusters.of(centroids).after([by_transfer]).after([]).changed.size == 0  # nothing moved, nothing changed
    big = rng.integers(-D.REACH, D.REACH, (50, D.DIMENSIONS))
    assert D.distances(big, big[:3]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in big[:3]] for x in big]


def test_too_large_components_are_named(spark):
    with pytest.raises(Exception, match="64 bits"):
        clustered(spark, [(1, [1e30] + [0.0] * 63)])


def runs_of(w, least):
    """Every maximal run by comparing all places at all distances."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(least, 2 * q) and i > a:
                best.setdefault((a, i - a + q), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts():
    from lexweave.llm.tandem_runs import repeated, runs_of_texts

    rng = random.Random(4)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k = rng.choice([1, 2, 3, 5, 30])
            w = [str(rng.randrange(k)).encode() for _ in range(rng.choice([0, 1, 2, 12, 13, 40, 120]))]
            if rng.random() < 0.5:
                w = repeated(w, rng.randrange(100))
            if rng.random() < 0.3:
                w = w + w[: rng.randint(1, 9)] * rng.randint(2, 6) + w[:5]
            texts.append(w)
        least = rng.choice([12, 4, 2])
        for w, found in zip(texts, runs_of_texts(texts, least)):
            assert [tuple(map(int, r)) for r in zip(*found)] == runs_of(w, least)


def test_long_runs_take_no_quadratic_time():
    from lexweave.llm.tandem_runs import runs_of_texts

    for part in ([b"a"], [b"a", b"b", b"c"]):
        ((start, length, period),) = runs_of_texts([part * 100_000])
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [100_000 * len(part)], [len(part)])


def test_op12_query_rows(spark, tmp_path):
    """The whole query, its planted documents included, on texts with nulls, repeats and other white space."""
    import zlib

    from lexweave.llm.queries import op12_tandem_runs

    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") + rng.choice(["", "é"]) for _ in range(rng.choice([0, 5, 30, 90]))) for _ in range(60)]
    texts += [None, "", " \n\t", "x " * 12, "x " * 11, "u v w " * 4 + "\x85 " + "u\x0bv\x0cw\r" * 5, "Aa aa " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "la " * 20), (3, texts[3]), (3, texts[3])]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        h, n = (zlib.crc32(str(d).encode()) if d is not None else 1), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_of(w, 12)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(runs), s, m, q, 1000 * m // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in op12_tandem_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[1] for r in got)


def leaks(docs, items, size=10):
    words = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[a : a + size])].add("" if i is None else str(i))
    for d, t in docs:
        w = words(t)
        hit, named = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    named |= own
        yield d, len(w), len(hit), sorted(named)


def leak_tables(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcÄé9") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.choice([0, 1, 2, 3, 9, 10, 11, 25]))) for i in range(25)] + [(30, ["the"] * 14), (31, say(12)), (31, say(12))]
    items.append((32, items[-1][1] + say(4)))
    docs = []
    for i in range(70):
        w = say(rng.randint(0, 60))
        if rng.random() < 0.6:
            item = rng.choice(items)[1]
            a = rng.randrange(len(item) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = item[a : a + rng.randint(1, 14)] if rng.random() < 0.5 else item
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs += [(70, None), (71, ""), (72, " .!"), (73, "The the THE " * 5), (None, " ".join(items[-1][1])), (None, "clean"), (3, docs[3][1]), (3, docs[3][1]), (3, docs[4][1])]
    items = [(i, " ".join(w)) for i, w in items] + [(40, None), (41, "..."), (None, "zz " * 10)]
    return docs + [(90, "zz " * 12)], items


@pytest.mark.parametrize(("seed", "rows"), [(1, 200_000), (2, 0)])  # 0: nothing is broadcast
def test_contamination(spark, monkeypatch, seed, rows):
    from lexweave.llm import decontaminate as D

    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    docs, items = leak_tables(seed)
    table = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n int, key string").repartition(3)
    asked = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, window string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in D.contamination(table, asked).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, leaks(docs, items)))
    assert sum(r[2] > 0 for r in got) > 20


def test_contamination_empty_tables(spark):
    from lexweave.llm.decontaminate import contamination

    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:3] for r in contamination(docs, items.limit(0)).collect()] == [(1, 2, 0)]
    assert contamination(docs.limit(0), items).count() == 0
    assert [tuple(r)[:3] for r in contamination(docs, items).collect()] == [(1, 2, 2)]


def test_a_window_asks_by_its_rarest_shingle(spark):
    from lexweave.llm import decontaminate as D

    docs = spark.createDataFrame([(i, "a b c d e f g h i " + ("j" if i == 0 else "x")) for i in range(5)], "doc_id long, text string")
    windows = spark.createDataFrame([("a b c d e f g h i j", 10), ("q r s", 3)], "text string, n int")
    shapes = D.rarest_shingles(windows, docs, [3]).collect()
    assert [(r["back"], r["n"]) for r in shapes] == [(7, 10)]  # h i j occurs once, the others five times; q r s nowhere
