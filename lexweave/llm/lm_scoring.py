"""Language-model scoring of whole documents: the Spark side of :mod:`lexweave.llm.language_model`.

1. *Counts.* Tasks count the words of their training texts; owners of id ranges add up. The
   result holds every distinct training word and stays distributed. The driver gets the
   ``FREQUENT`` most frequent words and the totals.
2. *Network.* A start on ``WARM_DOCS`` documents, then every task trains on every token of its
   training documents, state carried from each document's start to its end. The tasks' networks
   are averaged in groups, weighted by tokens; so the network depends on how rows are split among
   tasks, at 0.01 by some 0.02 in log10 a token between 1, 4 and 32 tasks.
3. *Scores.* One pass runs the network over every text, state carried to the text's end. What
   needs the count of a word that isn't frequent goes to the word's owner, which answers with
   sums per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import shuffle_partitions, stored, whole_text
from lexweave.llm.language_model import TAILS, Vocabulary

FREQUENT = 1 << 17  # words whose counts every task knows
WARM_DOCS = 400  # documents of the first start, those of the smallest id hashes
HOLD = 1_200_000  # tokens whose words a task holds at once
RUN = 4 * HOLD  # tokens, as numbers, that its network runs over side by side: long texts then have company to their end
FAN_IN = 16  # networks that are averaged at once


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    network: dict
    counts: DataFrame  # owner, ids, counts: packed training counts of every word
    owners: int


def _groups(batches, column: int, most: int = HOLD):
    """Runs of rows whose texts have about ``most`` bytes * 6: (batch, first row, texts)."""
    from lexweave.llm.tokens import text_slices

    held, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_pylist() if column else [None] * batch.num_rows
        for first, texts in text_slices(batch.column(column)):
            held += zip(ids[first : first + len(texts)], texts)
            size += sum(map(len, texts))
            if size >= most * 6:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_words(train: DataFrame, owners: int) -> DataFrame:
    """(owner, ids, counts, top_ids, top_counts, tokens, words): one row per owner that has words.

    ``tokens`` and ``words`` are sums and numbers of distinct words by tail class.
    """
    top = 2 * FREQUENT // owners + 64

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        from lexweave.llm.language_model import TAIL_BITS, word_ids

        for held in _groups(batches, 0):
            ids, n = np.unique(word_ids([t for _, t in held])[0], return_counts=True)
            owner = ((ids >> np.uint64(TAIL_BITS)) % np.uint64(owners)).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            at = np.flatnonzero(np.diff(owner[order], prepend=-1)).tolist()
            cuts = list(zip(at, at[1:] + [len(order)]))
            ids, n = ids[order], n[order].astype("<i8")
            yield pa.record_batch(
                [pa.array([int(owner[order[a]]) for a, _ in cuts], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in cuts], pa.binary())],
                names=["owner", "ids", "counts"],
            )

    def add(table):
        import numpy as np
        import pyarrow as pa

        from lexweave.llm.language_model import TAILS

        ids = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("ids")])
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
        ids, at = np.unique(ids, return_inverse=True)
        n = np.bincount(at, weights=n).astype("<i8")
        best = np.lexsort((ids, -n))[:top]
        tail = (ids % np.uint64(TAILS)).astype(int)
        return pa.table(
            {
                "owner": table.column("owner").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()),
                "top_ids": pa.array([ids[best].tobytes()], pa.binary()), "top_counts": pa.array([n[best].tobytes()], pa.binary()),
                "tokens": pa.array([np.bincount(tail, weights=n, minlength=TAILS).astype(np.int64).tolist()], pa.list_(pa.int64())),
                "words": pa.array([np.bincount(tail, minlength=TAILS).astype(np.int64).tolist()], pa.list_(pa.int64())),
            }
        )

    dealt = train.select(whole_text().alias("text")).mapInArrow(deal, "owner int, ids binary, counts binary")
    return dealt.groupBy("owner").applyInArrow(
        add, "owner int, ids binary, counts binary, top_ids binary, top_counts binary, tokens array<bigint>, words array<bigint>"
    )


def _vocabulary(counts: DataFrame) -> Vocabulary:
    import numpy as np

    ids, n, tokens, words = [], [], np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.select("top_ids", "top_counts", "tokens", "words").toLocalIterator():
        ids.append(np.frombuffer(r["top_ids"], "<u8"))
        n.append(np.frombuffer(r["top_counts"], "<i8"))
        tokens += np.array(r["tokens"])
        words += np.array(r["words"])
    ids, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, n))
    best = np.lexsort((ids, -n))[:FREQUENT]
    return Vocabulary.of(ids[best], n[best], tokens, words)


def _as_bytes(network: dict) -> bytes:
    import io

    import numpy as np

    out = io.BytesIO()
    np.savez(out, **network)
    return out.getvalue()


def _from_bytes(raw: bytes) -> dict:
    import io

    import numpy as np

    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def _end_symbol(vocabulary: Vocabulary) -> int:
    import numpy as np

    from lexweave.llm.language_model import END

    return int(vocabulary.look_up(np.array([END]))[1][0])


def _warm_network(train: DataFrame, vocabulary: Vocabulary, docs: int) -> dict:
    import numpy as np

    from lexweave.llm.language_model import HEAD, SYMBOLS, Trainer, new_model, seeded_biases, word_ids

    own = F.xxhash64("doc_id").alias("h")
    first = train.select(own).orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    some = train.select(own, whole_text().alias("text")).where(F.col("h") <= (first or 0)).orderBy("h", "text").limit(docs)  # ties by text
    texts = [r["text"].encode() for r in some.collect()]
    network = new_model()
    seen = np.zeros(SYMBOLS)
    known = vocabulary.rank >= 0
    seen[vocabulary.rank[known]] = vocabulary.counts[known]
    seen[HEAD:] = max(vocabulary.train_tokens - seen.sum(), 0) / TAILS
    seeded_biases(network, seen)
    if texts:
        ids, lengths = word_ids(texts)
        Trainer(network).documents(vocabulary.look_up(ids)[1], lengths, _end_symbol(vocabulary))
    return network


def learn(train: DataFrame, warm_docs: int = WARM_DOCS) -> LanguageModel:
    """Counts of all of ``train`` and a network fitted to it. ``train``: doc_id, text (null: empty)."""
    spark = train.sparkSession
    owners = 2 * shuffle_partitions(spark)
    counts = stored(count_words(train, owners), "word_counts")
    vocabulary = _vocabulary(counts)
    given = spark.sparkContext.broadcast((vocabulary, _warm_network(train, vocabulary, warm_docs), _end_symbol(vocabulary)))

    def fit(batches):
        import numpy as np
        import pyarrow as pa

        from lexweave.llm.language_model import Trainer, word_ids

        vocabulary, start, end = given.value
        network, tokens = {k: v.copy() for k, v in start.items()}, 0
        trainer = Trainer(network, seen=1.0)
        symbols, lengths, size = [], [], 0

        def train():
            trainer.documents(np.concatenate(symbols), np.concatenate(lengths), end)
            symbols.clear()
            lengths.clear()

        for held in _groups(batches, 0):
            ids, n = word_ids([t for _, t in held])
            symbols.append(vocabulary.look_up(ids)[1].astype(np.int32))
            lengths.append(n)
            size += len(ids)
            tokens += len(ids)
            if size >= RUN:
                train()
                size = 0
        if symbols:
            train()
        if tokens:
            yield pa.record_batch([pa.array([_as_bytes(network)], pa.binary()), pa.array([tokens], pa.int64())], names=["network", "tokens"])

    def average(table):
        import pyarrow as pa

        from lexweave.llm.language_model import averaged

        weights = table.column("tokens").to_pylist()
        mean = averaged([_from_bytes(x.as_py()) for x in table.column("network")], weights)
        return pa.table({"network": pa.array([_as_bytes(mean)], pa.binary()), "tokens": pa.array([sum(weights)], pa.int64())})

    schema = "network binary, tokens bigint"
    fitted = stored(train.select(whole_text().alias("text")).mapInArrow(fit, schema), "networks")
    while (n := fitted.count()) > FAN_IN:
        dealt = fitted.withColumn("team", F.monotonically_increasing_id() % F.lit(-(-n // FAN_IN)))
        dealt = stored(dealt, "network_teams")
        fitted = stored(dealt.groupBy("team").applyInArrow(average, schema), "networks")
    from lexweave.llm.language_model import averaged

    last = fitted.collect()  # FAN_IN networks at most
    network = averaged([_from_bytes(r[0]) for r in last], [r[1] for r in last]) if last else given.value[1]
    return LanguageModel(vocabulary, network, counts.select("owner", "ids", "counts"), owners)


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    A null or empty text is the end token alone. Repeated rows and null ids stay row by row. An
    empty table gives an empty result; if nothing was learned every word is unknown and has
    probability one over one. Other columns are ignored.
    """
    spark = docs.sparkSession
    owners = model.owners
    given = spark.sparkContext.broadcast((model.vocabulary, model.network, _end_symbol(model.vocabulary)))
    schema = "key bigint, doc_id bigint, n_tokens bigint, n_known bigint, seen_log double, tail_log double, tail_norm double, net double, owner int, ids binary, keys binary, runs binary"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from lexweave.llm.language_model import HEAD, TAIL_BITS, score_documents, word_ids

        vocabulary, network, end = given.value
        key = TaskContext.get().partitionId() << 40
        waiting, size = [], 0  # (columns, symbols, lengths) of rows that the network has yet to run over

        def finished():
            columns, symbols, lengths = (list(x) for x in zip(*waiting))
            waiting.clear()
            net = score_documents(network, np.concatenate(symbols), np.concatenate(lengths), end)
            at = 0
            for own in columns:
                m = len(own[0])
                yield pa.record_batch(own + [pa.array(net[at : at + m]), pa.nulls(m, pa.int32())] + [pa.nulls(m, pa.binary())] * 3, names=names)
                at += m

        names = ["key", "doc_id", "n_tokens", "n_known", "seen_log", "tail_log", "tail_norm", "net", "owner", "ids", "keys", "runs"]
        for held in _groups(batches, 1):
            ids, lengths = word_ids([t for _, t in held])
            place, symbol = vocabulary.look_up(ids)
            doc = np.repeat(np.arange(len(held)), lengths)
            keys = key + np.arange(len(held), dtype=np.int64)
            key += len(held)
            seen = place >= 0
            logs = np.where(seen, np.log10(vocabulary.counts[place] + 1) if len(vocabulary.counts) else 0.0, 0.0)
            tail = symbol >= HEAD
            norm = np.where(tail, vocabulary.tail_norm[np.maximum(symbol - HEAD, 0)], 0.0)
            add = lambda w: np.bincount(doc, weights=w, minlength=len(held))
            rows = [
                pa.array(keys), pa.array([d for d, _ in held], pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(add(seen).astype(np.int64)),
                pa.array(add(logs)), pa.array(add(logs * tail)), pa.array(add(norm)),
            ]
            waiting.append((rows, symbol.astype(np.int32), lengths))
            size += len(ids)
            ids, doc = ids[~seen], doc[~seen]
            if len(ids):
                owner = ((ids >> np.uint64(TAIL_BITS)) % np.uint64(owners)).astype(np.int32)
                order = np.argsort(owner, kind="stable")
                ids, doc, owner = ids[order], doc[order], owner[order]
                at = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
                cuts = list(zip(at, at[1:] + [len(ids)]))
                runs = [np.unique(doc[a:b], return_counts=True) for a, b in cuts]
                m = len(cuts)
                yield pa.record_batch(
                    [pa.nulls(m, pa.int64())] * 4 + [pa.nulls(m, pa.float64())] * 4
                    + [pa.array(owner[at]), pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([keys[d].tobytes() for d, _ in runs], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in runs], pa.binary())],
                    names=names,
                )
            if size >= RUN:
                yield from finished()
                size = 0
        if waiting:
            yield from finished()

    def answer(asked, counts):
        import numpy as np
        import pyarrow as pa

        known = np.frombuffer(counts.column("counted_ids")[0].as_py(), "<u8") if counts.num_rows else np.zeros(0, np.uint64)
        n = np.frombuffer(counts.column("counts")[0].as_py(), "<i8") if counts.num_rows else np.zeros(0, np.int64)
        key, log, hits = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for ids, keys, runs in zip(*(asked.column(c) for c in ("ids", "keys", "runs"))):
            ids, keys, runs = np.frombuffer(ids.as_py(), "<u8"), np.frombuffer(keys.as_py(), "<i8"), np.frombuffer(runs.as_py(), "<u4")
            c = np.zeros(len(ids), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                c = np.where(known[at] == ids, n[at], 0)
            doc = np.repeat(np.arange(len(keys)), runs)
            key.append(keys)
            log.append(np.bincount(doc, weights=np.log10(c + 1), minlength=len(keys)))
            hits.append(np.bincount(doc, weights=c > 0, minlength=len(keys)))
        key, log, hits = np.concatenate(key), np.concatenate(log), np.concatenate(hits).astype(np.int64)
        some = hits > 0  # a word that was never seen adds nothing
        return pa.table({"key": pa.array(key[some]), "log": pa.array(log[some]), "hits": pa.array(hits[some])})

    out = stored(docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(run, schema), "lm_scores")
    rows = out.where(F.col("owner").isNull()).drop("owner", "ids", "keys", "runs")
    asked = out.where(F.col("owner").isNotNull()).select("owner", "ids", "keys", "runs")
    counted = model.counts.select(F.col("owner").alias("counter"), F.col("ids").alias("counted_ids"), "counts")
    answers = asked.groupBy("owner").cogroup(counted.groupBy("counter")).applyInArrow(answer, "key bigint, log double, hits bigint")
    sums = answers.groupBy("key").agg(F.sum("log").alias("log"), F.sum("hits").alias("hits"))
    v = model.vocabulary
    log, hits = F.coalesce("log", F.lit(0.0)), F.coalesce("hits", F.lit(0).cast("bigint"))
    return rows.join(sums, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + hits).alias("n_known"),
        F.lit(v.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("seen_log") + log - F.col("n_tokens") * F.lit(v.base_norm)).alias("base_score"),
        (F.col("net") + F.col("tail_log") + log - F.col("tail_norm")).alias("score"),
    )
