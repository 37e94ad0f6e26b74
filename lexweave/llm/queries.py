"""The queries of the training-data operators and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.mixing import mix

    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.language_id import identify, learn

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    profiles = learn(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.lm_scoring import learn, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = score(docs, learn(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.html_extract import extract

    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.chat_format import format_conversations, loss_text, read_turns

    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{said}'")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(turns)
    read = out.select(
        "conv_id",
        F.explode(F.array(read_turns(F.col("formatted")))).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.token_files import round_trip

    read = round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.order_minhash import fingerprints

    return fingerprints(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.ngram_join import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.delta_lloyd import cluster_vectors

    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.tandem_runs import collapse_runs

    found = collapse_runs(read_table(spark, sf_dir, "documents"), plant=True)
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = found.select("doc_id", "runs", order.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.decontaminate import contamination

    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       sha256(body) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY body ORDER BY n_chars DESC, doc_id)
"""


#: The template's own length: marks around each run of one role, a separator between its texts, a tilde per control string.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joins,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 26 + length(role) END AS marks,
    length(regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\]|</?(?:SYS|ROLE|TURN|SEP)>>)', '\1~\2\3', 'g')) AS n_escaped
  FROM t)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n_escaped + CASE WHEN joins THEN 7 ELSE marks END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def op11_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out one after the other, every vector compared with every centroid."""
    steps = [f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM v QUALIFY k < {clusters})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT rid, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM v, c{r}),
    a{r} AS (SELECT rid, CAST(arg_min(k, d * 1000 + k) AS INTEGER) AS k, min(d) AS d FROM d{r} GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v JOIN a{r} USING (rid)) GROUP BY k, i),
    m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k),
    c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (k)"""


OP13_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', coalesce(CAST(item_id AS VARCHAR), ''), row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM w WHERE side = 'i' AND len(w) > 0)),
places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM items) WHERE side = 'd' AND len(w) >= n)),
hits AS (SELECT DISTINCT rid, i, p.n, p.t FROM places p WHERE EXISTS (SELECT 1 FROM items x WHERE x.t = p.t AND x.n = p.n)),
cover AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits JOIN items USING (t, n) GROUP BY rid)
SELECT CAST(id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid) WHERE side = 'd'
"""


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_language_id": op2_language_id,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_packing": op4_packing,
        "op5_html_extract": op5_html_extract,
        "op6_chat_format": op6_chat_format,
        "op7_token_files": op7_token_files,
        "op8_order_minhash": op8_order_minhash,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_delta_lloyd": op11_delta_lloyd,
        "op12_tandem_runs": op12_tandem_runs,
        "op13_decontaminate": op13_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_delta_lloyd": op11_sql(), "op13_decontaminate": OP13_SQL}
