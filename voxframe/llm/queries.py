"""Thin queries over the text operators, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.common import table


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.chat import format_conversations, loss_text, parse_formatted

    says = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = format_conversations(rows).withColumn("turns", parse_formatted(F.col("formatted"))).withColumn("lost", loss_text(F.col("segments")))
    nl = F.lit("\n")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s AS (
  SELECT conv_id, count(*)::bigint AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS lost,
    sum(length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 32)::bigint AS formatted_chars,
    string_agg(role, ',' ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost)::bigint AS loss_chars, sha256(lost) AS loss_sha256,
  formatted_chars, regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM s
"""

def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 24)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.common import id_bucket
    from voxframe.llm.quality import training_labels
    from voxframe.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0))
    return score_toxicity(docs, model, cut=0.5).select(
        "doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.decontamination import find_benchmark

    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, g)
), n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r
), t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::varchar AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


def op4_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.fingerprints import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.common import id_bucket, written
    from voxframe.llm.lm import corpus_counts, fit_lm, score_lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = id_bucket("doc_id", 7) == 2
    train = docs.where(~fold | F.col("doc_id").isNull())
    counts = written(corpus_counts(train), "lm-counts")
    return score_lm(docs, counts, fit_lm(train, counts)).withColumn("held_out", fold)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voxframe.llm.common import id_bucket
    from voxframe.llm.langid import fit_languages, predict_languages, vocabulary

    docs = table(spark, sf_dir, "documents")
    fold = id_bucket("doc_id", 4) == 2
    model = fit_languages(docs.where(~fold).select("doc_id", "text", "lang"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return predict_languages(docs.select("doc_id", "text"), model).select("doc_id", fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.common import id_bucket
    from voxframe.llm.quality import fit_quality, score_quality, training_labels

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_quality(docs, training_labels(table(spark, sf_dir, "labels"), "quality", 4, 2))
    return score_quality(docs, forest, cut=0.7).select(
        "doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voxframe.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.substrings import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), window=35)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), c AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g JOIN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) USING (h)
), k AS (
  SELECT r, count(*) FILTER (c.p IS NOT NULL) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (c.p IS NULL), '') AS kept
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS x LEFT JOIN c USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


#: `tab` for crc_of: the crc32 of each byte, by the reversed polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"


def crc_of(text: str) -> str:
    """DuckDB's expression of the unsigned crc32 of a string column's UTF-8 bytes."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || hex(encode({text}))[i:i + 1])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.repair import damaged, repair_conversations, repaired_text

    out = repair_conversations(damaged(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(repaired_text(F.col("repaired")), 256).alias("repaired_sha256"))


def _op12_sql() -> str:
    """The edit lattice by dynamic programming: a recursion over turns whose state is the best (cost, audit) and text of each grammar state."""

    def add(v: str, cost: str, letter: str, line: str | None = None) -> str:
        """v with an edit; the key orders costs, then audits."""
        text = f"CASE WHEN {v}.n THEN {v}.r || chr(10) || {line} ELSE {line} END" if line else f"{v}.r"
        return f"{{'k': lpad((left({v}.k, 9)::int + {cost})::varchar, 9, '0') || substr({v}.k, 10) || '{letter}', 'r': {text}, 'n': {'true' if line else v + '.n'}}}"

    def best(*offers: str) -> str:
        return f"list_sort([{', '.join(offers)}])[1]"

    none = "{'k': '900000000', 'r': '', 'n': false}"

    def stays(state: int, initial: str, sources: tuple[int, ...], role: str | None) -> list[str]:
        """Offers of a turn that stays and leads to the state: kept with its role, or with a new one."""
        out = [f"CASE WHEN must OR i <> '{initial}' THEN {none} ELSE {add(f'v{s}', 'pen', 'K', 'line')} END" for s in sources]
        if role:
            other = f"'{role}:' || text"
            out += [f"CASE WHEN must THEN {none} ELSE {add(f'v{s}', 'pen + 1', 'R', other)} END" for s in sources]
        return out

    user, assistant = "'user:'", "'assistant:'"
    w2 = best(add("v2", "2", "D"), *stays(2, "u", (0, 1, 3), "user"))
    w3 = best(add("v3", "2", "D"), *stays(3, "a", (2,), "assistant"))
    x2 = best("w2", *[add(f"w{s}", "5", "I", user) for s in (0, 1, 3)])
    x3 = best("w3", add("x2", "5", "I", assistant))
    # the keys of two offers differ, or they are one string of edits: no text decides
    return f"""
WITH RECURSIVE tab AS MATERIALIZED ({CRC_TABLE}
), k AS MATERIALIZED (
  SELECT *, {crc_of("key")} % 20 AS kind FROM (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations), tab
), m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM k WHERE kind <> 0)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, left(role, 1) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM m
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS h FROM o
), t AS MATERIALIZED (
  SELECT conv_id, p, i, text, role || ':' || text AS line, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS pen FROM f
), c AS (
  SELECT DISTINCT conv_id FROM conversations
), z AS (
  SELECT conv_id, 0::bigint AS p, {{'k': '000000000', 'r': '', 'n': false}} AS v0, {none} AS v1,
    {{'k': '000000005I', 'r': 'user:', 'n': true}} AS v2, {{'k': '000000010II', 'r': 'user:' || chr(10) || 'assistant:', 'n': true}} AS v3 FROM c
  UNION ALL
  SELECT conv_id, p, w0, w1, x2, {x3} FROM (
    SELECT *, {x2} AS x2 FROM (
      SELECT t.conv_id, t.p, {add("v0", "2", "D")} AS w0, {best(add("v1", "2", "D"), *stays(1, "s", (0,), None))} AS w1, {w2} AS w2, {w3} AS w3
      FROM z JOIN t ON z.conv_id IS NOT DISTINCT FROM t.conv_id AND t.p = z.p + 1))
), e AS (
  SELECT conv_id, {best("v0", "v3")} AS v FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (h IS NOT NULL AND h || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
  coalesce(illegal, 0)::bigint AS illegal, left(v.k, 9)::bigint AS cost, substr(v.k, 10) AS audit, sha256(v.r) AS repaired_sha256
FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""


OP12_SQL = _op12_sql()


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1, most=1, buckets=10_000, seed=2024, least_words=20, percent=10)


OP13_SQL = f"""
WITH tab AS MATERIALIZED ({CRC_TABLE}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark
), dx AS (SELECT r, x, count(*) AS m FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x
), sx AS (SELECT x, sum(m) AS n FROM dx GROUP BY x
), tx AS (SELECT x, count(*) AS n FROM b GROUP BY x
), k AS MATERIALIZED (SELECT x, {crc_of("x")} % 10000 AS bucket FROM (SELECT x FROM sx UNION SELECT x FROM tx), tab
), s AS (SELECT bucket, sum(n) AS s FROM sx JOIN k USING (x) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS t FROM tx JOIN k USING (x) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((SELECT coalesce(sum(n), 0) FROM sx) + 10000)::double) / ((s + 1)::double * ((SELECT coalesce(sum(n), 0) FROM tx) + 10000)::double)))::bigint AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (SELECT r, sum(m * gain)::bigint AS weight FROM dx JOIN k USING (x) JOIN g USING (bucket) GROUP BY r
), c AS (
  SELECT r, doc_id, len(w)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint AS score
  FROM d LEFT JOIN w USING (r)
), p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM p) * 10 // 100 THEN place END AS rank
FROM c LEFT JOIN p USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_sharding": op1_sharding, "op2_toxicity": op2_toxicity, "op3_decontamination": op3_decontamination, "op4_exact_digest": op4_exact_digest, "op5_lm_score": op5_lm_score, "op6_language_id": op6_language_id, "op7_quality": op7_quality, "op8_jaccard_join": op8_jaccard_join, "op9_chat_format": op9_chat_format, "op10_best_fit_packing": op10_best_fit_packing, "op11_substring_dedup": op11_substring_dedup, "op12_conversation_repair": op12_conversation_repair, "op13_importance_resampling": op13_importance_resampling, "pipeline": pipeline}
_ORACLES = {"op3_decontamination": OP3_SQL, "op9_chat_format": OP9_SQL, "op11_substring_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_importance_resampling": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
