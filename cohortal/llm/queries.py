"""One query opN_<name> for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.chat import RESPOND, as_calls, link

    calls, results = as_calls(table(spark, sf_dir, "conversations"))
    return link(calls, results, RESPOND).withColumn("errors", F.array_join("errors", "; "))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the secret itself hashed; a document's path is its source."""
    from cohortal.llm.secrets import labelled_findings, scan

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text")
    found = scan(docs, labelled_findings(spark))
    return found.withColumn("value", F.sha2(F.col("value").cast("binary"), 256)).withColumnRenamed("value", "value_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.spm import decode, encode_long, encode_short, whole

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    short, long = encode_short(docs, decoded=True), decode(encode_long(docs))
    text = F.md5(F.col("text").cast("binary")).alias("decoded_md5")
    one = short.select("doc_id", F.size("ids").alias("n_ids"), F.lit(1).alias("n_chunks"), F.xxhash64("ids").alias("ids_hash"), F.col("piece").alias("text"))
    joined = whole(long, "ids", "piece").withColumn("ids", F.flatten("ids"))
    many = joined.select(
        "doc_id", F.size("ids").alias("n_ids"), F.size("piece").alias("n_chunks"), F.xxhash64("ids").alias("ids_hash"), F.concat_ws("", "piece").alias("text")
    )
    return one.unionByName(many).select("doc_id", "n_ids", "n_chunks", "ids_hash", F.length("text").alias("n_chars"), text)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file under its source and its block of ids."""
    from cohortal.llm.license import scan

    docs = table(spark, sf_dir, "documents")
    block = F.expr("cast(doc_id div 64 as string)")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), block, F.col("doc_id").cast("string"))
    return scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.decontam import decontaminate

    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, benchmark).select("row.doc_id", "contaminated", "n_items", "best_overlap")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.langid import held_out, predict, train_on

    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train_on(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.docprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.linededup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_kept", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.substring import dedup_sentences

    done = dedup_sentences(table(spark, sf_dir, "documents"))
    first = F.array_sort(F.coalesce("first_docs", F.array().cast("array<bigint>"))).alias("first_docs")
    return done.select("doc_id", "n_sentences", "n_removed", first, F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.filteraudit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.interpolate import score

    return score(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortal.llm.tokenalign import align

    return align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": """
WITH asked AS (
  SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM conversations WHERE role = 'user'),
calls AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM asked),
replies AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
met AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1) AS place, c.turn AS asked_at, c.text AS prompt,
         c.level, r.turn AS answered_at, r.text AS answer
  FROM calls c FULL OUTER JOIN replies r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1)
SELECT conv_id, 't' || place AS call_id, coalesce(asked_at, answered_at) AS turn, level::BIGINT AS level,
  CASE WHEN asked_at IS NULL THEN 'orphan' WHEN coalesce(prompt, '') = '' THEN 'invalid'
       WHEN answered_at IS NULL THEN 'pending' ELSE 'linked' END AS status,
  CASE WHEN asked_at IS NULL THEN '' WHEN prompt IS NULL THEN '$.prompt: required'
       WHEN prompt = '' THEN '$.prompt: minLength' ELSE '' END AS errors,
  '{' || CASE WHEN asked_at IS NULL THEN '' ELSE '"arguments":{'
      || CASE WHEN level > 0 THEN '"after":"t' || (place - 2) || '",' ELSE '' END
      || CASE WHEN prompt IS NULL THEN '' ELSE '"prompt":' || to_json(prompt)::VARCHAR || ',' END
      || '"turn":' || place || '},' END
    || '"call":"t' || place || '"' || CASE WHEN asked_at IS NULL THEN '' ELSE ',"name":"respond"' END
    || CASE WHEN answer IS NULL THEN '' ELSE ',"result":' || to_json(answer)::VARCHAR END || '}' AS json
FROM met
""",
    "op6_decontamination": r"""
WITH items AS (
  SELECT min(item_id) AS item_id, item, len(item) AS m FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS item FROM benchmark) GROUP BY item HAVING len(item) >= 5),
item_words AS (SELECT item_id, m, unnest(item) AS word, unnest(range(m)) AS j FROM items),
doc_words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
hits AS (
  SELECT doc_id, item_id, m, i - j AS shift, list(j) AS js FROM doc_words JOIN item_words USING (word)
  GROUP BY ALL HAVING count(*) >= least(13, m)),
steps AS (
  SELECT doc_id, item_id, m, shift, unnest(range(m)) AS j,
         unnest(list_transform(range(m), lambda k: CASE WHEN list_contains(js, k) THEN 1 ELSE -2 END)) AS x FROM hits),
sums AS (SELECT *, sum(x) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS s FROM steps),
best AS (
  SELECT doc_id, item_id, m, s - least(0, coalesce(min(s) OVER (
    PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM sums),
found AS (SELECT doc_id, item_id, m, max(score) AS overlap FROM best GROUP BY ALL HAVING max(score) >= least(13, m)),
per_doc AS (SELECT doc_id, count(*) AS n, max(overlap) AS overlap FROM found GROUP BY 1)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::INTEGER AS n_items, coalesce(overlap, 0)::INTEGER AS best_overlap
FROM documents LEFT JOIN per_doc USING (doc_id)
""",
    "op9_line_dedup": """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
every AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM split),
firsts AS (
  SELECT line, length(line) AS n, min((doc_id, line_no)) AS place FROM every WHERE trim(line) <> '' GROUP BY line),
halves AS (
  SELECT place, line, n, m, 1 AS side, left(line, (m - 1) // 2) AS half FROM firsts, unnest([n, n + 1]) AS t(m)
  UNION ALL
  SELECT place, line, n, m, 2 AS side, right(line, (m - 1) // 2) AS half FROM firsts, unnest([n, n + 1]) AS t(m)),
pairs AS (
  SELECT DISTINCT b.place, a.line AS x, b.line AS y, greatest(a.n, b.n) AS m
  FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.place < b.place),
near AS (
  SELECT DISTINCT place FROM pairs
  WHERE len(list_filter(range(m), lambda i: left(x, i) = left(y, i)
                                  AND right(x, m - 1 - i) = right(y, m - 1 - i))) > 0),
stay AS (
  SELECT place.doc_id AS doc_id, place.line_no AS line_no FROM (
    SELECT {'doc_id': place[1], 'line_no': place[2]} AS place FROM (
      SELECT place FROM firsts EXCEPT SELECT place FROM near))
  UNION ALL
  SELECT doc_id, line_no FROM every WHERE trim(line) = ''),
joined AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM every JOIN stay USING (doc_id, line_no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::INTEGER AS n_lines, coalesce(n_kept, 0)::INTEGER AS n_kept,
       md5(CASE WHEN lines IS NOT NULL THEN coalesce(j.text, '') END) AS text_md5
FROM split d LEFT JOIN joined j USING (doc_id)
""",
    "op11_filter_audit": r"""
WITH read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
judged AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(words) < 100,
          'B': 100 * len(list_distinct(words)) < 80 * len(words),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)} AS f
  FROM read LEFT JOIN judged USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
vectors AS (
  SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS f, count(*) AS n FROM flagged GROUP BY ALL),
steps AS (
  SELECT part, filter_order, step, good, toxic, n,
         f[ascii(substr(filter_order, step, 1)) - 64] AS fails,
         list_count(list_filter(f, lambda x: x)) AS n_fails,
         list_bool_or(list_transform(range(1, step + 1), lambda k: f[ascii(substr(filter_order, k, 1)) - 64])) AS gone,
         coalesce(list_bool_or(list_transform(range(1, step), lambda k: f[ascii(substr(filter_order, k, 1)) - 64])), false) AS before
  FROM vectors, orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS x,
         coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT before AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (fails AND NOT before AND toxic), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
""",
}
