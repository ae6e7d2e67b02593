"""One query for each operator of this folder over the test tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    html_extraction,
    importance_resampling,
    language_id,
    neighbours,
    quality_rules,
    secret_scan,
    simhash,
    source_divergence,
    substring_dedup,
    token_counts,
)
from spanmill.session import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under the name of its function."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1 = """
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[ \\t\\r\\n]*[^.!?\\n]*[.!?\\n]+[ \\t\\r\\n]*|[^.!?\\n]+') AS parts FROM documents
), pieces AS (
  SELECT doc_id, i, parts[i] AS part, regexp_extract_all(parts[i], '[^ \\t\\r\\n]+') AS w
  FROM cut, unnest(generate_series(1, len(parts))) AS t(i)
), places AS (
  SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, array_to_string(w, ' ') AS words FROM pieces
), spans AS (
  SELECT a.doc_id, a.i, b.i AS j FROM places AS a JOIN places AS b
  ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 26 AND b.upto - a.upto + len(a.w) >= 25
), runs AS (
  SELECT doc_id, i, min(j) AS j FROM spans GROUP BY ALL UNION SELECT doc_id, max(i), j FROM spans GROUP BY doc_id, j
), spelled AS (
  SELECT r.doc_id, r.i, r.j, string_agg(p.words, ' ' ORDER BY p.i) AS k
  FROM runs AS r JOIN places AS p ON r.doc_id = p.doc_id AND p.i BETWEEN r.i AND r.j GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM spelled),
covered AS (SELECT DISTINCT doc_id, x FROM ranked, unnest(generate_series(i, j)) AS t(x) WHERE place > 1)
SELECT c.doc_id, coalesce(string_agg(p.part, '' ORDER BY p.i) FILTER (v.x IS NULL), '') AS text,
  count(p.i) AS n_sentences, count(v.x) AS n_removed, count(v.x) > 0 AS changed
FROM cut AS c LEFT JOIN pieces AS p ON c.doc_id = p.doc_id LEFT JOIN covered AS v ON p.doc_id = v.doc_id AND p.i = v.x
GROUP BY c.doc_id
"""


@query(OP1)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).withColumn("changed", F.col("n_removed") > 0)


OP2 = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM item_words, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM doc_words, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
), found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, k)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), parts AS (
  SELECT CAST(item_id AS VARCHAR) AS item, i AS j, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM item_words, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), met AS (SELECT doc_id, i, n, item, i - j AS diagonal FROM places JOIN parts USING (n, k)),
stretches AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, diagonal ORDER BY i) AS stretch FROM met),
verbatim AS (
  SELECT doc_id, item, min(i) - 1 AS start, max(i) + n - min(i) AS size FROM stretches GROUP BY doc_id, item, diagonal, stretch, n
), longest AS (
  SELECT doc_id, item, start, size FROM verbatim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start, item) = 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(size, 0) AS INTEGER) AS longest_match, CAST(start AS INTEGER) AS longest_start, item AS longest_item
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


@query(OP2)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    contract = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return found.select(*contract, "longest_match", "longest_start", "longest_item")


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


OP4 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
), marked AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS past,
    lead(0, 1, 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last,
    regexp_replace(text, '([\\\\#/])', '\\\\\\1', 'g') AS safe
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length('### : ') + length(safe) + length('</turn>') + 1) AS BIGINT) AS formatted_chars,
  bool_and((past, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND bool_or(last = 1 AND role = 'assistant') AS valid_order
FROM marked GROUP BY conv_id
"""


@query(OP4)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    return chat_format.read_back(chat_format.segments(turns.union(more)))


@query()
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.compared(table(spark, sf_dir, "pages"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = [F.col("doc_id").cast("bigint"), language_id.held_out()]
    found = language_id.predict(docs, language_id.learned(docs), keys, "doc_id bigint, held_out boolean")
    return found.withColumn("rejected", F.col("score") < language_id.Parameters().min_margin)


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encoded(docs, [F.col("doc_id").cast("bigint")], "doc_id bigint", with_ids=False)


OP8 = """
WITH live AS (
  SELECT d.doc_id, d.source, d.lang, CASE WHEN l.quality = 0 THEN regexp_replace(d.text, '[*&%$#!]{2,}', '', 'g') ELSE d.text END AS text
  FROM documents AS d LEFT JOIN labels AS l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1
), counts AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n FROM live
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N} \\t\\r\\n]')) FROM live
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts GROUP BY ALL
"""


@query(OP8)
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; those labelled toxic are taken down; those of low quality are cleaned and counted anew.

    The two later batches are delivered twice, as after a lost acknowledgement.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    low = labels.where("quality = 0 and coalesce(toxic, 0) <> 1").select("doc_id").distinct()
    cleaned = docs.withColumn("text", F.regexp_replace("text", r"[*&%$#!]{2,}", ""))
    rollup = token_counts.Rollup(spark, scratch(spark, "token-counts"))
    rollup.commit(1, token_counts.counted(docs, "insert", 1))
    # Counts meet the labels, not texts.
    deletes = token_counts.removed(docs, 2).join(toxic, "doc_id", "left_semi")
    revised = token_counts.counted(cleaned, "revise", 3).join(low, "doc_id", "left_semi")
    later = {2: deletes, 3: revised}
    for batch, changes in [*later.items(), *later.items()]:
        rollup.commit(batch, changes)
    return rollup.totals()


@query()
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.spelled("bits").alias("fingerprint"), "component_id")


OP11 = """
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30
), counts AS (
  SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
), shares AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p
  FROM counts WINDOW g AS (PARTITION BY lang, source)
), whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
language AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS q
  FROM whole WINDOW g AS (PARTITION BY lang)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value
  FROM shares JOIN language USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query(OP11)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


OP12 = """
WITH cut AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT row, i, array_to_string(w[i:i + 7], ' ') AS k FROM cut, unnest(generate_series(1, len(w) - 7)) AS t(i)
), twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM windows),
again AS (
  SELECT row, count(DISTINCT p) AS n FROM twice, unnest(generate_series(i, i + 7)) AS t(p) WHERE n > 1 GROUP BY ALL
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(w, lambda x: list_contains([{stop}], lower(x)))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines
  FROM cut LEFT JOIN again USING (row)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',',
    CASE WHEN 1000 * word_chars < 2000 * n_words OR 1000 * word_chars > 12000 * n_words THEN 'word_length' END,
    CASE WHEN 1000 * n_symbols > 100 * n_words THEN 'symbols' END,
    CASE WHEN 1000 * n_capitals > 300 * word_chars THEN 'capitals' END,
    CASE WHEN 1000 * n_stop_words < 20 * n_words THEN 'stop_words' END,
    CASE WHEN 1000 * n_dup_lines > 500 * n_lines THEN 'duplicate_lines' END,
    CASE WHEN 1000 * n_ellipsis_lines > 300 * n_lines THEN 'ellipsis_lines' END,
    CASE WHEN 1000 * n_bullet_lines > 900 * n_lines THEN 'bullet_lines' END) AS broken
  FROM counts
)
SELECT *, NOT base_failed AND broken = '' AS kept FROM judged
""".replace("{stop}", ", ".join(f"'{w}'" for w in quality_rules.stop_words()))


@query(OP12)
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query()
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
