"""The operators with production parameters over whole tables, as queries (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, lm, mixing, neardup, pii, quality, substring, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = importlib.import_module("public_tokenizers")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"), 2048)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0, 20)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda c: remainder(c, 5) != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = remainder(F.col("doc_id"), 7)
    return lm.score(table(spark, sf_dir, "documents"), part == 2, part == 3)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.fit(docs))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, period=1000)  # as ORACLE_SQL has it


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), 13)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, lambda c: remainder(c, 4) != 2)
    out = langid.predict(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


_ALL = (op1_token_counts, op2_nearest_neighbours, op3_near_duplicates, op4_quality_classifier, op5_benchmark_decontamination, op6_language_model, op7_pii, op8_mix_sources, op9_substring_dedup, op10_language_id)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(node, label) AS (SELECT doc_id, doc_id FROM words UNION SELECT b, label FROM reach JOIN edges ON a = node WHERE label < b)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, r.label AS component_id, w.doc_id = r.label AS kept
FROM words w LEFT JOIN sizes z ON z.doc_id = w.doc_id JOIN (SELECT node, min(label) AS label FROM reach GROUP BY node) r ON r.node = w.doc_id""",
    "op8_mix_sources": r"""
WITH RECURSIVE counts AS (SELECT coalesce(source, chr(0) || 'none') AS s, count(*) AS n FROM documents GROUP BY ALL),
exact AS (SELECT s, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (1000 - (SELECT count(*) FROM counts)) AS e FROM counts),
shares AS (SELECT s, n, 1 + CAST(floor(e) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, s) <= 1000 - (SELECT CAST(sum(1 + floor(e)) AS BIGINT) FROM exact) THEN 1 ELSE 0 END AS k FROM exact),
lists AS (SELECT list(s ORDER BY s) AS ss, list(k ORDER BY s) AS ks FROM shares),
plan(slot, pick, done) AS (
    SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(ks, lambda x: CAST(0 AS BIGINT)) FROM lists
    UNION ALL
    SELECT slot + 1, p, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END)
    FROM (SELECT slot, done, list_sort(list_transform(list_filter(range(1, len(ks) + 1), lambda i: done[i] < ks[i] AND done[i] * 1000 // ks[i] <= slot + 1), lambda i: {'due': ((done[i] + 1) * 1000 + ks[i] - 1) // ks[i], 'i': i}))[1].i AS p FROM plan, lists WHERE slot < 999)),
slots AS (SELECT ss[pick] AS s, done[pick] AS j, slot, (done[pick] * 1000 + ks[pick] - 1) // ks[pick] AS due FROM plan, lists WHERE slot >= 0),
horizon AS (SELECT min(n // 8 // k * 1000 + slot) AS h FROM shares JOIN slots ON slots.s = shares.s AND slots.j = n // 8 % k + 1),
mixed AS (SELECT doc_id, source, (x * 1103515245 + 12345) % 2147483648 AS key FROM (SELECT doc_id, source, xor(x, x >> 16) AS x FROM (SELECT doc_id, source, (((doc_id % 2147483648) + 2147483648) % 2147483648 * 1103515245 + 12345) % 2147483648 AS x FROM documents))),
ranked AS (SELECT doc_id, source, coalesce(source, chr(0) || 'none') AS s, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 AS r FROM mixed),
placed AS (SELECT doc_id, source, r, r // 8 // k * 1000 AS start, slot, due FROM ranked JOIN shares USING (s) JOIN slots ON slots.s = ranked.s AND slots.j = r // 8 % k + 1)
SELECT doc_id, source, start + slot AS mix_slot, (start + slot) * 8 + r % 8 AS mix_position, start + due AS mix_deadline, start + slot < h AS in_target FROM placed, horizon""",
    "op5_benchmark_decontamination": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
occurs AS (SELECT p.doc_id, p.i, p.n, x.item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)) p JOIN windows x ON x.win = p.win AND x.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM occurs)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM occurs) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op9_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN firsts USING (win) WHERE least < doc_id),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w.w AS w, coalesce(ks, []) AS ks FROM words w LEFT JOIN lists USING (doc_id)),
left_words AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM kept) u WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = u.doc_id AND g.k = u.i) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ks) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept k LEFT JOIN left_words l ON l.doc_id = k.doc_id""",
}
