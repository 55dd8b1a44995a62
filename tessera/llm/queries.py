"""The corpus operators as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, jaccard, languages, manifest, phrases, pieces, quality, secrets, shards, substrings, toxicity, urls

#: Where the public tokenizer's model lies.
MODEL = os.environ.get("TESSERA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", "name", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = chat.format_preferences(turns, chat.swapped_answers(turns))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["length"])), ";").alias(c)
    return out.select("conv_id", F.col("n_prefix").cast("bigint").alias("n_prefix"), "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, MODEL, keep_text=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), digest.alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = languages.identify(docs, languages.learn(docs))
    return out.select("doc_id", languages.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.manifest(table(spark, sf_dir, "documents"), changed={"text": manifest.lowered("doc_id", "text")})
    return out.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_secret_scans, op3_chat_formatting, op4_ngram_jaccard_join, op5_url_filters, op6_benchmark_decontamination, op7_quality_rules, op8_substring_dedup,
        op9_sentencepiece, op10_toxicity, op11_phrase_collocations, op12_language_id, op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {}

SQL["op3_chat_formatting"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
last AS (SELECT conv_id, max_by(turn, turn) AS last, max_by(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
rej AS (
  SELECT t.conv_id, t.turn, t.role, CASE WHEN t.role = 'assistant' AND t.turn = l.last THEN o.answer ELSE t.text END AS text
  FROM t LEFT JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = t.conv_id + 1
  WHERE NOT coalesce(t.role = 'assistant' AND t.turn = l.last, false) OR o.conv_id IS NOT NULL),
num AS (
  SELECT 'chosen' AS side, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM t
  UNION ALL SELECT 'rejected', *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 FROM (SELECT DISTINCT * FROM rej)),
cmp AS (SELECT conv_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS eq FROM num GROUP BY conv_id, pos),
ends AS (SELECT conv_id, coalesce(min(CASE WHEN NOT eq THEN pos END), max(pos) + 1) AS n_prefix FROM cmp GROUP BY conv_id),
parts AS (
  SELECT conv_id, n_prefix, pos, role, CASE WHEN pos < n_prefix THEN 'prompt' ELSE side END AS part,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body
  FROM num JOIN ends USING (conv_id) WHERE NOT (pos < n_prefix AND side = 'rejected')),
spans AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY conv_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS start FROM parts)
SELECT conv_id, n_prefix,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(start::BIGINT || ':' || (length(body) - length(role) - 5), ';' ORDER BY pos) FILTER (WHERE part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(start::BIGINT || ':' || (length(body) - length(role) - 5), ';' ORDER BY pos) FILTER (WHERE part = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id, n_prefix
"""

SQL["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
sets AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS node FROM s GROUP BY ALL),
of AS (SELECT doc_id, len(s.s) AS n, node FROM s JOIN sets ON list_sort(s.s) = sets.s),
e AS (SELECT node, n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, other) AS (SELECT node, node FROM sets UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT node, min(other) AS comp FROM reach GROUP BY node)
SELECT of.doc_id, of.n AS n_shingles, CASE WHEN of.n = 0 THEN of.doc_id ELSE comp END AS component_id FROM of JOIN comp USING (node)
"""

SQL["op6_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bl))),
hit AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw USING (l, g)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (g)) GROUP BY 1),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT word.doc_id, word.i, word.w[word.i] AS x FROM word LEFT JOIN (SELECT doc_id, unnest(p) AS i FROM gone) g ON g.doc_id = word.doc_id AND g.i = word.i WHERE g.i IS NULL),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) ks(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
over AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c l ON s.lang = l.lang AND l.k > s.k AND 100 * l.a >= 100 * s.a AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ')),
kept AS (SELECT c.* FROM c ANTI JOIN over USING (lang, phrase)),
cut AS (SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT cut.lang, cut.phrase, a, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y JOIN n ON n.lang = cut.lang),
weak AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weak
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_transform([0] || range(1, strlen(doc_id::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE ascii((doc_id::VARCHAR)[i:i])::BIGINT END),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM documents),
fields AS (
  SELECT doc_id, lang, crc, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS f, text,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM d),
leaf AS (
  SELECT doc_id, lang, sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(array_to_string(f, '') || coalesce(strlen(changed) || ':' || changed, '-')) AS again FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
-- a level holds its runs; the next one is made of their hashes
lower(lang, level, pos, hash, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM lower WHERE n > 1 GROUP BY lang, level, pos // 8, n),
sub AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower WHERE n = 1),
upper(level, pos, hash, n) AS (
  SELECT 0, pos, subroot, n FROM sub
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
lower_runs AS (SELECT lang, level, pos // 8 AS run, list(hash ORDER BY pos) AS c FROM lower WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, pos // 8 AS run, list(hash ORDER BY pos) AS c FROM upper WHERE n > 1 GROUP BY ALL),
climb(doc_id, leaf, lang, place, level, pos, hash, sides) AS (
  SELECT doc_id, leaf, lang, pos, 0, pos, again, '' FROM placed
  UNION ALL SELECT doc_id, leaf, b.lang, place, b.level + 1, pos // 8, sha256(array_to_string(c[:pos % 8], '') || hash || array_to_string(c[pos % 8 + 2:], '')), sides || array_to_string(c[:pos % 8], '') || array_to_string(c[pos % 8 + 2:], '')
  FROM climb b JOIN lower_runs r ON r.lang IS NOT DISTINCT FROM b.lang AND r.level = b.level AND r.run = b.pos // 8),
low AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY lang, place ORDER BY level DESC) = 1),
rise(doc_id, leaf, lang, place, subroot, level, pos, hash, sides) AS (
  SELECT doc_id, leaf, low.lang, place, subroot, 0, sub.pos, hash, sides FROM low JOIN sub ON sub.lang IS NOT DISTINCT FROM low.lang
  UNION ALL SELECT doc_id, leaf, b.lang, place, subroot, b.level + 1, pos // 8, sha256(array_to_string(c[:pos % 8], '') || hash || array_to_string(c[pos % 8 + 2:], '')), sides || array_to_string(c[:pos % 8], '') || array_to_string(c[pos % 8 + 2:], '')
  FROM rise b JOIN upper_runs r ON r.level = b.level AND r.run = b.pos // 8),
high AS (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY lang, place ORDER BY level DESC) = 1),
root AS (SELECT hash AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(sides) AS proof_sha256, hash AS folded_root, hash = root AS verified FROM high, root
"""
