"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import benchmark_hits
from .edits import count_tokens, masking_edits
from .extraction import extract_text
from .filter_audit import audit_filters
from .jaccard import jaccard_components
from .lattice import score_texts
from .licences import scan_licences
from .manifest import merkle_manifest
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .pii import find_pii, train_pii
from .sharding import shard_documents
from .toxicity import score_toxicity, train_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"ids_crc32": F.crc32("ids")}
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), payload=digest)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(_table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def may_learn(modulus: int):
    """Rows to learn from: crc32 of the id as text leaves a remainder other than 2; without an id there is none."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != 2, F.lit(True))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, train_toxicity(docs, labels.filter(may_learn(4))))
    return scored.select("doc_id", (~may_learn(4)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, neighbours=20)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(_table(spark, sf_dir, "documents"), threshold=0.8)
    names = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *names, "score", "closest")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), may_learn(7), _tokenizer("piece_bpe_32k.model"))
    return scored.select("doc_id", (~may_learn(7)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _spelled(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = find_pii(docs, train_pii(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(_spelled("base").cast("binary"), 256).alias("base_sha256"), _spelled("spans").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(masking_edits(_table(spark, sf_dir, "documents")), _tokenizer("byte_bpe_50k.tiktoken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return merkle_manifest(_table(spark, sf_dir, "documents"), F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


_ALL = (op1_best_fit_packing, op2_ngram_jaccard_join, op3_sharding, op4_toxicity, op5_nearest_neighbours, op6_license_scans, op7_benchmark_decontamination, op8_lm_scoring, op9_pii, op10_token_counts, op11_merkle_manifest, op12_filter_audit, op13_html_extraction)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id WHERE 100 * k >= 80 * (sx.n + sy.n - k)),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reached JOIN links ON doc_id = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY ALL""",
    "op7_benchmark_decontamination": rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
places AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, i, size, item_id FROM places JOIN windows USING (g, size)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY 1),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE crc(value, c) AS (SELECT range, range FROM range(256)),
stepped AS (SELECT value, list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM crc),
crc_table AS (SELECT list(c ORDER BY value) AS t FROM stepped),
texts AS (
  SELECT *, CASE WHEN list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])) & 1 = 1
    THEN replace(text, chr(10), '') ELSE text END AS altered
  FROM documents, crc_table),
coded AS (
  SELECT doc_id, source, text, altered,
    concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head
  FROM texts),
leaves AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, sha256(head || CASE WHEN altered IS NULL THEN '-' ELSE strlen(altered) || ':' || altered END) AS changed FROM coded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
up(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY place) FROM ranked GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM up WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM top WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
steps AS (
  SELECT r.source, r.place, 0 AS tree, level, nodes, (r.place // (3 ** level)::BIGINT) AS k FROM ranked r JOIN up ON r.source IS NOT DISTINCT FROM up.source WHERE len(nodes) > 1
  UNION ALL SELECT r.source, r.place, 1, level, nodes, (s.place // (3 ** level)::BIGINT) FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source, top WHERE len(nodes) > 1),
sides AS (SELECT source, place, tree, level, array_to_string(nodes[k // 3 * 3 + 1:k], '') AS l, array_to_string(nodes[k + 2:k // 3 * 3 + 3], '') AS r FROM steps),
paths AS (SELECT source, place, list(l || '|' || r ORDER BY tree, level) AS path, string_agg(l || r, '' ORDER BY tree, level) AS proof FROM sides GROUP BY ALL),
folded AS (
  SELECT ranked.*, coalesce(proof, '') AS proof, list_reduce(list_prepend(changed, coalesce(path, [])), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) AS folded_root
  FROM ranked LEFT JOIN paths ON ranked.source IS NOT DISTINCT FROM paths.source AND ranked.place = paths.place)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots ON folded.source IS NOT DISTINCT FROM subroots.source, root""",
    "op12_filter_audit": r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < words.doc_id, false)::INT AS mask
  FROM words JOIN firsts USING (t) LEFT JOIN marked ON words.doc_id = marked.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) r(step)),
done AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM done""",
    # these tables' pages mark their articles; other markup is held against known pages in the tests
    "op13_html_extraction": r"""
WITH cut AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g'), '</?(h1|p)>') AS parts FROM pages),
bare AS (SELECT page_id, url, list_transform(parts, lambda b: regexp_replace(b, '<[^>]*>', '', 'g')) AS parts FROM cut),
plain AS (
  SELECT page_id, url, list_transform(parts, lambda b: replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS parts FROM bare),
blocks AS (SELECT page_id, url, list_filter(list_transform(parts, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS parts FROM plain)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM blocks""",
}
