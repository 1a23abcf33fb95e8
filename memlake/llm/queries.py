"""The numbered queries over the tables of a folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm import bpe, embeddings, jaccard, kneser_ney, langid, mixing, negatives, packing, phrases, quality, secrets, sharding, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.with_secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = kneser_ney.score(docs, kneser_ney.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_quality(docs, _table(spark, sf_dir, "labels")).drop("text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return sharding.shard_uniform(docs, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = langid.learn_profiles(docs.where(~held_out))
    return langid.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(
            F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
        ).alias("vec"), (F.col("vec_id") % 100 == 0).alias("anchor"),
    )
    return negatives.hard_negatives(rows)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents")))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `op12_source_mixing` says of sizes and targets, the words that it takes of each source, and whether it takes too many of a document."""
    out = op12_source_mixing(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return out.select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), F.sum("taken").over(Window.partitionBy("source")).cast("long").alias("source_taken"), (F.col("taken") > 3 * F.col("size")).alias("too_many")
    )


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind `op1_secret_scans` finds."""
    return op1_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of `op7_quality_rules` that need no model."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & F.col("base_failed")).alias("wrongly_kept"))


def base_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `op5_lm_scoring` says without its model."""
    return op5_lm_scoring(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, different and last slots of each shard of `op10_sharding`, and its bytes in all."""
    out = op10_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("size"))
    return out.select("shard", "n", "slots", "last", F.sum("size").over(Window.partitionBy()).cast("long").alias("total_size"))


QUERIES = {
    f.__name__: f for f in (op1_secret_scans, op2_best_fit_packing, op3_language_id, op4_embedding_near_dedup, op5_lm_scoring, op6_substring_dedup, op7_quality_rules, op8_ngram_jaccard_join, op9_byte_bpe, op10_sharding, op11_hard_negatives, op12_source_mixing, op13_phrase_mining)
} | {f.__name__: f for f in (base_secrets, base_quality, base_lm, base_shards, base_mixing)}
_COMPONENTS = """reach AS (SELECT id, id AS r FROM ids UNION SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.r),
component AS (SELECT id, MIN(r) AS component_id FROM reach GROUP BY 1)"""

#: What the queries must return, where SQL can say it.
SQL: dict[str, str] = {
    "op4_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ids AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
{_COMPONENTS}
SELECT e.vec_id, COALESCE(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY 1) l ON l.a = e.vec_id""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS start FROM w WHERE len(ws) >= 20),
d AS (SELECT doc_id, start FROM (SELECT doc_id, start, ROW_NUMBER() OVER (PARTITION BY array_to_string(ws[start : start + 19], ' ') ORDER BY doc_id, start) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS p FROM d),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, COUNT(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - COALESCE(n, 0))::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i : i + 2], ' '))) AS shingle FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
ids AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id FROM w JOIN component c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10""",
    "op13_phrase_mining": rf"""
WITH t AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM w, range(1, 4) AS r(m)),
f AS (SELECT lang, m, phrase, COUNT(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
inside AS (SELECT lang, array_to_string(ws[i : i + 1], ' ') AS phrase, MAX(a) AS most FROM c, range(1, 3) AS r(i) WHERE m = 3 GROUP BY ALL),
ks AS (SELECT lang, phrase, a, ws, unnest(range(1, m)) AS k FROM c),
parts AS (SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : len(ws)], ' ') AS rest FROM ks),
cut AS (SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000""",
    "base_mixing": r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM t GROUP BY 1),
r AS (SELECT *, SUM(source_size) OVER () AS total, SUM(w) OVER () AS ws, COALESCE(SUM(3 * source_size) OVER o, 0) AS cut, COALESCE(SUM(w) OVER o, 0) AS gone FROM s
  WINDOW o AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - cut) / (ws - gone) AS level FROM r WHERE (total - cut) / (ws - gone) <= 3.0 * source_size / w ORDER BY 3.0 * source_size / w, source LIMIT 1),
targets AS (SELECT source, source_size, least(3.0 * source_size, w * level)::DOUBLE AS target FROM r, level)
SELECT doc_id, size, source_size, round(target, 3) AS target, floor(target + 0.5)::BIGINT AS source_taken, FALSE AS too_many FROM t JOIN targets ON t.source IS NOT DISTINCT FROM targets.source""",
    "base_secrets": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)""",
    "base_quality": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) AS gram FROM t WHERE len(ws) >= 5),
twice AS (SELECT r, i FROM g QUALIFY COUNT(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
l AS (SELECT r, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  COALESCE(l.n, 0)::BIGINT AS n_dup_lines, COALESCE(covered.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN l USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, FALSE AS wrongly_kept FROM c""",
    "base_shards": """
WITH t AS (SELECT COUNT(*) AS n, SUM(octet_length(encode(COALESCE(text, ''))) + 1)::BIGINT AS size FROM documents),
s AS (SELECT shard::INTEGER AS shard, n // 16 + CASE WHEN shard < n % 16 THEN 1 ELSE 0 END AS n, size FROM t, unnest(range(16)) AS u(shard))
SELECT shard, n, n AS slots, n - 1 AS last, size AS total_size FROM s WHERE n > 0""",
    "base_lm": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(list_append(ws, ' ')) AS token FROM t),
bits AS (SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS u(k)),
crcs AS (SELECT list(v ORDER BY k) AS crc FROM bits),
own AS (SELECT r, COALESCE(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: xor(c // 256, crc[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 2, FALSE) AS held_out FROM t, crcs),
learnt AS (SELECT token, COUNT(*) AS c FROM w JOIN own USING (r) WHERE NOT held_out GROUP BY 1),
n AS (SELECT COALESCE(SUM(c), 0)::BIGINT AS n, COUNT(*) AS v FROM learnt)
SELECT doc_id, COUNT(*) AS n_tokens, COUNT(c) AS n_known, any_value(n) AS train_tokens, round(SUM(log10((COALESCE(c, 0) + 1) / (n + 1.0 * (v + 1)))), 4) AS base_score
FROM w LEFT JOIN learnt USING (token), n GROUP BY r, doc_id""",
}
