"""Quality rules: hashed n-gram log-likelihood ratios, of a trusted target against the raw corpus and of toxic documents against clean ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed words and word pairs, and the labelled documents that the target is counted on at most
#: (those of the smallest hashes of their ids; a bound on what is broadcast).
BUCKETS, TARGET_DOCS = 1 << 14, 200_000
PRIOR = 8
#: A document is kept if its mean log-likelihood ratio over its n-grams is at least this.
THRESHOLD = -0.12
#: A word is strongly toxic if its log-likelihood ratio (share of the toxic documents that have it against share of the clean
#: ones) is at least STRONG, and the likelihood of its counts is larger by EVIDENCE (as a logarithm) than were it as frequent
#: in both. A document is toxic if the ratios of its strongly toxic words, once each, come to TOXIC.
STRONG, EVIDENCE, TOXIC = 3.0, 12.0, 4.0

#: Separators of words: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def with_hashes(docs: DataFrame) -> DataFrame:
    """`docs` with _w, its words, and _h, their hashes."""
    return docs.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))


def _labelled(labels: DataFrame, which: str, flag: str, most: int) -> DataFrame:
    return (
        labels.where(f"({which}) and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
        .orderBy(F.xxhash64("_id"), "_id").limit(most).withColumn(flag, F.lit(1))
    )


def learn_weights(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, most: int = TARGET_DOCS) -> DataFrame:
    """One row with w: array<double> of n log-likelihood ratios, by bucket; h, l: hash and ratio of the strongly toxic words, by bucket.

    Counts cover all documents (raw) and those labelled quality 1 and not
    toxic (target), in one pass. The target's shares start from the raw ones
    with a weight of PRIOR counts a bucket, so that little evidence moves
    them little; without target documents every ratio is 0.

    The same pass counts, by whole hash, the documents labelled toxic and
    those labelled otherwise that have a word; a document with both labels
    is toxic. Of strongly toxic words in one bucket that of most evidence
    stays. Without documents of both kinds no word is strongly toxic.
    """
    parts = [
        _labelled(labels, "quality = 1 and coalesce(toxic, 0) = 0", "_t", most),
        _labelled(labels, "toxic = 1", "_x", most),
        _labelled(labels, "coalesce(toxic, 0) = 0", "_c", most),
    ]
    flags = [p.select("_id", *(F.col(f) if f in p.columns else F.lit(None).cast("int").alias(f) for f in ("_t", "_x", "_c"))) for p in parts]
    known = (
        flags[0].unionByName(flags[1]).unionByName(flags[2]).groupBy("_id").agg(*(F.max(f).alias(f) for f in ("_t", "_x", "_c")))
        .withColumn("_c", F.expr("if(_x is null, _c, null)"))
    )
    # three times TARGET_DOCS ids of 8 bytes at most are broadcast
    mark = lambda rows: rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left")
    seen = with_hashes(mark(docs.select("doc_id", "text")))
    # words by their whole hash, once a document; below n, where a hash is with a chance of 1e-15, are the buckets
    seen = seen.withColumn("_y", F.expr("slice(_h, 2, size(_h))")).withColumn(
        "_o", F.expr("if(_x is null and _c is null, cast(array() as array<bigint>), array_distinct(_h))")
    )
    # rows of a word, the next one and one of the document's own: compiled code hashes and counts rows, lambdas over arrays are interpreted
    rows = seen.select("_t", "_x", "_c", F.inline(F.arrays_zip("_h", "_y", "_o"))).toDF("_t", "_x", "_c", "x", "y", "o")
    counted = (
        rows.select("_t", "_x", "_c", F.explode(F.expr(f"array(pmod(x, {n}L), if(y is null, null, pmod(xxhash64(y, x), {n}L)), o)")).alias("b"))
        .where("b is not null")
        .groupBy("b").agg(F.count("*").alias("r"), F.count("_t").alias("t"), F.count("_x").alias("x"), F.count("_c").alias("c"))
    )
    totals = mark(docs.select("doc_id")).agg(F.count("_x").cast("double").alias("x"), F.count("_c").cast("double").alias("c"))
    bucket, e = f"b >= 0 and b < {n}", "try_divide((x + c) * _n.x, _n.x + _n.c)"
    judged = (
        counted.withColumn("_n", totals.select(F.struct("x", "c")).scalar())
        .withColumn("l", F.expr("ln((x + 0.5D) / (_n.x + 1)) - ln((c + 0.5D) / (_n.c + 1))"))
        .withColumn("g", F.expr(f"x * ln(try_divide(x, {e})) + if(c = 0, 0D, c * ln(try_divide(c, x + c - {e})))"))
        .where(f"{bucket} or (x > 0 and l >= {STRONG} and g >= {EVIDENCE})")
        .groupBy(F.expr(f"cast(pmod(b, {n}L) as int)").alias("s"))
        .agg(F.max(F.expr(f"if({bucket}, r, null)")).alias("r"), F.max(F.expr(f"if({bucket}, t, null)")).alias("t"),
             F.max(F.expr(f"if({bucket}, null, struct(g, b, l))")).alias("v"))
    )
    # one row per bucket, n in all: small enough for one row of arrays
    filled = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(judged, F.col("b") == F.col("s"), "left")
    row = filled.agg(
        F.collect_list(F.struct("b", "r", "t", F.col("v.b").alias("h"), F.col("v.l").alias("l"))).alias("m"), F.sum("r").alias("R"), F.sum("t").alias("T")
    )
    share = f"((coalesce(x.r, 0) + 1) / (coalesce(R, 0) + {n}))"
    ratio = f"ln((coalesce(x.t, 0) + {PRIOR * n} * {share}) / (coalesce(T, 0) + {PRIOR * n})) - ln({share})"
    return row.withColumn("m", F.array_sort("m")).select(
        F.expr(f"transform(m, x -> {ratio})").alias("w"), F.expr("transform(m, x -> coalesce(x.h, 0L))").alias("h"), F.expr("transform(m, x -> coalesce(x.l, 0D))").alias("l")
    )


def _let(name: str, value: str, body: str) -> str:
    """`body` where `name` stands for `value`, which is computed once also where the optimizer moves the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Hashes of the word pairs, from those of the words.
_PAIRS = "zip_with(slice(_h, 2, size(_h)), slice(_h, 1, greatest(size(_h) - 1, 0)), (x, y) -> xxhash64(x, y))"

#: From the hashes of words and pairs: windows of three words; where a window of five comes twice, three of these have come
#: before. Only then windows of five, sorted with their starts; the starts of those next to an equal one, in order (most texts
#: have none). Each start covers five words, less what the one before covers.
_REPEATED = _let("ts", "zip_with(slice(_p, 1, greatest(size(_h) - 2, 0)), slice(_h, 3, size(_h)), (x, y) -> xxhash64(x, y))",
    "if(size(ts) < 4 or size(array_distinct(ts)) > size(ts) - 3, 0L, " + _let("gs", "zip_with(slice(ts, 1, size(ts) - 2), slice(ts, 3, size(ts)), (x, y) -> xxhash64(x, y))",
    "if(size(array_distinct(gs)) = size(gs), 0L, " + _let("sorted", "sort_array(arrays_zip(gs, sequence(0, size(gs) - 1)))", _let(
        "twice", "filter(zip_with(sorted, slice(sorted, 2, size(sorted)), (x, y) -> if(x.gs = y.gs, named_struct('i', x['1'], 'j', y['1']), null)), x -> x is not null)", _let(
            "starts", "sort_array(array_distinct(concat(twice.i, twice.j)))",
            "aggregate(transform(starts, (x, k) -> if(k = 0, 5, least(5, x - get(starts, k - 1)))), 0L, (a, x) -> a + x)"))) + ")") + ")")


def with_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score, toxic_score, kept.

    A null or empty text has no words and fails. Repeated rows are judged
    alike; columns of `docs` with these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "toxic_score", "kept"]
    weights = learn_weights(docs, labels, n)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    out = (
        with_hashes(docs.drop(*made))
        .withColumn("_p", F.expr(_PAIRS))
        .withColumn("n_repeat_words", F.expr(_REPEATED))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("_l", lines)
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    )
    # the weights are taken from their row once a document
    total = _let("w", "_r.w", f"aggregate(zip_with(slice(_h, 2, size(_h)), _p, (x, y) -> w[pmod(x, {n})] + w[pmod(y, {n})]), w[pmod(get(_h, 0), {n})], (a, x) -> a + x)")
    toxic = _let("hs", "_r.h", f"aggregate(array_distinct(filter(_h, x -> hs[pmod(x, {n})] = x)), 0D, (a, x) -> a + _r.l[pmod(x, {n})])")
    return (
        out.withColumn("_r", weights.select(F.struct("w", "h", "l")).scalar())
        .withColumn("score", F.when(F.size("_h") > 0, F.expr(total) / (2 * F.size("_h") - 1)))
        .withColumn("toxic_score", F.expr(toxic))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)) & (F.col("toxic_score") < TOXIC))
        .drop("_w", "_h", "_p", "_l", "_r")
    )
