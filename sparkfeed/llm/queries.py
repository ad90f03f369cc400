"""The corpus operators as queries over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, fill_middle, html_text, language_id, license_scan, packing, probminhash, quality_mil, quality_rules, spelling, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.license_scan(_table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    back = warc.archive_pages(pages).where("warc_type <> 'warcinfo'")
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("source_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_id").cast(kind).alias("refers_to"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_measures(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    m, failed = F.col("measures"), F.size("base_broken") > 0
    return found.select(
        "doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"), (~failed & (F.size("broken") == 0)).alias("kept"),
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup.with_digest(docs)


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_mil.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_mil.score(docs, model)
    return scored.select("doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe_codec.decode(bpe_codec.encode(_table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), bpe_codec.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(spelling.word_runs(_table(spark, sf_dir, "documents")))
    return spelling.group_variants(words)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_warc, op3_quality_rules, op4_pack, op5_exact_dedup, op6_quality_mil, op7_html_text, op8_token_counts, op9_probminhash, op10_bpe_codec, op11_spelling_variants, op12_fill_middle, op13_language_id, pipeline)
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(w.lower() for w in quality_rules.STOP_WORDS))

ORACLE_SQL = {
    # the base32 digits of a SHA-1, five hex digits at a time
    "op2_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * k AS INTEGER)) & 31)::INTEGER, 1)), '')), '') AS payload_digest FROM p
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (payload_digest)""",
    "op3_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(len(words) - 7), lambda i: {{'i': i, 'win': array_to_string(words[i + 1 : i + 8], ' ')}})) AS x FROM t WHERE len(words) >= 8),
c AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.win) AS n FROM w),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, i - coalesce(before, i - 8))) AS n_repeat_words FROM g GROUP BY 1),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS n_stop_words,
    len(list_filter(words, lambda w: length(w) > 1 AND upper(w) = w AND lower(w) <> w)) AS n_upper_words,
    len(list_filter(lines, lambda l: l LIKE '%...' OR l LIKE '%…')) AS n_ellipsis_lines,
    len(list_filter(lines, lambda l: regexp_matches(ltrim(l, ' '), '^[-*•]'))) AS n_bullet_lines,
    len(regexp_extract_all(text, '{quality_rules.OTHER_SCRIPTS}')) AS n_other_chars FROM t LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ((word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words OR n_stop_words < 0.03 * n_words) AND n_other_chars <= {quality_rules.OTHER_SHARE} * word_chars OR n_symbols > 0.30 * n_words
    OR n_dup_lines > 0.50 * n_lines OR n_ellipsis_lines > 0.50 * n_lines OR n_bullet_lines > 0.95 * n_lines OR n_upper_words > 0.40 * n_words) AS kept
FROM v""",
    # CRC-32 by its shift rule: a table of 256 remainders, then a step for each byte of the UTF-8
    "op11_spelling_variants": """
WITH RECURSIVE crc AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM range(256) x(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
hashed AS (SELECT run, m, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(id || ':' || run)), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 + 1 AS INTEGER)])), 4294967295) AS h FROM each, crc),
slipped AS (SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3),
gaps AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, CAST(i AS INTEGER)) AS a, substr(word, CAST(i + 2 AS INTEGER)) AS b FROM gaps),
near AS (SELECT x.word, x.n, y.word AS w, y.n AS wn FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN v y ON y.word = x.a || x.b
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN v y ON y.word = x.a || x.b),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY wn DESC, encode(w)) AS r FROM near),
best AS (SELECT word, n_near, CASE WHEN wn >= 2 * n THEN w END AS form, CASE WHEN wn >= 2 * n THEN wn END AS form_n FROM ranked WHERE r = 1),
chain AS (SELECT word, word AS root, 0 AS k FROM v UNION ALL SELECT c.word, b.form, c.k + 1 FROM chain c JOIN best b ON b.word = c.root WHERE b.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY 1)
SELECT v.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM v JOIN roots USING (word) LEFT JOIN best USING (word)""",
    "op12_fill_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, text, form, coalesce(array_to_string(u[1 : a], ''), '') AS pre, coalesce(array_to_string(u[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(u[b + 1 : n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
    "op5_exact_dedup": """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
}
