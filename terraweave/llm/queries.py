"""The queries of this package, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from terraweave.llm import decontamination, extraction, lexical, licenses, lines, mixing, sharding, simhash, spelling, substrings, token_files, topk, toxicity


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_mixing(spark, sf_dir):
    return mixing.mix(_docs(spark, sf_dir))


def op4_sharding(spark, sf_dir):
    return sharding.shard(_docs(spark, sf_dir))


def op8_licenses(spark, sf_dir):
    return licenses.scan(_docs(spark, sf_dir))


def op9_simhash(spark, sf_dir):
    return simhash.fingerprint_groups(_docs(spark, sf_dir))


def op1_substring_dedup(spark, sf_dir):
    return substrings.deduplicate(_docs(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    return lines.deduplicate(_docs(spark, sf_dir)).drop("text")


def op5_toxicity(spark, sf_dir):
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_extraction(spark, sf_dir):
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_decontamination(spark, sf_dir):
    return decontamination.hits(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_lexical_search(spark, sf_dir):
    return lexical.rank(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_spelling(spark, sf_dir):
    return spelling.group(_docs(spark, sf_dir))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql():
    return dict(SQL)


def _single(c: str) -> str:
    """Letters from U+00C0 to U+00FF as other single bytes: DuckDB's levenshtein counts bytes."""
    return f"translate({c}, '{''.join(map(chr, range(0xC0, 0x100)))}', '{''.join(map(chr, range(33, 97))).replace(chr(39), chr(39) * 2)}')"


SQL = {
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op3_mixing": r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM base GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY (source IS NULL)::INT, source) - 1) % 3 + 1 AS weight FROM per),
sums AS (SELECT *, coalesce(sum(source_size * 3) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS weight_before,
    sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight
  FROM weighed WINDOW b AS (ORDER BY source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
units AS (SELECT *, (all_words - capped)::DOUBLE / (all_weight - weight_before)::DOUBLE AS unit FROM sums),
flags AS (SELECT *, unit * weight > source_size * 3 AS is_capped FROM units),
targets AS (SELECT source, source_size, CASE WHEN is_capped THEN (source_size * 3)::DOUBLE
    ELSE least(max(unit) FILTER (NOT is_capped) OVER () * weight, (source_size * 3)::DOUBLE) END AS target FROM flags),
cfg AS (SELECT greatest(8, ceil(max(n) / 20000.0))::BIGINT AS slices FROM per),
cells AS (SELECT base.*, CASE WHEN size < 64 THEN size ELSE floor(log2(size::DOUBLE) * 16)::BIGINT - 32 END AS bin, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % slices AS slice FROM base, cfg),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bin, slice, size, doc_id) - 1 AS rnk FROM cells),
rated AS (SELECT ranked.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 1.0 END AS rate
  FROM ranked JOIN targets t ON ranked.source IS NOT DISTINCT FROM t.source),
offsets AS (SELECT (2 * k + 1) / 32.0::DOUBLE AS u FROM range(16) r(k)),
tried AS (SELECT source, u, abs(sum(size * least(floor(u + (rnk + 1) * rate) - floor(u + rnk * rate), 3)::INT) - any_value(target)) AS off
  FROM rated, offsets GROUP BY source, u),
chosen AS (SELECT source, arg_min(u, {o: off, u: u}) AS u FROM tried GROUP BY source),
crossed AS (SELECT rated.*, least(floor(u + (rnk + 1) * rate) - floor(u + rnk * rate), 3)::INT AS copies
  FROM rated JOIN chosen ON rated.source IS NOT DISTINCT FROM chosen.source)
SELECT doc_id, source, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM crossed
""",
    "op12_lexical_search": r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lens),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
df AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, nn),
scored AS (SELECT item_id, tf.r, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens ON lens.r = tf.r, whole GROUP BY item_id, tf.r, tf.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
""",
    "op13_spelling": r"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per AS (SELECT doc, run, count(*) AS c FROM runs GROUP BY ALL),
crc AS (SELECT list(v ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) t(b))),
hashed AS (SELECT doc, run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))),
    lambda a, b: xor(a // 256, crcs[xor(a % 256, b) + 1]))) AS h FROM per, crc),
thinned AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM thinned WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word
  AND (left(a.word, length(a.word) // 2) = left(b.word, length(a.word) // 2) OR right(a.word, length(a.word) - length(a.word) // 2 - 1) = right(b.word, length(a.word) - length(a.word) // 2 - 1)) AND levenshtein(""" + _single('a.word') + ", " + _single('b.word') + r""") = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS reached, 0 AS step FROM forms UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""",
}
