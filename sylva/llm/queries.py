"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .bpe import encode_texts
from .common import fold, shared_path, small_batches, table
from .decontaminate import find_leaks
from .langid import identify, learn_dictionaries
from .license_scan import scan_licenses
from .ngram_join import similar
from .periodic_runs import find_runs
from .pii import find_pii, fit_tagger
from .ranked_search import TERM, ranked_search
from .secret_scan import ACCESS, ASSIGN, HEX, scan_secrets
from .token_store import read_tokens, write_tokens
from .toxicity import fit, score
from .url_filter import judge


def whole(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, name)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(whole(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    labels = whole(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = fit(docs.where(~F.col("held_out")), labels)
    return score(docs, model).drop("text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(whole(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(whole(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    dictionaries = learn_dictionaries(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), dictionaries).drop("text")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_tokens(whole(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return read_tokens(spark, path, with_ids=False)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False, digest=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, whole(spark, sf_dir, "benchmark")).where(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.edits").alias("edits"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole(spark, sf_dir, "documents").select("doc_id", "text")
    return find_pii(docs, fit_tagger(docs)).drop("text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(whole(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return find_runs(whole(spark, sf_dir, "documents"), planted=seed)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(whole(spark, sf_dir, "documents"), whole(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(whole(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_token_output": op6_token_output,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(l) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')))) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] END AS grams FROM w
), k AS (SELECT doc_id, grams, CASE WHEN grams IS NULL THEN 'none ' || doc_id ELSE md5(array_to_string(grams, '|')) END AS key FROM s),
c AS (SELECT key, min(doc_id) AS copy_id, count(*) AS n_copies, any_value(grams) AS grams FROM k GROUP BY 1),
g AS (SELECT key, len(grams) AS n, unnest(grams) AS gram FROM c),
p AS (SELECT a.key AS a, b.key AS b, count(*) AS x, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.gram = b.gram AND a.key < b.key GROUP BY 1, 2),
half AS (SELECT a, b FROM p WHERE x >= 0.8 * (na + nb - x) - 1e-9), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT key, copy_id AS label FROM c UNION SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.key),
classes AS (SELECT key, min(label) AS class_id FROM reach GROUP BY 1),
counted AS (SELECT links.a AS key, sum(c.n_copies) AS others, count(*) AS texts FROM links JOIN c ON c.key = links.b GROUP BY 1)
SELECT k.doc_id, class_id, copy_id, n_copies, (n_copies - 1 + coalesce(others, 0))::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_text_links
FROM k JOIN c USING (key) JOIN classes USING (key) LEFT JOIN counted USING (key)""",
    "op11_periodic_runs": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l,
 CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) END AS h FROM documents),
e AS (SELECT r, doc_id, l, len(l) AS n, h % 10 = 0 AND len(l) > 0 AS planted, CASE WHEN len(l) > 0 THEN (h // 10) % len(l) ELSE 0 END AS a, (h // 10) % 8 AS k FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN l[i + 1] ELSE l[a + (i - a) % (1 + (n - a) // (3 + k)) + 1] END) ELSE l END AS l FROM e),
w AS (SELECT r, n, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM t),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON y.r = x.r AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
runs AS (SELECT r, start, length, min(q) AS period FROM islands GROUP BY 1, 2, 3),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT w.r, w.i FROM w JOIN runs ON runs.r = w.r AND w.i >= start + period AND w.i < start + length),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS text FROM w LEFT JOIN gone ON gone.r = w.r AND gone.i = w.i WHERE gone.r IS NULL GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, (1000 * best.length // best.period) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
    "op12_ranked_search": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(l) AS n FROM d WHERE len(l) > 0), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
i AS (SELECT DISTINCT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS l FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT item_id, text, unnest(l) AS term FROM i), asked AS (SELECT item_id, text, term, count(*) AS times FROM it GROUP BY 1, 2, 3),
x AS (SELECT r, unnest(l) AS term FROM d), tf AS (SELECT r, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total.n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY 1),
imp AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS s FROM tf JOIN n USING (r) JOIN w USING (term), total),
sc AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(times * s)::BIGINT AS score FROM asked JOIN imp USING (term) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_secret_scan": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p(kind, pattern) AS (VALUES (0, '{ASSIGN.replace("'", "''")}'), (1, '{ACCESS}'), (2, '{HEX}'), (3, '[0-9a-zA-Z+/_=-]{{20,}}')),
f AS (SELECT r, kind, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, '{ASSIGN.replace("'", "''")}', 2) AS vals FROM d, p WHERE regexp_matches(text, pattern)),
e AS (SELECT r, kind, unnest(found) AS s, unnest(gaps[1:len(found)]) AS gap, unnest(CASE WHEN kind = 0 THEN vals ELSE found END) AS val, generate_subscripts(found, 1) AS k FROM f),
b AS (SELECT r, kind, s, val, sum(length(gap) + length(s)) OVER (PARTITION BY r, kind ORDER BY k) AS stop FROM e),
base AS (SELECT r, kind, stop - length(s) AS start, stop FROM b WHERE kind < 3 AND (kind > 0 OR length(val) >= 12)),
c AS (SELECT r, s, stop - length(s) AS start, CASE WHEN NOT regexp_matches(s, '[0-9]') THEN NULL WHEN regexp_matches(s, '[a-fA-F]') AND regexp_full_match(s, '[0-9A-Fa-f]+') THEN 2.9 WHEN regexp_matches(s, '[a-zA-Z]') AND regexp_full_match(s, '[0-9A-Za-z]+') THEN 3.7 WHEN regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') THEN 3.9 END AS least FROM b WHERE kind = 3
 AND NOT regexp_matches(s, '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}') AND NOT regexp_matches(s, '^sha(1|256|384|512)-') AND NOT regexp_matches(lower(s), 'example|sample|dummy|placeholder|changeme|your[_-]|xxxx|abcdef|bcdefg|0123456|1234567|9876543')),
h AS (SELECT r, start, list_filter(range(1, length(s) - 18), lambda i: list_entropy(string_split(substr(s, i, 20), '')) >= least) AS high FROM c WHERE least IS NOT NULL),
added AS (SELECT r, 3 AS kind, start + high[1] - 1 AS start, start + high[-1] + 19 AS stop FROM h WHERE len(high) > 0),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = a.r AND base.start < a.stop AND base.stop > a.start)),
said AS (SELECT r, kind, start, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS say FROM spans)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
 sha256(coalesce(string_agg(say, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(say, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN said USING (r) GROUP BY r""",
}
