"""Registered queries of this subpackage, one for each operator, and SQL twins
where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.llm import (ann, collocations, divergence, langid, line_dedup, packing, quality, sharding, simhash,
                            substring_dedup, suffix_dedup, templates, toxicity)
from canopyflow.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), (F.col("n_symbols") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents")).drop("spans")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_suffix_array_dedup, op3_line_dedup, op4_simhash_near_dedup, op5_toxicity,
    op6_benchmark_decontamination, op7_substring_dedup, op8_sharding, op9_approximate_nearest_neighbours,
    op10_language_id, op11_phrase_collocations, op12_quality_classifier, op13_source_divergence, pipeline)}

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 2) AS byte,
             CASE WHEN 2 * i + 100 <= length(h) THEN hash(substring(h, 2 * i + 1, 100)) END AS k,
             CASE WHEN 2 * i + 100 <= length(h) THEN hash(substring(h, 2 * i + 1, 100) || '!') END AS k2 FROM b),
f AS (SELECT k, k2, min(doc_id) AS least FROM w WHERE k IS NOT NULL GROUP BY k, k2),
x AS (SELECT w.doc_id, i, byte, coalesce(least < w.doc_id, false)::INT AS late FROM w LEFT JOIN f USING (k, k2)),
c AS (SELECT doc_id, i, byte, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM x),
s AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM c),
r AS (SELECT doc_id, sum(gone) AS n_removed, sum((gone = 1 AND was = 0)::INT) AS n_spans,
             coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT doc_id, k, line, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS below FROM f),
n AS (SELECT doc_id, k, row_number() OVER (PARTITION BY line, below ORDER BY doc_id, k) AS copy FROM w WHERE below IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i FROM f JOIN (SELECT doc_id, unnest([k, k + 1]) AS k FROM n WHERE copy > 1) USING (doc_id, k))
SELECT l.doc_id, count(gone.i) AS n_lines_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
w AS (SELECT *, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS k FROM b
      WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
x AS (SELECT doc_id, i, word, (n = 20 AND row_number() OVER (PARTITION BY n = 20, k ORDER BY doc_id, i) > 1)::INT AS late FROM w),
c AS (SELECT *, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM x),
r AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def _sql_words(text: str, values: bool) -> str:
    value = r"\2" if values else ""
    for pattern, to in ((templates.NAME, rf"\1µn{value}"), (templates.NAME, rf"\1µn{value}"),
                        (templates.UNIT, rf"\1 µu{value}\3"), (templates.NUMBER, rf"\1µd{value}")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words('text', False)} AS w, {_sql_words('text', True)} AS v FROM documents),
q AS (SELECT item_id, {_sql_words('text', False)} AS w, {_sql_words('text', True)} AS v FROM benchmark),
dw AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i, w FROM d WHERE len(w) > 0),
qw AS (SELECT item_id, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS j, w, greatest(1, len(w) - 7) AS n_windows FROM q WHERE len(w) > 0),
dk AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM dw),
qk AS (SELECT item_id, j, n_windows, array_to_string(w[j:j + 7], ' ') AS k FROM qw
       WHERE len(list_filter(w[j:j + 7], lambda x: x[1] <> 'µ')) >= least(4, len(w))),
m AS (SELECT DISTINCT doc_id, item_id, i - j AS shift, j, n_windows FROM dk JOIN qk USING (k)),
g AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS island FROM m),
r AS (SELECT doc_id, item_id, shift, n_windows, count(*) AS n FROM g GROUP BY ALL),
best AS (SELECT doc_id, item_id, shift, max(n) AS matched FROM r GROUP BY ALL HAVING max(n) >= least(6, any_value(n_windows))),
places AS (SELECT DISTINCT doc_id, item_id, shift, unnest(range(j, j + 8)) AS j FROM m JOIN best USING (doc_id, item_id, shift)),
slots AS (SELECT doc_id, item_id, shift, q.v[j] AS asked, d.v[j + shift] AS said FROM places JOIN q USING (item_id) JOIN d USING (doc_id)
          WHERE j <= len(q.v) AND starts_with(q.v[j], 'µ')),
torn AS (SELECT doc_id, item_id, shift FROM slots GROUP BY doc_id, item_id, shift, asked HAVING count(DISTINCT said) > 1
         UNION SELECT doc_id, item_id, shift FROM slots GROUP BY doc_id, item_id, shift, said HAVING count(DISTINCT asked) > 1)
SELECT doc_id, item_id, max(matched)::INT AS matched FROM best ANTI JOIN torn USING (doc_id, item_id, shift) GROUP BY doc_id, item_id
"""

OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) AS size FROM w),
i AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM s WHERE len(ws) >= size),
f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
x AS (SELECT lang, a, size, ws, unnest(range(1, size + 1)) AS b FROM c),
y AS (SELECT lang, a, ws, size, b, unnest(range(b + 1, size + 1)) AS e FROM x),
sub AS (SELECT lang, array_to_string(ws[b:e], ' ') AS phrase, max(a) AS longer FROM y WHERE e - b + 1 < size GROUP BY ALL),
kept AS (SELECT c.* FROM c ANTI JOIN sub ON c.lang = sub.lang AND c.phrase = sub.phrase AND 100 * sub.longer >= 100 * c.a),
k AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
cut AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, n,
               (1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a) AS score
        FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1:k], ' ')
               JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:k.size], ' ') JOIN t ON t.lang = k.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS m FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN keep USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(m) AS nl FROM keep GROUP BY lang),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS nt FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)::HUGEINT) // (nt + v)::HUGEINT AS p,
             1 + (1000000000 * (m + 1)::HUGEINT) // (nl + v)::HUGEINT AS q
      FROM t JOIN v USING (lang) JOIN keep USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
"""

ORACLES = {"op2_suffix_array_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_benchmark_decontamination": OP6_SQL,
           "op7_substring_dedup": OP7_SQL, "op11_phrase_collocations": OP11_SQL, "op13_source_divergence": OP13_SQL}
