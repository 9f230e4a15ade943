"""Named queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlode.llm import (
    collocations,
    contamination,
    html_text,
    license_scan,
    mixing,
    neardup,
    pii,
    quality,
    secret_scan,
    simhash,
    token_counts,
    token_files,
    vector_codes,
)
from cmdlode.session import configure, stored, work_folder

Query = Callable[[SparkSession, str], DataFrame]
DEMO_KEY = b"pseudonyms of the registered query"
_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    samples = secret_scan.random_strings(spark).unionByName(secret_scan.ordinary_strings(docs))
    found = secret_scan.scan(docs, secret_scan.train(samples))
    base = F.filter("found", lambda s: s["kind"] != secret_scan.RANDOM)
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("found")).alias("spans"),
        of(secret_scan.RANDOM).alias("n_random"),
    )


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(_table(spark, sf_dir, "documents"), names_are_text=False)
    return token_counts.length_report(token_counts.histogram(lengths))


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken"),
    )


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(_table(spark, sf_dir, "documents"))


@_query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


@_query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key=DEMO_KEY)


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize_to_files(_table(spark, sf_dir, "documents"), work_folder(spark, "tokens"), names_are_text=False)


@_query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    coded = stored(coded, "codes")
    return vector_codes.label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    )


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_query
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


_BLANK, _CHAR = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_STOP = ",".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))

_OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_CHAR}')) AS l
  FROM documents),
win AS (
  SELECT rid, i, list_slice(w, i, i + {quality.WINDOW - 1}) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d WHERE len(w) >= {quality.WINDOW})),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win), range(0, {quality.WINDOW}) AS r(k)
  WHERE c > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(l) AS n_lines,
         length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
v AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         list_filter([
           CASE WHEN n_words > 0 AND (word_chars / n_words < 2.5 OR word_chars / n_words > 12.0) THEN 'word_length' END,
           CASE WHEN n_words > 0 AND n_symbols / n_words > 0.2 THEN 'symbols' END,
           CASE WHEN n_words >= 50 AND n_stop_words / n_words < 0.01 THEN 'stop_words' END,
           CASE WHEN n_lines >= 3 AND n_dup_lines / n_lines > 0.6 THEN 'duplicate_lines' END,
           CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.3 THEN 'repeated_words' END], lambda x: x IS NOT NULL) AS b
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND len(b) = 0) AS kept, coalesce(array_to_string(b, ','), '') AS broken
FROM v
"""

_OP7 = rf"""
WITH d AS (
  SELECT doc_id, source, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS g,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '{_CHAR}', 'x', 'g'), '{_BLANK}', '', 'g'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
         3 * source_size AS most, (sum(source_size) OVER ())::BIGINT AS total FROM s),
r AS (SELECT *, most * (6 // weight) AS level, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM w),
c AS (
  SELECT *, weight * (total - coalesce(sum(most) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         >= most * sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM r),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE
           (weight * (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()))::DOUBLE
           / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM c),
f AS (
  SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS k,
         round(target)::BIGINT - (round(target)::BIGINT // greatest(source_size, 1)) * source_size AS fraction FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY g ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, size, f.source_size, f.target, (k * size + greatest(0, least(size, fraction - upto + size)))::BIGINT AS taken
FROM p JOIN f ON p.source IS NOT DISTINCT FROM f.source
"""


def _op11() -> str:
    """Every round as two steps: the least ``256 * distance + entry`` of each part, then the means."""
    text = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {vector_codes.SCALE})::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // {vector_codes.PARTS} AS w FROM k),
p AS MATERIALIZED (
  SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, v[i] AS x
  FROM (SELECT r, v, w, unnest(range(1, len(v) + 1)) AS i FROM k, w)),
c0 AS MATERIALIZED (
  SELECT part, pos, e, x AS y
  FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (r) WHERE e < {vector_codes.ENTRIES}),
"""
    nearest = """a{0} AS MATERIALIZED (
  SELECT r, part, m % 256 AS e, m // 256 AS d
  FROM (SELECT r, part, min(256 * d + e) AS m
        FROM (SELECT r, part, e, sum((x - y) * (x - y))::BIGINT AS d FROM p JOIN c{0} USING (part, pos) GROUP BY r, part, e)
        GROUP BY r, part)),
"""
    means = """s{0} AS (
  SELECT part, pos, e, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN a{0} USING (r, part) GROUP BY part, pos, e),
c{1} AS MATERIALIZED (
  SELECT part, pos, e, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y
  FROM c{0} LEFT JOIN s{0} USING (part, pos, e)),
"""
    for i in range(vector_codes.ROUNDS):
        text += nearest.format(i) + means.format(i, i + 1)
    last = vector_codes.ROUNDS
    return text + nearest.format(last) + f"""f AS (
  SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, pos)) FROM c{last}) AS codebooks_sha256
FROM k JOIN f USING (r)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP12 = rf"""
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
t AS MATERIALIZED (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f1 AS MATERIALIZED (SELECT lang, a, count(*) AS n FROM t GROUP BY lang, a),
f2 AS MATERIALIZED (SELECT lang, a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY lang, a, b HAVING n >= {collocations.MIN_COUNT}),
f3 AS MATERIALIZED (SELECT lang, a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING n >= {collocations.MIN_COUNT}),
m AS (SELECT lang, a, b, max(n) AS most FROM (SELECT lang, a, b, n FROM f3 UNION ALL SELECT lang, b, c, n FROM f3) GROUP BY lang, a, b),
s2 AS (
  SELECT x.lang, x.a || ' ' || x.b AS phrase, x.n AS a, y.n AS l, z.n AS r,
         ({collocations.SCALE}::HUGEINT * x.n * x.n // (y.n::HUGEINT * z.n))::BIGINT AS score
  FROM f2 x JOIN f1 y ON x.lang = y.lang AND x.a = y.a JOIN f1 z ON x.lang = z.lang AND x.b = z.a
  LEFT JOIN m ON x.lang = m.lang AND x.a = m.a AND x.b = m.b
  WHERE m.most IS NULL OR 100 * m.most < {collocations.INSIDE_PERCENT} * x.n),
c3 AS (
  SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c AS phrase, x.n AS a, p.n AS l1, q.n AS r1, g.n AS l2, h.n AS r2,
         ({collocations.SCALE}::HUGEINT * x.n * x.n // (p.n::HUGEINT * q.n))::BIGINT AS v1,
         ({collocations.SCALE}::HUGEINT * x.n * x.n // (g.n::HUGEINT * h.n))::BIGINT AS v2
  FROM f3 x JOIN f1 p ON x.lang = p.lang AND x.a = p.a JOIN f2 q ON x.lang = q.lang AND x.b = q.a AND x.c = q.b
  JOIN f2 g ON x.lang = g.lang AND x.a = g.a AND x.b = g.b JOIN f1 h ON x.lang = h.lang AND x.c = h.a),
s AS (
  SELECT * FROM s2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN v1 <= v2 THEN l1 ELSE l2 END, CASE WHEN v1 <= v2 THEN r1 ELSE r2 END, least(v1, v2) FROM c3)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang)
WHERE rank <= {collocations.TOP}
"""

ORACLE_SQL = {"op3_quality_rules": _OP3, "op7_mixing": _OP7, "op11_vector_codes": _op11(), "op12_collocations": _OP12}
