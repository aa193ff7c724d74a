"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    exact, language, lz, mixing, near_dup, neighbours, packing, passages, phrases, quality,
    toxicity, trie, warc,
)
from plumbline.plans.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


_MIX = r"""
WITH d AS (
  SELECT doc_id, source, h, size FROM (SELECT doc_id, source,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS s,
        1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER o AS k,
        ((SELECT sum(s) FROM s)::BIGINT - coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
        / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit
      FROM s WINDOW o AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST)),
u AS (SELECT arg_min(unit, k) AS unit FROM q WHERE 3 * s >= unit * w),
t AS (SELECT s.*, CASE WHEN 3 * s < unit * w THEN (3 * s)::DOUBLE ELSE unit * w END AS target FROM s, u),
b AS (SELECT *, CASE WHEN s > 0 THEN floor(target)::BIGINT // s ELSE 0 END AS times,
        CASE WHEN s > 0 THEN floor(target)::BIGINT % s ELSE 0 END AS rest FROM t),
c AS (SELECT d.*, b.s, b.target, b.times, b.rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0)::BIGINT AS before,
        (sum(size) OVER (PARTITION BY d.source, h))::BIGINT AS tied
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
p AS (SELECT *, (CASE WHEN before + tied <= rest THEN size WHEN before > rest OR tied = 0 THEN 0
        ELSE (rest - before) * size // tied END)::BIGINT AS part FROM c)
SELECT doc_id, source, size, s AS source_size, target, times * size + part AS taken,
  (times + CASE WHEN part >= size AND size > 0 THEN 1 ELSE 0 END)::INTEGER AS copies,
  CASE WHEN part >= size THEN 0 ELSE part END AS part_words FROM p"""


@query("op5_source_mixing", _MIX)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "part_words")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@query("op8_lz_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_sequence_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op1_projected_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op2_warc_archive")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


_EXACT = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (t)"""


@query("op13_exact_dedup", _EXACT)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("chain")


_TRIE = r"""
WITH t AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(strlen(r)::VARCHAR || ':' || r || x)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''),
    lambda b: unicode(b)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
    lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM c),
s AS (SELECT h.conv_id, 0 AS part, i, r, x FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND i <= h
  UNION ALL SELECT h.conv_id, 1, i, r, x FROM h JOIN t ON t.conv_id = h.conv_id AND i > h),
p AS (SELECT h.conv_id, coalesce(list(struct_pack(r := r, x := x) ORDER BY part, i) FILTER (r IS NOT NULL), []) AS path
  FROM h LEFT JOIN s USING (conv_id) GROUP BY h.conv_id),
e AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM p),
n AS (SELECT path[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(path[1:d][d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM e GROUP BY ALL),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT node[1:j] AS node, sum(n_children = 0) AS leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM m) GROUP BY 1)
SELECT m.conv_id, m.d::BIGINT AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children,
  u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN u USING (node) LEFT JOIN m AS a ON m.d > 0 AND a.node = m.node[1:m.d - 1]"""


@query("op12_conversation_trie", _TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 5) AS s(m) WHERE len(w) >= m),
f AS (SELECT lang, w[i:i + m - 1] AS ph, count(*) AS c FROM o GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
c AS (SELECT lang, ph, c AS a FROM f WHERE len(ph) > 1 AND c >= 30),
s AS (SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS longer FROM (SELECT lang, ph, a, m, unnest(range(1, len(ph) - m + 2)) AS i
    FROM c, range(2, 4) AS s(m) WHERE len(ph) > m) GROUP BY ALL),
k AS (SELECT c.lang, c.ph, c.a, unnest(range(1, len(c.ph))) AS k FROM c LEFT JOIN s USING (lang, ph)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
v AS (SELECT k.*, x.c AS l, y.c AS r, ((2000000::HUGEINT * a) // (x.c + y.c))::BIGINT AS score
  FROM k JOIN f AS x ON x.lang = k.lang AND x.ph = k.ph[1:k] JOIN f AS y ON y.lang = k.lang AND y.ph = k.ph[k + 1:]),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
w AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM b),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM w)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000"""


@query("op11_phrase_collocations", _PHRASES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
