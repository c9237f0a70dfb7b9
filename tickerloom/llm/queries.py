"""The queries of the text operators over the given tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import exact, language, leaks, licenses, mixing, near, packing, pieces, records, repeats, search, secrets, turns

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op5_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)""",
)
def op5_exact_dedup(spark, sf_dir):
    return exact.exact_groups(documents(spark, sf_dir))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    return secrets.span_digest(secrets.secret_spans(documents(spark, sf_dir)))


@query("op2_token_records")
def op2_token_records(spark, sf_dir):
    return records.token_records(documents(spark, sf_dir))


@query("op8_packing")
def op8_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query(
    "op9_benchmark_leaks",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
occ AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op9_benchmark_leaks(spark, sf_dir):
    return leaks.benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    return licenses.license_scan(documents(spark, sf_dir))


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    return language.identify(documents(spark, sf_dir))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query(
    "op4_near_dedup",
    rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT g, row_number() OVER () AS k FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
t AS (SELECT doc_id, k FROM s JOIN k USING (g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, f.b FROM r JOIN f ON r.m = f.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(m) AS component_id FROM r GROUP BY d) USING (doc_id)""",
)
def op4_near_dedup(spark, sf_dir):
    return near.near_groups(documents(spark, sf_dir), words=3, same_of_100=85).drop("mark")


@query("op1_repeated_bytes")
def op1_repeated_bytes(spark, sf_dir):
    return repeats.without_repeats(documents(spark, sf_dir))


@query("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    return mixing.score(documents(spark, sf_dir))


@query("op13_pieces")
def op13_pieces(spark, sf_dir):
    return pieces.digests(pieces.decode(pieces.encode(documents(spark, sf_dir))))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op11_lexical_search",
    rf"""
WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
)
def op11_lexical_search(spark, sf_dir):
    return search.search(search.build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(
    "op12_prefix_trie",
    r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, p, sha256(length(role) || ':' || role || text) AS g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
l AS (SELECT c.conv_id, c.h, count(v.p) AS k FROM c LEFT JOIN v ON v.conv_id = c.base AND v.p <= c.h GROUP BY ALL),
r AS (SELECT c.conv_id, v.p AS d, g, w FROM c JOIN v ON v.conv_id = c.base AND v.p <= c.h
      UNION ALL SELECT l.conv_id, v.p - h + k, g, w FROM l JOIN v ON v.conv_id = l.conv_id AND v.p > h),
m AS (SELECT conv_id, d, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS x, w FROM r
      UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
u AS (SELECT m.*, lag(x) OVER (PARTITION BY conv_id ORDER BY d) AS px, d = max(d) OVER (PARTITION BY conv_id) AS final FROM m),
n AS (SELECT d, x, any_value(px) AS px, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final), '')) AS e FROM u GROUP BY d, x),
k AS (SELECT px AS x, count(*) AS k FROM n GROUP BY px),
o AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN k USING (x)),
a AS (SELECT u.conv_id, u.d, u.x, CAST(sum(CASE WHEN o.conv_id = u.conv_id AND k = 0 THEN 1 ELSE 0 END) OVER s AS BIGINT) AS leaves,
             CAST(sum(CASE WHEN o.conv_id = u.conv_id THEN (n - 1) * o.w ELSE 0 END) OVER s AS BIGINT) AS saved
      FROM u JOIN o USING (d, x) WINDOW s AS (PARTITION BY u.conv_id ORDER BY u.d DESC)),
b AS (SELECT d, x, CAST(sum(leaves) AS BIGINT) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM a GROUP BY d, x)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.k AS BIGINT) AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, o.e AS ends_sha256
FROM o JOIN b USING (d, x) LEFT JOIN n parent ON parent.x = o.px""",
)
def op12_prefix_trie(spark, sf_dir):
    return turns.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
