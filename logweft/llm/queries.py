"""The registered queries of this subpackage, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logweft.llm import common as c
from logweft.llm import (bpe_codec, exact_dedup, html_text, jaccard_join, merkle, packing, quality_rules, secret_scan, sharding, substring_dedup,
                         suffix_dedup, token_alignment, wavelet_shards)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_substring_dedup", f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM docs WHERE len(w) >= 20),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1:i + 20], ' ')
                                             ORDER BY doc_id, i) AS n FROM spot),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win, range(20) r(j) WHERE n > 1),
word AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS x FROM docs),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
""")
def op1_substring_dedup(spark, sf_dir):
    """Words of repeated 20-word windows of ``documents`` removed through the compacted De Bruijn graph."""
    out = substring_dedup.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_suffix_array_dedup", """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spot AS (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM docs WHERE len(h) >= 100),
win AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY substr(h, 2 * i + 1, 100)) AS f FROM spot),
hit AS (SELECT doc_id, i, i - coalesce(max(i + 50) OVER (PARTITION BY doc_id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) > 0 AS fresh
        FROM win WHERE f < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g,
               min(i) OVER (PARTITION BY doc_id) AS i0 FROM hit),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY 1, 2),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
parts AS (SELECT d.doc_id, len(h) // 2 AS n, coalesce(sum(b - a), 0) AS gone, count(a) AS spans,
                 coalesce(string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a), '')
                 || substr(any_value(h), CAST(2 * coalesce(max(b), 0) + 1 AS BIGINT)) AS k
          FROM docs d LEFT JOIN cut USING (doc_id) GROUP BY d.doc_id, len(h))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM parts
""")
def op5_suffix_array_dedup(spark, sf_dir):
    """Bytes of ``documents`` in 50-byte strings of smaller documents removed through sorted suffixes."""
    out = suffix_dedup.dedup_suffixes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_jaccard_join", f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
spot AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM spot),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b USING (s)
         WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
          WHERE 100 * i >= 80 * (a.n + b.n - i)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM docs d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
""")
def op7_jaccard_join(spark, sf_dir):
    """Components of documents whose five-word shingle sets have Jaccard similarity 0.8 or more."""
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op8_exact_dedup(spark, sf_dir):
    """``documents`` in two batches, the larger ids first, against one digest index."""
    return exact_dedup.dedup_exact(documents(spark, sf_dir), batches=2)


@query("op2_bpe_codec")
def op2_bpe_codec(spark, sf_dir):
    """Every text of ``documents`` encoded and decoded with the 49k word vocabulary through the distinct-word table."""
    return bpe_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    """Counts, base rules and suffix-array repetition of every document."""
    out = quality_rules.measure(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "n_covered_words", "longest_repeat")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """All documents, by word count, packed into sequences of 512 to 4,096 words."""
    return packing.pack_documents(documents(spark, sf_dir))


_KINDS = secret_scan.KINDS


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_OP6_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[:len(m)]) AS g "
    f"FROM (SELECT doc_id, regexp_extract_all(t, {_sql_text(kind.pattern)}, 0) AS m, "
    f"regexp_extract_all(t, {_sql_text(kind.pattern)}, {kind.group}) AS v, "
    f"string_split_regex(t, {_sql_text(kind.pattern)}) AS g FROM docs)" for k, kind in enumerate(_KINDS))
_OP6_LIST = ", ".join(f"({k}, '{kind.name}', {kind.least}, {str(kind.base).lower()})" for k, kind in enumerate(_KINDS))


@query("op6_secret_scan", f"""
WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
kinds(k, name, least, base) AS (VALUES {_OP6_LIST}),
found AS ({_OP6_FOUND}),
placed AS (SELECT doc_id, k, v, length(m) AS size,
                  sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM found),
long_enough AS (SELECT doc_id, k, name, base, v, CAST(stop - size AS BIGINT) AS a, CAST(stop AS BIGINT) AS b
                FROM placed JOIN kinds USING (k) WHERE length(v) >= least),
owned AS (SELECT v, count(DISTINCT source) > {secret_scan.MAX_OWNERS}
                    OR count(DISTINCT concat_ws('/', source, lang)) > {secret_scan.MAX_REPOSITORIES} AS shared
          FROM long_enough JOIN docs USING (doc_id) GROUP BY v),
spans AS (SELECT doc_id, k, name, base, a, b, shared FROM long_enough JOIN owned USING (v)
          WHERE base OR (NOT shared AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')
                         AND NOT regexp_matches(v, {_sql_text(secret_scan.PLACEHOLDER)})
                         AND replace(v, substr(v, 1, 1), '') <> ''))
SELECT d.doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access,
       count(*) FILTER (name = 'hex') AS n_hex,
       sha256(coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, k), '') AS spans,
       count(*) FILTER (shared) AS n_shared, count(*) FILTER (NOT shared) AS n_owner_specific
FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
""")
def op6_secret_scan(spark, sf_dir):
    """Secrets of every document, with owner-specific candidates by corpus-wide ownership (owner: source)."""
    out = secret_scan.scan_documents(documents(spark, sf_dir))
    spans = F.col("spans")
    of_kind = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    shared = lambda flag: F.size(F.filter(spans, lambda s: s["shared"] == F.lit(flag))).cast("long")
    return out.select(
        "doc_id", of_kind("assign").alias("n_assign"), of_kind("access").alias("n_access"), of_kind("hex").alias("n_hex"),
        F.sha2(secret_scan.joined_spans(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        secret_scan.joined_spans(spans).alias("spans"), shared(True).alias("n_shared"),
        shared(False).alias("n_owner_specific"))


@query("op10_wavelet_shards")
def op10_wavelet_shards(spark, sf_dir):
    """Token ids of every document (50k byte vocabulary) written as wavelet-matrix shards and read back."""
    shards = wavelet_shards.write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet_shards.document_checksums(shards)


@query("op9_html_text")
def op9_html_text(spark, sf_dir):
    """Visible text of every page of ``pages``, laid out."""
    c.prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return html_text.extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


_SHARDS = 40
_CRC = ("xor(list_reduce(l, lambda a, x : xor(a >> 8, t[CAST(xor(a, x) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), "
        "4294967295)")
_CRC_TABLE = ("SELECT list_transform(range(256), lambda b : list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x : "
              "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t")


def _sql_bytes(hex_text: str) -> str:
    return (f"list_transform(range(len({hex_text}) // 2), "
            f"lambda i : CAST('0x' || substr({hex_text}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))")


@query("op11_rendezvous_shards", f"""
WITH tab AS ({_CRC_TABLE}),
docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, {_sql_bytes('h')} AS l FROM docs),
sums AS (SELECT doc_id, CAST(len(l) + 16 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32 FROM bytes, tab),
score AS (SELECT doc_id, s, ('0x' || substr(md5('=' || doc_id || ':' || s), 1, 13))::BIGINT AS u
          FROM documents, range({_SHARDS + 1}) r(s)),
best AS (SELECT doc_id, arg_max(s, u) FILTER (s < {_SHARDS}) AS shard, arg_max(s, u) AS grown FROM score GROUP BY 1)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM sums JOIN best USING (doc_id)
""")
def op11_rendezvous_shards(spark, sf_dir):
    """``documents`` over 40 shards of equal weight by rendezvous hashing of their ids, and over 41."""
    return sharding.shard_documents(documents(spark, sf_dir), [1.0] * _SHARDS)


@query("op12_merkle_manifest", f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
bytes AS (SELECT doc_id, {_sql_bytes("hex(encode(CAST(doc_id AS VARCHAR)))")} AS l FROM documents),
hit AS (SELECT doc_id, {_CRC} % 5 = 0 AS tampered FROM bytes, tab),
fields AS (SELECT doc_id, source, strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id
                  || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                  || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                  strlen(text) || ':' AS size, text,
                  CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
           FROM documents JOIN hit USING (doc_id)),
leaf AS MATERIALIZED (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r,
                sha256(head || coalesce(size || text, '-')) AS leaf, sha256(head || coalesce(size || changed, '-')) AS now FROM fields),
node(source, level, i, d, n) AS (
  SELECT source, 0, r, leaf, count(*) OVER (PARTITION BY source) FROM leaf
  UNION ALL
  SELECT source, level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 15) // 16)
  FROM node WHERE n > 1 GROUP BY source, level, i // 16),
inner_nodes AS MATERIALIZED (SELECT source, level, i, d, n FROM node),
top AS MATERIALIZED (SELECT source, level AS h, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s
                     FROM inner_nodes WHERE n = 1),
over(level, i, d, n) AS (
  SELECT 0, s, subroot, count(*) OVER () FROM top
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 15) // 16)
  FROM over WHERE n > 1 GROUP BY level, i // 16),
outer_nodes AS MATERIALIZED (SELECT level, i, d, n FROM over),
height AS (SELECT max(level) AS hr, any_value(d) FILTER (n = 1) AS root FROM outer_nodes),
line AS MATERIALIZED (SELECT doc_id, leaf, now, l.source, r, h, s, subroot, hr, root FROM leaf l
                      JOIN top t ON t.source IS NOT DISTINCT FROM l.source, height),
step AS (
  SELECT doc_id, k, string_agg(d, '' ORDER BY i) FILTER (i < x) AS a, string_agg(d, '' ORDER BY i) FILTER (i > x) AS b
  FROM (SELECT doc_id, source, k, r // CAST(pow(16, k) AS BIGINT) AS x FROM line, range(h) g(k)) w
  JOIN inner_nodes n ON n.level = k AND n.source IS NOT DISTINCT FROM w.source AND n.i // 16 = x // 16 GROUP BY doc_id, k
  UNION ALL
  SELECT doc_id, h + k, string_agg(d, '' ORDER BY i) FILTER (i < x), string_agg(d, '' ORDER BY i) FILTER (i > x)
  FROM (SELECT doc_id, h, k, s // CAST(pow(16, k) AS BIGINT) AS x FROM line, range(hr) g(k)) w
  JOIN outer_nodes n ON n.level = k AND n.i // 16 = x // 16 GROUP BY doc_id, h, k),
proof AS MATERIALIZED (SELECT doc_id, list(coalesce(a, '') ORDER BY k) AS a, list(coalesce(b, '') ORDER BY k) AS b FROM step GROUP BY 1),
fold(doc_id, k, d) AS (
  SELECT doc_id, 0, now FROM line
  UNION ALL
  SELECT doc_id, k + 1, sha256(a[k + 1] || d || b[k + 1]) FROM fold JOIN proof USING (doc_id) WHERE k < len(a)),
ends AS (SELECT doc_id, arg_max(d, k) AS folded FROM fold GROUP BY 1)
SELECT doc_id, leaf, subroot, root,
       sha256(coalesce(array_to_string(list_transform(range(len(a)), lambda j : a[j + 1] || b[j + 1]), ''), '')) AS proof_sha256,
       folded AS folded_root, folded = root AS verified
FROM line JOIN ends USING (doc_id) LEFT JOIN proof USING (doc_id)
""")
def op12_merkle_manifest(spark, sf_dir):
    """Merkle manifest of ``documents`` by source, every document verified, a fifth of them changed in between."""
    number = F.crc32(F.col("doc_id").cast("string"))
    text = F.when(number % 5 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify_documents(documents(spark, sf_dir), {"text": text})


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    """Ids of the 50k byte vocabulary and the 32k piece model aligned over every text of ``documents``."""
    out = token_alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                          public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return out.withColumnRenamed("groups", "groups_sha256")
