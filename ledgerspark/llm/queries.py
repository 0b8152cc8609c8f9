"""The operators as queries over the test tables, with the SQL they are checked against."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import (decontaminate, exact, html, language, manifest, mixing, paragraphs, quality, secrets, simhash, tokens,
                             vector_codes, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources", r"""
WITH sized AS (SELECT doc_id, coalesce('=' || source, '~') AS g, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '-')) AS key,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY g) - 1 AS place FROM sized GROUP BY g),
weighed AS (SELECT *, [3, 1, 2][place % 3 + 1] AS w, 2 * source_size AS cap FROM sources),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
   - coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w::DOUBLE, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT g, source_size, least(cap::DOUBLE, w * (SELECT max(level) FROM levels)) AS target FROM levels),
walked AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
  coalesce(sum(size) OVER (PARTITION BY s.g ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN targets t ON t.g = s.g)
SELECT doc_id, size, source_size, target,
 CAST(passes * size + greatest(0, least(size, floor(target - passes * source_size) - earlier)) AS BIGINT) AS taken FROM walked""")
def _(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_quality_rules")
def _(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_simhash_near_dedup")
def _(spark, sf_dir):
    return simhash.link(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def _(spark, sf_dir):
    counted = tokens.token_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.over_limit(counted, 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op10_language_id")
def _(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_secret_scans")
def _(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "word_no", "found", *secrets.FEATURES, "score", "is_secret")


@query("op5_benchmark_decontamination")
def _(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_html_extraction")
def _(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_warc_fixity", """
SELECT page_id, url, CASE page_id % 1009 WHEN 7 THEN 'missing' WHEN 31 THEN 'copies' ELSE 'changed' END AS kind,
 CAST(1 AS BIGINT) AS copies FROM pages
WHERE page_id % 1009 IN (7, 31) OR (page_id % 1009 = 17 AND html NOT LIKE '?%') OR (page_id % 1009 = 23 AND length(html) > 200)""")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages)).select("page_id", "url", "kind", "copies")


@query("op3_substring_dedup")
def _(spark, sf_dir):
    return paragraphs.find(table(spark, sf_dir, "documents"), min_words=30).drop("text_key")


_ROUNDS = "".join(f"""
nearest{n} AS MATERIALIZED (SELECT part, vec_id, any_value(x) AS x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c)
  + list_dot_product(c, c), 'e': entry}}) AS best FROM parts JOIN book{n} USING (part) GROUP BY part, vec_id),""" + (f"""
moved{n} AS (SELECT part, entry, list(mean ORDER BY place) AS c FROM (SELECT part, best.e AS entry, place, floor(sum(x[place]) / count(*)) AS mean
  FROM nearest{n}, unnest(range(1, len(x) + 1)) AS t(place) GROUP BY ALL) GROUP BY part, entry),
book{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN moved{n} m USING (part, entry)),""" if n < 4 else "")
    for n in range(5))


@query("op11_vector_codes", f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS x FROM kept, unnest(range(4)) AS t(part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256),{_ROUNDS}
books AS (SELECT sha256(string_agg(CAST(CAST(c[place] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM book4, unnest(range(1, len(c) + 1)) AS t(place)),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM nearest4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)""")
def _(spark, sf_dir):
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


@query("op12_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""")
def _(spark, sf_dir):
    return exact.dedup(table(spark, sf_dir, "documents"))


_FRAMED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))


@query("op13_merkle_manifest", f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
  sha256({_FRAMED.format(text="text")}) AS leaf, sha256({_FRAMED.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, crc),
tree AS (SELECT 0 AS level, g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL SELECT level + 1, g, i, h, count(*) OVER (PARTITION BY g) FROM (SELECT level, g, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h
   FROM tree WHERE n > 1 GROUP BY level, g, i // 8)),
subroots AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS k, h AS subroot FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, k AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, i, h, count(*) OVER () FROM (SELECT level, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM top WHERE n > 1 GROUP BY level, i // 8)),
root AS (SELECT h AS root FROM top WHERE n = 1),
inner_path AS (SELECT g, i AS leaf_i, 0 AS level, i AS spot, CASE WHEN hit THEN low ELSE leaf END AS cur, '' AS proof FROM leaves
  UNION ALL SELECT p.g, leaf_i, p.level + 1, any_value(spot) // 8, sha256(string_agg(CASE WHEN t.i = spot THEN cur ELSE t.h END, '' ORDER BY t.i)),
   any_value(proof) || coalesce(string_agg(CASE WHEN t.i <> spot THEN t.h END, '' ORDER BY t.i), '')
  FROM inner_path p JOIN tree t ON t.g = p.g AND t.level = p.level AND t.i // 8 = spot // 8 AND t.n > 1 GROUP BY p.g, leaf_i, p.level),
at_subroot AS MATERIALIZED (SELECT g, leaf_i, cur, proof FROM inner_path QUALIFY row_number() OVER (PARTITION BY g, leaf_i ORDER BY level DESC) = 1),
outer_path AS (SELECT g, leaf_i, 0 AS level, k AS spot, cur, proof FROM at_subroot JOIN subroots USING (g)
  UNION ALL SELECT p.g, leaf_i, p.level + 1, any_value(spot) // 8, sha256(string_agg(CASE WHEN t.i = spot THEN cur ELSE t.h END, '' ORDER BY t.i)),
   any_value(proof) || coalesce(string_agg(CASE WHEN t.i <> spot THEN t.h END, '' ORDER BY t.i), '')
  FROM outer_path p JOIN top t ON t.level = p.level AND t.i // 8 = spot // 8 AND t.n > 1 GROUP BY p.g, leaf_i, p.level),
done AS (SELECT g, leaf_i, cur, proof FROM outer_path QUALIFY row_number() OVER (PARTITION BY g, leaf_i ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM leaves l JOIN done d ON d.g = l.g AND d.leaf_i = l.i JOIN subroots s ON s.g = l.g, root""")
def _(spark, sf_dir):
    return manifest.audit(table(spark, sf_dir, "documents"))
