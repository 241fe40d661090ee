"""The corpus operators as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import tokencount

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 512).drop("text")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = warc.resolve(warc.page_records(pages))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return rows.select(F.expr("(id - 1) div 2").alias("page_id"), "url", F.expr("base div 2").alias("base_page"), "validator", "resolved", merged.alias("headers"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), 80)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    return passages.repeated(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    rows = sharding.interleave(_table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 80)


def op8_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False).drop("text")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "html"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose crc32 of the doc_id as text leaves 2 by 7 are held out."""
    from . import lm

    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2
    return lm.score(_table(spark, sf_dir, "documents"), held_out).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the crc32 of the doc_id as text, tampering takes the line feeds out of the text."""
    from . import manifest

    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    tampered = {"text": F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest.manifest(_table(spark, sf_dir, "documents"), tampered=tampered).drop("path")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import align

    return align.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_RULES = {
    "short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "100 * n_symbols > 30 * n_words", "lines": "100 * n_dup_lines > 30 * n_lines",
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
}
_BETWEEN = "greatest(var_pop({k} / n) - (sum({k}) / sum(n)) * (1 - sum({k}) / sum(n)) * avg(1 / n), 0)"
_STRENGTH = "least(greatest(CASE WHEN b_{k} > 0 THEN m_{k} * (1 - m_{k}) / b_{k} - 1 ELSE 1e6 END, 2), 1e6)"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), lined AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs
), grams AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lined) WINDOW p AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) t(d) GROUP BY rid
), measured AS (
  SELECT rid, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM lined LEFT JOIN covered USING (rid)
), hosts AS (
  SELECT source, count(*)::double AS n, {", ".join(f"sum(({c})::int) AS {k}" for k, c in _RULES.items())} FROM measured WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT {", ".join(f"sum({k}) / sum(n) AS m_{k}, {_BETWEEN.format(k=k)} AS b_{k}" for k in _RULES)} FROM hosts
), rates AS (
  SELECT source, {", ".join(f"({k} + m_{k} * {_STRENGTH.format(k=k)}) / (n + {_STRENGTH.format(k=k)}) AS r_{k}" for k in _RULES)} FROM hosts CROSS JOIN prior
), verdicts AS (
  SELECT source, CASE WHEN r_base >= 0.8 THEN 'blocked' WHEN greatest(r_short, r_repeats, r_symbols, r_lines) >= 0.5 THEN 'watched' ELSE 'fine' END AS verdict FROM rates
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["base"]}) AS base_failed,
  NOT ({_RULES["base"]}) AND coalesce(verdict, 'fine') <> 'blocked' AND (coalesce(verdict, 'fine') <> 'watched' OR NOT ({_RULES["symbols"]} OR {_RULES["lines"]})) AS kept
FROM measured LEFT JOIN verdicts USING (source)
""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g
    FROM (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs WHERE len(w) >= 5) WINDOW p AS (PARTITION BY rid ORDER BY i)
    UNION ALL SELECT rid, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4
  ) WHERE g IS NOT NULL
), sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid
), shared AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.rid < y.rid GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT rid, rid FROM docs UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN docs d ON d.rid = reach.a JOIN docs o ON o.rid = reach.b LEFT JOIN sizes s ON s.rid = d.rid GROUP BY d.rid, d.doc_id, s.n
""",
    "op6_sharding": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), docs AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: (16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1)::bigint)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
  FROM documents CROSS JOIN crc
), keyed AS (SELECT *, md5('0:' || coalesce(doc_id::varchar, text_crc32::varchar)) AS key FROM docs
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, text_crc32, size) - 1 + 0.5::double) / count(*) OVER (PARTITION BY source) AS share FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY share, key, source NULLS FIRST, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((place * 40) // total)::int AS shard, place - ((place * 40) // total * total + 39) // 40 AS slot, NULL::int AS grown_shard, source FROM placed
""",
    "op11_lm_scoring": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 7 = 2, false) AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w
  FROM documents CROSS JOIN crc
), tokens AS (SELECT rid, held_out, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs
), pairs AS (SELECT *, lag(w, 1, '  ') OVER (PARTITION BY rid ORDER BY i) AS h FROM tokens
), known AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w
), whole AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM known
), arcs AS (SELECT h, w, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY h, w
), states AS (SELECT h, sum(c) AS c, count(*) AS t FROM arcs GROUP BY h
), met AS (
  SELECT p.rid, k.c IS NOT NULL AS known, (coalesce(k.c, 0) + 1)::double / (n + v + 1) AS p, s.c AS c, s.t AS t, coalesce(a.c, 0) AS a
  FROM pairs p CROSS JOIN whole LEFT JOIN known k ON k.w = p.w LEFT JOIN states s ON s.h = p.h LEFT JOIN arcs a ON a.h = p.h AND a.w = p.w
), scored AS (
  SELECT rid, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, fsum(log10(p)) AS base_score, fsum(log10(CASE WHEN c IS NULL THEN p ELSE greatest(a - 0.75, 0)::double / c + 0.75::double * t / c * p END)) AS score FROM met GROUP BY rid
)
SELECT doc_id, held_out, n_tokens, n_known, n::bigint AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM scored JOIN docs USING (rid) CROSS JOIN whole
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), docs AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, *,
    CASE WHEN coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 2 = 0, false)
      THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents CROSS JOIN crc
), texts AS (
  SELECT i, n, doc_id, source, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(changed) || ':' || changed, '-') AS other FROM docs
), leaves AS (SELECT i, n, doc_id, source, sha256(head || body) AS leaf, sha256(head || other) AS again FROM texts
), nodes(level, source, i, n, d) AS (
  SELECT 0, source, i, n, leaf FROM leaves
  UNION ALL SELECT level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, source, i // 3, n
), subroots AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, i, n, d) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n
), steps AS (
  SELECT l.doc_id, l.leaf, l.source, m.level, m.i, m.d, (l.i // (3::bigint ** m.level)::bigint) AS own FROM leaves l JOIN nodes m ON m.source IS NOT DISTINCT FROM l.source AND m.n > 1 AND m.i // 3 = l.i // (3::bigint ** (m.level + 1))::bigint
  UNION ALL SELECT l.doc_id, l.leaf, l.source, 1000 + m.level, m.i, m.d, (s.place // (3::bigint ** m.level)::bigint) FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops m ON m.n > 1 AND m.i // 3 = s.place // (3::bigint ** (m.level + 1))::bigint
), runs AS (
  SELECT doc_id, leaf, source, level, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < own), '') AS before, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > own), '') AS after FROM steps GROUP BY doc_id, leaf, source, level
), ways AS (
  SELECT doc_id, leaf, source, sha256(string_agg(before || after, '' ORDER BY level)) AS proof, list({'b': before, 'a': after} ORDER BY level) AS way FROM runs GROUP BY doc_id, leaf, source
), folds(doc_id, source, leaf, k, way, d) AS (
  SELECT l.doc_id, l.source, l.leaf, 1, coalesce(way, []), again FROM leaves l LEFT JOIN ways w ON w.doc_id = l.doc_id AND w.leaf = l.leaf
  UNION ALL SELECT doc_id, source, leaf, k + 1, way, sha256(way[k].b || d || way[k].a) FROM folds WHERE k <= len(way)
)
SELECT l.source, l.doc_id, l.leaf, s.subroot, r.d AS root, coalesce(w.proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT d FROM tops WHERE n = 1) r
LEFT JOIN ways w ON w.doc_id = l.doc_id AND w.leaf = l.leaf JOIN (SELECT * FROM folds WHERE k = len(way) + 1) f ON f.doc_id = l.doc_id AND f.leaf = l.leaf
""",
    "op7_decontamination": r"""
WITH items AS (
  SELECT *, len(w) AS n, least(5, len(w)) AS k FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0
), placed AS (
  SELECT i, n, k, o, array_to_string(w[o + 1 : o + k], ' ') AS g FROM (SELECT *, unnest(range(n - k + 1)) AS o FROM items)
), whole AS (SELECT count(*)::double AS total FROM items
), known AS (SELECT g, 1 + ln(total / count(DISTINCT i)) AS wt FROM placed CROSS JOIN whole GROUP BY g, total
), counted AS (SELECT i, n, k, g, count(*) AS c FROM placed GROUP BY ALL
), heavy AS (SELECT i, sum(c * wt) AS weight FROM counted JOIN known USING (g) GROUP BY i
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT rid, size, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM (SELECT *, len(w) AS size, unnest(range(len(w) - k + 1)) AS pos FROM docs CROSS JOIN (SELECT DISTINCT k FROM items))
), windows AS (
  SELECT DISTINCT rid, k, n, greatest(0, least(pos - o, size - n)) AS start FROM grams JOIN placed USING (g, k)
), held AS (
  SELECT rid, k, n, start, g, count(*) AS h FROM windows JOIN grams USING (rid, k) WHERE pos BETWEEN start AND start + n - k GROUP BY ALL
), own AS (
  SELECT rid, k, n, start, sum(h * coalesce(wt, 1 + ln(total))) AS own FROM held LEFT JOIN known USING (g) CROSS JOIN whole GROUP BY ALL
), scored AS (
  SELECT rid, k, n, start, i, sum(least(h, c) * wt) AS same FROM held JOIN counted USING (g, n, k) JOIN known USING (g) GROUP BY ALL
), likely AS (
  SELECT rid, i, n, start, same / (own + weight - same) AS similarity FROM scored JOIN own USING (rid, k, n, start) JOIN heavy USING (i)
)
SELECT doc_id, item_id, start::bigint AS start_word, l.n::bigint AS n_words, round(similarity, 6) AS similarity
FROM likely l JOIN docs USING (rid) JOIN items USING (i) WHERE similarity >= 0.8 - 1e-9
QUALIFY row_number() OVER (PARTITION BY rid, item_id ORDER BY similarity DESC, start) = 1
""",
    "op3_warc_revisits": r"""
WITH parts AS (
  SELECT page_id AS page, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS plain, sha1(coalesce(html, '')) AS digest FROM pages
), canon AS (
  SELECT page, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(plain, '^(?:[^/?@]*@)?([^/?]*)', 1)), '(^(?:www|m)\.)|(:(?:80|443)$)', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '(?:\.html?|/)+$', '') AS path,
    list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)')) AS kept
  FROM parts
), named AS (
  SELECT page, digest, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS url,
    CASE WHEN page % 5 <> 0 THEN '"' || substr(digest, 1, 16) || '"' END AS etag
  FROM canon
), asked AS (
  SELECT r.page, r.url, r.page + 1000 AS at, CASE WHEN r.page % 5 <> 0 THEN CASE WHEN r.page % 7 = 0 THEN '"changed"' ELSE r.etag END END AS etag FROM named r
), met AS (
  SELECT r.page, r.url, b.page AS base, r.etag, b.etag AS b_etag FROM asked r ASOF LEFT JOIN named b ON r.url = b.url AND r.at > b.page
), judged AS (
  SELECT page, url, base, CASE WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN 'etag' WHEN base IS NOT NULL THEN 'last-modified' ELSE 'none' END AS validator,
    coalesce(CASE WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN etag = b_etag ELSE base = page END, false) AS resolved
  FROM met
)
SELECT page AS page_id, url, base AS base_page, validator, resolved,
  CASE WHEN resolved THEN 'cache-control=max-age=60;content-type=text/html;date=' || (page + 1000) || ';expires=' || (page + 2000)
       ELSE 'date=' || (page + 1000) || ';expires=' || (page + 2000) || ';server=unit' END AS headers
FROM judged
""",
}
