"""Registered queries of the pipeline operators and their SQL."""

from pyspark.sql import functions as F

from scoreloom.llm import chat_query, manifest_query, spelling_query
from scoreloom.llm.decontaminate import contamination, items_digest
from scoreloom.llm.exact_dedup import exact_dedup
from scoreloom.llm.jaccard_join import near_duplicates
from scoreloom.llm.langid import identify
from scoreloom.llm.licenses import LEAST, license_scan, template_bigrams
from scoreloom.llm.line_templates import drop_recurring_lines
from scoreloom.llm.mixing import mix_counts
from scoreloom.llm.quality import quality_scores
from scoreloom.llm.url_filter import host_of, url_verdicts
from scoreloom.llm.warc import assemble, page_ids, read_archives, write_archives
from scoreloom.session import new_folder


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumn("items_sha256", items_digest(F.col("items"))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


DAY = 86400
START = 1704067200  # 2024-01-01


def url_captures(pages):
    """Pages as captures: the crawl takes one of 360 days by the digest of its page id."""
    draw = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long")
    return pages.select(F.col("page_id").alias("capture_id"), "url", (F.lit(START) + draw % (360 * DAY)).alias("fetched_at"))


def url_entries(pages):
    """Dated list entries that follow from the hosts of the pages.

    By its digest a host is blocked from some day on, lifted 60 days later and blocked again after 90 more; its
    parent domain is allowed by another list from a day on; some first path steps are blocked for 200 days.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), "url").where("host IS NOT NULL").withColumn(
        "d", F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    )
    start = F.lit(START) + (F.col("d") % 150) * DAY
    entry = lambda *x: F.struct(*[c.alias(n) for c, n in zip(x, ("list", "kind", "value", "verdict", "active", "since"))])
    text, yes, no = F.lit, F.lit(True), F.lit(False)
    by_host = hosts.select("host", "d").distinct().select(F.explode(F.concat(
        F.when(F.col("d") % 3 == 0, F.array(*[
            entry(text("ut1"), text("host"), F.col("host"), text("block"), on, start + after * DAY)
            for on, after in ((yes, 0), (no, 60), (yes, 150))])).otherwise(F.array()),
        F.when(F.col("d") % 4 == 1, F.array(
            entry(text("curated"), text("domain"), F.substring_index("host", ".", -2), text("allow"), yes, start))).otherwise(F.array()),
    )).alias("e")).select("e.*")
    step = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1)
    by_path = hosts.where(F.col("d") % 5 == 2).select("host", step.alias("step"), "d").where("step <> ''").distinct().select(F.explode(F.array(*[
        entry(text("paths"), text("prefix"), F.concat_ws("/", "host", "step"), text("block"), on, start + after * DAY)
        for on, after in ((yes, 0), (no, 200))])).alias("e")).select("e.*")
    return by_host.unionByName(by_path).distinct()


def op2_url_filter(spark, folder):
    pages = table(spark, folder, "pages")
    return url_verdicts(url_captures(pages), url_entries(pages)).withColumnRenamed("capture_id", "page_id")


def op3_mix_sources(spark, folder):
    return mix_counts(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc_captures(spark, folder):
    archives = new_folder(spark, "warc")
    write_archives(table(spark, folder, "pages"), archives, every_row=True)
    captures = new_folder(spark, "captures")  # page ids are looked up among the captures themselves
    assembled = assemble(read_archives(spark, archives, keep_payload=False)).select("record_id", "response", "metadata")
    assembled.write.option("compression", "zstd").parquet(captures)
    found = page_ids(spark.read.parquet(captures))
    return found.select(
        "page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )


def op5_jaccard_join(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


def op6_line_dedup(spark, folder):
    """Lines of every document, how many go, and the digest of the text that stays."""
    return drop_recurring_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")
    )


def op7_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))


def op8_license_scan(spark, folder):
    return license_scan(table(spark, folder, "documents"))


def op9_quality_classifier(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_language_id(spark, folder):
    return identify(table(spark, folder, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_filter": op2_url_filter,
    "op3_mix_sources": op3_mix_sources,
    "op4_warc_captures": op4_warc_captures,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_chat_formatting": chat_query.op11_chat_formatting,
    "op12_merkle_manifest": manifest_query.op12_merkle_manifest,
    "op13_spelling_variants": spelling_query.op13_spelling_variants,
}

SQL = {
    "op1_decontaminate": r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, coalesce(w, []) AS w, coalesce(len(w), 0) AS n FROM lowered),
tests AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM tests WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, n - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM item_windows) WHERE n >= k)),
hits AS (SELECT doc_id, d.k, i, item_id FROM doc_windows d JOIN item_windows t ON d.k = t.k AND d.words = t.words),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op2_url_filter": r"""
WITH captures AS (
  SELECT page_id, url, CAST(1704067200 + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 31104000 AS BIGINT) AS fetched_at,
    nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host FROM pages),
hosts AS (
  SELECT host, url, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS d,
    1704067200 + CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % 150 * 86400 AS start FROM captures WHERE host IS NOT NULL),
entries AS (
  SELECT DISTINCT 'ut1' AS list, 'host' AS kind, host AS value, 'block' AS verdict, a.active, start + a.days * 86400 AS since
  FROM hosts, (VALUES (true, 0), (false, 60), (true, 150)) a(active, days) WHERE d % 3 = 0
  UNION
  SELECT DISTINCT 'curated', 'domain', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), 'allow', true, start FROM hosts WHERE d % 4 = 1
  UNION
  SELECT DISTINCT 'paths', 'prefix', host || '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1), 'block', a.active, start + a.days * 86400
  FROM hosts, (VALUES (true, 0), (false, 200)) a(active, days)
  WHERE d % 5 = 2 AND regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1) <> ''),
spans AS (
  SELECT * FROM (
    SELECT list, kind, value, verdict, active, since, lead(since) OVER (PARTITION BY list, kind, value ORDER BY since) AS until
    FROM (SELECT list, kind, value, since, bool_or(active) AS active, min(verdict) FILTER (active) AS verdict
          FROM entries GROUP BY list, kind, value, since)) WHERE active),
parts AS (
  SELECT page_id, url, fetched_at, host, string_split(host, '.') AS labels,
    string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '^/|/$', '', 'g'), '/') AS steps
  FROM captures WHERE host IS NOT NULL),
keys AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS value, 0 AS depth FROM parts
  UNION ALL
  SELECT page_id, fetched_at, 'domain', array_to_string(labels[len(labels) - k + 1:], '.'), k
  FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS k FROM parts)
  UNION ALL
  SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(steps[1:k], '/'), k
  FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS k FROM parts)),
hits AS (
  SELECT page_id, list, k.kind, k.value, verdict, since,
    row_number() OVER (PARTITION BY page_id ORDER BY CASE k.kind WHEN 'prefix' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, depth DESC, verdict, list) AS place,
    count(*) OVER (PARTITION BY page_id) AS matches
  FROM (SELECT DISTINCT * FROM keys) k JOIN spans s ON k.kind = s.kind AND k.value = s.value AND since <= fetched_at AND (until IS NULL OR fetched_at < until))
SELECT c.page_id, url, fetched_at, host, verdict, list, kind, value, since, coalesce(matches, 0) AS matches
FROM captures c LEFT JOIN (SELECT * FROM hits WHERE place = 1) h ON c.page_id = h.page_id
""",
    "op3_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
weighted AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, source_size * 3 AS ceiling FROM placed),
levels AS (
  SELECT *, CAST(ceiling AS DOUBLE) / weight AS full_at FROM weighted),
levelled AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(ceiling) OVER e, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS DOUBLE) AS level
  FROM levels WINDOW e AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT level AS water FROM levelled WHERE level <= full_at ORDER BY full_at, place LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * coalesce((SELECT water FROM water), 0.0), CAST(ceiling AS DOUBLE)) AS target
  FROM levelled),
steps AS (
  SELECT s.*, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY length(bin(s.size)), substr(bin(s.size), 1, 5), s.draw, s.doc_id NULLS LAST, s.size) AS step,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('s' || s.source, 'n')), 1, 6) AS BIGINT) AS DOUBLE) / 16777216 AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * step + start) - floor(rate * (step - 1) + start) AS BIGINT) * size AS taken
FROM steps
""",
    "op4_warc_captures": r"""
WITH hashed AS (
  SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, url, body, [CAST('0x' || substr(h, CAST(i AS INT) * 5 + 1, 5) AS BIGINT) FOR i IN range(8)] AS parts FROM hashed),
known AS (
  SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[k // 4 + 1] // CAST(power(32, 3 - k % 4) AS BIGINT)) % 32 + 1 AS INT), 1)
      FOR k IN range(32)], '') AS payload_digest
  FROM coded),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM known
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to
FROM ranked
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meetings AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
linked AS (
  SELECT a, b FROM meetings JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
labels AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN labels USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
exploded AS (SELECT doc_id, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM split),
cleaned AS (SELECT doc_id, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS clean FROM exploded),
masked AS (SELECT doc_id, pos, clean, regexp_replace(clean, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM cleaned),
tokens AS (SELECT doc_id, pos, clean, line, string_split(line, ' ') AS w FROM masked WHERE line <> ''),
lines AS (SELECT doc_id, pos, clean, line, w, (len(w) || ' ' || array_to_string(w[1:2], ' ')) AS leaf FROM tokens),
busy AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
inside AS (SELECT * FROM lines WHERE leaf IN (SELECT leaf FROM busy)),
distinct_lines AS (SELECT leaf, line, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM inside WHERE len(w) >= 4 GROUP BY leaf, line),
parts AS (SELECT leaf, line, docs, unnest(w) AS token, unnest(range(len(w))) AS place FROM distinct_lines),
constant AS (
  SELECT leaf, place, token, token <> '<*>' AND sum(docs) >= 5 AS keep FROM parts GROUP BY leaf, place, token),
shapes AS (
  SELECT leaf, line, CASE WHEN avg(CAST(keep AS INT)) >= 0.6
    THEN string_agg(CASE WHEN keep THEN token ELSE '<*>' END, ' ' ORDER BY place) END AS template
  FROM parts JOIN constant USING (leaf, place, token) GROUP BY leaf, line),
shaped AS (
  SELECT doc_id, pos, leaf, template IS NOT NULL AS general, coalesce(template, clean) AS template FROM inside LEFT JOIN shapes USING (leaf, line)),
many AS (SELECT leaf, general, template FROM shaped GROUP BY leaf, general, template HAVING count(DISTINCT doc_id) >= 5),
gone AS (
  SELECT doc_id, list(pos) AS pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY leaf, general, template ORDER BY doc_id, pos) AS place
    FROM shaped JOIN many USING (leaf, general, template)) WHERE place > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(len(lines), 0)::INT AS n_lines, coalesce(len(pos), 0)::INT AS n_dropped,
  sha256(array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(coalesce(pos, []), i)], chr(10))) AS text_sha256
FROM split LEFT JOIN gone USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
groups AS (
  SELECT doc_id, sha256(body) AS text_sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM rows WINDOW w AS (PARTITION BY body))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM groups
""",
}


_TEMPLATE_ROWS = ", ".join(
    f"('{name}', [{', '.join(repr(p) for p in pairs)}])" for name, pairs in template_bigrams()
)
SQL["op8_license_scan"] = rf"""
WITH templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) t(license, pairs)),
clean AS (
  SELECT doc_id, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
pieces AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS piece FROM clean
  UNION ALL
  SELECT doc_id, piece FROM (SELECT doc_id, unnest(string_split_regex(t, '\n[ \n]*\n')) AS piece FROM clean) WHERE contains(piece, chr(10))),
words AS (SELECT doc_id, regexp_extract_all(piece, '[a-z0-9]+') AS w FROM pieces),
pairs AS (
  SELECT doc_id, array_to_string(w, ' ') AS unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS mine
  FROM words WHERE len(w) >= 2),
found AS (
  SELECT doc_id, unit, license, max(2.0 * len(list_intersect(mine, pairs.pairs)) / (len(mine) + len(pairs.pairs))) AS dice
  FROM (SELECT p.doc_id, p.unit, p.mine, t.license, t.pairs FROM pairs p JOIN templates t
        ON len(p.mine) >= len(t.pairs) * {LEAST / (2 - LEAST)!r} AND len(p.mine) <= len(t.pairs) / {LEAST / (2 - LEAST)!r}) pairs
  GROUP BY doc_id, unit, license HAVING dice >= {LEAST}),
best AS (
  SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(*) AS n_matches FROM found GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(n_matches, 0) AS n_matches FROM documents LEFT JOIN best USING (doc_id)
"""


SQL["op11_chat_formatting"] = chat_query.SQL
SQL["op12_merkle_manifest"] = manifest_query.SQL
SQL["op13_spelling_variants"] = spelling_query.SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
