"""The registered query of the spelling variants and its SQL."""

from scoreloom.llm.manifest_query import crc32_sql
from scoreloom.llm.spelling import spelling_variants


def op13_spelling_variants(spark, folder):
    return spelling_variants(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, count(*) AS times, {crc32_sql("(coalesce(id, 'null') || ':' || run)")} AS h FROM runs WHERE length(run) >= 7 GROUP BY id, run),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
shorter AS (SELECT DISTINCT word, n, a || b AS other FROM masked),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM masked x JOIN masked y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL
  SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.other = w.word
  UNION ALL
  SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.other = w.word),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, form, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, c.form, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON f.word = e.word
"""
