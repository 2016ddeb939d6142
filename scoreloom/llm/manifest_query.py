"""The registered query of the dataset manifest and its SQL."""

from pyspark.sql import functions as F

from scoreloom.llm.merkle import manifest, row_leaf, with_proofs

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark, folder):
    """Documents as leaves, one tree per language; some n_chars are tampered with after the manifest was made."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select(
        "doc_id", F.col("lang").alias("grp"), row_leaf(*[F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(hit, row_leaf(*changed)).alias("tampered"),
    )
    placed = manifest(leaves, [F.col("doc_id")])
    return with_proofs(placed, F.coalesce("tampered", "leaf")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


# CRC-32 of a text: half a byte a step, by the table of the polynomial
NIBBLES = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text in UTF-8."""
    hexed = f"hex(encode({text}))"
    low = f"list_transform(range(len({hexed})), lambda i: strpos('0123456789ABCDEF', substr({hexed}, (i + 1 + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END)::INT, 1)) - 1)"
    return f"xor(list_reduce({low}, lambda crc, x: xor(crc >> 4, {NIBBLES}[((xor(crc, x)) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _leaf_sql(n_chars: str) -> str:
    parts = [f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts) + ")"


def _levels(name: str, start: str) -> str:
    """CTE of all levels of the trees over the lists of ``start`` (g, l)."""
    return f"""{name} AS (
  SELECT g, 0 AS level, l FROM {start}
  UNION ALL
  SELECT g, level + 1, [sha256(l[i] || coalesce(l[i + 1], '')) FOR i IN range(1, len(l) + 1, 2)] FROM {name} WHERE len(l) > 1)"""


STEPS = """list({before: CASE WHEN (idx >> level) % 2 = 1 THEN l[(idx >> level)::BIGINT] ELSE '' END,
  after: CASE WHEN (idx >> level) % 2 = 0 THEN coalesce(l[(idx >> level)::BIGINT + 2], '') ELSE '' END} ORDER BY level) FILTER (len(l) > 1)"""

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || lang, 'n') AS g, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS changed,
    n_chars IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
lists AS (SELECT g, list(leaf ORDER BY idx) AS l FROM placed GROUP BY g),
{_levels("trees", "lists")},
subroots AS (SELECT g, l[1] AS subroot FROM trees WHERE len(l) = 1),
top_list AS (SELECT 'all' AS g, list(subroot ORDER BY g) AS l FROM subroots),
{_levels("top", "top_list")},
groups AS (SELECT g, subroot, row_number() OVER (ORDER BY g) - 1 AS idx FROM subroots),
group_steps AS (SELECT s.g, any_value(subroot) AS subroot, coalesce({STEPS}, []) AS upper FROM groups s, top GROUP BY s.g),
steps AS (
  SELECT doc_id, idx, p.g, leaf, changed, hit, coalesce({STEPS}, []) AS lower FROM placed p JOIN trees t ON p.g = t.g GROUP BY ALL),
whole AS (
  SELECT doc_id, leaf, subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root, CASE WHEN hit THEN changed ELSE leaf END AS shown,
    list_concat(lower, upper) AS path FROM steps JOIN group_steps USING (g)),
ends AS (
  SELECT *, list_reduce(path, lambda acc, s: sha256(s.before || acc || s.after), shown) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.before || s.after FOR s IN path], '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM ends
"""
