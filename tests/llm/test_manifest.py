"""The dataset manifest against a plain tree, and odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scoreloom.llm.merkle import manifest, row_leaf, with_proofs

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, path string, kept int, parent string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, arity):
    """Root of a list of digests, and for every one its siblings level by level as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            start = at[k] - at[k] % arity
            run = nodes[start: start + arity]
            p.append((run[: at[k] - start], run[at[k] - start + 1:]))
            at[k] //= arity
        nodes = [h(*nodes[i: i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def fold(digest, path):
    for before, after in path:
        digest = h(*before, digest, *after)
    return digest


def plain(rows, arity):
    groups = {}
    for r in rows:
        own = leaf(*r[:5])
        shown = leaf(*r[:3], r[3] + 1, r[4]) if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
        groups.setdefault(r[2], []).append((r[0], own, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [climb([x[1] for x in groups[g]], arity) for g in names]
    root, upper = climb([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), up in zip(names, trees, upper):
        for (i, own, shown), path in zip(groups[g], paths):
            proof = h(*[d for before, after in path + up for d in before + after])
            found = fold(shown, path + up)
            out.append((i, own, subroot, root, proof, found, found == root))
    return sorted(out, key=repr)


def found(spark, rows, arity):
    docs = spark.createDataFrame(rows, SCHEMA)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [c + 1 if k == 3 else c for k, c in enumerate(columns)]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", F.col("lang").alias("grp"), row_leaf(*columns).alias("leaf"), F.when(hit, row_leaf(*changed)).alias("shown"))
    placed = with_proofs(manifest(leaves, [F.col("doc_id")], arity), F.coalesce("shown", "leaf"), arity)
    return sorted((tuple(r) for r in placed.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def row(i, lang, text="t", n=3, source="s"):
    return (i, source, lang, n, text, "p", 1, "q")


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_equals_a_plain_tree(spark, arity):
    draw = random.Random(arity)
    rows = [row(draw.choice([None, k, k, k % 9]), draw.choice(["en", "en", "en", "Ü", None, ""]), draw.choice([None, "", "é" * 300, "x y"]),
                draw.choice([None, 5]), draw.choice([None, "a"])) for k in range(45)]
    rows += [row(1, "alone"), row(2, "pair"), row(3, "pair"), row(3, "pair")]
    got = found(spark, rows, arity)
    assert got == plain(rows, arity)
    assert any(not r[-1] for r in got) and sum(r[-1] for r in got) > 30


def test_odd_tables(spark):
    assert found(spark, [], 2) == []
    one = [row(4, None, "word " * 60_000, None)]
    assert found(spark, one, 2) == plain(one, 2)
    assert found(spark, one, 2)[0][4] == h() and found(spark, one, 2)[0][1] == found(spark, one, 2)[0][3]
    twice = [row(7, "x")] * 3
    assert found(spark, twice, 2) == plain(twice, 2)
    with pytest.raises(ValueError):
        found(spark, twice, 1)
