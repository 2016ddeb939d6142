"""The pipeline against plain Python versions of its stages."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from scoreloom.llm.langid import identify
from tests.llm.test_operators import brute_components, brute_hits, words_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(docs, min_docs=5, depth=2, min_tokens=4, least=0.6):
    lines = []
    for i, text in docs.items():
        for pos, raw in enumerate(text.split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split(" ")]
            if line:
                lines.append((i, pos, (len(tokens), *tokens[:depth]), tuple(tokens), line))
    in_leaf, in_line = defaultdict(set), defaultdict(set)
    for i, _, leaf, tokens, _ in lines:
        in_leaf[leaf].add(i)
        in_line[tokens].add(i)
    busy = [x for x in lines if len(in_leaf[x[2]]) >= min_docs]
    support = Counter()
    for leaf, tokens in {(leaf, tokens) for _, _, leaf, tokens, _ in busy}:
        for at, token in enumerate(tokens):
            support[leaf, at, token] += len(in_line[tokens])

    def template(leaf, tokens, line):
        constant = [t != "<*>" and support[leaf, at, t] >= min_docs for at, t in enumerate(tokens)]
        if len(tokens) >= min_tokens and sum(constant) >= least * len(tokens):
            return leaf, True, tuple(t if c else "<*>" for t, c in zip(tokens, constant))
        return leaf, False, line

    places = defaultdict(list)
    for i, pos, leaf, tokens, line in busy:
        places[template(leaf, tokens, line)].append((i, pos))
    gone = {p for found in places.values() if len({i for i, _ in found}) >= min_docs for p in sorted(found)[1:]}
    out = {}
    for i, text in docs.items():
        kept = [x for pos, x in enumerate(text.split("\n")) if (i, pos) not in gone]
        new = "\n".join(kept)
        if len(kept) == len(text.split("\n")) or re.search(r"[^\x20\x09-\x0D]", new):
            out[i] = new
    return out


def decontaminate(docs, items):
    out = {}
    for i, text in docs.items():
        n, hit, _ = brute_hits(text, items, 10)
        if len(hit) > 0.5 * n:
            continue
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(UPPER))]
        new, at, runs = "", 0, []
        for k in hit:
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        for a, b in runs:
            new += text[at:spans[a][0]]
            at = spans[b][1]
        out[i] = new + text[at:]
    return out


def mix(docs, source):
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for i, t in docs.items()}
    per = Counter()
    for i in docs:
        per[source[i]] += size[i]
    names = sorted(per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full, target = sum(per.values()), set(), {}
    while True:  # share, stop at three times the size, share the excess again
        level = (total - sum(3 * per[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weight[s] * level > 3 * per[s]}
        if not above:
            break
        full |= above
    for s in names:
        target[s] = 3 * per[s] if s in full else weight[s] * level
    copies = {}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for s in names:
        rate, start = target[s] / per[s], int(md5("mix:s" + s)[:6], 16) / (1 << 24)
        members = sorted((len(bin(size[i])) - 2, bin(size[i])[2:7], md5(f"mix:{i}"), i) for i in docs if source[i] == s)
        for step, (*_, i) in enumerate(members, 1):
            copies[i] = math.floor(rate * step + start) - math.floor(rate * (step - 1) + start)
    return copies


def test_stages_equal_brute_force(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet")
    source = {r.doc_id: r.source for r in rows.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    known = {r.doc_id for r in identify(rows).collect() if r.lang_pred != "und" and r.score >= 0.35}
    state = {r.doc_id: r.text for r in rows.collect() if r.doc_id in known}
    docs = rows
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, tables)
        got = docs.collect()
        if name == "line_dedup":
            state = line_dedup(state)
        elif name == "ngram_jaccard":
            ids = sorted(state)
            _, labels = brute_components([state[i] for i in ids])
            state = {i: state[i] for k, i in enumerate(ids) if labels[k] == k}
        elif name == "benchmark_decontamination":
            state = decontaminate(state, items)
        elif name == "mix_sources":
            assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in mix(state, source).items() if n})
            assert all(r.text == state[r.doc_id] for r in got)
            continue
        assert {r.doc_id: r.text for r in got} == state and len(got) == len(state), name
        assert docs.columns == columns
        assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("kind", ["empty", "nulls", "extra"])
def test_stages_take_odd_tables(spark, tables, kind):
    rows = spark.read.parquet(f"{tables}/documents.parquet").limit(6)
    odd = {
        "empty": rows.limit(0),
        "nulls": rows.unionByName(rows.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, 0), (8, "", "", "", 0)], rows.schema)),
        "extra": rows.selectExpr("*", "1 AS copy", "2 AS id", "3 AS n_lines", "4 AS row", "5 AS key", "6 AS likely"),
    }[kind]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, tables)
        got = found.collect()
        assert len(got) <= 3 * max(odd.count(), 1)
        if name != "mix_sources":
            assert found.columns == odd.columns and (kind == "empty") == (not got)


def test_tables_of_numbers_stay(spark, tables):
    rows = [(i, f"page {i} own words stand here\n{i} {i + 1} 34.5 78\nTotal {i} 20{i} 7\n1 2 3 4", "en", "s", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, docs, tables).collect()}
    for i in range(8):
        assert {f"{i} {i + 1} 34.5 78", f"Total {i} 20{i} 7"} <= set(texts[i])
        assert ("1 2 3 4" in texts[i]) == (i == 0)  # equal rows are copies


def test_stages_read_what_the_one_before_wrote(spark, tables, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append((docs.count(), docs.inputFiles()))
        return docs.limit(docs.count() - 1)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    n = corpus_pipeline.run(spark, tables).count()
    assert [x for x, _ in read] == [n + 3, n + 2, n + 1]
    for name, (_, files) in zip(("one", "two"), read[1:]):
        assert files and all(f"/{name}-" in f for f in files)


def test_words_match_the_contract():
    assert words_of("Añb-9 C_d") == ["añb", "9", "c", "d"]
