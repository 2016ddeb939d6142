"""Edge cases of the pipeline operators and comparisons with brute force."""

import contextlib
import io
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm.components import component_labels
from scoreloom.llm.decontaminate import _joined, contamination, decontaminate, scanner
from scoreloom.llm.exact_dedup import exact_dedup
from scoreloom.llm import jaccard_join, line_templates
from scoreloom.llm.jaccard_join import keep_one_of_each, near_duplicates
from scoreloom.llm.langid import identify, keep_identified
from scoreloom.llm.licenses import TEMPLATES, license_scan
from scoreloom.llm.line_templates import drop_recurring_lines
from scoreloom.llm.mixing import emit_mix, mix_counts, source_targets
from scoreloom.llm.quality import quality_scores
from scoreloom.llm.url_filter import host_of, intervals, url_verdicts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, kept string, size int, copy int, body string"
LONG = "word " * 60_000


def docs_of(spark, texts, ids=None, source="s", lang="en"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, 1, "x", "y", 7, 8, "z") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "a", "a", LONG, LONG, "ü é 漢字", "1 2 3", None]
ODD_IDS = [5, 3, 9, 2, 2, 8, 1, None, 11, None]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, ODD_IDS)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def items_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts)), "item_id bigint, text string")


# --- exact dedup ---------------------------------------------------------------------------


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("hits", [2, 10_000])  # with and without texts that count as hot
def test_exact_dedup_equals_brute_force(spark, hits):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a  b", "a b", "a\nb ", "c", None, "", "d" * draw.randrange(1, 4)])) for i in range(200)]
    draw.shuffle(rows)
    found = exact_dedup(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), sample_hits=hits).collect()
    groups = brute_groups(rows)
    text = dict(rows)
    assert len(found) == 200
    for r in found:
        group = groups[re.sub(r"[\x20\x09-\x0D]+", " ", text[r.doc_id] or "")]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), r.doc_id == min(group))


def test_exact_dedup_odd_rows(odd, empty):
    rows = exact_dedup(odd).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == 6
    assert [r.keep_id for r in rows if r.group_size == 3] == [3, 3, 3]
    assert [r.keep_id for r in rows if r.doc_id is None and r.group_size == 1] == [None]
    assert exact_dedup(empty).collect() == []


# --- mixing -----------------------------------------------------------------------------------


def test_targets_are_filled_up_by_weight(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 30), (None, 60)], "source string, source_size bigint")
    found = {r.source: r.target for r in source_targets(sources).collect()}
    assert sum(found.values()) == pytest.approx(1100) and found["a"] == 30
    # a (5) is full, c (1) is full, the null source weighs 5 like the first
    assert found["c"] <= 90 and found[None] <= 180 and found["b"] / 2 >= found["c"]


def test_mix_comes_near_its_targets_and_repeats(spark):
    draw = random.Random(2)
    rows = [(i, "w " * int(draw.paretovariate(1.2) * 20 % 3000), "en", draw.choice("aaaabbc"), 1, "", "", 0, 0, "") for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mix_counts(docs)
    assert found.exceptAll(mix_counts(docs.repartition(7))).isEmpty()
    per = found.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"))
    for r in per.collect():
        assert abs(r.taken - r.target) <= max(0.05 * r.target, 2 * r.largest)
    assert found.where("taken > 3 * size").isEmpty()
    assert emit_mix(docs).count() == found.agg(F.sum("copies")).first()[0]


def test_mix_odd_rows(odd, empty):
    rows = mix_counts(odd).collect()
    assert len(rows) == len(ODD) and all(r.copies == 1 for r in rows) and {r.size for r in rows} >= {0, 60_000}
    assert mix_counts(empty).collect() == [] and emit_mix(empty).collect() == []
    assert mix_counts(odd.withColumn("text", F.lit(None).cast("string"))).where("taken <> 0").isEmpty()


def test_mix_emits_every_row_with_its_own_copies(spark):
    # the source takes three copies of each row: null and repeated ids get no more and no less
    texts, ids = ["a b", "c d", "e f", "e f", "g h", "i j"], [None, None, 4, 4, 4, 6]
    docs = docs_of(spark, texts, ids).unionByName(docs_of(spark, ["w " * 5000], [9], source="t"))
    got = Counter((r.doc_id, r.text, r.copy) for r in emit_mix(docs).where("source = 's'").collect())
    assert got == Counter((i, t, c) for i, t in zip(ids, texts) for c in (1, 2, 3))
    counts = Counter({(r.doc_id, r.size): r.n for r in mix_counts(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()})
    rows = emit_mix(docs).withColumn("size", F.size(F.split(F.trim("text"), " "))).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == +counts


# --- decontamination ---------------------------------------------------------------------------


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, window):
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        w = words_of(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == w[k:k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(words), sorted(hit), sorted(names)


@pytest.mark.parametrize("shard_words", [2_000_000, 3])  # one automaton, and several
@pytest.mark.parametrize("shortest", [1, 2, 5])
def test_contamination_equals_brute_force(spark, shortest, shard_words):
    draw = random.Random(shortest)
    make = lambda n: " ".join(draw.choice("aBcÄ") for _ in range(n))
    items = [(k, make(draw.randrange(shortest, 9))) for k in range(6)] + [(7, ""), (8, None), (9, "...")]
    texts = [make(draw.randrange(0, 40)) for _ in range(40)] + [None, "", "--"]
    found = contamination(docs_of(spark, texts), items_of(spark, [t for _, t in items], [k for k, _ in items]), window=4, shard_words=shard_words)
    for r in found.collect():
        n, hit, names = brute_hits(texts[r.doc_id], items, 4)
        assert (r.n_words, r.positions, r.items) == (n, hit, names)


def test_passages_are_cut_and_covered_documents_go(spark):
    passage = "one two three four five six seven eight nine ten"
    texts = [f"before. {passage.title()}! after", passage, None, "", "clean text"]
    kept = decontaminate(docs_of(spark, [t + " x" * 20 if t and "before" in t else t for t in texts]), items_of(spark, [passage]))
    rows = {r.doc_id: r for r in kept.collect()}
    assert sorted(rows) == [0, 2, 3, 4]
    assert rows[0].text == "before. ! after" + " x" * 20 and rows[4].text == "clean text" and rows[2].text is None
    assert kept.columns == docs_of(spark, []).columns


def test_contamination_odd_rows(spark, odd, empty):
    items = items_of(spark, ["a", "word word", None], [1, None, 2])
    rows = contamination(odd, items).collect()
    assert len(rows) == len(ODD) and sum(r.contaminated for r in rows) == 4
    assert {r.n_hit for r in rows if r.n_words == 60_000} == {60_000} and {r.n_items for r in rows if r.n_words == 60_000} == {0}
    assert contamination(empty, items).collect() == [] and decontaminate(odd, items_of(spark, [])).count() == len(ODD)


def test_shards_give_what_one_automaton_gives(spark):
    # two overlapping windows, a document with 40 % of each of two items, joined rests, repeated and null ids
    items = items_of(spark, ["a b c d", "d e f g", "h i j k", "x a b y", "p q r s"])
    texts = ["0 a b c d e f g 1 2 3 4 5 6 7 8 9", "a b c d h i j k 1 2", "x a h i j k b y 1 2 3 4 5 6 7 8", "p q r s 1 2 3 4 5 6",
             "p q r s 1 2 3 4 5 6", "p q r s 1 2 3 4 5 6", None, "", "clean", "Ä! P q-R  s, Ä 1 2 3 4 5"]
    docs = docs_of(spark, texts, [0, 1, 2, 3, 3, None, None, 7, 8, 9])
    one, many = (sorted(map(repr, decontaminate(docs, items, window=4, shard_words=n).collect())) for n in (2_000_000, 3))
    assert one == many and len(many) == len(texts) - 1
    one, many = (sorted(map(repr, contamination(docs, items, window=4, shard_words=n).collect())) for n in (2_000_000, 3))
    assert one == many and len(many) == len(texts)


def test_each_shard_scans_a_text_once(spark):
    # filters on what a scan found must not be moved below it: the scan would run again, in a worker of its own
    def scans_in(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("ArrowEvalPython [scan(" in line for line in plan.split("\n"))

    docs, items = docs_of(spark, ["a b c d e", "clean"]), items_of(spark, ["a b c d", "d e f g", "h i j k"])
    assert scans_in(contamination(docs, items, window=4)) == 1
    assert scans_in(decontaminate(docs, items, window=4)) == 1
    assert scans_in(decontaminate(docs, items, window=4).withColumn("n_chars", F.length("text")).where("n_chars > 0")) == 1
    shards = scanner(items, 4, "item_id", "text", 3, cut=True)
    assert len(shards) > 1
    for hits_only in (False, True):
        assert scans_in(_joined(docs.withColumn("key", F.col("doc_id")), shards, hits_only)) == len(shards)


# --- Jaccard join ----------------------------------------------------------------------------------


def shingle_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("block", [1000, 3])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "STRAGGLERS", block)
    monkeypatch.setattr(jaccard_join, "MEMBERS", block)
    draw = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = [None, "", "  ", "One two", "one TWO", "a b c d e", "x " * 50, "x " * 30]
    for _ in range(60):  # a group of copies with more or less changes
        w = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            w[draw.randrange(60)] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(w[draw.randrange(3):]))
    for _ in range(40):
        texts.append(" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 30))))
    sizes, labels = brute_components(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(spark, texts).repartition(5)).collect()}
    assert found == {i: (sizes[i], labels[i]) for i in range(len(texts))}


def test_jaccard_in_many_buckets(spark, monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") * 3 + str(draw.randrange(40)) for _ in range(30)) for _ in range(40)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:20]] + texts[:10]
    wanted = sorted(near_duplicates(docs_of(spark, texts)).collect())
    assert sum(r.doc_id != r.component_id for r in wanted) == 30
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 20)
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(jaccard_join, "SEEN", 1)
    assert sorted(near_duplicates(docs_of(spark, texts)).collect()) == wanted


def test_jaccard_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in rows if r.n_shingles == 1 and r.doc_id} >= {(2, 2), (8, 1), (1, 1)}
    assert near_duplicates(empty).collect() == []
    kept = keep_one_of_each(odd)
    left = [i for k, i in enumerate(ODD_IDS) if i != 8 and k != 4]  # 8 is a copy of 1, the fifth row repeats the fourth
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, left)) and kept.columns == odd.columns


def test_one_of_repeated_rows_stays(spark):
    text, other = "a b c d e f g h i j", "words of another text that is here"
    rows = [(1, text), (1, text), (1, text), (None, text), (None, text), (2, text), (3, other), (3, other), (4, None), (4, None), (5, ""), (6, "a")]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = sorted(((r.doc_id, r.text) for r in keep_one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(1, text), (None, text), (3, other), (4, None), (5, ""), (6, "a")], key=repr)


def test_long_chain_of_links(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 501), (3, 3), (None, 4)], "a bigint, b bigint")
    found = {r.node: r.label for r in component_labels(edges).collect()}
    assert found == {**{k: 0 for k in range(n + 1)}, 500: 500, 501: 500}
    assert component_labels(edges.limit(0)).collect() == []


def test_prefixes_of_a_task_take_little_memory():
    # numpy reports its arrays to tracemalloc; fixed parts (sketch, powers) are of the order of 10 MB
    draw = np.random.default_rng(5)
    texts = [" ".join(map(str, draw.integers(0, 10**6, 300))) for _ in range(6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k: k + 3000])], ["text"]) for k in (0, 3000)]
    levels = SimpleNamespace(value=np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8))
    tracemalloc.start()
    try:
        sent = sum(b.num_rows for b in jaccard_join._prefix_blocks(iter(batches), levels, 4))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert sent > 0 and peak < 60, peak


# --- lines -----------------------------------------------------------------------------------------


def test_templates_with_variable_fields_go_but_for_the_first(spark):
    names = ["anna", "bert", "carl", "dora", "emil", "fritz"]
    texts = [f"own text number {k} of {n} stays here\nDear user {n} your order {k} is ready now\nEnd {n}." for k, n in enumerate(names)]
    rows = {r.doc_id: r for r in drop_recurring_lines(docs_of(spark, texts), min_docs=5, depth=1).collect()}
    assert "Dear user anna" in rows[0].text and rows[0].n_dropped == 0
    for k in range(1, 6):
        assert "Dear user" not in rows[k].text and rows[k].n_lines == 3 and "End" in rows[k].text


def test_short_lines_and_rows_of_numbers_go_as_they_stand(spark):
    texts = [f"All rights reserved.\nYear {k}\n{k} {k + 1} 34.5 78\nMenu" for k in range(8)]
    rows = {r.doc_id: r for r in drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert rows[0].text == texts[0]
    assert all(rows[k].text == f"Year {k}\n{k} {k + 1} 34.5 78" and rows[k].n_dropped == 2 for k in range(1, 8))


def test_lines_below_the_threshold_stay(spark):
    texts = ["this line is in four documents\nx" for _ in range(4)] + ["other words stand in this one here"]
    assert drop_recurring_lines(docs_of(spark, texts)).where("n_dropped > 0").isEmpty()


def test_line_dedup_odd_rows(odd, empty, spark):
    kept = drop_recurring_lines(odd)
    rows = kept.collect()
    assert len(rows) == len(ODD) and all(r.n_dropped == 0 for r in rows)
    assert sorted(str(r.text) for r in rows) == sorted(str(t) for t in ODD) and drop_recurring_lines(empty).collect() == []
    many = docs_of(spark, ["one line that many hold\n" * 3] * 6, [1, 1, 2, 3, 4, None])
    assert drop_recurring_lines(many, min_docs=5).where("n_dropped > 0").isEmpty()  # four ids only
    dropped = drop_recurring_lines(many, min_docs=4).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_dropped) for r in dropped] == [(None, 0), (1, 2), (1, 2), (2, 3), (3, 3), (4, 3)]


def test_tokens_of_lines_cross_no_shuffle(spark, monkeypatch):
    plans = []

    def staged(df, name, write=line_templates._staged):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        plans.append(out.getvalue())
        return write(df, name)

    monkeypatch.setattr(line_templates, "_staged", staged)
    names = ["anna", "bert", "carl", "dora", "emil", "fritz"]
    drop_recurring_lines(docs_of(spark, [f"Dear user {n} your order {k} is ready now" for k, n in enumerate(names)])).collect()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", "".join(plans))
    assert dealt and not [x for x in dealt if "token#" in x or "at#" in x]


def test_leaves_of_very_many_lines_drop_the_same(spark, monkeypatch):
    draw = random.Random(6)
    texts = ["\n".join(f"Posted by {draw.choice('abcdefgh')} in {draw.choice('uvwxyz')} on day {k} {draw.choice('pqr')} x {draw.choice('stuvwxyz')}{j}" for j in range(3))
             + f"\nAll other words stay {draw.choice('ab')} here {k % 7}\nMenu" for k in range(60)]
    docs = docs_of(spark, texts)
    found = [sorted(r[:] for r in drop_recurring_lines(docs).select("doc_id", "text", "n_dropped").collect())]
    for most in (0, 1, 50):  # all, some and few leaves are worked on by all tasks
        monkeypatch.setattr(line_templates, "LEAF_LINES", most)
        found.append(sorted(r[:] for r in drop_recurring_lines(docs).select("doc_id", "text", "n_dropped").collect()))
    assert sum(r[2] for r in found[0]) > 60 and all(x == found[0] for x in found)


# --- licenses ----------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = TEMPLATES["MIT"][1]
    texts = [
        "Some code.\nReleased under the MIT License.\nMore.", "intro words\n\n" + mit[:200] + "\n" + mit[200:] + "\n\nend of it",
        "Licensed under the apache license version 2.0 ok", "nothing here", None, "", "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.\nLicensed under the Apache License, Version 2.0.",
    ]
    rows = {r.doc_id: r for r in license_scan(docs_of(spark, texts)).collect()}
    assert [rows[k].license for k in range(8)] == ["MIT", "MIT", "Apache-2.0", None, None, None, "CC-BY-NC-4.0", "Apache-2.0"]
    assert rows[7].n_matches >= 2 and rows[0].dice == 1.0 and rows[3].n_matches == 0


def test_license_odd_rows(odd, empty):
    assert [r.license for r in license_scan(odd).collect()] == [None] * len(ODD)
    assert license_scan(empty).collect() == [] and license_scan(odd, templates={}).count() == len(ODD)


# --- urls --------------------------------------------------------------------------------------------


def test_hosts(spark):
    urls = ["HTTP://User@Www.Example.COM.:80/a?b", "ftp://h", "no url", None, "http://", "https://a.b#c"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["www.example.com", "h", None, None, None, "a.b"]


ENTRY = "list string, kind string, value string, verdict string, active boolean, since bigint"


def test_verdicts_equal_brute_force(spark):
    draw = random.Random(4)
    hosts = ["a.x.org", "b.x.org", "x.org", "y.net"]
    entries = [
        (draw.choice(["l1", "l2"]), kind, value, draw.choice(["block", "allow"]), draw.random() < 0.7, draw.randrange(0, 400_000))
        for _ in range(60) for kind, value in [draw.choice([
            ("domain", "x.org"), ("domain", "net"), ("host", draw.choice(hosts)), ("prefix", draw.choice(hosts) + "/p"), ("prefix", "x.org/p/q")])]
    ]
    captures = [(i, f"http://{draw.choice(hosts)}/{draw.choice(['', 'p', 'p/q', 'p/q/r?z', 'pp'])}", draw.randrange(0, 400_000)) for i in range(150)]
    frame = spark.createDataFrame(entries, ENTRY)
    spans = [tuple(r) for r in intervals(frame).select("list", "kind", "value", "verdict", "since", "until").collect()]
    found = {r.capture_id: r for r in url_verdicts(spark.createDataFrame(captures, "capture_id bigint, url string, fetched_at bigint"), frame).collect()}
    assert len(found) == 150
    for i, url, at in captures:
        host, path = re.match(r"http://([^/]+)/([^?]*)", url).groups()
        steps = path.split("/") if path else [""]
        covers = {("host", host): 0}
        covers |= {("domain", ".".join(host.split(".")[-k:])): k for k in range(1, host.count(".") + 2)}
        covers |= {("prefix", host + "/" + "/".join(steps[:k])): k for k in range(0, len(steps) + 1)}
        # the reference: the latest change of each key decides
        hits = []
        for key in {(e[0], e[1], e[2]) for e in entries if (e[1], e[2]) in covers}:
            past = [e for e in entries if e[:3] == key and e[5] <= at]
            if past:
                last = max(e[5] for e in past)
                on = sorted(e[3] for e in past if e[5] == last and e[4])
                if on:
                    rank = {"prefix": 0, "host": 1, "domain": 2}[key[1]]
                    hits.append((rank, -covers[key[1], key[2]], on[0], key[0]))
        assert found[i].matches == len(hits)
        assert (found[i].verdict, found[i].list) == ((min(hits)[2], min(hits)[3]) if hits else (None, None))
    assert spans


def test_url_odd_rows(spark):
    captures = spark.createDataFrame([(1, None, 5), (2, "http://x.org", None), (None, "http://x.org", 5), (3, "junk", 5), (4, "http://x.org", 5), (4, "http://x.org", 5)],
                                     "capture_id bigint, url string, fetched_at bigint")
    entries = spark.createDataFrame([("l", "host", "x.org", "block", True, 0), ("l", "host", None, "block", True, 0), ("l", "host", "x.org", "block", False, None)], ENTRY)
    rows = url_verdicts(captures, entries).collect()
    assert len(rows) == 6 and sum(r.verdict == "block" for r in rows) == 3
    assert url_verdicts(captures, entries.limit(0)).where("matches > 0").isEmpty() and url_verdicts(captures.limit(0), entries).collect() == []


# --- models -----------------------------------------------------------------------------------------


def test_language_odd_rows(spark, odd, empty):
    rows = identify(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} <= {"en", "und"}
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (5, 3, 9, 11)} == {("und", 0.0)}
    assert identify(empty).collect() == [] and {r.lang_pred for r in identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "8", "None"]


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1, 0), (8, 0, 0), (8, None, 0), (None, 1, 0), (1, 7, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_scores(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality_scores(empty, labels).collect() == []
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
