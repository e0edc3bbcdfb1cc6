"""Decontamination, n-gram join, repeat removal and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from carelake.llm import common, decontam, ngram_join, suffix_dedup, toxicity

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}


def shingles(text):
    w = common.words_of((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_links(texts):
    sets = [shingles(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    common_ = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                common_[ids[a], ids[b]] += 1
    return {(a, b) for (a, b), n in common_.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9}


def classes_of(n, links):
    label = list(range(n))
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        label[root(a)] = root(b)
    return [root(i) for i in range(n)]


def check_join(spark, make_docs, rows, params):
    ids = [r[0] for r in rows]
    distinct = sorted({r[1] for r in rows})
    links = jaccard_links(distinct)
    number = {t: i for i, t in enumerate(distinct)}
    classes = classes_of(len(distinct), links)
    degree = Counter(x for l in links for x in l)
    first = {}
    for i, t in rows:
        c = classes[number[t]]
        first[c] = min(first.get(c, i), i)
    found = ngram_join.classes(make_docs(rows).select("doc_id", "text"), params)
    got = (make_docs(rows).select("doc_id", common.text_key(F.col("text")).alias("tkey")).join(found, "tkey").collect())
    assert len(got) == len(ids)
    text_of = dict(rows)
    for r in got:
        k = number[text_of[r["doc_id"]]]
        assert r["class_id"] == first[classes[k]], r
        assert r["n_texts"] == degree[k], r


def near_copies(rng, n, words=60):
    vocab = [f"v{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        out += [out[-1]] * rng.randrange(2)
    return out


@pytest.mark.parametrize("block", [1_500, 7])
def test_join_against_all_pairs(spark, make_docs, block):
    rng = random.Random(3)
    base = [f"g{i}" for i in range(80)]
    group = []
    for i in range(40):  # one large group of near copies
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        group.append(" ".join(w))
    texts = near_copies(rng, 60) + group + ["", " ", "one two", "one two", "Three, four"]
    check_join(spark, make_docs, list(enumerate(texts)), ngram_join.JoinParams(block=block, chunk=200))


def test_join_on_the_documents(spark, make_docs, docs):
    check_join(spark, make_docs, list(docs.items()), ngram_join.JoinParams())


def test_pruning_keeps_what_can_reach_the_threshold():
    p = ngram_join.JoinParams()
    least = ngram_join.least_matches(p)
    assert 0 < least[16] < 16 * 0.8 and list(least[16::16]) == sorted(least[16::16]) and least[96] < 0.8 * 96


def test_one_of_each(spark, make_docs):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "other text"), (7, None), (8, "")]
    got = ngram_join.one_of_each(make_docs(rows, extra=True))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(2, "a b c d e f"), (7, None), (9, "other text")]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [
        (2000, 2001 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: label[x] for e in edges if e[0] != e[1] for x in e}


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_edit_distance():
    import numpy as np
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        assert decontam.edit_distance(np.array(a), np.array(b))[0] == plain_edits(a, b)


def test_decontamination_recall_and_clean(spark, make_docs, docs):
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()]
    clean = [t for t in docs.values()][:300]
    index = decontam.Index([i for i, _ in items], [t for _, t in items], decontam.DecontamParams())
    base = [{index.ids[m[1]] for m in index.matches([t])} for t in clean[:60]]
    found, rows = 0, []
    for k in range(240):
        item, text = items[k % len(items)]
        w = text.split()
        for _ in range(int(0.15 * len(common.words_of(text.lower())))):
            at = rng.randrange(len(w))
            w[at:at + rng.choice((0, 1))] = [] if rng.random() < 0.3 else ["qzx"]
        host = clean[k % 60].split()
        at = rng.randrange(len(host) + 1)
        rows.append((k, " ".join(host[:at] + w + host[at:]), item))
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(
        make_docs([r[:2] for r in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = sum((k, item) in got for k, _, item in rows)
    assert found / len(rows) >= 0.97
    own = {(k, item) for k, _, item in rows}
    texts = dict(items)
    for (k, item), r in got.items():  # exact: what is reported is near
        a, b = common.words_of(texts[item].lower()), common.words_of(rows[k][1].lower())
        assert r["edits"] == plain_edits(a, b[max(0, r["first_word"] - 30): r["first_word"] + 2 * len(a) + 30]) <= 0.2 * len(a)
        assert (k, item) in own or item in base[k % 60]


def test_decontamination_recall_of_each_size():
    import numpy as np
    rng = random.Random(4)
    sizes = (15, 30, 60, 100, 200, 400)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(m)] for m in sizes for _ in range(10)]
    index = decontam.Index(list(range(len(items))), [" ".join(w) for w in items], decontam.DecontamParams())
    planted = defaultdict(list)
    for i, item in enumerate(items):
        for _ in range(20):
            w = list(item)
            for _ in range(int(0.2 * len(item))):
                at = rng.randrange(len(w))
                w[at:at + rng.choice((0, 1))] = [] if rng.random() < 0.3 else ["qzx"]
            text = " ".join([word() for _ in range(50)] + w + [word() for _ in range(50)])
            planted[len(item)].append(i in {m[1] for m in index.matches([text])})
    assert {m: np.mean(found) for m, found in planted.items() if np.mean(found) < 0.975} == {}


def test_short_items_match_as_they_are(spark, make_docs):
    items = [(1, "alpha beta gamma delta epsilon"), (2, "one two three four five six seven"), (3, "zeta"), (4, ""), (5, "!"), (6, None)]
    docs = make_docs([(1, "say Alpha beta, gamma delta epsilon here"), (2, "alpha beta gamma x epsilon"), (3, "one two three four five six seven"),
                      (4, "one two three four five six eight"), (5, "a zeta b"), (6, "gamma delta"), (7, None)])
    items = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontam.leaks(docs, items).collect()) == [(1, 1, 0, 5), (3, 2, 0, 7), (5, 3, 0, 1)]
    assert sorted(r["doc_id"] for r in decontam.without_leaks(docs, items).collect()) == [2, 4, 6, 7]


def test_decontamination_in_blocks(spark):
    rows = {params: sorted(map(tuple, decontam.leaks(
        spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/benchmark.parquet"),
        decontam.DecontamParams(block_words=words)).select("doc_id", "item_id", "edits").collect()))
        for params, words in (("one", 100_000), ("many", 400))}
    assert rows["one"] == rows["many"] and rows["one"]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans, at, kept = [], 0, b""
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        for x, y in spans:
            kept, at = kept + b[at:x], y
        out.append((len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


def test_matching_statistics():
    rng = random.Random(6)
    p = suffix_dedup.RepeatParams(length=12, gram=8)
    for _ in range(150):
        k = rng.choice((1, 2, 4, 26))
        pool = [bytes(rng.randrange(k) + 97 for _ in range(40)) for _ in range(3)]
        segs = [b"".join(rng.choice([x[rng.randrange(10):rng.randrange(20, 40)] for x in pool]) for _ in range(rng.randrange(1, 4)))
                for _ in range(rng.randrange(1, 8))]
        segs = [s for s in segs if len(s) >= 12]
        if not segs:
            continue
        count = Counter(s[i:i + 12] for s in segs for i in range(len(s) - 11))
        want = [[i for i in range(len(s) - 11) if count[s[i:i + 12]] > 1] for s in segs]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(segs, p)] == want


@pytest.mark.parametrize("params", [
    suffix_dedup.RepeatParams(length=40, gram=16, batch_bytes=300, piece=256),
    suffix_dedup.RepeatParams(length=40, gram=16, batch_bytes=80),    # most anchors are just above a batch
    suffix_dedup.RepeatParams(length=40, gram=16, group_bytes=100)])  # windows counted one by one
def test_repeats_against_all_windows(spark, make_docs, params):
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcdé ") for _ in range(120)) for _ in range(5)]
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choice([rng.choice(shared)[rng.randrange(40):rng.randrange(60, 120)],
                                         "".join(rng.choice("xyzü") for _ in range(rng.randrange(50)))]) for _ in range(rng.randrange(6))))
    texts += [texts[3], texts[3], "a" * 300, None, "", "ab" * 100, shared[0], shared[0] + "!"]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(make_docs(list(enumerate(texts))), params).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 40)


def test_an_anchor_just_above_a_batch_is_counted_elsewhere():
    """Parts of one anchor beyond ``batch_bytes`` never reach the index; at the bound they do."""
    rng = random.Random(3)
    core = bytes(rng.randrange(256) for _ in range(60))
    tails = [bytes(rng.randrange(256) for _ in range(30)) for _ in range(4)]
    segs = [t + core + u for t in tails for u in tails]          # any two share the core and what they have beside it
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({
        "anchor": pa.array([7] * len(segs), pa.int64()), "sid": pa.array([b"%02d" % i for i in range(len(segs))], pa.binary()),
        "seg": pa.array(segs, pa.binary()), "pos": pa.array([30] * len(segs), pa.int64()), "n": pa.array([1] * len(segs), pa.int64())})

    def run(limit):
        p = suffix_dedup.RepeatParams(length=50, gram=16, batch_bytes=limit)
        return [r for b in suffix_dedup.index_batches(iter([batch]), p) for r in b.to_pylist()]

    size = sum(map(len, segs))
    above, at = run(size - 1), run(size)
    assert {r["part"] for r in above} == set(segs) and all(r["b"] is None and r["anchor"] == 7 for r in above)
    assert {r["sid"] for r in at} == {r["sid"] for r in above} and all(r["part"] is None for r in at)


def test_no_table_is_left_in_the_catalog(spark, make_docs):
    suffix_dedup.remove_repeats(make_docs([(1, "a" * 900), (2, "b" * 10)])).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("carelake_texts")]


def test_repeats_of_the_documents(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op10_suffix_dedup(spark, MID).collect()}
    assert [got[i] for i in docs] == brute_repeats(docs.values(), 400)


def test_pipeline_stages_against_plain_rules(spark, docs):
    source = spark.read.parquet(f"{MID}/documents.parquet")
    steps, cur = {}, source
    for name, stage in corpus_pipeline.STAGES:
        cur = common.written(stage(spark, cur, MID), name)
        steps[name] = cur.select("doc_id").collect()
    ids = {k: [r["doc_id"] for r in v] for k, v in steps.items()}
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.op7_toxicity(spark, MID).collect()}
    assert set(ids["toxicity"]) == {i for i in docs if scores[i] == 0}
    left = sorted(ids["toxicity"])
    links = jaccard_links([docs[i] for i in left]) | {
        (a, b) for a in range(len(left)) for b in range(a + 1, len(left)) if docs[left[a]] == docs[left[b]]}
    groups = classes_of(len(left), links)
    first = {}
    for i, g in zip(left, groups):
        first.setdefault(g, i)
    assert sorted(ids["ngram_join"]) == sorted(first.values())
    items = [" ".join(common.words_of(r["text"].lower())) for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()]
    holds = {i for i in first.values() if any(x in " ".join(common.words_of(docs[i].lower())) for x in items)}
    assert sorted(ids["decontaminate"]) == sorted(set(first.values()) - holds)
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(Counter(ids["mix"]).values()) <= 2
    assert sorted(ids["shard"]) == sorted(ids["mix"])
    assert len(cur.select("shard", "slot").distinct().collect()) == len(ids["mix"])
    assert cur.columns[:5] == source.columns
