"""Line removal, vector codes and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import line_dedup, prefix_trie, vector_codes

MID = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# ------------------------------------------------------------------ lines
def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WHITE).translate(UPPER)
    held = defaultdict(set)
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    low = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    keeper = {k: max(map(low, who)) for k, who in held.items() if len(who) >= min_docs}
    out = []
    for i, (doc, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), low(i)) == low(i)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rnd = random.Random(5)
    common = [f"This line number {i} stands in many documents" for i in range(40)]
    rows = []
    for d in range(300):
        lines = [f"own line {d} {j} of this document only" for j in range(rnd.randrange(4))]
        for _ in range(rnd.randrange(5)):
            x = rnd.choice(common[: 1 + rnd.randrange(40)])
            lines.append(rnd.choice(["", "  ", "\t\r"]) + rnd.choice([x, x.upper(), x.lower()]) + rnd.choice(["", " ", "\x0b"]))
        rnd.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    # Nulls, empty texts, white space beyond ASCII, letters beyond A-Z, a line of 19 and of 20 code points, repeated rows.
    odd = [" ÄÖÜ line with other letters ÄÖÜ", "äöü" * 7, "x" * 19, "y" * 20, "😀" * 20, "", " \t "]
    rows += [(None, "\n".join(odd)), (400, None), (401, ""), (402, "\n\n"), (403, "\n".join(odd * 2)), (404, "\n".join(odd)), (404, "\n".join(odd)),
             (405, "\n".join(odd).upper()), (None, "only null ids hold this line, three times"), (None, "only null ids hold this line, three times"),
             (None, "only null ids hold this line, three times"), (406, "z" * 300_000 + "\n" + "y" * 20)]
    return rows


@pytest.mark.parametrize("params", [
    line_dedup.LineParams(), line_dedup.LineParams(max_broadcast=0), line_dedup.LineParams(max_broadcast=0, hot_share=20),
    line_dedup.LineParams(max_bits=1 << 16, bits_per_key=1, chunk_keys=50)])
def test_lines_equal_brute_force(spark, make_docs, params):
    rows = line_rows()
    got = line_dedup.drop_lines(make_docs(rows, extra=True).repartition(5), params).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_bloom_filters_keep_most_single_keys_from_the_shuffle(spark, make_docs):
    rows = [(d, "\n".join(f"a line of document {d} and place {j}" for j in range(50)) + "\nshared by every document here") for d in range(400)]
    lists = line_dedup.key_lists(make_docs(rows).repartition(4), line_dedup.LineParams()).cache()
    suspects = line_dedup.suspected(lists, line_dedup.LineParams())
    n = suspects.count()
    assert 400 <= n <= 400 + 0.05 * 20_000  # all repeats, and few of 20,000 single keys


def test_merged_cells_count_tasks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 3_000).astype(np.uint64), rng.integers(0, 2**63, 60_000).astype(np.uint64)
    both = np.concatenate([b, a[:500]])
    marks = [line_dedup.mark_cells(x, 2) for x in (a, both)]
    rows = sorted((r for m in marks for r in m.to_pylist()), key=lambda r: r["cell"])
    import pyarrow as pa
    got = {r["cell"]: set(line_dedup.unpacked(r["seen"]).tolist()) for m in line_dedup.merge_cells(iter([pa.RecordBatch.from_pylist(rows)])) for r in m.to_pylist()}
    for at in line_dedup.bits_of(a[:500], 2):
        assert all(int(x) & 0xFFFF in got[int(x) >> 16] for x in at)


# ------------------------------------------------------------------ codes
def brute_codes(rows, p):
    ints = [(i, [int(np.floor(p.scale * float(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints.sort(key=lambda r: r[0])
    w = len(ints[0][1]) // p.parts
    part = lambda v, k: v[k * w: (k + 1) * w]
    books = [[part(v, k) for _, v, _ in ints[: p.entries]] for k in range(p.parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v, k):
        return min((d2(part(v, k), e), i) for i, e in enumerate(books[k]))

    for _ in range(p.rounds):
        moved = [[list(e) for e in b] for b in books]
        for k in range(p.parts):
            got = defaultdict(list)
            for _, v, _ in ints:
                got[nearest(v, k)[1]].append(part(v, k))
            for i, vs in got.items():
                moved[k][i] = [sum(c) // len(vs) for c in zip(*vs)]
        books = moved
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, label, [nearest(v, k) for k in range(p.parts)]) for i, v, label in ints]
    by_label = defaultdict(int)
    for _, label, n in coded:
        by_label[label] += sum(d for d, _ in n)
    return [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), by_label[label], sha) for i, label, n in coded]


@pytest.mark.parametrize("p,n,coarse", [
    (vector_codes.CodeParams(), 200, False), (vector_codes.CodeParams(parts=2, entries=40, rounds=2, degree=3, leaf=2), 300, True),
    (vector_codes.CodeParams(small_labels=0, rows=7), 60, True), (vector_codes.CodeParams(), 5, False)])
def test_codes_equal_brute_force(spark, p, n, coarse):
    rng = np.random.default_rng(n)
    v = rng.normal(0, 0.3, (n, 16)).astype(np.float32)
    if coarse:
        v = np.round(v * 2) / 2  # many ties and equal entries
    rows = [(int(i), v[j].tolist(), [None, 1, 2][j % 3]) for j, i in enumerate(rng.permutation(n))]
    rows += [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, 2), (1003, [float("-inf")] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = vector_codes.compress(df, p).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_codes(rows, p))


@pytest.mark.parametrize("degree,leaf", [(2, 1), (4, 4), (3, 5)])
def test_gnat_is_exact_and_saves_comparisons(degree, leaf):
    rng = np.random.default_rng(degree)
    centres = rng.integers(-4_000, 4_000, (12, 8))
    entries = np.concatenate([centres + rng.integers(-60, 60, (12, 8)) for _ in range(20)] + [centres[:3], centres[:3]])
    q = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.integers(-80, 80, (500, 8)), entries[:50], rng.integers(-9_000, 9_000, (50, 8))])
    tree = vector_codes.Gnat(entries, degree, leaf)
    got, dist = tree.nearest(q)
    d = vector_codes.squared(q, entries)
    assert (got == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert tree.compared < 0.7 * d.size


def test_codes_of_large_components_stay_within_bounds(spark):
    df = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 8, 0) for i in range(20)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(df).agg(F.max("error")).first()[0] == 0


# ------------------------------------------------------------------ trie
def brute_trie(rows):
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            chats[c].append(((turn is not None, turn or 0, digest), (role or "", text or "")))
    chats = {c: [t for _, t in sorted(v)] for c, v in chats.items()}
    built = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = chats.get(c - c % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        sub = [below[k] for k in kids[node]]
        below[node] = (own + sum(s for s, _ in sub), sum(n for _, n in sub) if sub else 1)
    out = []
    for node, who in members.items():
        at_end = sorted(c for c in who if len(built[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), below[node][1], below[node][0],
                    hashlib.sha256(",".join(map(str, at_end)).encode()).hexdigest()))
    return sorted(out, key=str)


def chat_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(400):
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t if rnd.random() < 0.97 else None, ["user", "assistant", None][t % 3], rnd.choice(["hi", "so", "né 😀", None, "a longer turn"])))
    rows += [(7_000, t, "user", f"turn {t}") for t in range(900)] + [(7_001, t, "user", f"turn {t}") for t in range(901)]
    rows += [(c, 0, "user", "the same first turn") for c in range(9_000, 9_150)] + [(c, 0, "user", "x" * 50_000) for c in (9_300, 9_301)]
    rows += [(c, t, "user", f"copy {t}") for c in range(20_001, 20_090) for t in range(7)]      # many copies; no first conversation
    rows += [(30_000, 1, "b", "tie"), (30_000, 1, "a", "tie"), (30_000, 1, "a", "tie"), (None, 0, "user", "nobody's"), (30_100, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("params,seed", [
    (prefix_trie.TrieParams(), 1), (prefix_trie.TrieParams(shard_bytes=500, sampled=1_000), 2),
    (prefix_trie.TrieParams(shard_bytes=2_000, sampled=3, small_rows=0), 3), (prefix_trie.TrieParams(shard_bytes=60, sampled=9), 4)])
def test_trie_equals_brute_force(spark, params, seed):
    rows = chat_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.prefix_trie(df, params).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_walk_adds_up_over_any_cuts():
    rnd = random.Random(9)
    rec = lambda k: bytes([k]) * 16 + (10 + k).to_bytes(4, "big")
    paths = sorted({b"".join(rec(rnd.randrange(3)) for _ in range(rnd.randrange(7))) for _ in range(150)})
    rows = [(p, 1 + i % 3, 500 - i, "end") for i, p in enumerate(paths)]

    def total(cuts):
        out, edges = [], [0, *cuts, len(rows)]
        for a, b in zip(edges, edges[1:]):
            left = None if a == 0 else paths[a][: 20 * prefix_trie.common(paths[a - 1], paths[a])]
            right = None if b == len(rows) else paths[b][: 20 * prefix_trie.common(paths[b - 1], paths[b])]
            walk = prefix_trie.Walk(left, right, out)
            for r in rows[a:b]:
                walk.push(*r)
            walk.finish()
        bones = {}
        for r in out:
            if r[0]:
                x = bones.setdefault(r[1], [r[4], r[5], 0, 0, 0, 0])
                x[0] = min(x[0], r[4])
                for i in range(4):
                    x[2 + i] += r[6 + i]
        return sorted([tuple(r[4:10]) for r in out if not r[0]] + [tuple(x) for x in bones.values()])

    whole = total([])
    for _ in range(40):
        assert total(sorted(rnd.sample(range(1, len(rows)), rnd.randrange(1, 12)))) == whole
    assert total(list(range(1, len(rows)))) == whole


def test_base_and_ends_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op11_prefix_trie(spark, MID).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
