"""Mixing, fingerprints, chats and shards against plain Python."""

import hashlib
import re
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from carelake.llm import chat, mixing, sharding, simhash

SMALL = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def test_mix_targets_and_words(spark):
    rows = mixing.op1_mix_sources(spark, SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    left, budget, target = set(by), 1.5 * sum(sizes.values()), {}
    while True:  # share by weight; cap; share the excess anew
        level = budget / sum(weights[s] for s in left)
        over = [s for s in left if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            budget -= target[s]
            left.remove(s)
    target |= {s: weights[s] * level for s in left}
    for s, v in by.items():
        assert abs(v[0]["target"] - target[s]) < 1e-6 and v[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v) / 2 + 1


def test_mix_reruns_agree_and_repeated_rows_are_split(spark, make_docs):
    docs = make_docs([(1, "a b c", "en", "x")] * 40 + [(2, "d e f", "en", "y")] * 10)
    params = mixing.MixParams()
    one = mixing.mix(mixing.sized_rows(docs, params), params).select("source", "target", "taken").collect()
    two = mixing.mix(mixing.sized_rows(docs.repartition(3), params), params).select("source", "target", "taken").collect()
    assert sorted(one) == sorted(two)
    for s in "xy":
        rows = [r for r in one if r["source"] == s]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 2


def test_mixed_documents_match_their_thresholds(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.op1_mix_sources(spark, SMALL).collect() if r["size"]}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in times.items() if k in want}


H1 = xxhash.xxh64_intdigest(struct.pack("<q", 7), seed=42)


def votes(text):
    out, weight = [[0] * 64, [0] * 64], 0
    for w in set(re.split(SPACE, text)):
        k = min(len(w), 16)
        weight += k
        for half, seed in enumerate((42, H1)):
            h = xxhash.xxh64_intdigest(w.encode(), seed=seed)
            for b in range(64):
                out[half][b] += k * (h >> b & 1)
    return tuple(sum(1 << b for b in range(64) if 2 * v[b] > weight) for v in out)


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in simhash.op5_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, r in enumerate(docs[:60]):
        nxt = docs[(i + 1) % len(docs)]["text"]
        k = len(r["text"]) // 3
        edited = r["text"][: len(r["text"]) - k] + nxt[:k]
        g, a, b = got[r["doc_id"]], votes(r["text"]), votes(edited)
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(r["text"])
        assert g["fingerprint"] == f"{a[0]:016x}{a[1]:016x}" and g["edited_fingerprint"] == f"{b[0]:016x}{b[1]:016x}"
        apart = bin(a[0] ^ b[0]).count("1") + bin(a[1] ^ b[1]).count("1")
        assert abs(g["near_edited"] - (1 - apart / 128)) < 1e-12


def test_long_texts_vote_in_parts(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(9_000))
    docs = make_docs([(1, text)]).select("doc_id", "text")
    fp = simhash.fingerprints(docs, ["doc_id"], {"text": "fp"}).select(simhash.as_hex(F.col("fp"))).first()[0]
    assert fp == "{:016x}{:016x}".format(*votes(text))


def test_neighbours_are_complete(spark):
    import random
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(60)]
    prints = set(base)
    for x in base:
        for flips in range(6):
            y = x
            for b in rng.sample(range(128), flips):
                y ^= 1 << b
            prints.add(y)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([((signed(p >> 64), signed(p & (1 << 64) - 1)),) for p in prints], "fp struct<hi: long, lo: long>")
    for radius, blocks in ((3, 6), (2, 4)):
        got = [((r["q"]["hi"], r["q"]["lo"]), (r["fp"]["hi"], r["fp"]["lo"]), r["distance"])
               for r in simhash.neighbours(frame, frame, radius, blocks).collect()]
        want = {(p, q) for p in prints for q in prints if bin(p ^ q).count("1") <= radius}
        back = lambda t: ((t[0] % (1 << 64)) << 64) | (t[1] % (1 << 64))
        assert {(back(a), back(b)) for a, b, _ in got} == want and len(got) == len(want)


def test_chats_round_trip(spark, make_docs):
    texts = ["\\### Assistant: </turn> ok", "\\b\\h#<:", "", None, "plain\n</turn>\n### User: x", "\\\\", "é😀"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool: #", None]
    rows = [(1, i, roles[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in out["back"]] == [(r or "", t or "") for r, t in zip(roles, texts)]
    assert out["valid"] is False and out["broken_turn"] == 5
    loss = "".join(t or "" for r, t in zip(roles, texts) if r == "assistant")
    d = chat.digest(chat.format_chats(df)).first()
    assert d["loss_chars"] == len(loss) and d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert "".join(s["text"] for s in out["segments"]) == out["formatted"]
    assert d["formatted_chars"] == len(out["formatted"])


def test_turn_order(spark):
    cases = {"user,assistant": True, "system,user": True, "assistant,user": False, "system,system,user": False,
             "user,user": False, "user,assistant,user": True, "system": False}
    rows = [(i, j, role, "t") for i, c in enumerate(cases) for j, role in enumerate(c.split(","))]
    got = {r["conv_id"]: r["valid"] for r in chat.format_chats(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert list(cases.values()) == [got[i] for i in range(len(cases))]


def test_shards(spark):
    got = sharding.op8_shard_rows(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(docs)
    slots = {}
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op8_shard_rows(spark, SMALL).collect()}
    assert all(again[r["doc_id"]] == (r["shard"], r["slot"]) for r in got)


def test_permutation_of_every_size(spark):
    for n in (1, 2, 3, 7, 16, 17, 100, 1000, 4097):
        places = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, sharding.ShardParams())).collect()]
        assert sorted(places) == list(range(n))


def test_rows_are_numbered_over_buckets(spark, make_docs):
    docs = make_docs([(i % 37, f"t{i % 50}") for i in range(400)])
    rows = docs.select("doc_id", *sharding.sized())
    got = sharding.numbered(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], 400,
                            sharding.ShardParams(rows_per_bucket=30)).collect()
    assert sorted(r["__row"] for r in got) == list(range(400))


def test_rows_of_one_id_are_numbered_in_many_buckets(spark, make_docs):
    rows = make_docs([(None if i % 3 else 7, f"text {i}") for i in range(600)] + [(7, "same")] * 5)
    got = sharding.shard(rows.select("doc_id", *sharding.sized()), sharding.ShardParams(rows_per_bucket=20))
    places = [r["slot"] * 16 + r["shard"] for r in got.collect()]
    assert sorted(places) == list(range(605))
    parts = got.select(((F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(31)) + F.col("text_crc32") % 31) % 31).alias("b")).groupBy("b").count()
    assert parts.agg(F.max("count")).first()[0] < 60


def test_next_texts_where_one_id_and_no_id_are_frequent(spark, make_docs):
    rows = [(7, f"seven {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"own {i}") for i in range(1_000, 1_100)]
    rows += [(i, f"low {i}") for i in range(-20, 7)] + [(7, "seven 3"), (None, "none 3")]
    docs = make_docs(rows).repartition(4)
    h = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -h[r[1]]))
    got = simhash.edited_texts(docs).orderBy("bucket", "place").select("doc_id", "text", "edited", "bucket").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [r[:2] for r in order]
    for r, after in zip(got, [*order[1:], order[0]]):
        k = len(r["text"]) // 3
        assert r["edited"] == r["text"][: len(r["text"]) - k] + after[1][:k]
    assert len({r["bucket"] for r in got if r["doc_id"] is None}) > 100 and len({r["bucket"] for r in got if r["doc_id"] == 7}) > 100
