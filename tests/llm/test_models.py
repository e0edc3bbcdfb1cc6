"""Language ID, PPM and toxicity: plain-Python references and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from carelake.llm import langid, ppm, toxicity

MID = "/root/testdata/sf0.01"


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}


def test_kneser_ney_probabilities_sum_to_one():
    model = langid.train(["abracadabra und so weiter", "banane ananas"], 3)
    sym, doc = langid.symbols(["ab", "zz", "ana"], 3)
    known = [s for s in np.unique(langid.symbols(["abracadabra und so weiter banane"], 3)[0]) if s != langid.SEP]
    hashes = langid.gram_hashes(sym, 3)
    for i in range(len(sym) - 2):
        total = 0.0
        for s in known:
            changed = sym.copy()
            changed[i + 2] = s
            total += 2 ** langid.log_probs(model, langid.gram_hashes(changed, 3), np.array([i]))[0]
        unseen = sym.copy()
        unseen[i + 2] = 0x2460
        total += 2 ** langid.log_probs(model, langid.gram_hashes(unseen, 3), np.array([i]))[0]
        assert total == pytest.approx(1, abs=0.02)
    assert len(hashes) == 4


def test_kneser_ney_against_plain_counts():
    texts, order = ["abab ba", "bac"], 3
    model = langid.train(texts, order)
    rows = [["\x01"] * 2 + list(t) + ["\x01"] * 2 for t in texts]
    flat = ["\x01"] * 2 + [s for t in texts for s in [*t, "\x01", "\x01"]]
    grams = [tuple(flat[i:i + 3]) for i in range(len(flat) - 2) if flat[i + 2] != "\x01"]
    counts = {3: Counter(grams)}
    counts[2] = Counter(g[1:] for g in counts[3])
    counts[1] = Counter(g[1:] for g in counts[2])
    def discount(c):
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        d, same = discount(counts[k]), {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        lower = prob(g[1:])
        if not same:
            return lower
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * lower
    sym, doc = langid.symbols(["aba c", "cab"], order)
    hashes = langid.gram_hashes(sym, order)
    starts = np.flatnonzero(doc[order - 1:] >= 0)
    got = langid.log_probs(model, hashes, starts)
    for s, p in zip(starts, got):
        g = tuple(chr(int(x)) for x in sym[s:s + 3])
        assert 2 ** p == pytest.approx(prob(g), rel=1e-9)
    assert rows


def test_long_texts_are_read_whole(monkeypatch):
    model = {"x": langid.train(["abab abba " * 30], 3)}
    whole = langid.Scorer(model, 3).entropies(["abba " * 500])
    monkeypatch.setattr(langid, "PIECE", 64)
    parts = langid.Scorer(model, 3).entropies(["abba " * 500])
    assert abs(whole[1][0] - parts[1][0]) < 45 and whole[0][0, 0] == pytest.approx(parts[0][0, 0], rel=0.2)


def test_language_accuracy(spark, docs):
    got = langid.op2_language(spark, MID).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if crc(i, 3) == 1}
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_und_and_rejection(spark, docs, make_docs):
    train = make_docs([(i, r["text"], r["lang"]) for i, r in docs.items()])
    model = langid.fit(train, langid.F.lit(True))
    odd = make_docs([(1, None), (2, "123 !!"), (3, "你好世界" * 20), (4, docs[0]["text"], "en")])
    got = {r["doc_id"]: r for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[3]["rejected"] and got[3]["lang_pred"] != "und" and not got[4]["rejected"]


def brute_ppm(texts, order):
    table = defaultdict(Counter)
    for t in texts:
        s = [ppm.EDGE] * order + list(t) + [ppm.EDGE]
        for i in range(order, len(s)):
            for k in range(order + 1):
                table[tuple(s[i - k:i])][s[i]] += 1
    def score(t):
        s, out = [ppm.EDGE] * order + list(t) + [ppm.EDGE], 0.0
        for i in range(order, len(s)):
            ruled = set()
            for k in range(order, -1, -1):
                seen = {x: n for x, n in table.get(tuple(s[i - k:i]), {}).items() if x not in ruled}
                mass = sum(seen.values())
                if s[i] in seen:
                    out += math.log10((seen[s[i]] - 0.5) / mass)
                    break
                if mass:
                    out += math.log10(0.5 * len(seen) / mass)
                ruled |= seen.keys()
            else:
                out -= math.log10(257 - len(ruled))
        return out
    return score


def test_ppm_against_plain_contexts(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(60))) for _ in range(30)] + [b"", b"\x00\xff"]
    monkeypatch.setattr(ppm, "PIECE", 16)
    grams = np.concatenate([g for g, _ in ppm.pieces(texts, 3)])
    trie = []
    for m in ppm.trie_orders(3):
        key, c = np.unique(grams & np.uint64(m), return_counts=True)
        trie.append((key, c))
    model, brute = ppm.Scorer(ppm.Trie(trie)), brute_ppm(texts, 3)
    tests = texts[:5] + [b"", b"zzz", b"abcd" * 40, b"\xff\x00"]
    assert model.log10(tests) == pytest.approx([brute(t) for t in tests], rel=1e-9)


def test_adaptive_code_length_learns():
    once, twice = ppm.adaptive_log10(b"the cat sat on the mat "), ppm.adaptive_log10(b"the cat sat on the mat " * 2)
    assert once < 0 and twice > 1.5 * once


@pytest.mark.parametrize("limit", [400_000, 50])
def test_word_base_and_score(spark, docs, limit):
    params = ppm.PpmParams(max_words=limit, order=3)
    F = ppm.F
    got = ppm.score(spark.read.parquet(f"{MID}/documents.parquet"), ~ppm.held_out(F.col("doc_id"), 7, 2), params).collect()
    count = Counter()
    for i, r in docs.items():
        if crc(i, 7) != 2:
            count.update(r["text"].encode().lower().split())
            count[b""] += 1
    n, v = sum(count.values()), len(count)
    assert len(got) == len(docs)
    for r in got:
        words = docs[r["doc_id"]]["text"].encode().lower().split() + [b""]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    if limit > 50:
        train = [r["text"].encode() for i, r in docs.items() if crc(i, 7) != 2]
        brute = brute_ppm(train, 3)
        for r in got[:5]:
            assert r["score"] == pytest.approx(brute(docs[r["doc_id"]]["text"].encode()))


def test_trie_fits_its_bound(spark):
    params = ppm.PpmParams(max_nodes=3_000)
    table = ppm.written(ppm.counts(spark.read.parquet(f"{MID}/documents.parquet"), params), "t")
    trie = ppm.gather_trie(table, params)
    assert 0 < sum(map(len, trie.keys)) <= 3_000
    score = ppm.Scorer(trie).log10([b"the thing", b""])
    assert (score < 0).all()


def test_contexts_beyond_the_bound_score_too(spark):
    docs, F = spark.read.parquet(f"{MID}/documents.parquet").where("doc_id < 300"), ppm.F
    got = [{r["doc_id"]: r for r in ppm.score(docs, ~ppm.held_out(F.col("doc_id"), 7, 2), ppm.PpmParams(max_nodes=n)).collect()}
           for n in (2_000_000, 3_000, 100)]
    for few in got[1:]:
        assert few.keys() == got[0].keys()
        for i, r in got[0].items():
            assert few[i]["score"] == pytest.approx(r["score"], rel=1e-9)
            assert few[i]["base_score"] == pytest.approx(r["base_score"]) and few[i]["n_known"] == r["n_known"]


def test_clause_grammar():
    g = toxicity.Grammar(exact={"fool": 2.0}, prefixes={"idio": 3.0}, weights={k: 1.0 for k in toxicity.KINDS}, intercept=0.0)
    kinds = {"what a fool": "plain", "you are an idiot": "aimed", "it is not a fool": "negated",
             "someone said idiot": "reported", "kill you all": "threat", "do not hurt them": None, "foolish": None}
    for text, kind in kinds.items():
        assert set(g.features(text)) - {"strongest"} == ({kind} if kind else set()), text
    got = g.features("a fool. a fool, idiots idiots")
    assert got["plain"] == pytest.approx(10.0) and got["strongest"] == 3.0
    # A negation ends with the insult that it negates; a report holds to the end of the clause.
    assert g.features("not a fool but an idiot") == {"negated": 2.0, "plain": 3.0, "strongest": 3.0}
    assert g.features("you are not not a fool") == {"aimed": 2.0, "strongest": 2.0}
    assert g.features("he said not a fool but idiot") == {"negated": 2.0, "reported": 3.0}
    assert g.score(None) == g.score("") == 0.5


def test_clauses_are_read_whole():
    g = toxicity.Grammar(exact={"fool": 1.0}, weights={k: 1.0 for k in toxicity.KINDS}, intercept=0.0)
    far = "word " * 2000
    kinds = {f"not {far} a fool": "negated", f"someone said {far} fool": "reported", f"a fool {far} you": "aimed",
             f"kill {far} you": "threat", f"not. {far} a fool": "plain", f"a fool {far}. you": "plain"}
    for text, kind in kinds.items():
        assert set(g.features(text)) - {"strongest"} == {kind}, text[:20]
    assert g.features(f"a fool {far} fool {far} fool. fool")["plain"] == pytest.approx(4.0)


def test_copies_do_not_make_insults():
    rng = random.Random(1)
    line = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(12))
    copied = line() + " copied text with words"
    toxic = [f"grak {line()}" for _ in range(20)] + [f"grak {copied} {i}" for i in range(60)]
    clean = [line() for _ in range(60)]
    g = toxicity.fit(toxic, clean, toxicity.ToxicityParams(min_support=4))
    assert g.word_class("grak")[0] == "I" and g.word_class("copied") == ("O", 0.0)


def brute_clause(words):
    """The rules of a clause in plain words."""
    kinds, negated, reported = {}, False, False
    aimed = any(c == "T" for c, _ in words)
    for c, w in words:
        if c == "N":
            negated = not negated
        elif c == "R":
            reported = True
        elif c in "IH":
            kind = "negated" if negated else "reported" if reported else "aimed" if aimed else "plain"
            negated = False
            if c == "H":
                kind = "threat" if kind == "aimed" else None
            if kind:
                kinds[kind] = kinds.get(kind, 0.0) + w
    return kinds


def test_composed_machine_equals_plain_rules():
    rng = random.Random(4)
    for _ in range(3_000):
        words = [(c, {"I": 2.5, "H": 1.0}.get(c, 0.0)) for c in rng.choices(toxicity.SYMBOLS, k=rng.randrange(9))]
        assert toxicity.clause_kinds(words) == pytest.approx(brute_clause(words))


def test_stems_weigh_their_smoothed_log_odds():
    toxic = ["brillax one"] * 3 + ["brillon two"] * 4 + ["brillum x"] * 3 + ["brillet y"] * 3 + ["brillik z"] * 3
    clean = ["brillax one"] + ["plain words"] * 99
    p = toxicity.ToxicityParams(min_support=3, min_weight=1.0)
    exact, prefixes = toxicity.learn_stems(toxic, clean, p)
    assert prefixes["brill"] == pytest.approx(np.log(17 / 18 / (2 / 102))) and exact["brillon"] == pytest.approx(np.log(5 / 18 / (1 / 102)))
    assert "words" not in exact and "plain" not in prefixes


def test_toxicity_accuracy(spark):
    mid = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, mid).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{mid}/labels.parquet").collect()}
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert np.mean([b for a, b in held if a == 1]) >= 0.9                     # recall
    scored = [(labels[i], r["score"]) for i, r in got.items() if r["held_out"] and labels.get(i) is not None]
    high, low = (np.sort([x for a, x in scored if a == k]) for k in (1, 0))
    above = (np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")) / 2
    assert above.sum() / (len(high) * len(low)) >= 0.95                       # area under the curve
    assert sum(a == 0 and b == 1 for a, b in held) / sum(a == 0 for a, _ in held) < 0.01
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_no_labels_nothing_toxic(spark, tables):
    path = tables([(1, "you idiot"), (2, None)])
    assert [r["score"] for r in toxicity.op7_toxicity(spark, path).collect()] == [0.0, 0.0]
