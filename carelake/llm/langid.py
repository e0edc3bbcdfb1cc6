"""Language identification with interpolated Kneser-Ney character models.

One model a language, of order ``order``: n-grams are 64-bit hashes in sorted arrays,
each with its interpolated probability, and contexts with their back-off weight. A
text gets the language whose model gives the lowest cross-entropy a character; it is
rejected where that exceeds what the model's own held-back texts reach.

The models are fitted on a sample bounded by ``LangParams`` (whole texts in hash
order, the characters shared evenly by the languages) and broadcast: their size is
bounded by the sample. Every whole text is scored.

Defined results: a null text or one without a letter is ``und`` with score 0; without
training texts every text is ``und``; texts of null language train nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import GramCache, find, held_out, read_table, sample_texts

SEP = 1          # between texts; never predicted
PIECE = 1 << 20  # characters of one text that are read at a time


@dataclass(frozen=True)
class LangParams:
    order: int = 4
    sample_chars: int = 6_000_000   # of all languages together
    calibrate: float = 0.1          # share of the sample that is held back
    reject_quantile: float = 0.995  # of the held-back texts' cross-entropy
    reject_margin: float = 0.5      # bits a character above it
    evidence: float = 40.0          # characters whose evidence the score counts at most


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``order - 1`` separators, and the text's number for each (-1: separator).

    Letters are lower case; a run of anything else is one space.
    """
    lower = [t.lower() for t in texts]
    lens = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    raw = np.frombuffer("".join(t + "\x01" for t in lower).encode("utf-32-le", "replace"), "<u4")
    sym = np.where(letters()[raw], raw, 32).astype(np.uint64)
    ends = np.cumsum(lens) - 1
    sym[ends] = SEP
    doc = np.repeat(np.arange(len(lower)), lens)
    doc[ends] = -1
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
    sym, doc = sym[keep], doc[keep]
    reps = np.where(doc < 0, order - 1, 1)
    pad = np.full(order - 1, SEP, np.uint64)
    return np.concatenate([pad, np.repeat(sym, reps)]), np.concatenate([np.full(order - 1, -1), np.repeat(doc, reps)])


def gram_hashes(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order: the hash of the k symbols that begin at each place (as far as they fit)."""
    out = [np.zeros(len(sym) + 1, np.uint64)]
    for k in range(1, order + 1):
        h = out[-1][: len(sym) - k + 1] * np.uint64(0x9E3779B97F4A7C15)
        h += sym[k - 1:] + np.uint64(k)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def train(texts: list[str], order: int) -> list[dict[str, np.ndarray]]:
    """Per order k: sorted gram keys with probability p, sorted context keys with weight g."""
    sym, _ = symbols(texts, order)
    hashes = gram_hashes(sym, order)
    found = []
    for k in range(order, 0, -1):
        if k == order:
            real = sym[order - 1:] != SEP
            at = np.flatnonzero(real)
            keys, first, counts = np.unique(hashes[k][at], return_index=True, return_counts=True)
            places = at[first]
        else:  # continuation counts: distinct symbols before the gram
            above = found[-1]["places"] + 1
            keys, first, counts = np.unique(hashes[k][above], return_index=True, return_counts=True)
            places = above[first]
        found.append({"keys": keys, "places": places, "counts": counts.astype(np.float64)})
    found.reverse()
    model = []
    for k, grams in enumerate(found, 1):
        c = grams["counts"]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
        ctx, inverse = np.unique(hashes[k - 1][grams["places"]], return_inverse=True)
        total = np.bincount(inverse, weights=c)
        weight = discount * np.bincount(inverse) / total
        lower = (np.full(len(c), 1.0 / (len(c) + 1)) if k == 1 else
                 model[-1]["p"][np.searchsorted(model[-1]["keys"], hashes[k - 1][grams["places"] + 1])])
        p = (c - discount) / total[inverse] + weight[inverse] * lower
        model.append({"keys": grams["keys"], "p": p, "ctx": ctx, "g": weight})
    return model


def log_probs(model: list[dict[str, np.ndarray]], hashes: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """log2 P(last symbol | the ones before) of the grams of full order that begin at ``starts``."""
    order = len(model)
    p = np.full(len(starts), 1.0 / (len(model[0]["keys"]) + 1))
    for k in range(1, order + 1):
        begin = starts + order - k
        at, seen = find(model[k - 1]["ctx"], hashes[k - 1][begin])
        p = np.where(seen, model[k - 1]["g"][at] * p, p)
        at, seen = find(model[k - 1]["keys"], hashes[k][begin])
        p = np.where(seen, model[k - 1]["p"][at], p)
    return np.log2(p)


class Scorer:
    """Cross-entropies of texts under all models; grams met before keep their values."""

    def __init__(self, models: dict[str, list[dict[str, np.ndarray]]], order: int) -> None:
        self.langs, self.order = sorted(models), order
        self.models = [models[x] for x in self.langs]
        self.cache = GramCache(len(self.langs))

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) sum of bits, and the number of symbols of each text."""
        sym, doc = symbols(texts, self.order)
        hashes = gram_hashes(sym, self.order)
        starts = np.flatnonzero(doc[self.order - 1:] >= 0)
        owner = doc[self.order - 1:][starts]
        ids = self.cache.numbers(hashes[self.order][starts], lambda new: np.stack(
            [-log_probs(m, hashes, starts[new]) for m in self.models]))
        sums = np.stack([np.bincount(owner, v[ids], len(texts)) for v in self.cache.values], 1)
        return sums, np.bincount(owner, minlength=len(texts))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol, and symbols; long texts are read in pieces, batches in parts of bounded size."""
        sums, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        part, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                part.append(t[at: at + PIECE])
                owner.append(i)
                size += len(part[-1])
                if size >= 2 * PIECE:
                    self._add(part, owner, sums, count)
                    part, owner, size = [], [], 0
        if part:
            self._add(part, owner, sums, count)
        return sums / np.maximum(count, 1)[:, None], count

    def _add(self, part: list[str], owner: list[int], sums: np.ndarray, count: np.ndarray) -> None:
        got, n = self.bits(part)
        np.add.at(sums, owner, got)
        np.add.at(count, owner, n)


def pack(model: list[dict[str, np.ndarray]]) -> list[dict]:
    return [{"k": k, "keys": m["keys"].tobytes(), "p": m["p"].tobytes(), "ctx": m["ctx"].tobytes(), "g": m["g"].tobytes()}
            for k, m in enumerate(model)]


PACKED = "lang string, k int, keys binary, p binary, ctx binary, g binary, threshold double"


def fit(docs: DataFrame, train_rows: Column, params: LangParams = LangParams()) -> dict:
    """{"models": by language, "thresholds": by language} from a bounded sample; one task a language."""
    some = docs.where(train_rows & F.col("lang").isNotNull())
    each = params.sample_chars // max(1, some.select("lang").distinct().count())
    some = sample_texts(some, None, "lang", max(1, each // 50), each)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(set(pdf["text"]))
        held = int(len(texts) * params.calibrate)
        order = np.random.default_rng(7).permutation(len(texts))
        model = train([texts[i] for i in order[held:]], params.order)
        if not all(len(m["keys"]) for m in model):
            return pd.DataFrame(columns=["lang", "k", "keys", "p", "ctx", "g", "threshold"])
        check = [texts[i] for i in (order[:held] if held >= 10 else order)]
        entropy, _ = Scorer({"": model}, params.order).entropies(check)
        limit = float(np.quantile(entropy[:, 0], params.reject_quantile)) + params.reject_margin
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], **row, "threshold": limit} for row in pack(model)])

    rows = some.groupBy("lang").applyInPandas(task, PACKED).collect()
    models: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        models.setdefault(r["lang"], []).append({
            "keys": np.frombuffer(r["keys"], np.uint64), "p": np.frombuffer(r["p"]),
            "ctx": np.frombuffer(r["ctx"], np.uint64), "g": np.frombuffer(r["g"])})
    return {"models": models, "thresholds": {r["lang"]: r["threshold"] for r in rows}}


def predict(docs: DataFrame, model: dict, keep: list[str], params: LangParams = LangParams()) -> DataFrame:
    """``keep`` columns + lang_pred, score, bits (a character), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = shared.value
        scorer = Scorer(got["models"], params.order) if got["models"] else None
        limits = np.array([got["thresholds"][x] for x in sorted(got["models"])])
        names = np.array(sorted(got["models"]), dtype=object)
        for pdf in batches:
            texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in pdf.pop("__text")]
            n = len(texts)
            if scorer is None:
                yield pdf.assign(lang_pred="und", score=0.0, bits=np.nan, rejected=True)
                continue
            entropy, count = scorer.entropies(texts)
            best = entropy.argmin(1)
            low = entropy[np.arange(n), best]
            evidence = np.minimum(count, params.evidence)[:, None]
            share = 1 / np.exp2((low[:, None] - entropy) * evidence).sum(1)
            none = np.array([not t for t in texts], bool)
            yield pdf.assign(
                lang_pred=np.where(none, "und", names[best]),
                score=np.where(none, 0.0, share), bits=np.where(none, np.nan, low),
                rejected=none | (low > limits[best]))

    names = [f"__k{i}" for i in range(len(keep))]
    got = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("text").alias("__text"))
    schema = ", ".join([f"{n} {got.schema[n].dataType.simpleString()}" for n in names]
                       + ["lang_pred string, score double, bits double, rejected boolean"])
    out = got.mapInPandas(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score", "bits", "rejected")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(F.col("doc_id"), 3, 1))
    got = predict(docs, model, ["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "bits", "rejected")
