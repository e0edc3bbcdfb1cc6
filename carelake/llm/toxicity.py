"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses. Small transducers rewrite a clause word by word: negation marks
the insult or threat that it negates and ends with it, reported speech marks what follows
the report, and the target transducer remembers whether somebody is meant. They are
composed into one machine over product states, whose outputs carry the weights of their
words. Scored are the sums by kind: plain, aimed, negated and reported insults, and
threats at a target; not isolated words.

Insults are learned: stems (whole words or word beginnings) of labelled texts, each with
the log odds of standing in a toxic text as the weight of its arc, smoothed and kept if
large and seen often enough. Near copies of a toxic text count once, so that copies do
not make its other words insults. The weight of each kind is then fitted by logistic
regression, with the strongest insult and the text's length beside the sums. Both are
fitted in one task on a sample bounded by ``ToxicityParams``; every document is scored,
as a whole.

Defined results: a null or empty text has no clause and gets the score of the
intercept; without toxic labels nothing is learned and every score is 0; several
labels of one id count as the highest; repeated rows are scored each; texts are read
whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import WordIds, held_out, read_table, sample_texts, words_of


@dataclass(frozen=True)
class ToxicityParams:
    sample_docs: int = 4_000          # labelled texts of each label
    sample_chars: int = 16_000_000    # and their characters, of each label
    min_support: int = 6              # toxic texts that must have a stem
    min_share: float = 0.015          # and the share of them
    min_kinds: int = 5                # words that a beginning must have
    min_weight: float = 2.0           # log odds of a stem
    smoothing: float = 1.0            # texts added to each count
    stem_chars: tuple[int, ...] = (3, 4, 5, 6, 7, 8)


# Closed classes, four languages.
TARGETS = frozenset("you your yours yourself u he she they them him her these those people all everyone "
                    "du dich dir dein deine ihr euch sie er tu te toi ton ta vous votre ils elles il elle "
                    "tú ti tus su usted ustedes ellos ellas vosotros él ella".split())
NEGATIONS = frozenset("not no never neither nor without hardly isn't aren't wasn't don't nicht kein keine nie "
                      "niemals ne pas jamais aucun aucune sans nunca jamás tampoco sin".split())
REPORTS = frozenset("said says say called calls quoted wrote writes claimed reported according sagte sagt nannte "
                    "schrieb laut dit disait appelé écrit selon dijo dice llamó escribió según".split())
THREATS = frozenset("kill hurt destroy murder beat shoot stab burn hang töten umbringen verletzen schlagen "
                    "tuer frapper détruire brûler matar golpear destruir quemar".split())

KINDS = ("plain", "aimed", "negated", "reported", "threat")
FEATURES = (*KINDS, "strongest", "length")
CLAUSE_END = re.compile(r"[.,;:!?\n|]")

SYMBOLS = ("I", "H", "N", "R", "T", "O")     # insult, threat, negation, report, target, other


@dataclass(frozen=True)
class Transducer:
    """(state, symbol) -> (state, symbol); a symbol without a move passes and keeps the state."""

    moves: dict[tuple[str, str], tuple[str, str]]
    start: str = "0"

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.moves.get((state, symbol), (state, symbol))


# A negation holds until the insult or threat that it negates; a second one lifts it.
NEGATION = Transducer({("0", "N"): ("open", "N"), ("open", "N"): ("0", "N"),
                       ("open", "I"): ("0", "I:negated"), ("open", "H"): ("0", "H:negated")})
# A report holds to the end of the clause.
REPORT = Transducer({("0", "R"): ("open", "R"), ("open", "I"): ("open", "I:reported"), ("open", "H"): ("open", "H:reported")})
TARGET = Transducer({("0", "T"): ("aimed", "T")})


@dataclass(frozen=True)
class Machine:
    """Transducers one behind the other as one table: (state, symbol) -> (state, output)."""

    table: dict[tuple[tuple, str], tuple[tuple, str]]
    start: tuple

    def run(self, words: list[tuple[str, float]]) -> tuple[tuple, dict[str, float]]:
        """End state, and the summed weight of each output of a clause of (symbol, weight)."""
        state, sums = self.start, defaultdict(float)
        for symbol, weight in words:
            state, out = self.table[state, symbol]
            if weight:
                sums[out] += weight
        return state, sums


def compose(*parts: Transducer) -> Machine:
    """All product states that can be reached, with the output of the last transducer."""
    start = tuple(t.start for t in parts)
    table, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            out, after = symbol, []
            for t, own in zip(parts, state):
                got, out = t.step(own, out)
                after.append(got)
            table[state, symbol] = (tuple(after), out)
            if tuple(after) not in seen:
                seen.add(tuple(after))
                todo.append(tuple(after))
    return Machine(table, start)


CLAUSE = compose(NEGATION, REPORT, TARGET)


def clause_kinds(words: list[tuple[str, float]]) -> dict[str, float]:
    """Weight of each kind in a clause of (symbol, weight)."""
    state, sums = CLAUSE.run(words)
    aimed = state[-1] == "aimed"
    found = {"aimed" if aimed else "plain": sums.get("I", 0.0), "negated": sums.get("I:negated", 0.0),
             "reported": sums.get("I:reported", 0.0), "threat": sums.get("H", 0.0) if aimed else 0.0}
    return {k: w for k, w in found.items() if w}


@dataclass
class Grammar:
    """Learned arcs and weights; ``exact`` are whole words, ``prefixes`` word beginnings, with their log odds."""

    exact: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -20.0

    @cached_property
    def trigger(self) -> re.Pattern:
        stems = sorted({*self.prefixes}) + [w + r"\b" for w in sorted({*self.exact, *THREATS})]
        return re.compile(r"\b(?:" + "|".join(stems) + ")")

    @cached_property
    def stem_lengths(self) -> tuple[int, ...]:
        return tuple(sorted({len(p) for p in self.prefixes}))

    def word_class(self, word: str) -> tuple[str, float]:
        """Symbol and weight of a word: an insult weighs as much as the strongest stem that it matches."""
        best = self.exact.get(word, 0.0)
        for n in self.stem_lengths:
            best = max(best, self.prefixes.get(word[:n], 0.0))
        if best > 0:
            return "I", best
        for name, members in (("H", THREATS), ("N", NEGATIONS), ("R", REPORTS), ("T", TARGETS)):
            if word in members:
                return name, float(name == "H")
        return "O", 0.0

    def features(self, text: str) -> dict[str, float]:
        """Sums of clause weights by kind, and the strongest insult that is neither negated nor reported."""
        text, out, done = text.lower(), defaultdict(float), 0
        for hit in self.trigger.finditer(text):
            if hit.start() < done:
                continue  # in a clause already read
            begin = done
            for end in CLAUSE_END.finditer(text, done, hit.start()):
                begin = end.end()
            close = CLAUSE_END.search(text, hit.end())
            done = close.start() if close else len(text)
            words = [self.word_class(w) for w in words_of(text[begin:done])]
            found = clause_kinds(words)
            for kind, weight in found.items():
                out[kind] += weight
            if "plain" in found or "aimed" in found:
                out["strongest"] = max(out["strongest"], *(w for c, w in words if c == "I"))
        return out

    def row(self, text: str | None) -> list[float]:
        """What the regression reads, in the order of FEATURES."""
        found = self.features(text) if text else {}
        return [*(float(np.log1p(found.get(k, 0.0))) for k in KINDS), found.get("strongest", 0.0), float(np.log1p(len(text or "")))]

    def score(self, text: str | None) -> float:
        if self.intercept < -500:  # nothing learned
            return 0.0
        z = self.intercept
        if text:
            z += sum(self.weights.get(k, 0.0) * x for k, x in zip(FEATURES, self.row(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def dump(self) -> str:
        return json.dumps({"exact": self.exact, "prefixes": self.prefixes, "weights": self.weights, "intercept": self.intercept})


def unlike(texts: list[str], values: int = 16, alike: int = 11) -> list[str]:
    """The texts without those whose word set is nearly that of an earlier one (by MinHash)."""
    if not texts:
        return texts
    ids, mult = WordIds(), np.random.default_rng(3).integers(1, 2**63, values, dtype=np.uint64) * 2 + 1
    sig = np.zeros((len(texts), values), np.uint64)
    for i, t in enumerate(texts):
        words = ids.of(list(set(words_of(t.lower()))))
        if len(words):
            sig[i] = (words[:, None] * mult >> np.uint64(16)).min(0)
    kept: list[int] = []
    gone = np.zeros(len(texts), bool)
    for i in range(len(texts)):
        if not gone[i]:
            kept.append(i)
            gone[i:] |= (sig[i:] == sig[i]).sum(1) >= alike
    return [texts[i] for i in kept]


def learn_stems(toxic: list[str], clean: list[str], params: ToxicityParams) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and word beginnings that mark toxic texts, with their smoothed log odds."""
    def terms(text: str) -> set[str]:
        words = set(words_of(text.lower()))
        out = {w + "$" for w in words}
        for n in params.stem_chars:
            out.update(w[:n] for w in words if len(w) > n)
        return out

    pos, neg = Counter(), Counter()
    for t in toxic:
        pos.update(terms(t))
    # A beginning stands for many words; one that a single word makes up is left to that word.
    kinds, most = Counter(), Counter()
    for t, count in pos.items():
        if t.endswith("$"):
            for n in params.stem_chars:
                if len(t) - 1 > n:
                    kinds[t[:n]] += 1
                    most[t[:n]] = max(most[t[:n]], count)
    least = max(params.min_support, params.min_share * len(toxic))
    pos = {t: n for t, n in pos.items() if n >= least and (
        t.endswith("$") or (kinds[t] >= params.min_kinds and most[t] <= n / 2))}
    for t in clean:
        neg.update(pos.keys() & terms(t))
    # Clean texts may be fewer or more than toxic ones: shares are compared.
    a = params.smoothing
    odds = {t: float(np.log((n + a) / (len(toxic) + 2 * a) / ((neg[t] + a) / (len(clean) + 2 * a)))) for t, n in pos.items()}
    kept = sorted((t, w) for t, w in odds.items() if w >= params.min_weight)
    return {t[:-1]: w for t, w in kept if t.endswith("$")}, {t: w for t, w in kept if not t.endswith("$")}


def fit(toxic: list[str], clean: list[str], params: ToxicityParams = ToxicityParams()) -> Grammar:
    if not toxic:
        return Grammar(intercept=-1000.0)
    toxic = unlike(toxic)  # copies are no further evidence
    grammar = Grammar(*learn_stems(toxic, clean, params))
    x = np.array([[1.0, *grammar.row(t)] for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    b, ridge = np.zeros(x.shape[1]), np.diag([0.01] + [0.05] * len(FEATURES))
    for _ in range(50):  # Newton's method, ridge penalty
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    grammar.intercept, grammar.weights = float(b[0]), dict(zip(FEATURES, map(float, b[1:])))
    return grammar


def fit_grammar(docs: DataFrame, labels: DataFrame, train: Column, params: ToxicityParams = ToxicityParams()) -> Grammar:
    """Fit on the first labelled training texts in hash order, bounded in number and characters for each label."""
    marks = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.max("toxic") > 0).cast("int").alias("__toxic")))
    some = sample_texts(docs.where(train), marks, "__toxic", params.sample_docs, params.sample_chars)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["__toxic"] > 0
        return pd.DataFrame({"model": [fit(sorted(pdf["text"][one]), sorted(pdf["text"][~one]), params).dump()]})

    got = some.select("__toxic", "text", F.lit(0).alias("__all")).groupBy("__all").applyInPandas(task, "model string").collect()
    return Grammar(**json.loads(got[0]["model"])) if got else Grammar(intercept=-1000.0)


def score_texts(docs: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    """``keep`` columns + score, predicted."""
    model = grammar.dump()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Grammar(**json.loads(model))
        for pdf in batches:
            pdf["__score"] = [g.score(t) for t in pdf["__text"]]
            yield pdf.drop(columns="__text")

    names = [f"__k{i}" for i in range(len(keep))]
    got = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("text").alias("__text"))
    schema = ", ".join([f"{n} {got.schema[n].dataType.simpleString()}" for n in names] + ["__score double"])
    scored = got.mapInPandas(run, schema)
    return scored.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("__score").alias("score"),
                         (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def training_rows() -> Column:
    return ~held_out(F.col("doc_id"), 5, 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit_grammar(docs, read_table(spark, sf_dir, "labels"), training_rows())
    scored = score_texts(docs, grammar, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Documents that are not toxic, with the columns of ``docs``."""
    grammar = fit_grammar(docs, labels, training_rows(), params)
    model = grammar.dump()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        g = Grammar(**json.loads(model))
        return pd.Series([g.score(t) for t in texts], dtype="float64")

    return docs.where(score(F.col("text")) < 0.5)
