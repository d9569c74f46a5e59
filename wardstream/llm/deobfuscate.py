"""Toxicity of restored text: a noisy channel over characters, then learned evidence.

The channel writes a word's letters as look-alike signs, repeats them, or puts marks or
spaces between them.  A word that only has letters without a run of three stands for itself.
Any other, of any length, with or without letters, is a lattice of readings, and Viterbi finds
the likeliest under a character trigram model of all documents; no state is dropped.  Marks at
the edges that can be letters stay in the lattice.  In runs of four or more single letters each
gap is nothing or the end of a word.

Restored words and their beginnings are evidence.  How much each one tells is a shrunk
log-odds from labelled training documents; a document's evidence is the sum of its strongest
pieces, and a logistic curve fitted on the training documents makes the score.

Defined results: null and empty texts have no evidence and get the score of none; very long
texts are read whole; repeated rows get equal scores; labels without a text, or null, are
left out; contradicting labels of one document count as toxic; without labels of both kinds
every score is 0; other columns are not read.

The pieces of evidence come from the bounded number of labelled rows alone, and each stands in
at least ``SUPPORT`` toxic ones of them, so their table does not grow with the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstream.session import cut_lineage

#: Letters that a sign can stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
#: Costs of the channel in nats: a sign for a letter, a dropped mark, a dropped repeat.
SIGN, MARK, REPEAT = 1.0, 0.7, 0.3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Trained on at most so many labelled documents, taken by hash; all documents feed the character model.
TRAINED_ON = 50_000
#: Documents that must hold a piece of evidence; strongest pieces that are summed; beginnings of words.
SUPPORT, STRONGEST, BEGINNINGS = 5, 3, (4, 5, 6)
#: Tokens in each generation of a worker's memory; keys that a task gathers before it passes them on.
REMEMBERED, GATHERED = 300_000, 300_000

_SIGNS = re.escape("".join(c for c in LOOKALIKES if not c.isalnum()))
#: Marks whose only reading is nothing.
_EDGE = re.compile(rf"^[^\w{_SIGNS}]+|[^\w{_SIGNS}]+$")
_PLAIN = re.compile(r"^[^\W\d_]+$")
_THRICE = re.compile(r"(.)\1\1")
_GAP = re.compile(r"[ .\-_*]")
_SPACED = re.compile(rf"(?<!\S)(?:(?:[^\W_]|[{_SIGNS}])[ .\-_*]){{3,}}(?:[^\W_]|[{_SIGNS}])(?!\S)")


class CharacterModel:
    """Trigram probabilities of lower-case words with both ends marked."""

    def __init__(self, counts: dict[str, int]):
        self._three, self._two, self._one = Counter(counts), Counter(), Counter()
        for gram, n in counts.items():
            self._two[gram[:2]] += n
            self._one[gram[2]] += n
        self._all, self._known = sum(counts.values()) or 1, {}

    def cost(self, before: str, c: str) -> float:
        """Minus the log of the chance of ``c`` after two characters, mixed with its plain chance."""
        key = before + c
        got = self._known.get(key)
        if got is None:
            plain = (self._one[c] + 0.5) / (self._all + 20)
            got = self._known[key] = -math.log((self._three[key] + 5 * plain) / (self._two[before] + 5))
        return got


def readings(token: str) -> list[list[tuple[str, float]]]:
    """For each character of a token what it may stand for, with the cost ('' is nothing)."""
    lattice = []
    for i, c in enumerate(token):
        ways = []
        if c.isalpha():
            ways.append((c, 0.0))
        ways += [(x, SIGN) for x in LOOKALIKES.get(c, "")]
        if i and c == token[i - 1]:
            ways.append(("", REPEAT))
        elif not c.isalpha():
            ways.append(("", MARK if not c.isdigit() else 2 * SIGN))
        if not ways:
            ways.append((c, 0.0))
        lattice.append(ways)
    return lattice


def spaced_readings(run: str) -> list[list[tuple[str, float]]]:
    """Readings of a run of single letters; between two of them stands nothing or a space."""
    letters = _GAP.sub("", run)
    plain = _PLAIN.match(letters) and not _THRICE.search(letters)
    lattice = []
    for ways in [[(c, 0.0)] for c in letters] if plain else readings(letters):
        lattice += [ways, [("", 0.0), (" ", 0.0)]]
    return lattice[:-1]


def likeliest(lattice: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The best path: Viterbi, a state is the last two letters of a word, and a space ends one.

    Texts are chains of (before, letter), so time and memory grow with the length only.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for ways in lattice:
        after: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, text) in states.items():
            for c, own in ways:
                if not c:
                    total, to = cost + own, last
                elif c == " ":
                    if last == "^^":
                        continue
                    total, to = cost + own + model.cost(last, "$"), "^^"
                else:
                    total, to = cost + own + model.cost(last, c), last[1] + c
                if to not in after or total < after[to][0]:
                    after[to] = (total, (text, c) if c else text)
        states = after
    ends = [(cost + model.cost(last, "$"), text) for last, (cost, text) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_unchained(text) for cost, text in ends if cost == least)


def _unchained(text: tuple | None) -> str:
    out = []
    while text:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest word behind a token."""
    return likeliest(readings(token), model)


def restore_word(token: str, model: CharacterModel) -> str:
    """A lower-case token, decoded unless it stands for itself without marks at its edges."""
    core = _EDGE.sub("", token)
    if not core or (_PLAIN.match(core) and not _THRICE.search(core)):
        return core
    return decode(core, model)


def restore_run(run: str, model: CharacterModel) -> str:
    """The likeliest words, parted by spaces, behind a run of single letters."""
    return likeliest(spaced_readings(run), model)


class Restorer:
    """The distinct restored words of a text, or those of them that ``matters`` holds for.

    Decoded tokens are remembered in two generations; when the younger is full, the older goes.
    Broadcast, so that all tasks of a worker process share one memory.
    """

    def __init__(self, model: CharacterModel, matters: Callable[[str], bool] | None = None):
        self._model, self._matters = model, matters
        self._young: dict[str, str] = {}
        self._old: dict[str, str] = {}

    def words(self, text: str) -> set[str]:
        text = text.lower()
        if len(self._young) > REMEMBERED:
            self._young, self._old = {}, self._young
        out, young = set(), self._young
        for t in set(text.split()):
            got = young.get(t)
            if got is None:
                got = self._recall(t, restore_word)
            out.add(got)
        # no token has a space, so a run never has the key of one
        for run in {f" {run}" for run in _SPACED.findall(text)}:
            got = young.get(run)
            out.update((self._recall(run, restore_run) if got is None else got).split())
        out.discard("")
        return out

    def _recall(self, key: str, restore: Callable[[str, CharacterModel], str]) -> str:
        got = self._old.get(key)
        if got is None:
            got = restore(key.lstrip(" "), self._model)
            if self._matters:
                got = " ".join(w for w in got.split(" ") if self._matters(w))
        self._young[key] = got
        return got


def restored_text(text: str, model: CharacterModel) -> str:
    """The whole text with decoded words."""
    joined = _SPACED.sub(lambda m: restore_run(m[0], model), (text or "").lower())
    return " ".join(restore_word(t, model) for t in joined.split())


def evidence_of(words: Iterable[str]) -> set[str]:
    """Words, and beginnings of longer words."""
    out = {w for w in words if len(w) > 2}
    out.update(f"{w[:n]}~" for w in words for n in BEGINNINGS if len(w) > n)
    return out


def character_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Trigrams of the letters-only words of all documents.

    Tasks count words and send trigrams over the 26 letters and the two ends, of which
    there are fewer than 28 ** 3.
    """
    word = re.compile(r"[a-z]{1,30}(?![^.,;:!?])")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Counter[str] = Counter()
        held: Counter[str] = Counter()

        def flush() -> None:
            for token, n in held.items():
                w = word.match(token)
                if w:
                    marked = f"^^{w[0]}$"
                    for i in range(len(marked) - 2):
                        grams[marked[i:i + 3]] += n
            held.clear()

        for batch in batches:
            for text in batch.iloc[:, 0]:
                if text:
                    held.update(text.lower().split())
                    if len(held) > GATHERED:
                        flush()
        flush()
        if grams:
            yield pd.DataFrame({"g": list(grams), "n": list(grams.values())})

    rows = docs.select(text_col).mapInPandas(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    return {r["g"]: r["n"] for r in rows}


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int) -> DataFrame:
    """toxic, text of the labelled documents outside the held-out fold, at most ``bound`` by hash.

    The bound makes the ids small enough to send to every task, so texts are not shuffled.
    """
    told = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    some = cut_lineage(told.orderBy(F.xxhash64("_id"), "_id").limit(bound))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return own.join(F.broadcast(some), "_id").select("toxic", "text")


class Scorer:
    """Log-odds of evidence and the logistic curve over the sum of the strongest pieces."""

    def __init__(self, odds: dict[str, float], curve: tuple[float, float]):
        self.odds, self.curve = odds, curve

    def worth(self, word: str) -> float:
        """A word counts once, by its strongest piece, so one word is not evidence thrice."""
        return max((self.odds.get(e, 0.0) for e in evidence_of({word})), default=0.0)

    def matters(self, word: str) -> bool:
        return self.worth(word) > 0

    def sum_of(self, words: Iterable[str]) -> float:
        found = sorted(x for x in map(self.worth, words) if x > 0)
        return sum(found[-STRONGEST:])

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * evidence + b))))


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable by damped Newton steps, slightly pulled to 0."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum()])
        v = w * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAINED_ON,
        model: CharacterModel | None = None) -> tuple[CharacterModel, Scorer]:
    model = model or CharacterModel(character_counts(docs, text_col))
    rows = training_rows(docs, labels, id_col, text_col, bound)

    shared = docs.sparkSession.sparkContext.broadcast(Restorer(model))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": [int(t == 1) for t in batch["toxic"]],
                                "words": [list(shared.value.words(t)) for t in batch["text"]]}, columns=["toxic", "words"])

    # decoded once, counted and summed from the written words
    restored = cut_lineage(rows.mapInPandas(restore, "toxic int, words array<string>"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = {}, [0, 0]

        def out() -> pd.DataFrame:
            keys = list(held)
            return pd.DataFrame({"e": keys, "bad": [held[k][1] for k in keys], "good": [held[k][0] for k in keys]}, columns=["e", "bad", "good"])

        for batch in batches:
            for toxic, words in batch.itertuples(index=False):
                n[toxic] += 1
                for e in evidence_of(words):
                    held.setdefault(e, [0, 0])[toxic] += 1
            if len(held) > GATHERED:
                yield out()
                held.clear()
        held[""] = n
        yield out()

    counts = cut_lineage(restored.mapInPandas(count, "e string, bad long, good long").groupBy("e").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    totals = counts.filter("e = ''").first()
    bad, good = (totals["bad"], totals["good"]) if totals else (0, 0)
    if not bad or not good:
        return model, Scorer({}, (0.0, -30.0))
    # shrunk: half a document is added on either side, and a piece needs SUPPORT toxic documents
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # a piece must be far from chance
    telling = counts.filter((F.col("e") != "") & (F.col("bad") >= SUPPORT)).select("e", odds.alias("o"), "bad").filter("o > 1.5")
    kept = telling.select("e", "o").collect()
    scorer = Scorer({r["e"]: r["o"] for r in kept}, (1.0, 0.0))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listener = known.value
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [round(listener.sum_of(w), 1) for w in batch["words"]]})

    known = docs.sparkSession.sparkContext.broadcast(scorer)
    seen = restored.mapInPandas(sums, "toxic int, x double").groupBy("toxic", "x").count().toPandas()
    curve = fit_curve(seen["x"].to_numpy(float), seen["toxic"].to_numpy(float), seen["count"].to_numpy(float))
    return model, Scorer(scorer.odds, curve)


def score(docs: DataFrame, model: CharacterModel, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    both = docs.sparkSession.sparkContext.broadcast((Restorer(model, scorer.matters), scorer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, scorer = both.value
        for batch in batches:
            yield pd.DataFrame({"_id": batch.iloc[:, 0], "score": [
                scorer.score(scorer.sum_of(restorer.words(t)) if t else 0.0) for t in batch.iloc[:, 1]]})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), F.coalesce(held_out(F.col("_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
