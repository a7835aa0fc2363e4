"""Toxicity by Levenshtein automata over a lexicon trie, scored in context.

The lexicon is learnt: words and word stems (prefixes that many words share)
whose document counts in labelled rows tell the label, at most ``TERMS`` of
them.  Its trie is intersected with the Levenshtein automaton of one edit (a
letter more, less or other, or two neighbours swapped); the product's states are
made when a word first needs them and kept, so a word costs a table look-up a
letter until no term is left.  Stems match words that start with them, terms of ``FUZZY`` letters and more also words one edit away:
whole words with the first letter right (from ``FIRST`` letters on any edit),
stems with the first and the last letter right, for an edit of its last letter
would make any stem a shorter one.  The learnt words under a stem are terms too,
besides the ``TERMS``, so that their misspellings are found by the whole word.
A token with figures or marks between its letters is also looked up with the
letters that those stand for (``MASKS``), and counts as misspelled.

Every hit weighs its term's log-odds, and its context window: inside quotation
marks, or next to words that report speech, it counts as quoted; near a second
person or another hit as abuse.  A text's sums, exact, misspelled and quoted,
and its densest window are the inputs of a logistic regression fitted to at
most ``LEARN_ROWS`` labelled rows outside the held-out quarter.

Defined cases: null and empty texts have no hits and get the score of such
texts; repeated rows are separate documents; without labelled rows (or with one
label only) the score is the share of positive ones, smoothed; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.labelled import learnable
from tendril.llm.shared import cut, held_out, small_batches

LEARN_ROWS = 12_000
TERMS = 1_000
CANDIDATES = 6_000
LEAST_ODDS = 2.0
LEAST_SURE = 24.0
FUZZY = 5
#: Letters from which a whole word may also be misspelled in its first letter.
FIRST = 10
STEMS = range(4, 9)
WINDOW = 12
THRESHOLD = 0.3
#: Entries of a worker's memory of words.
MEMORY = 400_000

#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says say quote quoted quotes called calls word words term terms wrote writes reads article dit sagte sagt dijo".split())
ADDRESS = frozenset("you your youre u ur yourself du dein deine tu te toi vous ton usted".split())
FEATURES = ["exact", "misspelled", "quoted", "strongest", "densest", "rate"]

#: Figures and marks that stand for letters, or for nothing.
MASKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": "", "+": ""}

_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[\w@$!|*.+-]{4,40}")
_UNMASK = str.maketrans(MASKS)
_QUOTE = re.compile("[\"“”«»„]")


class Lexicon:
    """The product of the trie and the one-edit automaton, made as needed; two
    neighbouring letters that are swapped are one edit."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.weights = [w for _, _, w in terms]
        self.children: list[dict[str, int]] = [{}]
        self.whole, self.stem, self.length = [-1], [-1], [0]
        #: The length of the longest whole word at or below each node.
        self.longest = [0]
        for t, (term, is_stem, _) in enumerate(terms):
            node = 0
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.length.append(self.length[node] + 1)
                    self.longest.append(0)
                node = self.children[node][char]
                if not is_stem:
                    self.longest[node] = max(self.longest[node], len(term))
            (self.stem if is_stem else self.whole)[node] = t
        self._reset()

    def _reset(self) -> None:
        # (node, edits); 2 stands for one edit, of the first letter.
        start = {(0, 0)} | {(child, 2) for child in self.children[0].values() if self.longest[child] >= FIRST}
        self.states: dict[tuple[frozenset, frozenset, frozenset], int] = {(frozenset(start), frozenset(), frozenset()): 0}
        #: By state: nodes with their edits; nodes behind the first of two
        #: swapped letters, with the letter that must follow.
        self.sets: list[tuple[frozenset, frozenset]] = [(frozenset(start), frozenset())]
        self.steps: list[dict[str, int]] = [{}]
        #: By state: exact word, exact stem, misspelled word, misspelled stem.
        self.ends: list[tuple[int, int, int, int]] = [(-1, -1, -1, -1)]
        self.known: dict[str, tuple[int, bool] | None] = {}

    def _best(self, terms: list[int]) -> int:
        return max((t for t in terms if t >= 0), key=lambda t: (self.weights[t], -t), default=-1)

    def _step(self, state: int, char: str) -> int:
        reached: dict[int, int] = {}
        stems, swapped = set(), set()

        def reach(node: int, edits: int) -> None:
            if reached.get(node, 9) > edits and (edits < 2 or not node or self.longest[node] >= FIRST):
                reached[node] = edits
                if edits == 0 and node:  # a letter of the term is missing from the word
                    for child in self.children[node].values():
                        reach(child, 1)

        for node, letter, edits in self.sets[state][1]:
            if char == letter:
                reach(node, edits)
        for node, edits in self.sets[state][0]:
            if char in self.children[node]:
                child = self.children[node][char]
                reach(child, edits)
                if edits == 1 and self.stem[child] >= 0 and self.length[child] >= FUZZY:
                    stems.add(self.stem[child])
            if edits == 0:
                reach(node, 1 if node else 2)
                for letter, child in self.children[node].items():
                    reach(child, 1 if node else 2)
                    behind = self.children[child].get(char)
                    if behind is not None and letter != char and (node or self.longest[behind] >= FIRST):
                        swapped.add((behind, letter, 1 if node else 2))
        key = frozenset(reached.items()), frozenset(stems), frozenset(swapped)
        if not reached and not swapped:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append((key[0], key[2]))
            self.steps.append({})
            exact = [self.whole[n] for n, e in key[0] if e == 0]
            exact_stems = [self.stem[n] for n, e in key[0] if e == 0]
            near = [self.whole[n] for n, e in key[0] if e and self.length[n] >= (FUZZY if e == 1 else FIRST)]
            self.ends.append((self._best(exact), self._best(exact_stems), self._best(near), self._best([*stems])))
        return self.states[key]

    def look(self, word: str) -> tuple[int, bool] | None:
        """(term, whether exact) of a word, or None."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= MEMORY or len(self.sets) >= MEMORY:
            self._reset()
        state, stem, near_stem = 0, -1, -1
        for char in word:
            after = self.steps[state].get(char)
            if after is None:
                after = self.steps[state][char] = self._step(state, char)
            state = after
            if state < 0:
                break
            _, here, _, near_here = self.ends[state]
            if here >= 0:
                stem = here
            if near_here >= 0:
                near_stem = self._best([near_stem, near_here])
        exact, _, near, _ = self.ends[state] if state > 0 else (-1, -1, -1, -1)
        near = self._best([near, near_stem])
        found = (exact, True) if exact >= 0 else (stem, True) if stem >= 0 else (near, False) if near >= 0 else None
        self.known[word] = found
        return found

    def masked(self, low: str) -> dict[str, int]:
        """The term of each token that is one behind figures or marks."""
        out = {}
        for token in set(_MASKED.findall(low)):
            core = token.strip(".!*-|+_")
            if len(core) > 3 and not core.isalpha() and (plain := core.translate(_UNMASK)).isalpha() and len(plain) > 3:
                if (found := self.look(plain)) and not any(self.look(w) for w in _WORD.findall(core)):
                    out[token] = found[0]
        return out

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        masked = self.masked(low)
        if not masked and not any(self.look(w) for w in set(words)):
            return [0.0] * len(FEATURES)
        places = [(m.start(), m[0]) for m in _WORD.finditer(low)]
        quotes = np.array([m.start() for m in _QUOTE.finditer(low)])
        hits = [(i, found) for i, (_, w) in enumerate(places) if (found := self.look(w))]
        if masked:
            starts = [at for at, _ in places]
            # The word that a masked token begins with, or comes before.
            hits += [(min(bisect_left(starts, m.start()), len(places) - 1), (masked[m[0]], False)) for m in _MASKED.finditer(low) if m[0] in masked]
            hits.sort()
        at = np.array([i for i, _ in hits])
        sums, weights = Counter(), []
        for i, (term, exact) in hits:
            near = {w for _, w in places[max(0, i - WINDOW) : i + WINDOW + 1]}
            start = places[i][0]
            before = int(np.searchsorted(quotes, start))
            inside = before % 2 == 1 and before < len(quotes) and start - quotes[before - 1] < 400
            weight = self.weights[term] * (1.0 if exact else 0.6)
            if near & ADDRESS:
                weight *= 1.3
            if inside or near & REPORTING:
                sums["quoted"] += weight
                weight *= 0.3
            sums["exact" if exact else "misspelled"] += weight
            weights.append(weight)
        total = np.concatenate([[0.0], np.cumsum(weights)])
        dense = (total[np.searchsorted(at, at + WINDOW, "right")] - total[np.arange(len(at))]).max()
        return [math.log1p(sums["exact"]), math.log1p(sums["misspelled"]), math.log1p(sums["quoted"]), max(weights), math.log1p(dense), math.log1p(100 * sum(weights) / len(words))]


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts of words and stems by label."""
    for batch in batches:
        counts = [Counter(), Counter()]
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = {w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= 40}
            counts[int(label > 0)].update(words | {w[:k] + "*" for w in words for k in STEMS if k < len(w)})
        terms = [*{**counts[0], **counts[1]}]
        yield pd.DataFrame({"term": terms, "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]}, dtype=object).astype({"clean": "int64", "toxic": "int64"})


def learn_terms(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight): at most TERMS, and after them the words under
    their stems, at most CANDIDATES in all."""
    sizes = sample.agg(F.count_if(F.col("label") > 0).alias("toxic"), F.count_if(F.col("label") <= 0).alias("clean")).first()
    if not sizes.toxic or not sizes.clean:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (sizes.toxic + 1)) - F.log((F.col("clean") + 0.5) / (sizes.clean + 1))
    counts = sample.mapInPandas(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # The likelihood ratio statistic against the label's own rate: most of a
    # corpus's words are rare, and many of those are in toxic texts by chance.
    rate = sizes.toxic / (sizes.toxic + sizes.clean)
    seen = F.col("toxic") + F.col("clean")
    sure = 2 * (F.col("toxic") * F.log(F.col("toxic") / (seen * rate)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * (1 - rate)))).otherwise(0.0))
    likely = counts.filter(F.col("toxic") > 0).withColumns({"odds": odds, "sure": sure}).filter((F.col("odds") >= LEAST_ODDS) & (F.col("sure") >= LEAST_SURE))
    rows = likely.orderBy(F.desc("sure"), "term").limit(CANDIDATES).collect()
    words = {r.term: r for r in rows if not r.term.endswith("*")}
    most: dict[str, int] = {}
    for w, r in words.items():
        for k in STEMS:
            if k < len(w):
                most[w[:k] + "*"] = max(most.get(w[:k] + "*", 0), r.toxic)
    # A stem that mostly is one word, or extends a stem that tells as much, adds nothing.
    stems = {r.term[:-1]: r for r in rows if r.term.endswith("*") and most.get(r.term, 0) < 0.6 * r.toxic}
    stems = {s: r for s, r in stems.items() if not any(s[:k] in stems and stems[s[:k]].odds >= r.odds - 0.3 for k in range(STEMS.start, len(s)))}
    kept = [(s, True, r.odds, r.toxic) for s, r in stems.items()]
    under = {w for w in words if any(w[:k] in stems and stems[w[:k]].odds >= words[w].odds - 0.3 for k in STEMS if k < len(w))}
    kept += [(w, False, r.odds, r.toxic) for w, r in words.items() if w not in under]
    kept.sort(key=lambda t: (-t[2] * math.log1p(t[3]), t[0]))
    terms = [(t, stem, float(o)) for t, stem, o, _ in kept[:TERMS]]
    held = {t for t, stem, _ in terms if stem}
    # A stem tells these words as they are; they are here for their misspellings.
    return terms + [(w, False, float(words[w].odds)) for w in sorted(under) if any(w[:k] in held for k in STEMS if k < len(w))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _featuriser(terms: list[tuple[str, bool, float]], carry: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for batch in batches:
            rows = np.array([lexicon.features(t or "") for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pd.concat([batch[carry].reset_index(drop=True), pd.DataFrame(rows, columns=FEATURES)], axis=1)

    return features


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_rows: int = LEARN_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted and the inputs."""
    small_batches(docs.sparkSession)
    numbers = ", ".join(f"{f} double" for f in FEATURES)
    sample = cut(learnable(docs, labels, label_col, learn_rows, id_col, text_col))
    terms = learn_terms(sample)
    # At most LEARN_ROWS rows of seven numbers.
    learnt = sample.mapInPandas(_featuriser(terms, ["label"]), f"label int, {numbers}").toPandas()
    weights = fit(learnt[FEATURES].to_numpy(float), (learnt["label"].to_numpy() > 0).astype(float))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = texts.mapInPandas(_featuriser(terms, ["doc_id"]), f"doc_id long, {numbers}")
    logit = F.lit(float(weights[-1]))
    for name, weight in zip(FEATURES, weights, strict=False):
        logit = logit + F.col(name) * float(weight)
    out = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)
