"""Toxicity scores from misspelling-tolerant lexicon hits and their context.

Lexicon. Whole words and word stems that mark toxic documents are learned from labelled rows: a
term must be far more frequent in toxic documents than chance allows (likelihood ratio, corrected
for the number of terms), and a greedy cover keeps the few terms that together explain the toxic
documents. Labelled rows of one label that are near copies count once, so the words of a text that
was copied often are not taken for markers. Two rows are near copies if the exact Jaccard similarity
of their five-word shingles is 0.8 or more; of rows linked by a chain of these the least id stays.

Matching. The lexicon is a trie. Its words of five letters or more are met with one error, of ten
or more with two. Stems are met with the errors of their own length, and a misspelt stem must go
on, as the words it was learned from do. A stem tolerates less than its longer words, so the cover
keeps the words and stems under a chosen stem whose misspellings it does not meet. The Levenshtein
automaton of every word is intersected with the trie as one automaton over sets of (trie node,
errors), determined lazily: a text word costs one lookup per letter and most end after a few.
Letters written as digits or signs are read back first.

Context. Around each hit a window of words is scored: quotation marks around the hit and verbs of
reporting speak for quotation, second-person words for abuse. A hit's class is (term, exact or
misspelt, sign of the context score).

Score. For each class the share of toxic rows among labelled rows with such a hit is estimated,
drawn towards the share of its kind and context, and that towards a fixed prior. A hit's evidence
is the log-odds of its class above those of a row without hits. A logistic model of the total
evidence, its density, its maximum and the number of terms gives the score, so one word that
ordinary prose forms by chance weighs less than several. A class whose share is ``CONVINCING`` or more
gives at least that share, however long the text around the hit is.

Bounds: at most ``max_labelled`` rows (expected; chosen by hash of the id) are learned from, at
most ``MAX_CANDIDATES`` terms enter the cover, both independent of the corpus. Scores are
computed on the whole text of every row.

Defined cases: null and empty texts score as texts without a hit; several labels of one id count
as toxic if one is; null labels are ignored; with no toxic label every score is near 0; rows that repeat
are scored each; other columns pass through ``scored``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm import jaccard_join
from meterbook.session import Staging

MAX_LABELLED = 20_000
MAX_CANDIDATES = 20_000
WINDOW = 6
STEM_LENGTHS = (4, 5, 6, 7, 8)
_MIN_COUNT = 4
_COVER = 6

# Signs read as letters, quotation marks, and words of three languages more.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&+-=/\\|~^_“”„«»‘’…¡¿"
_INSIDE = str.maketrans("", "", ".-_*'’`~^+")
_OPENING = tuple("\"“„«‘'»")
_CLOSING = tuple("\"”“»’'«")
_REPORTING = frozenset(
    "said says say called calls call quote quoted quotes wrote writes word words term terms "
    "sagte sagt nannte wort zitat dit disait mot citation dijo dice palabra cita".split()
)
_ADDRESS = frozenset("you your you're youre yourself du dein dich ihr tu toi vous te usted eres".split())

PLAIN, QUOTATION, ABUSE = 0, -1, 1
#: Prior share of toxic rows by (misspelt, context), and how many rows the prior counts as.
PRIOR = {
    (False, PLAIN): 0.9, (False, ABUSE): 0.95, (False, QUOTATION): 0.3,
    (True, PLAIN): 0.85, (True, ABUSE): 0.9, (True, QUOTATION): 0.2,
}
PRIOR_ROWS = 4
#: A class of at least this share convinces by a single hit.
CONVINCING = 0.85


def errors_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 10 else 2


class Automaton:
    """Levenshtein automata of all words of a lexicon, intersected with its trie.

    A state maps trie nodes to the fewest errors with which they are reached; the stem met with the
    fewest errors is kept in the state for the rest of the word. ``match`` gives ``(term, errors)``.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem, self.reach = [None], [None], [0]
        for n, (text, is_stem) in enumerate(terms):
            allowed = errors_allowed(len(text))
            node, path = 0, [0]
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][ch]
                path.append(node)
            (self.stem if is_stem else self.word)[node] = n
            for step in path:
                self.reach[step] = max(self.reach[step], allowed)
        self.allowed = [errors_allowed(len(t)) for t, _ in terms]
        self.ids: dict = {}
        self.states, self.moves, self.results = [], [], []
        self.start = self._state({0: 0}, None)

    def _stem(self, nodes: dict[int, int], most: int) -> tuple[int, int] | None:
        """``errors, term`` of the stem reached with the fewest errors, at most ``most``."""
        ends = [(e, t) for n, e in nodes.items() if (t := self.stem[n]) is not None and e <= min(most, self.allowed[t])]
        return min(ends, default=None)

    def _state(self, nodes: dict[int, int], stem: tuple[int, int] | None) -> int:
        todo = list(nodes.items())
        while todo:  # a letter of the term left out of the text
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors < self.reach[child] and errors + 1 < nodes.get(child, 99):
                    nodes[child] = errors + 1
                    todo.append((child, errors + 1))
        if stem is None or stem[0]:
            stem = self._stem(nodes, 0) or stem
        key = (frozenset(nodes.items()), stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append((nodes, stem))
            self.moves.append({})
            ends = [
                (e, -self.allowed[t], t)
                for n, e in nodes.items()
                if (t := self.word[n]) is not None and e <= self.allowed[t]
            ]
            best = min(ends, default=None)
            if stem is not None and (best is None or best[0] > stem[0]):
                best = (stem[0], 0, stem[1])
            self.results.append(best and (best[2], best[0]))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        nodes, stem = self.states[state]
        if stem is None or stem[0]:  # the word goes on after a misspelt stem
            met = self._stem(nodes, 99)
            stem = met if stem is None or met and met[0] < stem[0] else stem
        then: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.reach[node] and errors < then.get(node, 99):
                then[node] = errors

        for node, errors in nodes.items():
            reach(node, errors + 1)  # a letter too many in the text
            for letter, child in self.children[node].items():
                reach(child, errors + (letter != ch))
        new = self._state(then, stem) if then or stem is not None else -1
        self.moves[state][ch] = new
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        state = self.start
        for ch in word:
            moves = self.moves[state]
            state = moves[ch] if ch in moves else self._move(state, ch)
            if state < 0:
                return None
        return self.results[state]


class _Hits(dict):
    """Word to hit, remembered up to a fixed number of words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: str):
        if len(self) > 400_000:
            self.clear()
        hit = None
        for form in forms(token):
            hit = self.automaton.match(form)
            if hit:
                break
        self[token] = hit
        return hit


def forms(token: str) -> list[str]:
    """The word as written, and as read with signs for letters."""
    bare = token.strip(_EDGE)
    if not bare:
        return []
    if bare.isalpha():
        return [bare]
    read = bare.translate(_LEET).translate(_INSIDE)
    return [bare] if read == bare else [bare, read]


def context_score(tokens: list[str], at: int, window: int = WINDOW) -> int:
    """Above 0 where the surrounding words are abuse, below 0 where they quote."""
    left, right = tokens[max(0, at - window) : at], tokens[at + 1 : at + 1 + window]
    here = tokens[at]
    opened = here.startswith(_OPENING) or any(t.startswith(_OPENING) for t in left)
    closed = here.rstrip(".,;:!?").endswith(_CLOSING) or any(t.rstrip(".,;:!?").endswith(_CLOSING) for t in right)
    near = {t.strip(_EDGE) for t in left + right}
    return (2 if near & _ADDRESS else 0) - (3 if opened and closed else 0) - (2 if near & _REPORTING else 0)


def hit_classes(text: str, hits: _Hits) -> tuple[Counter, int]:
    """Number of hits by class ``(term, misspelt, context)``, and the number of words."""
    tokens = text.lower().split()
    found: Counter = Counter()
    for at, hit in [(i, h) for i, h in enumerate(map(hits.__getitem__, tokens)) if h]:
        score = context_score(tokens, at)
        found[hit[0], hit[1] > 0, (score > 0) - (score < 0)] += 1
    return found, len(tokens)


def _terms_of(text: str) -> set[str]:
    """Words, and stems written with a star, of a text."""
    whole = {w for t in set(text.lower().split()) if (w := t.strip(_EDGE)).isalpha()}
    return whole | {w[:n] + "*" for w in whole for n in STEM_LENGTHS if len(w) > n}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sampled(docs: DataFrame, labels: DataFrame, max_labelled: int, staging: Staging) -> DataFrame:
    """``text, toxic`` of labelled rows: about ``max_labelled``, chosen by hash of the id, each
    text once and near copies of one label once."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    # at most about max_labelled narrow rows, by the line above
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = staging.put(joined.select("doc_id", "text", "toxic"), "labelled")
    toxic = F.col("toxic") != 0
    kept = [jaccard_join.representatives(rows.where(same)) for same in (toxic, ~toxic)]
    return kept[0].unionByName(kept[1]).select("text", "toxic").distinct()


def _term_counts(sample: DataFrame) -> DataFrame:
    """``term, toxic, clean``: documents of each label that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(terms, pa.string())]
            columns += [pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0])]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                counts[bool(toxic)].update(_terms_of(text or ""))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield flushed()
        yield flushed()

    parts = sample.mapInArrow(count, "term string, toxic bigint, clean bigint")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _excess(toxic: float, clean: float, share: float) -> float:
    """Log-likelihood ratio (G) of a term's counts against the share of toxic rows."""
    total = toxic + clean
    parts = ((toxic, share), (clean, 1 - share))
    return 2 * sum(n * math.log(n / (total * max(rate, 1e-12))) for n, rate in parts if n)


def _candidates(sample: DataFrame, n_toxic: int, n_clean: int, staging: Staging) -> tuple[list, float]:
    """``(term, clean)`` by promise, and the least excess that chance does not explain."""
    counts = staging.put(_term_counts(sample).where(F.col("toxic") >= _MIN_COUNT), "terms")
    least = 2 * math.log(max(counts.count(), 1) / 0.01)
    # nine of ten documents with the term are toxic, after weighing the labels alike
    pure = F.col("toxic") * n_clean >= 9 * F.col("clean") * max(n_toxic, 1)
    stem = F.endswith("term", F.lit("*"))
    rows = (
        counts.where(pure)
        .orderBy(F.desc("toxic"), F.asc("clean"), stem, F.desc(F.length("term")), "term")
        .limit(MAX_CANDIDATES)
        .collect()
    )
    share = n_toxic / max(n_toxic + n_clean, 1)
    return [(r.term, r.clean) for r in rows if _excess(r.toxic, r.clean, share) > least], least


def _cover(sample: DataFrame, candidates: list, least: float, share: float) -> list[tuple[str, bool]]:
    """Terms that together explain the toxic rows, each row by up to ``_COVER`` of them.

    What a term explains beyond the terms before it must still be more than chance.
    """
    if not candidates:
        return []
    number = {t: n for n, (t, _) in enumerate(candidates)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(number[t] for t in _terms_of(x or "") if t in number) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["terms"])

    toxic = sample.where("toxic = 1").select("text").mapInArrow(incidence, "terms array<int>")
    rows = sorted(r.terms for r in toxic.collect())
    need = [_COVER] * len(rows)
    holders: dict[int, list[int]] = {}
    for i, terms in enumerate(rows):
        for t in terms:
            holders.setdefault(t, []).append(i)
    chosen: list[tuple[str, bool]] = []
    while holders:
        gains = {t: sum(need[i] > 0 for i in h) for t, h in holders.items()}
        holders = {t: h for t, h in holders.items() if _excess(gains[t], candidates[t][1], share) > least}
        if not holders:
            break
        best = max(holders, key=lambda t: (gains[t], -t))
        # a longer term that explains nearly as much is the better marker
        start = candidates[best][0].rstrip("*")
        longer = [t for t in holders if gains[t] >= 0.9 * gains[best] and candidates[t][0].startswith(start)]
        best = min(longer, key=lambda t: (candidates[t][1], -gains[t], t))
        text = candidates[best][0]
        chosen.append((text.rstrip("*"), text.endswith("*")))
        for i in holders[best]:
            need[i] -= 1
        under = {t for t in holders if t != best and _under(candidates[t][0], chosen[-1])}
        # stems first: they may meet the misspellings of the words
        for t in sorted(under, key=lambda t: (not candidates[t][0].endswith("*"), len(candidates[t][0]), t)):
            term = candidates[t][0].rstrip("*"), candidates[t][0].endswith("*")
            if not any(_covered(term, other) for other in chosen):
                chosen.append(term)
        holders = {t: h for t, h in holders.items() if t != best and t not in under}
    return chosen


def _under(term: str, chosen: tuple[str, bool]) -> bool:
    """Does the chosen term explain the rows of this one as well?"""
    text, stem = chosen
    return stem and term.startswith(text) or not stem and term.endswith("*") and text.startswith(term[:-1])


def _covered(term: tuple[str, bool], chosen: tuple[str, bool]) -> bool:
    """Does the chosen term meet the other in all spellings that are tolerated?

    A stem that goes with a chosen whole word is dropped, as the word is the better marker.
    """
    (text, is_stem), (other, other_stem) = term, chosen
    if term == chosen or not other_stem:
        return term == chosen or is_stem and other.startswith(text)
    allowed = errors_allowed(len(text))
    longer = len(text) > len(other) and allowed <= errors_allowed(len(other))
    return text.startswith(other) and (not allowed or longer)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class Model:
    """Lexicon, evidence by class and logistic weights; bounded by the lexicon."""

    def __init__(self, terms: list[tuple[str, bool]], shares: dict, base: float):
        self.terms, self.shares, self.base = terms, shares, _logit(base)
        self.weights = np.zeros(5)

    def share(self, kind: tuple[int, bool, int]) -> float:
        return self.shares.get(kind, self.shares.get(kind[1:], PRIOR[kind[1:]]))

    def evidence(self, kind: tuple[int, bool, int]) -> float:
        return max(0.0, _logit(self.share(kind)) - self.base)

    def features(self, found: Counter, n_words: int) -> list[float]:
        each = {k: self.evidence(k) for k in found}
        total = sum(n * each[k] for k, n in found.items())
        terms = len({k[0] for k in found if each[k] > 0})
        return [1.0, math.log1p(total), math.log1p(100 * total / max(n_words, 1)), max(each.values(), default=0.0), terms]

    def score(self, found: Counter, n_words: int) -> float:
        if not self.terms:
            return 1 / (1 + math.exp(-self.base))
        z = float(np.dot(self.weights, self.features(found, n_words)))
        best = max(map(self.share, found), default=0.0)
        return max(1 / (1 + math.exp(-max(min(z, 30.0), -30.0))), best if best >= CONVINCING else 0.0)

    def fit(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps on standardised features."""
        mean, scale = x.mean(0), x.std(0)
        mean[0], scale[0] = 0.0, 1.0
        scale[scale == 0] = 1.0
        z = (x - mean) / scale
        ridge = np.array([0.0] + [0.5] * (x.shape[1] - 1))
        w = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - toxic) + ridge * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w / scale
        self.weights[0] = w[0] - float(np.sum((w * mean / scale)[1:]))


def _class_counts(sample: DataFrame, terms: list[tuple[str, bool]]) -> list:
    """Labelled rows by class of hit, by kind of hit (term -1), and without a hit (term -2)."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Automaton(terms))
        kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        names = ["term", "misspelt", "context", "toxic", "n"]
        for batch in batches:
            counts = Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                found = set(hit_classes(text or "", hits)[0])
                kind = {(-1, *c[1:]) for c in found} or {(-2, False, 0)}
                counts.update((*c, toxic) for c in found | kind)
            columns = list(zip(*[(*k, n) for k, n in counts.items()])) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = "term int, misspelt boolean, context int, toxic int, n bigint"
    rows = sample.mapInArrow(classes, schema).groupBy("term", "misspelt", "context")
    toxic = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    return rows.agg(toxic.alias("toxic"), F.sum("n").alias("n")).orderBy("term").collect()


def _features(sample: DataFrame, model: Model) -> np.ndarray:
    """Features and label of the sampled rows, as many at most as the sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(Automaton(model.terms))
        for batch in batches:
            found = [
                [*model.features(*hit_classes(text or "", hits)), float(toxic)]
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["x"])

    return np.array(sorted(r.x for r in sample.mapInArrow(rows, "x array<double>").collect()))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit lexicon, shares and weights on the labelled rows of ``docs``."""
    with Staging(docs.sparkSession, "toxicity") as staging:
        sample = staging.put(_sampled(docs, labels, max_labelled, staging), "sample")
        totals = {bool(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()}
        n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
        if not n_toxic:
            return Model([], {}, 0.0)
        candidates, least = _candidates(sample, n_toxic, n_clean, staging)
        terms = _cover(sample, candidates, least, n_toxic / (n_toxic + n_clean))
        if not terms:
            return Model([], {}, n_toxic / (n_toxic + n_clean + 2))
        shares, base = {}, 0.0
        for r in _class_counts(sample, terms):
            kind = (r.misspelt, r.context)
            if r.term == -2:
                base = r.toxic / (r.n + 2)
            elif r.term == -1:
                shares[kind] = (r.toxic + PRIOR_ROWS * PRIOR[kind]) / (r.n + PRIOR_ROWS)
            else:
                shares[(r.term, *kind)] = (r.toxic + PRIOR_ROWS * shares[kind]) / (r.n + PRIOR_ROWS)
        model = Model(terms, shares, base)
        data = _features(sample, model)
        model.fit(data[:, :-1], data[:, -1])
        return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, from the whole text; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits = _Hits(Automaton(shared.value.terms))
        for column in columns:
            texts = (t.as_py() or "" for t in column)
            yield pa.array([shared.value.score(*hit_classes(t, hits)) for t in texts], pa.float64())

    return docs.withColumn("toxicity", score("text"))


def clean(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the model, learned from rows not held out, does not reject."""
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))), max_labelled)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return scored(docs.select(row, docs["text"].alias("text")), model).where("toxicity < 0.5").select("row.*")
