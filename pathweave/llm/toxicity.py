"""Toxicity: Levenshtein automata over a lexicon trie, with scores of the context.

The lexicon is learned from labelled documents: words, and stems that begin many
words, which are far more frequent in toxic documents than in others. It is kept as
a trie. A word's Levenshtein automaton, run along the trie, finds the terms within
its number of errors, and the stems within theirs of its beginning, so misspelled
terms count too, unless the misspelling is a word of clean documents itself. Each hit is weighed by its window of words:
quotation and words of report lower it, direct address raises it. A logistic
model of the sums gives the score of a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed, no_name_clash, packed
from pathweave.llm.labelled import training_rows, with_fold

TARGET, FOLDS, HELD_OUT = "toxic", 5, 0
#: Labelled rows to learn from, at most (about).
MOST_TRAINING_ROWS = 20_000
#: A term must be so many times as frequent in toxic text as in other text, in so many different places.
LEAST_RATIO, WORD_PLACES, STEM_PLACES, STEM_WORDS = 25.0, 5, 12, 3
STEM_LETTERS = range(3, 9)
#: Letters that a term, or a stem by itself, needs for one and for two errors.
ONE_ERROR, TWO_ERRORS = 5, 12
#: A term that so many words of clean documents come near counts only as it is written.
NEAR_CLEAN_WORDS = 3
WINDOW = 8
#: The logit of every score where no label can be learned from.
NO_LABELS = -30.0
#: Words whose matches a worker keeps; the store is emptied when full.
KEPT_WORDS = 200_000

# Words of report and of direct address, quotation marks, and weights.
REPORT = frozenset("said says quoted quote called word term phrase insult slur means dit mot sagte wort dijo palabra".split())
ADDRESS = frozenset("you your you're u tu toi vous du dich dir ihr usted te".split())
OPENS, CLOSES = "\"“„«‹‘'", "\"”“»›’'"
QUOTED, REPORTED, ADDRESSED, MISSPELLED = 0.2, 0.6, 1.25, 0.7

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def plain_word(token: str) -> str:
    """A lower-case token without what is no letter at its ends."""
    return token if token.isalpha() else _EDGE.sub("", token)


class Automaton:
    """The Levenshtein automaton of a word for up to ``errors`` errors.

    A state is the row of least errors at each place of the word, cut off above
    ``errors``; ``step`` reads one character of a candidate.
    """

    def __init__(self, word: str, errors: int):
        self.word, self.most = word, errors

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.most + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        above, out = self.most + 1, [min(state[0] + 1, self.most + 1)]
        for i, c in enumerate(self.word):
            out.append(min(out[i] + 1, state[i] + (c != char), state[i + 1] + 1, above))
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.most


def errors_for(term: str) -> int:
    letters = len(term) - term.endswith("*")
    return (letters >= ONE_ERROR) + (letters >= TWO_ERRORS)


class Lexicon:
    """Terms with weights in a trie; a term that ends in * is a stem, found at the start of words with any rest."""

    def __init__(self, terms: dict[str, float], clean: frozenset[str] = frozenset(), exact: frozenset[str] = frozenset()):
        self.terms, self.clean, self.exact = terms, clean, exact
        self.root: dict = {}
        self.stems = frozenset(t[:-1] for t in terms if t.endswith("*"))
        self.stem_letters = sorted({len(s) for s in self.stems})
        pieces: tuple[set[str], ...] = set(), set(), set()  # at the start, at the end, anywhere
        for t in terms:
            stem, letters = t.endswith("*"), t.removesuffix("*")
            node = self.root
            for c in letters:
                node = node.setdefault(c, {})
            node[None if stem else ""] = t
            # of k + 1 pieces of a term, k errors leave one whole
            k = errors_for(t)
            cut = [letters[len(letters) * i // (k + 1):len(letters) * (i + 1) // (k + 1)] for i in range(k + 1)]
            pieces[0].add(cut[0])
            if stem:  # its end is anywhere in a word
                pieces[2].update(cut[1:])
            else:
                pieces[1].add(cut[-1])
                pieces[2].update(cut[1:-1])
        either = [rf"^(?:{'|'.join(map(re.escape, sorted(pieces[0])))})"] * bool(pieces[0])
        either += [rf"(?:{'|'.join(map(re.escape, sorted(pieces[1])))})$"] * bool(pieces[1])
        either += [rf"(?:{'|'.join(map(re.escape, sorted(pieces[2])))})"] * bool(pieces[2])
        self.maybe = re.compile("|".join(either) or r"(?!)").search  # without terms nothing may match

    def within(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its own number of errors, and the errors; ties by the term."""
        best: tuple[int, str] | None = None
        automaton = Automaton(word, 2 if len(word) >= TWO_ERRORS - 2 else 1)
        todo = [(self.root, automaton.start())]
        while todo:
            node, state = todo.pop()
            for c, below in node.items():
                if not c:
                    most = 0 if below in self.exact else min(errors_for(below), automaton.most)
                    errors = state[-1] if c == "" else min(state)  # a stem leaves any rest of the word
                    if errors <= most and (best is None or (errors, below) < best):
                        best = (errors, below)
                elif automaton.alive(after := automaton.step(state, c)):
                    todo.append((below, after))
        return best and (best[1], best[0])

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is or misspells, and its errors."""
        for n in self.stem_letters:
            if word[:n] in self.stems:
                return word[:n] + "*", 0
        if len(word) < 3 or not self.maybe(word):
            return None
        found = self.within(word)
        return None if found and found[1] and word in self.clean else found


def context_weight(tokens: list[str], at: int) -> float:
    """How far the window of a hit speaks for abuse: below 1 in quotation or report, above 1 in direct address."""
    lo, hi = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
    opened = any(t[:1] in OPENS for t in tokens[lo:at + 1] if t) and not any(t[-1:] in CLOSES and len(t) > 1 for t in tokens[lo:at])
    closed = any(t.rstrip(".,;:!?")[-1:] in CLOSES for t in tokens[at:hi] if t.rstrip(".,;:!?"))
    weight = QUOTED if opened and closed else 1.0
    near = {plain_word(t) for t in tokens[max(0, at - 4):at + 3]}
    if near & REPORT:
        weight *= REPORTED
    elif near & ADDRESS:
        weight *= ADDRESSED
    return weight


FEATURES = ("abuse", "quoted", "misspelled", "hits")


class Scanner:
    """Sums of a text's hits; remembers for words whether they match."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.hits, self.misses = lexicon, {}, set()

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Weighted sums of hits in abuse and in quotation, of misspelled ones, and their number; empty texts have none."""
        tokens = (text or "").lower().split()
        words = set(tokens)
        for w in words - self.misses - self.hits.keys():
            if found := self.lexicon.match(plain_word(w)):
                self.hits[w] = found
            else:
                self.misses.add(w)
        there = words & self.hits.keys()
        if len(self.misses) > KEPT_WORDS:
            self.misses.clear()
        abuse = quoted = misspelled = n = 0.0
        if there:
            for i, t in enumerate(tokens):
                if t in there:
                    term, errors = self.hits[t]
                    context = context_weight(tokens, i)
                    weight = self.lexicon.terms[term] * (MISSPELLED if errors else 1.0) * context
                    n += 1
                    misspelled += weight * (errors > 0)
                    if context < 1:
                        quoted += weight
                    else:
                        abuse += weight
        if len(self.hits) > KEPT_WORDS:
            self.hits.clear()
        return abuse, quoted, misspelled, n


def _vector(features: np.ndarray) -> np.ndarray:
    """Inputs of the logistic model: sums, their logarithms and 1."""
    return np.hstack([np.minimum(features, 50.0), np.log1p(features), np.ones((len(features), 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton steps; ``ridge`` bounds them where the classes separate."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a text with a hash of its two neighbours; a copied passage then counts once."""
    for batch in batches:
        seen = set()
        for t in batch.column("text"):
            words = [w for w in map(plain_word, t.as_py().lower().split()) if len(w) > 2]
            around = ["", *words, ""]
            seen.update((w, f"{around[i]} {around[i + 2]}") for i, w in enumerate(words))
        if seen:
            a, b = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["word", "around"])


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Lexicon of terms that mark toxic rows of ``train`` (text, y), which is a bounded sample."""
    spark = train.sparkSession
    bad, good = train.filter("y = 1").select("text"), train.filter("y = 0").select("text")
    words = checkpointed(bad.mapInArrow(_places, "word string, around string").distinct().groupBy("word").agg(F.count("*").alias("n")))
    stems = (words.withColumn("stem", F.explode(F.transform(
                F.array(*[F.lit(k) for k in STEM_LETTERS]), lambda k: F.when(F.length("word") > k, F.substring("word", F.lit(1), k)))))
             .dropna().groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
             .filter((F.col("n") >= STEM_PLACES) & (F.col("words") >= STEM_WORDS)))
    total = words.agg(F.sum("n")).first()[0] or 0
    found = {r[0]: r[1] for r in words.filter(F.col("n") >= WORD_PLACES).collect()}
    found |= {r[0] + "*": r[1] for r in stems.collect()}
    shared = spark.sparkContext.broadcast((frozenset(t for t in found if t[-1] != "*"), frozenset(t[:-1] for t in found if t[-1] == "*")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, starts = shared.value
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column("text"):
                seen.update(t.as_py().lower().split())
            clean: Counter = Counter()
            for token, n in seen.items():
                w = plain_word(token)
                if len(w) > 2:
                    clean[""] += n
                    if w in whole:
                        clean[w] += n
                    for k in STEM_LETTERS:
                        if len(w) > k - 1 and w[:k] in starts:
                            clean[w[:k] + "*"] += n
            if clean:
                yield pa.RecordBatch.from_arrays([pa.array(clean.keys()), pa.array(clean.values(), pa.int64())], ["term", "n"])

    clean = {r[0]: r[1] for r in good.mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n")).collect()}
    all_clean = clean.get("", 0)

    def ratio(t: str, more: float = 0.05) -> float:
        return (found[t] / max(1, total)) / ((clean.get(t, 0) + more) / max(1, all_clean))

    def weight(t: str) -> float:
        """Evidence of a term: the logarithm of its ratio, about 1 for one that is just above the least."""
        return float(np.clip(np.log(ratio(t, 1.0)) / np.log(LEAST_RATIO), 0.5, 2.0))

    marks = {t: n for t, n in found.items() if ratio(t) >= LEAST_RATIO}
    terms: dict[str, float] = {}
    taken: list[str] = []
    for t in sorted((t for t in marks if t[-1] == "*"), key=len):
        stem = t[:-1]
        if any(stem.startswith(s) for s in taken):
            continue
        while longer := next((u for u in marks if u[-1] == "*" and len(u) == len(stem) + 2 and u.startswith(stem) and marks[u] >= 0.95 * marks[t]), None):
            stem, t = longer[:-1], longer
        taken.append(stem)
        terms[stem + "*"] = weight(stem + "*")
    terms |= {t: weight(t) for t in marks if t[-1] != "*"}  # those under a stem too: longer terms have more errors

    lexicon = spark.sparkContext.broadcast(Lexicon(terms))

    def near_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            new = {plain_word(w) for t in batch.column("text") for w in set(t.as_py().lower().split())} - known
            known |= new
            out = [(w, m[0]) for w in new if (m := lexicon.value.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["word", "term"])

    near = good.mapInArrow(near_misses, "word string, term string").distinct().collect()  # some words of the sample
    often = Counter(r[1] for r in near)
    exact = frozenset(t for t, n in often.items() if n >= NEAR_CLEAN_WORDS)
    return Lexicon(terms, frozenset(r[0] for r in near), exact)


class Model:
    """Lexicon and weights; picklable, as large as the lexicon."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_vector(features) @ self.weights, -30, 30)))


def _features(texts: pa.Array, scanner: Scanner) -> np.ndarray:
    return np.array([scanner.features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_TRAINING_ROWS) -> Model:
    """A model of the labelled rows outside the held-out fold, from about ``most`` of them at most.

    Without usable labels every score is near 0, so that nothing is rejected; with
    one class only it is near that class.
    """
    train = checkpointed(training_rows(docs, labels, TARGET, FOLDS, HELD_OUT, most, doc_id, text))
    lexicon = learn_lexicon(train)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            columns = _features(batch.column("text"), scanner).T
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, columns)], ["y", *FEATURES])

    rows = train.mapInArrow(measure, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).collect()  # about ``most`` short rows
    data = np.array(rows, float).reshape(-1, 1 + len(FEATURES))
    unlabelled = np.array([0.0] * 2 * len(FEATURES) + [NO_LABELS])
    return Model(lexicon, fit_logistic(_vector(data[:, 1:]), data[:, 0]) if len(data) else unlabelled)


OUTPUTS = ["held_out", "score", "predicted", *FEATURES]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score, predicted and the sums behind them.

    Each row is scored on its whole text, null as empty; texts without hits have
    the score of none. Input columns named like an output are replaced, others stay; an empty
    table gives an empty table. Null ids are not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value.lexicon)
        for batch in batches:
            f = _features(batch.column("t"), scanner)
            s = shared.value.scores(f)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(s), pa.array((s >= 0.5).astype("int32")), *map(pa.array, f.T)],
                ["row", "score", "predicted", *FEATURES])

    rest = no_name_clash(docs, [c for c in OUTPUTS if c not in (doc_id, text)])
    rows = packed(rest, F.col(text).cast("string").alias("t"))
    spec = f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int, " + ", ".join(f"{f} double" for f in FEATURES)
    return with_fold(rows.mapInArrow(run, spec).select("row.*", "score", "predicted", *FEATURES), FOLDS, HELD_OUT, doc_id)
