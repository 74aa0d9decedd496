"""Toxicity: a Levenshtein automaton run against a lexicon trie, and scores of context windows.

The lexicon is learned from labelled documents: words, and stems of words, that stand in toxic
documents far more often than in others.  Words are matched with a misspelling or two, stems as
beginnings.  The product of trie and automaton is made deterministic step by step while words are
read, so a word costs one table look-up a letter.  Every match is judged by the words around it:
in quotation marks or not, alone or close to other matches; a logistic score joins these sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import slices

MAX_LABELLED = 12_000  # labelled rows of the fit: those with the smallest hashes of their ids
MAX_TERMS = 2_000  # terms of the lexicon, the strongest first
MAX_SPARED = 20_000  # spellings that clean documents use, the most frequent first
STEMS = range(4, 9)  # lengths of stems in code points
MIN_SUPPORT, MIN_PRECISION = 4, 0.8
DISCOUNT = 0.8  # weight of a match for each misspelling
WINDOW = 8  # words on either side of a match
OPEN, CLOSE = "\"'“‘«„‹([", "\"'”’»“›)]"


def plain(word: str) -> str:
    """A word in lower case without the marks around it."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def slack(term: str) -> int:
    """Misspellings that a term of this length bears."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of a lexicon times a Levenshtein automaton, determinised as words come.

    A state is the set of (trie node, edits so far), without nodes below which no term bears
    so many.  ``stems`` match any word that begins with them, without edits.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[str, float] | None] = [None]
        self.stem: list[float | None] = [None]
        self.most = [0]  # edits that a term below a node bears
        for entries, ends in ((words, "word"), (stems, "stem")):
            for term, weight in entries.items():
                node, most = 0, slack(term) if ends == "word" else 0
                self.most[0] = max(self.most[0], most)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.word.append(None)
                        self.stem.append(None)
                        self.most.append(0)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], most)
                getattr(self, ends)[node] = (term, weight) if ends == "word" else weight
        self.start = (self._closed({0: 0}), 0.0)
        self.steps: dict[tuple, dict[str, tuple | None]] = {}

    def _closed(self, found: dict[int, int]) -> frozenset:
        queue = list(found)
        while queue:  # letters of the term that the word leaves out
            node = queue.pop()
            edits = found[node] + 1
            if edits <= self.most[node]:
                for child in self.children[node].values():
                    if edits <= self.most[child] and found.get(child, edits + 1) > edits:
                        found[child] = edits
                        queue.append(child)
        return frozenset(found.items())

    def _step(self, state: tuple, c: str) -> tuple | None:
        pairs, stem = state
        found: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.most[node] and found.get(node, edits + 1) > edits:
                found[node] = edits

        for node, edits in pairs:
            for letter, child in self.children[node].items():
                if letter == c:
                    reach(child, edits)
                else:
                    reach(child, edits + 1)
            reach(node, edits + 1)
        stem = max([stem, *(self.stem[n] or 0.0 for n, e in found.items() if e == 0)])
        return (self._closed(found), stem) if found or stem else None

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best entry for a plain word: fewest edits, then most weight."""
        state: tuple | None = self.start
        for c in word:
            row = self.steps.setdefault(state, {})
            if c not in row:
                row[c] = self._step(state, c)
            state = row[c]
            if state is None:
                return None
        pairs, stem = state
        ends = [(e, -self.word[n][1]) for n, e in pairs if self.word[n] and e <= slack(self.word[n][0])]
        if stem:
            ends.append((0, -stem))
        if not ends:
            return None
        edits, weight = min(ends)
        return -weight, edits


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    spared: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.automaton = Automaton(self.words, self.stems)
        self.cache: dict[str, tuple[float, int] | None] = {}

    def __getstate__(self):
        return self.words, self.stems, self.spared, self.weights

    def __setstate__(self, state):
        self.words, self.stems, self.spared, self.weights = state
        self.__post_init__()

    def of_word(self, raw: str) -> tuple[float, int] | None:
        if raw not in self.cache:
            if len(self.cache) > 300_000:  # a cache, no state
                self.cache.clear()
            if len(self.automaton.steps) > 50_000:
                self.automaton.steps.clear()
            word = plain(raw)
            found = self.automaton.match(word) if word else None
            self.cache[raw] = None if found and found[1] and word in self.spared else found
        return self.cache[raw]

    def spans(self, text: str) -> list[tuple[int, float, int, bool, int]]:
        """(word index, weight, edits, quoted, matches within the window) of each match."""
        words = text.split()
        of_word = self.of_word
        hits = [(i, found) for i, w in enumerate(words) if (found := of_word(w))]
        at = np.array([i for i, _ in hits], np.int64)
        near = np.searchsorted(at, at + WINDOW, "right") - np.searchsorted(at, at - WINDOW, "left")
        return [(i, f[0], f[1], _quoted(words, i), int(n)) for (i, f), n in zip(hits, near)]

    def features(self, found: list[tuple[int, float, int, bool, int]]) -> np.ndarray:
        """What the score knows of a text: sums over its matches."""
        direct = [s for s in found if not s[3]]
        # a misspelling counts less than the word itself, but in the same sums
        strength = [DISCOUNT ** s[2] for s in direct]
        return np.array(
            [
                1.0,
                max(strength, default=0.0),
                math.log1p(sum(strength)),
                max((s[1] * x for s, x in zip(direct, strength)), default=0.0),
                math.log1p(max((s[4] for s in direct), default=0)),
                math.log1p(len(found) - len(direct)),
            ]
        )

    def score(self, spans: list[list[tuple[int, float, int, bool, int]]]) -> np.ndarray:
        x = np.array([self.features(s) for s in spans]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -35, 35)))


def _quoted(words: list[str], i: int) -> bool:
    """Whether a quotation opens at or shortly before word i and closes at or shortly after it."""
    opened = False
    for w in words[max(0, i - WINDOW) : i + 1]:
        opened = opened and not w.rstrip(".,;:!?")[-1:] in CLOSE or w[0] in OPEN
    if w.rstrip(".,;:!?")[-1:] in CLOSE:  # the word itself closes it
        return w[0] in OPEN or any(x[0] in OPEN for x in words[max(0, i - WINDOW) : i])
    return opened and any(x.rstrip(".,;:!?")[-1:] in CLOSE for x in words[i : i + WINDOW + 1])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        ridge = np.diag([1e-4] + [0.05] * (x.shape[1] - 1))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(text: str) -> list[str]:
    """Distinct words and stems (marked by a star) of a text."""
    words = {plain(w) for w in text.split()} - {""}
    return [*words, *{f"{w[:k]}*" for w in words if w.isalpha() for k in STEMS if len(w) > k}]


def _prints(text: str) -> list[int]:
    """Three minimum hashes of the word triples, to find copies."""
    words = text.encode().split()
    triples = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh3_64_intdigest(w, seed=s) for w in triples) >> 1 for s in (1, 2, 3)]


def lexicon(found: list[tuple[str, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights, from (term, toxic documents, weight).

    A stem stands for its words unless one of them makes up most of it; of nested stems the
    shortest stays.  Words that a stem covers stay too, for their misspellings.
    """
    support = {term: t for term, t, _ in found}
    main: dict[str, int] = {}
    for term, t in support.items():
        if not term.endswith("*"):
            for k in STEMS:
                main[term[:k]] = max(main.get(term[:k], 0), t)
    stems = {t[:-1]: w for t, n, w in found if t.endswith("*") and main.get(t[:-1], 0) < 0.7 * n}
    stems = {t: w for t, w in stems.items() if not any(t[:k] in stems for k in range(4, len(t)))}
    words = {t: w for t, _, w in found if not t.endswith("*")}
    return words, stems


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Learn lexicon, spared spellings and context weights from labelled rows that are not held out.

    At most ``max_labelled`` documents are used, chosen by the hash of their ids; copies count once.
    Terms are counted by Spark; the driver gets the lexicon and six features per document.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    prints = F.arrow_udf(
        lambda t: pa.array([_prints(x or "") for x in t.to_pylist()], pa.list_(pa.int64())), "array<long>"
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("id", "r.*")
    rows = rows.withColumn("prints", prints("text"))
    for k in range(3):
        rows = rows.groupBy(F.col("prints")[k]).agg(F.min_by(F.struct("id", "text", "toxic", "prints"), "id").alias("r"))
        rows = rows.select("r.*")
    rows = rows.persist()
    terms = F.arrow_udf(
        lambda t: pa.array([_terms(x or "") for x in t.to_pylist()], pa.list_(pa.string())), "array<string>"
    )
    counted = rows.select("toxic", F.explode(terms("text")).alias("term")).groupBy("term")
    counted = counted.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).filter(F.col("t") >= MIN_SUPPORT)
    precise = counted.filter(F.col("t") / (F.col("n") + 0.5) >= MIN_PRECISION)
    # log odds of a match, with half a clean document added
    weight = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5))
    best = precise.orderBy(F.desc(F.sqrt("t") * weight), "term").limit(MAX_TERMS)
    words, stems = lexicon([(r["term"], r["t"], r["w"]) for r in best.select("term", "t", weight.alias("w")).collect()])
    model = Model(words, stems)

    def variants(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            near = {plain(w) for w in (t or "").split() if (m := model.of_word(w)) and m[1]}
            out.append(sorted(near))
        return pa.array(out, pa.list_(pa.string()))

    clean = rows.filter("toxic = 0").select(F.explode(F.arrow_udf(variants, "array<string>")("text")).alias("word"))
    clean = clean.groupBy("word").count().orderBy(F.desc("count"), "word").limit(MAX_SPARED)
    model.spared = frozenset(r["word"] for r in clean.collect())
    model.cache = {}
    features = F.arrow_udf(
        lambda t: pa.array([model.features(model.spans(x or "")).tolist() for x in t.to_pylist()], pa.list_(pa.float64())),
        "array<double>",
    )
    sample = sorted(rows.select("id", "toxic", features("text").alias("x")).collect())
    rows.unpersist()
    if sample:
        model.weights = _fit(np.array([r["x"] for r in sample]), np.array([r["toxic"] for r in sample], float))
    else:
        model.weights = np.array([-5.0, 0, 0, 0, 0, 0])  # nothing known: nothing is toxic
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score, predicted and matches (in place of like-named columns).

    ``matches`` lists word index, weight, edits, quoted, and matches nearby.  Null and empty texts
    have no match and get the score of such texts.  Only the text is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TERMS and MAX_SPARED
    span = pa.struct([("word", pa.int32()), ("weight", pa.float64()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("near", pa.int32())])

    @F.arrow_udf("struct<score:double,matches:array<struct<word:int,weight:double,edits:int,quoted:boolean,near:int>>>")
    def scored(texts: pa.Array) -> pa.Array:
        names = ("word", "weight", "edits", "quoted", "near")
        spans, scores = [], []
        for part in slices(texts):
            found = [sent.value.spans(t or "") for t in part.to_pylist()]
            scores += sent.value.score(found).tolist()
            spans += [[dict(zip(names, s)) for s in own] for own in found]
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["score", "matches"]
        )

    out = docs.withColumn("__s", scored(text_col))
    return out.withColumns(
        {
            "score": F.col("__s.score"),
            "predicted": (F.col("__s.score") >= 0.5).cast("int"),
            "matches": F.col("__s.matches"),
        }
    ).drop("__s")
