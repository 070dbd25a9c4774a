"""Toxicity of texts that hide their words: a noisy channel is decoded, then the restored text is scored.

A writer of a word may have passed it through a channel that puts digits and signs for letters, repeats letters, or sets blanks and dots between them.
Every token that shows such traces becomes a lattice: at each place the letters that could have been meant, for a run of one letter also the
shorter runs. Viterbi's algorithm finds the path with the highest product of channel and language model, a model of letter triples
counted over the whole corpus. Letters that stand alone in a row are read as one token. Tokens without traces are taken as they are.
Every token is also split at its signs, whatever its length, and each part is taken and decoded like a token. A lattice of more than
``TOKEN_PLACES`` places is decoded in overlapping stretches: of a part without signs all pieces of 4 to ``SPACED_PART`` decoded letters
count, of one with signs all neighbouring parts that make up to ``SPACED_PART`` places together. A run of one letter is one place.

The score is a logistic function of the strongest words of the restored text. Word weights are lower bounds of log odds between toxic and
other labelled texts, counted over different texts. Labels come from a bounded sample of at most ``FIT_ROWS`` labelled rows.

Defined results: null and empty texts have no words and get the score of a text without known words; rows without label are only
scored; repeated rows are scored each; if no label can be used, all scores are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.common import cut, importable, map_batches

# Labelled rows that a fit takes at most, those with the least hash; folds: rows of fold 0 are never fitted on.
FIT_ROWS, FOLDS = 50_000, 5
# Words that the fit keeps at most, and the different texts that a word needs.
LEXICON, WORD_TEXTS = 20_000, 4
CACHE = 500_000

# Letters that a sign may stand for (fixed values).
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~=/\\«»„“”’"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Letter classes of the language model: a border, a to z, any other letter.
OTHER, CLASSES = 27, 28
_CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
_TRACE = re.compile(r"[0-9@$!|+(<*#%]|([^\W\d_])\1\1|[._\-~]")
# Three or more letters or signs that stand alone, with one blank, dot, dash or the like between.
_SPACED = re.compile(r"(?<![\w@$!|+*])(?:[^\W_]|[@$!|+*])(?:[ .\-_~*](?:[^\W_]|[@$!|+*])){2,}(?![\w@$!|+*])")
# Costs of the channel, as natural logarithms: a sign for a letter, a letter repeated.
SIGN_COST, REPEAT_COST = 1.0, 0.7
# Longest word looked for in spaced letters; such runs are decoded in overlapping stretches of this many characters.
SPACED_PART, SPACED_RUN = 14, 80
# Places of a lattice that is decoded in one piece, and characters of a token that is cached.
TOKEN_PLACES = 40
# What parts a token has: with the signs that may stand for letters, and without them.
_SIGNED = re.compile(r"(?:[^\W_]|[@$!|+(<*#%])+")
_PLAIN = re.compile(r"[^\W_]+")


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


# --- language model ----------------------------------------------------------------------------------------------------------

def _byte_classes() -> np.ndarray:
    """Class of each byte of a lower-cased UTF-8 text. The first byte of a longer character is the class of other letters, its following
    bytes have none and are left out."""
    table = np.zeros(256, np.uint8)
    for c, k in _CODE.items():
        table[ord(c)] = table[ord(c.upper())] = k
    table[0xC3:0xF8] = OTHER
    table[0x80:0xC0] = 255
    return table


def letter_triples(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter triples over all texts, CLASSES ** 3 numbers. Each task sums its own, so what is shuffled does not grow with
    its texts."""
    schema = pa.schema([("triple", pa.int32()), ("n", pa.int64())])
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _byte_classes(), np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in cut(batch):
                data = " ".join(t for t in part.column(0).to_pylist() if t)
                code = table[np.frombuffer(data.encode("utf-8"), np.uint8)]
                code = code[code != 255].astype(np.int32)
                if len(code) > 2:
                    total += np.bincount((code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], schema=schema)

    counts = np.zeros(CLASSES**3)
    summed = importable(rows).mapInArrow(task, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        counts[r.triple] = r.n
    return counts


class LetterModel:
    """log P(letter | two before), smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        triple = counts.reshape(CLASSES, CLASSES, CLASSES)
        pair, single = triple.sum(0), triple.sum((0, 1))
        p1 = (single + 1) / (single.sum() + CLASSES)
        p2 = (pair + 50 * p1) / (pair.sum(1, keepdims=True) + 50)
        self.log = np.log((triple + 20 * p2[None]) / (triple.sum(2, keepdims=True) + 20)).tolist()


def code_of(c: str) -> int:
    return _CODE.get(c, OTHER)


# --- decoding ----------------------------------------------------------------------------------------------------------------

def lattice(token: str) -> list[list[tuple[str, float]]]:
    """At each place of a token the strings that may have been meant, with their cost."""
    return list(places_of(token))


def places_of(token: str) -> Iterator[list[tuple[str, float]]]:
    at = 0
    while at < len(token):
        c, n = token[at], 1
        while at + n < len(token) and token[at + n] == c:
            n += 1
        if c in SIGNS:
            choices = [(letter, SIGN_COST) for letter in SIGNS[c]]
            yield from [choices] if n > 2 else [choices] * n
        elif c.isalpha():
            # A run of three or more was one or two letters; a run of two may have been one.
            lengths = ((1, REPEAT_COST), (2, REPEAT_COST)) if n > 2 else ((2, 0.0), (1, 2 * REPEAT_COST)) if n == 2 else ((1, 0.0),)
            yield [(c * k, cost) for k, cost in lengths]
        at += n


def viterbi(places: list[list[tuple[str, float]]], model: LetterModel) -> str:
    """The path with the least cost of channel and model. A state is the last two letter classes."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in places:
        ahead: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, path) in best.items():
            for letters, own in choices:
                x, y, total = a, b, cost + own
                for letter in letters:
                    k = code_of(letter)
                    total -= model.log[x][y][k]
                    x, y = y, k
                if (x, y) not in ahead or (total, path + letters) < ahead[x, y]:
                    ahead[x, y] = (total, path + letters)
        best = ahead
    ends = [(cost - model.log[a][b][0], path) for (a, b), (cost, path) in best.items()]
    return min(ends)[1] if ends else ""


class Restorer:
    """``wanted``: if given, of the pieces of spaced letters and long parts only those in it are kept."""

    def __init__(self, model: LetterModel, cache: int = CACHE, wanted: Collection[str] | None = None):
        self.model, self.most, self.wanted, self.known = model, cache, wanted, {}

    def token(self, token: str) -> tuple[str, ...]:
        """What a blank-free token in lower case may have meant: itself without edges, its parts, and the decoded forms of both."""
        if len(token) > TOKEN_PLACES:
            return self._token(token)
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[token] = self._token(token)
        return found

    def _token(self, token: str) -> tuple[str, ...]:
        bare = token.strip(EDGE)
        forms = dict.fromkeys([bare])
        # With signs at its edges a token may be a word with decoration, or one whose first or last letter is a sign.
        whole = {bare, token.strip(".,;:?\"'()[]{}-")}
        parts = dict.fromkeys(m.group() for kind in (_SIGNED, _PLAIN) for m in kind.finditer(token))
        forms.update(dict.fromkeys(p for p in parts if p.isalnum()))
        for form in whole | parts.keys():
            if _TRACE.search(form) and any(map(str.isalpha, form)):
                forms.update(dict.fromkeys(self._decoded(form)))
        return tuple(f for f in forms if f)

    def _decoded(self, form: str) -> Iterator[str]:
        places = places_of(form)
        first = list(islice(places, TOKEN_PLACES + 1))
        if len(first) <= TOKEN_PLACES:
            yield viterbi(first, self.model)
        elif _SIGNED.fullmatch(form):
            yield from self._stretches(chain(first, places))
        else:
            yield from self._neighbours(form)

    def _stretches(self, places: Iterator[list[tuple[str, float]]]) -> Iterator[str]:
        """Pieces of a long part, decoded in stretches that overlap by the longest word."""
        stretch: list[list[tuple[str, float]]] = []
        while more := list(islice(places, TOKEN_PLACES + SPACED_PART - len(stretch))):
            stretch += more
            yield from self._pieces(viterbi(stretch, self.model))
            stretch = stretch[TOKEN_PLACES:]

    def _neighbours(self, form: str) -> Iterator[str]:
        """Parts beside each other as one word, as signs may have been set into it."""
        size = lambda part: max(1, sum(1 for _ in islice(places_of(part), SPACED_PART + 1)))
        sized = [(m.start(), m.end(), size(m.group())) for m in _SIGNED.finditer(form)]
        for k, (start, _, total) in enumerate(sized):
            for _, end, n in sized[k + 1 : k + SPACED_PART]:
                total += n
                if total > SPACED_PART:
                    break
                run = form[start:end]
                if _TRACE.search(run) and any(map(str.isalpha, run)):
                    yield viterbi(lattice(run), self.model)

    def _pieces(self, decoded: str) -> Iterator[str]:
        for n in range(4, SPACED_PART + 1):
            for k in range(len(decoded) - n + 1):
                piece = decoded[k : k + n]
                if self.wanted is None or piece in self.wanted:
                    yield piece

    def words(self, text: str) -> set[str]:
        """The different words of the restored text."""
        low = text.lower()
        found: set[str] = set()
        for token in set(low.split()):
            found.update(self.token(token))
        for m in _SPACED.finditer(low):
            run = m.group()
            # Where one spaced word ends and the next begins is not known, so all parts of the decoded letters count.
            for at in range(0, len(run), SPACED_RUN):
                decoded = viterbi(lattice(run[at : at + SPACED_RUN + 2 * SPACED_PART : 2]), self.model)
                found.add(decoded)
                found.update(self._pieces(decoded))
        return found


# --- fit and score -------------------------------------------------------------------------------------------------------------

def fit_rows(labels: DataFrame, id_col="doc_id", label_col="toxic", folds: bool = True, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids with their label, none of fold 0."""
    known = labels.select(F.col(id_col).alias("fit_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("fit_id").isNotNull() & F.col("label").isin(0, 1)
    )
    if folds:
        known = known.filter(fold_of(F.col("fit_id")) != 0)
    return known.groupBy("fit_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("fit_id"), "fit_id").limit(rows)


def word_weights(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Lower bounds (two standard errors) of the log odds of words that speak for the label."""
    weights = {}
    for word, t, c in counts:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (other + 1))
        bound = odds - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if bound > 0.5:
            weights[word] = bound
    return dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def features(words: set[str], weights: dict[str, float]) -> list[float]:
    """A one, the strongest weight, and the sum of the five strongest, damped."""
    best = sorted((weights[w] for w in words if w in weights), reverse=True)[:5]
    return [1.0, best[0] if best else 0.0, math.log1p(sum(best))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method for the penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, model: LetterModel, weights: dict[str, float], coefficients: list[float] | None):
        self.model, self.weights, self.coefficients = model, weights, coefficients

    def scores(self, texts: list[str | None], restorer: Restorer) -> list[float]:
        if self.coefficients is None:
            return [0.0] * len(texts)
        out = []
        for t in texts:
            z = sum(a * b for a, b in zip(features(restorer.words(t) if t else set(), self.weights), self.coefficients))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds: bool = True) -> Scorer:
    spark = docs.sparkSession
    model = LetterModel(letter_triples(docs, text_col))
    shared = spark.sparkContext.broadcast(model)
    asked = fit_rows(labels, id_col, label_col, folds)
    # At most FIT_ROWS ids, so they may be broadcast; a text that stands under several ids is counted once per label.
    rows = docs.select(F.col(id_col).alias("fit_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(asked), "fit_id")
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "fit_id").alias("text"), F.max("label").alias("label"))

    def restored(columns: dict[str, list]) -> dict[str, list]:
        restorer = Restorer(shared.value)
        found = [sorted(restorer.words(t)) if t else [] for t in columns["text"]]
        return {"label": columns["label"], "words": found}

    from emberline.llm.common import reliable_cut

    texts = reliable_cut(map_batches(rows.select("text", "label"), restored, "label int, words array<string>"), "toxic-fit")
    sizes = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Scorer(model, {}, None)
    counted = (
        texts.select(F.explode("words").alias("word"), "label").groupBy("word")
        .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).filter(F.col("t") >= WORD_TEXTS)
        # Words that cannot reach the bound stay where they are; the rest are the strongest, in a number that is bounded.
        .filter((F.col("t") + 0.5) / (toxic + 1) > 1.6 * (F.col("c") + 0.5) / (other + 1))
        .orderBy(F.desc((F.col("t") + 0.5) / (F.col("c") + 0.5)), "word").limit(4 * LEXICON)
    )
    weights = word_weights([(r.word, r.t, r.c) for r in counted.collect()], toxic, other)

    def measured(columns: dict[str, list]) -> dict[str, list]:
        return {"label": columns["label"], "x": [features(set(w), weights) for w in columns["words"]]}

    # FIT_ROWS rows of three numbers.
    sample = map_batches(texts, measured, "label int, x array<double>").collect()
    w = logistic(np.array([r.x for r in sample]), np.array([r.label for r in sample], float))
    return Scorer(model, weights, w.tolist())


def score(docs: DataFrame, scorer: Scorer, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        restorer = Restorer(scorer.model, wanted=scorer.weights)
        for batch in batches:
            for part in cut(batch):
                scores = scorer.scores(part.column(1).to_pylist(), restorer)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], schema=schema)

    return importable(rows).mapInArrow(task, "doc_id long, score double")


def op7_noisy_channel(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
