"""Toxicity scoring after noisy-channel deobfuscation.

Words that mark toxic documents are learned from labels. A character trigram model of
the training words serves as the source; the channel may write a letter as a look-alike,
put a mark in its place, repeat it, or set marks and spaces between letters. Suspicious
tokens and runs of spaced letters, of any length, become a lattice of what their
characters may stand for; the Viterbi path through it, which also decides where words
end, is what was meant. The words of the restored text are scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, discard, free_name, materialize, release
from palimpsest.llm.labelled import calibrated, id_remainder, isotonic, isotonic_of, training_rows

MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Least documents of a word, and least odds ratio between toxic and other documents.
MIN_DOCS, MIN_ODDS = 3, 20.0
#: Parts of the training rows; a row's score for the calibration uses a lexicon of the others.
FOLDS = 3
#: Letters of a stem; a word whose own form is unknown counts by its stem.
STEM = 5
#: Share of the lexicon in the character model; the rest is the training text.
LEXICON_SHARE = 0.5
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "¡": "i", "§": "s",
}
#: Marks that may stand for any letter (the third and later ones in a row stand for none),
#: and marks that may stand between letters or between words.
WILD, BETWEEN = "*#?%", " \t.-_*~'`,:;/\\^=+|\u200b\u00ad"
#: Greek and Cyrillic letters that look like Latin ones, and those; they count where a word mixes both.
TWINS = dict(zip("αεικνορτυχавгеикмнорстухіјѕ", "aeikvoptuxabreukmhopctyxijs", strict=True))
COST_LOOKALIKE, COST_WILD, COST_BETWEEN, COST_REPEAT, COST_LITERAL, COST_END = 1.0, 2.5, 0.7, 0.7, 9.0, 0.5
#: Scripts of more signs than an alphabet has: a mark in place of a sign cannot tell which.
#: Of these the character model knows the signs of marking words, of other scripts every letter.
MANY_SIGNS = frozenset(("CJK", "HANGUL", "YI", "TANGUT", "EGYPTIAN", "CUNEIFORM", "ANATOLIAN", "BAMUM", "NUSHU", "VAI", "CANADIAN", "ETHIOPIC"))
#: Log-probabilities that a character model keeps ready; more are worked out anew.
READY = 2_000_000
BOUND = "\x02"
NOTHING, END = -1, 0
#: Combinations of states and meanings from which a step is done as a matrix; the result is the same.
WIDE_STEP = 20_000

#: More than three of a character in a row mean what three mean.
_LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
_SPACED = re.compile(r"(?<!\S)(?:[^\s.\-_*~][ \t.\-_*~]+){2,}[^\s.\-_*~](?![^\s.,;:!?\"')\]])")
_TRIM = " \t\r\n.,;:!?\"'()[]{}<>%&*#$|~^=+-_/\\`"
_RUNS = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$|[.,;:\"'()\[\]{}]+$|^[.,;:\"'()\[\]{}]+")
_TWIN = "".join(TWINS)
#: What is odd in a token of letters alone, and in any other.
_ODD_LETTERS = re.compile(rf"(.)\1\1|[a-z][{_TWIN}]|[{_TWIN}][a-z]")
_STRETCHED = re.compile(r"(.)\1\1")
_ODD = re.compile(rf"(.)\1\1|[^\W\d_][^\W\d_]*[\d\W_]|[\d\W_][^\W\d_]|[a-z][{_TWIN}]|[{_TWIN}][a-z]", re.DOTALL)


def folded(text: str) -> str:
    """Lower case, and compatibility forms such as full-width letters as plain ones."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def collapsed(text: str) -> str:
    return _LONG_RUN.sub(r"\1\1\1", text)


@cache
def script(letter: str) -> str:
    """The script of a letter, by the first word of its name."""
    return unicodedata.name(letter, "").split(" ")[0].split("-")[0]


def alphabet(seen: set[str], words: set[str]) -> str:
    """Letters of the character model: those of ``words``, and of those seen the ones of their scripts that are alphabets."""
    own = {c for word in words for c in word if c.isalpha()}
    scripts = {script(c) for c in own} - MANY_SIGNS
    return "".join(sorted(own | {c for c in seen if c.isalpha() and script(c) in scripts}))


@dataclass
class CharModel:
    """Trigram log-probabilities of characters, backed off to bigrams and to single ones.

    Only what was counted is stored; the row of a context is worked out when it is asked for.
    """

    letters: str
    after: dict[tuple[int, int], dict[int, float]] = field(repr=False)
    pairs: dict[int, dict[int, float]] = field(repr=False)
    single: np.ndarray = field(repr=False)
    ready: dict[tuple[int, int], list[float]] = field(default_factory=dict, repr=False)

    @classmethod
    def train(cls, grams: dict[str, float], boost: dict[str, float], letters: str | None = None) -> CharModel:
        """From trigrams with counts (bounded by BOUND on each side), and lexicon words with theirs.

        Trigrams with another letter than ``letters`` (all of both, where none are given) count nothing.
        """
        marked: Counter = Counter()
        for word, n in boost.items():
            padded = BOUND * 2 + word + BOUND
            for i in range(len(padded) - 2):
                marked[padded[i : i + 3]] += n
        if letters is None:
            letters = alphabet({c for gram in grams for c in gram}, {*boost, *(gram.replace(BOUND, "") for gram in grams)})
        # letters only: look-alikes are what the channel writes, not what was meant
        index = {c: i for i, c in enumerate(BOUND + letters)}
        after: dict[tuple[int, int], dict[int, float]] = {}
        pairs: dict[int, dict[int, float]] = {}
        single = np.full(len(index), 1e-6)
        for source, share in ((grams, 1 - LEXICON_SHARE), (marked, LEXICON_SHARE)):
            known = {tuple(index[c] for c in gram): n for gram, n in source.items() if all(c in index for c in gram)}
            total = sum(known.values()) or 1.0
            for (a, b, c), n in known.items():
                weight = share * n / total
                row, pair = after.setdefault((a, b), {}), pairs.setdefault(b, {})
                row[c] = row.get(c, 0.0) + weight
                pair[c] = pair.get(c, 0.0) + weight
                single[c] += weight
        return cls(BOUND + letters, after, pairs, single / single.sum())

    def row(self, a: int, b: int) -> list[float]:
        """Log-probabilities of every letter after two; index 0 is the end of the word."""
        if (found := self.ready.get((a, b))) is None:
            bi = 1e-4 * self.single
            for c, n in self.pairs.get(b, {}).items():
                bi[c] += n
            tri = 1e-6 / bi.sum() * bi
            for c, n in self.after.get((a, b), {}).items():
                tri[c] += n
            found = np.log(tri / tri.sum()).tolist()
            if len(self.ready) * len(self.letters) > READY:
                self.ready.clear()
            self.ready[a, b] = found
        return found


@dataclass
class Decoder:
    model: CharModel

    def __post_init__(self) -> None:
        self.index = {c: i for i, c in enumerate(self.model.letters) if c != BOUND}
        self.hidden = [i for c, i in self.index.items() if script(c) not in MANY_SIGNS]

    def options(self, token: str, at: int) -> list[tuple[int, float]]:
        """What a character may stand for, with costs: a letter, nothing, or the end of a word."""
        c = token[at]
        found: list[tuple[int, float]] = []
        if c in self.index:
            found.append((self.index[c], 0.0))
        found += [(self.index[x], COST_LOOKALIKE) for x in LOOKALIKES.get(c) or TWINS.get(c, "") if x in self.index]
        if c in WILD and not (at > 1 and token[at - 1] in WILD and token[at - 2] in WILD):
            found += [(i, COST_WILD) for i in self.hidden]
        if c in BETWEEN:
            found += [(NOTHING, COST_BETWEEN), (END, COST_END)]
        if at and token[at - 1] == c:
            found.append((NOTHING, COST_REPEAT))
        return found or [(NOTHING, COST_LITERAL)]

    def restore(self, token: str) -> str:
        """The words on the best path through the lattice of a token, which may be of any length.

        States are the last two letters meant; each step keeps the best path into each
        state, so the work grows with the length of the token alone.
        """
        letters, row_of = self.model.letters, self.model.row
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at in range(len(token)):
            options = self.options(token, at)
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            wide = len(best) * len(options) > WIDE_STEP
            if wide:
                self._wide(best, [(k, price) for k, price in options if k > 0], step)
            for (a, b), (cost, path) in best.items():
                row = row_of(a, b)
                for k, price in options:
                    if k > 0 and wide:
                        continue
                    if k == NOTHING:
                        state, total, then = (a, b), cost + price, path
                    elif k == END:
                        state, total, then = (0, 0), self._ended(cost, a, b) + price, (path, " ")
                    else:
                        state, total, then = (b, k), cost + price - row[k], (path, letters[k])
                    if state not in step or total < step[state][0]:
                        step[state] = (total, then)
            best = step
        path = min(((self._ended(cost, a, b), (a, b), path) for (a, b), (cost, path) in best.items()), key=lambda x: x[:2])[2]
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)).strip()

    def _ended(self, cost: float, a: int, b: int) -> float:
        """The cost of a path once its word ends; between words nothing ends."""
        return cost if a == b == 0 else cost - self.model.row(a, b)[0]

    def _wide(self, best: dict, options: list[tuple[int, float]], step: dict) -> None:
        """The step for very many states, a matrix for each last letter."""
        meant, prices = [k for k, _ in options], np.asarray([price for _, price in options])
        by_last: dict[int, list[int]] = {}
        for a, b in sorted(best):
            by_last.setdefault(b, []).append(a)
        for b, firsts in by_last.items():
            total = np.asarray([best[a, b][0] for a in firsts])[:, None] - np.asarray([[row[k] for k in meant] for row in (self.model.row(a, b) for a in firsts)])
            first = total.argmin(0)
            for j, c in enumerate((total.min(0) + prices).tolist()):
                if (b, meant[j]) not in step or c < step[b, meant[j]][0]:
                    step[b, meant[j]] = (c, (best[firsts[first[j]], b][1], self.model.letters[meant[j]]))


@dataclass
class ToxicityModel:
    """Weights of marking words, the character model and the calibration.

    The lexicon is what passes the tests of ``_weight``, whose bar rises with the words that were counted.
    """

    weights: dict[str, float]
    chars: CharModel
    knots: np.ndarray
    values: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)

    def raw(self, markers: set[str]) -> float:
        """The surest marker, and a quarter of the next; a sum would let many weak ones outweigh it."""
        best = sorted((self.weights[w] for w in markers), reverse=True)[:2]
        return best[0] + 0.25 * sum(best[1:]) if best else 0.0


class Scorer:
    """Scores texts; remembers what recent tokens were restored to."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.decoder = model, Decoder(model.chars)
        self.memo: dict[str, str | None] = {}
        # a marking word can be hidden only by what can spell it
        self.spelled = sorted({(w.rstrip("~"), w.endswith("~")) for w in model.weights})

    def known(self, word: str) -> str | None:
        """The lexicon's word or stem for a word."""
        if word in self.model.weights:
            return word
        stem = word[:STEM] + "~"
        return stem if len(word) > STEM and stem in self.model.weights else None

    def restore(self, token: str) -> str | None:
        """What a token or spaced run was meant to be, or None where it is what it says.

        Only what can spell a marking word is decoded: the path of any other holds none.
        """
        if token in self.memo:
            return self.memo[token]
        if len(self.memo) > 100_000:
            self.memo.clear()
        found = None
        if self.known(token.strip(_TRIM)) is None:
            if token.isalpha():
                raw, odd = token, _STRETCHED if token.isascii() else _ODD_LETTERS
            else:
                raw, odd = _RUNS.sub("", _RUNS.sub("", token)), _ODD
            if odd.search(raw):
                for form in dict.fromkeys((token.strip(_TRIM), raw)):
                    if len(form) > 2 and self.may_hide(form):
                        found = self.decoder.restore(form)
                        if any(self.known(w) for w in found.split()):
                            break
        self.memo[token] = found
        return found

    def may_hide(self, form: str) -> bool:
        """Whether some path through the lattice spells a marking word, as far as letters in their order tell."""
        letters = self.decoder.model.letters
        options = [self.decoder.options(form, at) for at in range(len(form))]
        means = [{letters[k] for k, _ in found if k > 0} for found in options]
        every = set().union(*means)
        sure = {next(iter(m)) for m, found in zip(means, options, strict=True) if len(found) == 1 and m}
        one_word = all(k != END for found in options for k, _ in found)
        for word, stem in self.spelled:
            if every.issuperset(word) and (stem or not one_word or sure <= set(word)):
                at = iter(means)
                if all(any(c in m for m in at) for c in word):
                    return True
        return False

    def words(self, text) -> set[str]:
        """The words of the restored text."""
        if not isinstance(text, str) or not text:
            return set()
        text = collapsed(folded(text))
        tokens = set(text.split())
        tokens.update(_SPACED.findall(text))
        found = {t.strip(_TRIM) for t in tokens}
        for t in tokens:
            if meant := self.restore(t):
                found.update(meant.split())
        return found

    def markers(self, text) -> set[str]:
        """Lexicon words that the restored text holds."""
        return {known for w in self.words(text) if (known := self.known(w)) is not None}

    def raw(self, text) -> float:
        return self.model.raw(self.markers(text))

    def scores(self, texts) -> np.ndarray:
        return calibrated(np.asarray([self.raw(t) for t in texts], dtype=float), self.model.knots, self.model.values)

    def restored(self, text: str) -> str:
        """The text with what was decoded written out; everything else as it was, but for long runs of one character."""
        plain = lambda m: self.restore(folded(m[0])) or m[0]
        return re.sub(r"\S+", plain, _SPACED.sub(plain, collapsed(text)))


def _words(text: str) -> set[str]:
    words = {w for t in set(folded(text).split()) if (w := t.strip(_TRIM))}
    return words | {w[:STEM] + "~" for w in words if len(w) > STEM}


def _weight(toxic: Column, other: Column, n_toxic: float, n_other: float, n_words: int) -> Column:
    """Weight of a word in so many toxic and other documents; null where it marks nothing."""
    odds = (toxic + 0.5) / (n_toxic + 1.0) / ((other + 0.5) / (n_other + 1.0))
    rate = n_toxic / max(n_toxic + n_other, 1)
    # log-likelihood ratio of a word's own toxic rate against the overall rate
    term = lambda k, p: F.when(k > 0, k * F.log(k / ((toxic + other) * p))).otherwise(0.0)
    ratio = 2 * (term(toxic, rate) + term(other, 1 - rate))
    # log-odds less two standard errors: what rests on few documents counts little
    weight = F.greatest(F.log(odds) - 2 * F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)), F.lit(0.05))
    return F.when((toxic >= MIN_DOCS) & (odds >= MIN_ODDS) & (ratio >= 2 * math.log(n_words)), weight)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> ToxicityModel:
    """Learn lexicon, character model and calibration from all labelled rows outside the held-out remainder.

    The calibration scores each of them by a lexicon that its own fold has no part in.
    """
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", MODULUS, HELD_OUT, max_rows, distinct_texts=True)
    # written, so that the texts are dealt once for both the counts and the calibration
    rows = materialize(rows.select("text", "y", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "toxic_rows")
    release(docs.sparkSession)
    counts = [f"{kind}{k}" for kind in ("toxic", "other") for k in range(FOLDS)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, y, fold in batch[["text", "y", "fold"]].itertuples(index=False):
                for word in {"", *_words(text)}:  # the empty word counts documents
                    found.setdefault(word, [0] * len(counts))[fold if y > 0.5 else FOLDS + fold] += 1
            yield pd.DataFrame([(word, *n) for word, n in found.items()], columns=["word", *counts])

    table = materialize(rows.mapInPandas(count, "word string, " + ", ".join(f"{c} long" for c in counts)).groupBy("word").agg(*(F.sum(c).alias(c) for c in counts)), "toxic_words")
    n = table.filter("word = ''").first()
    n_toxic, n_other = ([n[f"{kind}{k}"] if n else 0 for k in range(FOLDS)] for kind in ("toxic", "other"))
    n_words = max(table.count(), 2)
    if sum(n_toxic) == 0 or sum(n_other) == 0:
        knots, values = isotonic(np.zeros(1), np.asarray([1.0 if sum(n_toxic) else 0.0])) if n else isotonic(np.zeros(0), np.zeros(0))
        return ToxicityModel({}, CharModel.train({BOUND * 2 + "a": 1.0}, {}), knots, values)

    def weight(without: int | None) -> Column:
        use = [k for k in range(FOLDS) if k != without]
        toxic, other = (sum((F.col(f"{kind}{k}") for k in use[1:]), F.col(f"{kind}{use[0]}")) for kind in ("toxic", "other"))
        return _weight(toxic, other, sum(n_toxic[k] for k in use), sum(n_other[k] for k in use), n_words)

    variants = [None, *range(FOLDS)]
    total = sum((F.col(f"toxic{k}") for k in range(1, FOLDS)), F.col("toxic0"))
    weighed = table.filter((F.length("word") > 2) & (total >= MIN_DOCS)).select("word", total.alias("toxic"), *(weight(v).alias(f"w{i}") for i, v in enumerate(variants)))
    marking = weighed.filter(F.coalesce(*(f"w{i}" for i in range(len(variants)))).isNotNull()).orderBy("word").collect()
    lexicons = [{r.word: float(r[f"w{i}"]) for r in marking if r[f"w{i}"] is not None} for i in range(len(variants))]

    def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: Counter = Counter()
            for word, k in zip(batch["word"], batch["n"], strict=True):
                if word.isalpha():  # stems end in a mark
                    padded = BOUND * 2 + word + BOUND
                    for i in range(len(padded) - 2):
                        held[padded[i : i + 3]] += k
            yield pd.DataFrame({"gram": list(held), "n": list(held.values())})

    both = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    grams = materialize(table.filter("word <> ''").select("word", both.alias("n")).mapInPandas(trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    boost = {r.word: float(r.toxic) for r in marking if r.word in lexicons[0] and r.word.isalpha()}
    # one row for each letter that any language has, then the trigrams of the alphabets that marking words use
    seen = {r.c for r in grams.select(F.substring("gram", 3, 1).alias("c")).distinct().collect()}
    letters = alphabet(seen, {r.word.rstrip("~") for r in marking})
    known = grams.filter(F.translate("gram", letters + BOUND, "") == "").collect()
    chars = CharModel.train({r.gram: r.n for r in known}, boost, letters)
    discard(table)
    discard(grams)
    by_fold = docs.sparkSession.sparkContext.broadcast([ToxicityModel(lexicon, chars, np.zeros(1), np.zeros(1)) for lexicon in lexicons[1:]])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [model.scorer() for model in by_fold.value]
        for batch in batches:
            yield pd.DataFrame({"s": [scorers[k].raw(t) for t, k in zip(batch["text"], batch["fold"], strict=True)], "y": batch["y"]})

    model = ToxicityModel(lexicons[0], chars, *isotonic_of(rows.mapInPandas(raw, "s double, y double")))
    discard(rows)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> DataFrame:
    """All columns of ``docs``, ``_toxicity`` and ``_markers`` (marking words found, restored, sorted).

    Scores depend on the text alone; null and empty texts hold no marker and get the
    score of texts without one. Null labels, labels without a document and documents
    without a label are no training rows. Without labels every score is 0.5. Repeated
    rows and null ids are scored like any other; an empty table gives an empty one.
    Texts are read whole, and tokens and spaced runs of any length are decoded. Columns
    of ``docs`` that have the names of the two are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    @F.pandas_udf("score double, markers array<string>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = shared.value.scorer()
        model = shared.value
        for texts in batches:
            found = [sorted(scorer.markers(t)) for t in texts]
            raw = np.asarray([model.raw(words) for words in found], dtype=float)
            yield pd.DataFrame({"score": calibrated(raw, model.knots, model.values), "markers": found})

    both = free_name("_scored", docs)
    scored = docs.withColumn(both, score(F.col("text").cast("string")))
    return scored.withColumns({"_toxicity": F.col(f"{both}.score"), "_markers": F.col(f"{both}.markers")}).drop(both)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id",
        (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
