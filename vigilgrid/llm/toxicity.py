"""Toxicity of texts that may be disguised: a noisy channel is decoded first, then words are scored.

Writing is seen as letters sent through a channel that swaps letters for signs that look like them,
puts spaces or marks between them and repeats them. A token with letters that has anything else in it, a
doubled letter, or no plain reading in the model's letters becomes a lattice, if its plain reading is no
known feature; while features are learned, a token with clear traces does. Compatibility forms and letters
of other scripts that look like ours are replaced before, format characters removed. In the lattice
each character offers the letters it may stand for, or nothing. The Viterbi algorithm finds the most
probable reading under a character trigram model, exactly, since a lattice has few states at a time.
Tokens without traces are their own reading. The trigram model is counted over all texts. While toxicity
is scored, only known features matter: a lattice in which no path spells one is not decoded, which
changes no score (``Spelling``).

The score comes from the words of the restored text: words themselves, and how many distinct words
share a beginning (a stem takes many endings). They are counted in a bounded sample of labelled rows
(``SAMPLE_PER_LABEL``: of both labels the texts with the smallest hashes). All that occur in more of the
toxic texts than of the others, by a likelihood-ratio test (``SIGNIFICANT``), are features. A logistic
regression over their sparse counts weighs them together, so that words which merely share texts with
toxic words gain little. Its odds are set back from the sample's share of toxic texts to that of all
labelled texts.

Counting and scoring run where the rows are; only narrow rows (key, hash, label) are exchanged. The
driver sees 27 ** 3 counts and the features of the bounded sample.

Defined results: null and empty texts get the score of texts without a known feature; without any
labelled text of both kinds every score is 0; of several labels for one key the largest counts; rows with a null label teach
nothing; repeated rows get a row each; very long texts are scored whole; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import SLICE_ROWS, append_values, fresh_name, map_texts, smallest_hashes, stage

SAMPLE_PER_LABEL = 4000
THRESHOLD = 0.3
SIGNIFICANT = 10.83  # of the likelihood ratio, one in a thousand by chance
STEMS = (4, 5, 6, 7)  # lengths of the beginnings that count
MOST_WORDS = 6  # of a stem, in one text
CACHE_TOKENS = 300_000
CACHE_LETTERS = 64
LETTERS = 26
SYMBOLS = LETTERS + 1  # 0 is the edge of a word

# Signs and the letters they are written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
# Costs of the channel, as negative log probabilities.
SWAP_COST = 0.7
VEIL_COST = 2.0  # a star for any vowel
DROP_COST = 0.4  # a mark or space between letters
REPEAT_COST = 0.6  # one more of the letter before

_TRACE = re.compile(
    r"[a-z][0-9@$!|+(€*]+[a-z]|^[0-9@$|+(€]+[a-z]{2}|[a-z]{2}[0-9$@]+\W*$|([a-z])\1\1|^\W*(?:[a-z0-9@$!|+][-._*~,]+){2,}[a-z0-9@$!|+]\W*$"
)
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^a-z]|([a-z])\1")
_CLOSING = ".,;:?!\"')]}"
# A word of a-z with nothing but marks around it that are no part of a disguise.
_BARE = re.compile(r"[\"'.,;:?\-\[\]{})]*([a-z]+)[\"'.,;:?\-()\[\]{}]*")
_TRIPLE = re.compile(r"([a-z])\1\1")
# Where runs of short tokens may be: such tokens one after the other, the last one with closing marks or not.
_SHORT = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}(?!\S))+(?:\s+\S{1,2}[.,;:?!\"')\]}]+(?!\S))?")
# Cyrillic and Greek letters and the Latin ones that they look like.
_SCRIPTS = str.maketrans(
    "авеікмнорстухјѕһԁԛԝъьпгαβεικνορτυχω",
    "abeikmhopctyxjshdqwbbnrabeiknoptuxw",
)


def _fold_table() -> np.ndarray:
    """Symbol of every code point below 0x250: its base letter without marks, or the edge."""
    table = np.zeros(0x250, dtype=np.int64)
    for code in range(0x250):
        base = unicodedata.normalize("NFD", chr(code).lower())[:1]
        if "a" <= base <= "z":
            table[code] = ord(base) - ord("a") + 1
    return table


_FOLD = _fold_table()
_PLAIN = {code: chr(96 + int(symbol)) for code, symbol in enumerate(_FOLD) if symbol}


def trigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``trigram, n``: counts of folded letter trigrams over all texts, added up per task first."""
    source = df.select(F.col(f"`{text}`").alias("_text")).filter(F.length("_text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                joined = "\n\n".join(["", *batch.column(0).slice(start, SLICE_ROWS).to_pylist(), ""])
                codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
                s = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], 0)
                counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["trigram", "n"])

    parts = source.mapInArrow(run, "trigram long, n long")
    return parts.groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs -log P(c | a, b) by smoothed counts, backed by bigrams and single letters."""
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    n[:, 0, 0] = 0  # edges that follow edges say nothing about words
    single = n.sum(axis=(0, 1)) + 1
    single /= single.sum()
    pair = n.sum(axis=0)
    pair = (pair + 20 * single) / (pair.sum(axis=1, keepdims=True) + 20)
    triple = (n + 20 * pair[None]) / (n.sum(axis=2, keepdims=True) + 20)
    return -np.log(triple)


def fit_language_model(df: DataFrame, text: str = "text") -> np.ndarray:
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for row in trigram_counts(df, text).collect():
        counts[row["trigram"]] = row["n"]
    return language_model(counts)


@lru_cache(maxsize=4096)
def _signs(ch: str) -> tuple[list[tuple[int, float]], float | None]:
    base = _PLAIN.get(ord(ch))
    if base is not None:
        return [(ord(base) - 96, 0.0)], None
    if ch.isspace():
        return [(0, 0.0)], DROP_COST
    if ch in LOOKALIKES:
        cost = VEIL_COST if ch == "*" else SWAP_COST
        return [(ord(x) - 96, cost) for x in LOOKALIKES[ch]], 2 * DROP_COST
    return [], DROP_COST


class Decoder:
    """Most probable reading of disguised tokens under a letter model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    @staticmethod
    def lattice(token: str) -> Iterator[tuple[list[tuple[int, float]], float | None]]:
        """For each character the symbols it may stand for with their costs, and the cost of dropping it."""
        return map(_signs, token)

    def read(self, token: str) -> str:
        """Reading of a token or a run of spaced letters: words of a-z between single spaces."""
        # state: the last two symbols -> cost and the reading as a linked list
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        costs = self.costs
        for options, drop in self.lattice(token):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                row = costs[a][b]
                for symbol, extra in options:
                    if symbol == 0 and b == 0:
                        moved, total, way = (a, b), cost, path
                    else:
                        moved, total, way = (b, symbol), cost + row[symbol] + extra, (path, symbol)
                    known = after.get(moved)
                    if known is None or total < known[0]:
                        after[moved] = (total, way)
                    if symbol == b and b:  # one more of the letter before
                        total, known = cost + extra + REPEAT_COST, after.get((a, b))
                        if known is None or total < known[0]:
                            after[(a, b)] = (total, path)
                if drop is not None:
                    total, known = cost + drop, after.get((a, b))
                    if known is None or total < known[0]:
                        after[(a, b)] = (total, path)
            states = after
        ends = [(cost + (costs[a][b][0] if b else 0.0), path) for (a, b), (cost, path) in states.items()]
        path = min(ends, key=lambda end: end[0])[1]
        symbols = []
        while path is not None:
            path, symbol = path
            symbols.append(symbol)
        return "".join(" " if s == 0 else chr(96 + s) for s in reversed(symbols)).strip()


class Spelling:
    """Whether a lattice may spell a known word, or a longer one with a known beginning.

    The features form a trie. All its nodes that the symbols read so far can lead to are followed at
    once; most tokens leave it after a few characters. A node is a prefix of a feature, so there are
    few at a time. What is refused has no reading with a known word; what is let through is decoded.
    """

    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        for name in names:
            node = self.root
            for letter in name.rstrip("-"):
                node = node.setdefault(letter, {"": letter})
            node["stem" if name.endswith("-") else "word"] = True

    def may(self, token: str) -> bool:
        nodes = {id(self.root): self.root}
        one_word = not any(ch.isspace() for ch in token)
        for options, drop in Decoder.lattice(token):
            after = dict(nodes) if drop is not None else {}
            if options and options[0][0] == 0:  # a word may end here and another one start
                if any("word" in node for node in nodes.values()):
                    return True
                after[id(self.root)] = self.root
            for node in nodes.values():
                for symbol, _ in options:
                    if symbol == 0:
                        continue
                    letter = chr(96 + symbol)
                    if node.get("") == letter:  # one more of the letter before
                        after[id(node)] = node
                    child = node.get(letter)
                    if child is not None:
                        if "stem" in child:
                            return True
                        after[id(child)] = child
            nodes = after
            if one_word and not nodes:
                return False
        return any("word" in node for node in nodes.values())


def _shown(text: str) -> str:
    """``_folded`` text as it looks: without format characters, compatibility forms and other scripts' look-alikes."""
    if text.isascii():
        return text.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    return _folded(plain.lower().translate(_SCRIPTS))


def _folded(text: str) -> str:
    """Lower case with letters without marks."""
    return text.lower().translate(_PLAIN)


class Restorer:
    """Words of restored texts; readings of tokens are remembered within a task."""

    def __init__(self, costs: np.ndarray, keep: Callable[[str], bool] | None = None, names: Iterable[str] | None = None):
        self.decoder = Decoder(costs)
        self.keep = keep
        self.spelling = None if names is None else Spelling(names)
        self.cache: dict[str, tuple[str, ...]] = {}

    def _read(self, token: str) -> list[str]:
        """Words of the most probable reading; none where no reading can have a known word."""
        if self.spelling is not None and not self.spelling.may(token):
            return []
        return self.decoder.read(token).split()

    def _known(self, words: list[str]) -> tuple[str, ...]:
        return tuple(words) if self.keep is None else tuple(w for w in words if self.keep(w))

    def token(self, token: str) -> tuple[str, ...]:
        """Known words of a token. Most tokens are plain words, for which little has to be looked at."""
        if self.keep is not None and token.isascii():
            lower = token.lower()
            bare = _BARE.fullmatch(lower)
            if bare and not _TRIPLE.search(lower):
                word = bare.group(1)
                if self.keep(word):
                    return (word,)
                return self._known(self._read(word)) if _ODD.search(word) else ()
        return self.whole_token(token)

    def whole_token(self, token: str) -> tuple[str, ...]:
        shown = _folded(token)
        traced = _TRACE.search(shown)
        known = self._known(self._read(shown) if traced else _WORD.findall(token.lower()))
        if known or self.keep is None:
            return known
        looks = _shown(token)
        core = looks.strip("\"'.,;:?-()[]{}")
        if core == looks and traced or not re.search("[a-z]", core):
            return ()
        if not _ODD.search(core):
            return self._known([core]) if core != token.lower() else ()
        return self._known(self._read(core)) or self._known(_WORD.findall(core))

    def words(self, texts: list[str]) -> list[set[str]]:
        """The distinct (known) words of each whole text after restoring it."""
        cache = self.cache
        if len(cache) > CACHE_TOKENS:
            cache.clear()
        out = []
        for text in texts:
            distinct = set(text.split())
            found: set[str] = set()
            for t in distinct.difference(cache):
                words = self.token(t)
                if len(t) <= CACHE_LETTERS:
                    cache[t] = words
                else:
                    found.update(words)
            for words in map(cache.get, distinct):
                if words:
                    found.update(words)
            for run in spaced_runs_of(text, letters=1 if self.keep is None else 2):
                found.update(self._known(self._read(_folded(run))))
            out.append(found)
        return out


def spaced_runs(tokens: list[str], least: int = 3, letters: int = 1) -> list[str]:
    """Runs of at least ``least`` tokens of up to ``letters`` characters, one of them of one character.

    Closing marks do not count as characters; they end a run.
    """
    runs, current = [], []
    for t in [*tokens, "   "]:
        core = t if len(t) == 1 else t.rstrip(_CLOSING)
        short = 1 <= len(core) <= letters
        if short:
            current.append(core)
        if short and core == t:
            continue
        if len(current) >= least and any(len(c) == 1 for c in current):
            runs.append(" ".join(current))
        current = []
    return runs


def spaced_runs_of(text: str, letters: int) -> list[str]:
    """``spaced_runs`` of the tokens of a text, from the few places where there may be any."""
    return [run for m in _SHORT.finditer(text) for run in spaced_runs(m.group().split(), letters=letters)]


def stems(word: str) -> list[str]:
    return [word[:n] + "-" for n in STEMS if len(word) > n]


def features(words: set[str]) -> Counter:
    """A text's words, once each, and the numbers of its distinct words with each beginning."""
    found = Counter(words)
    for word in words:
        found.update(stems(word))
    return found


@dataclass
class Model:
    """Letter costs, weights of the features, and the log odds of a text without any."""

    costs: np.ndarray
    weights: dict[str, float]
    bias: float

    def known(self, word: str) -> bool:
        return word in self.weights or any(s in self.weights for s in stems(word))

    def score(self, words: set[str]) -> float:
        logit = self.bias
        for name, n in sorted(features(words).items()):
            logit += self.weights.get(name, 0.0) * min(n, MOST_WORDS)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit)))) if self.bias > -math.inf else 0.0


def logistic(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 25
) -> np.ndarray:
    """Weights of a logistic regression on sparse features, the bias last, by Newton's method with a ridge.

    Each step is found by conjugate gradients, so no matrix over the features is built.
    """
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-3

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * v[columns], minlength=len(y)) + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, values * r[rows], minlength=width), r.sum())

    w = np.zeros(width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        curve = p * (1 - p)
        rest = back(p - y) + penalty * w
        step, way, size = np.zeros_like(w), rest.copy(), rest @ rest
        for _ in range(500):
            if size < 1e-14:
                break
            turned = back(curve * times(way)) + penalty * way
            far = size / (way @ turned)
            step += far * way
            rest -= far * turned
            size, before = rest @ rest, size
            way = rest + size / before * way
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _xlogx(x: Column, share: Column) -> Column:
    return F.when(x > 0, x * F.log(x / share)).otherwise(0.0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    corpus: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
) -> Model:
    """Model from labelled ``docs``; letters are counted over ``corpus`` (default: ``docs``)."""
    spark = docs.sparkSession
    costs = fit_language_model(docs if corpus is None else corpus, text)
    marked = labels.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_label"))
    marked = marked.filter(F.col("_label").isin(0, 1))
    narrow = docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    known = narrow.join(marked, "_key").groupBy("_h").agg(F.max("_label").alias("_label"))
    known = stage(known, "toxic-labels")
    totals = {row["_label"]: row["count"] for row in known.groupBy("_label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(costs, {}, -math.inf)
    picked = smallest_hashes(known, "_label", "_h", per_label).select("_h", "_label").collect()
    # Made from Arrow: from Python rows Spark makes tables in more Python workers, which linger.
    columns = {"_h": pa.array([row["_h"] for row in picked], pa.int64()), "_label": pa.array([row["_label"] for row in picked], pa.int32())}
    names = spark.createDataFrame(pa.table(columns))
    texts = docs.select(F.col(f"`{text}`").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    texts = texts.join(F.broadcast(names), "_h").select("_h", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                words = restorer.words([t or "" for t in part.column(2).to_pylist()])
                lists = pa.array([sorted(w) for w in words], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["h", "label", "words"])

    restored = texts.mapInArrow(run, "h long, label int, words array<string>")
    restored = stage(restored.dropDuplicates(["h"]), "toxic-words")
    size = {row["label"]: row["count"] for row in restored.groupBy("label").count().collect()}
    distinct = restored.select("h", "label", F.explode("words").alias("word"))
    begins = F.array(F.col("word"), *[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("-"))) for n in STEMS])
    named = distinct.select("h", "label", F.explode(F.array_compact(begins)).alias("name")).groupBy("h", "label", "name")
    named = named.agg(F.least(F.count(F.lit(1)), F.lit(MOST_WORDS)).alias("n"))
    counts = named.groupBy("name").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    # Likelihood ratio of the counts in toxic and other texts against equal rates.
    share = size.get(1, 0) / (size.get(0, 0) + size.get(1, 0))
    both = F.col("toxic") + F.col("clean")
    ratio = 2 * (_xlogx(F.col("toxic"), both * share) + _xlogx(F.col("clean"), both * (1 - share)))
    best = counts.filter((F.col("toxic") > both * share) & (ratio >= SIGNIFICANT)).select("name")
    names = sorted(best.toArrow().column("name").to_pylist())
    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string()), "at": pa.array(range(len(names)), pa.int32())}))
    # Numbers only, as arrays: what the driver holds is bounded by the sample.
    texts = restored.select("h", "label").toArrow().sort_by("h")
    hits = named.join(listed, "name").select("h", "at", "n").toArrow()
    hashes, y = (texts.column(c).to_numpy() for c in ("h", "label"))
    rows = np.searchsorted(hashes, hits.column("h").to_numpy())
    w = logistic(rows, hits.column("at").to_numpy(), hits.column("n").to_numpy().astype(float), y.astype(float), len(names))
    shift = math.log(totals[1] / totals[0]) - math.log(y.sum() / max(1.0, (1 - y).sum()))
    return Model(costs, dict(zip(names, w.tolist())), float(w[-1]) + shift)


def _scorer(model: Model):
    restorer = Restorer(model.costs, model.known, model.weights)

    def many(texts: list) -> tuple:
        return ([model.score(words) for words in restorer.words(texts)],)

    return many


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score``: probability that each whole text is toxic."""
    return map_texts(df, key, text, [("score", DoubleType())], lambda: _scorer(model))


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``df`` whose text scores below the threshold."""
    name = fresh_name(df, "_toxicity")
    found = append_values(df, text, [(name, DoubleType())], lambda: _scorer(model))
    return found.filter(F.col(name) < threshold).drop(name)
