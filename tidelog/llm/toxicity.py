"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton after folding, normalised by length.

Folding lower-cases, undoes look-alike letters, accents and full-width forms, and reads digits that
stand for letters. A lexicon entry is a whole word or the beginning of one; of the entries that match
at one word the heaviest counts, and none does inside an exception phrase.

The lexicon is learned from a bounded sample of labelled texts: at most SAMPLE_TOXIC toxic and
SAMPLE_CLEAN clean ones of up to SAMPLE_CHARS characters, taken by the hash of their id. An entry is
a word or prefix whose share of toxic texts is far above that of clean ones, and that follows
many different words there (so that one much-copied text teaches nothing). A logistic curve
over the summed weights, alone and per word, gives the score; it is weighted back to
the labels' own proportion.

Null and empty texts have no match and get the score of such texts. Without labels of both classes
the lexicon is empty and all scores equal the share of toxic labels. Rows with a null id or label are
not learned from. A text is folded in windows of about WINDOW characters that end at a space; what could still be part of a
phrase is carried over, so the windows change no result. The lexicon has every entry that the sample supports.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extended, map_batches, only

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 3000, 6000, 20_000
#: An entry's least log odds, least number of different words before it, and length of prefixes.
LEAST_ODDS, LEAST_CONTEXTS, CONTEXT_SHARE = 4.0, 5, 0.004
PREFIXES = range(4, 11)
#: Characters folded at a time, up to the next space.
WINDOW = 1 << 20

# Letters that look like Latin ones, and digits and signs that are read as letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѡ": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Phrases in which an entry means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pond scum")

_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_table: dict[int, str] | None = None


def _fold_table() -> dict[int, str]:
    """What str.translate needs: digits, look-alikes, and the plain letters of accented and full-width ones."""
    global _table
    if _table is None:
        out = {}
        for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)):
            for cp in block:
                plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)).lower()
                if plain and plain != chr(cp):
                    out[cp] = plain
        for k, v in LOOK_ALIKES.items():
            out[ord(k)] = DIGITS.get(v, v)
        for k, v in DIGITS.items():
            out[ord(k)] = v
        for cp in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF]:
            out[cp] = ""
        _table = out
    return _table


def fold(text: str) -> str:
    low = text.lower()
    if "@" in low or "$" in low or "!" in low:
        low = _SIGN.sub(lambda m: SIGNS[m[0]], low)
    return low.translate(_fold_table())


def _windows(text: str | None):
    """(whether it is the last, folded window) of a text; windows end before a space."""
    at = 0
    while text and at < len(text):
        stop = text.find(" ", at + WINDOW)
        stop = len(text) if stop < 0 else stop
        yield stop == len(text), fold(text[at:stop])
        at = stop


class Lexicon:
    """Entries with weights. A key that ends in a space is a whole word; else it begins words."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions = weights, exceptions
        self.automaton = ahocorasick.Automaton()
        for key, w in weights.items():
            if (word := key.strip()) not in self.automaton:
                self.automaton.add_word(word, (len(word), [None, None], None))
            self.automaton.get(word)[1][key.endswith(" ")] = w
        for phrase in map(fold, exceptions):
            n, pair = self.automaton.get(phrase)[:2] if phrase in self.automaton else (len(phrase), [None, None])
            self.automaton.add_word(phrase, (n, pair, True))
        self.longest = max(map(len, self.automaton.keys()), default=0)
        if weights:
            self.automaton.make_automaton()

    def match(self, text: str | None) -> tuple[float, int]:
        """(summed weight, matched words) of a whole text."""
        total, count = 0.0, 0
        if not self.weights:
            return total, count
        carried, decided = "", 0  # the end of what was looked at, and the place in it where the next entry may begin
        for last_window, more in _windows(text):
            folded = carried + more
            # up to here whatever could touch an entry is in sight
            limit = len(folded) if last_window else max(decided, len(folded) - self.longest - 1)
            found: dict[int, float] = {}
            free: list[tuple[int, int]] = []
            for last, (n, (prefix, whole), exception) in self.automaton.iter(folded):
                start = last + 1 - n
                if start and folded[start - 1].isalnum():
                    continue
                ends = last + 1 == len(folded) or not folded[last + 1].isalnum()
                if exception and ends:
                    free.append((start, last))
                w = max(prefix if prefix is not None else 0.0, whole if whole is not None and ends else 0.0)
                if decided <= start < limit and w > found.get(start, 0.0):
                    found[start] = w
            for start, w in found.items():
                if not any(a <= start <= b for a, b in free):
                    total, count = total + w, count + 1
            kept = min(len(folded), len(folded) - limit + self.longest + 1)
            carried, decided = folded[len(folded) - kept :], kept - (len(folded) - limit)
        return total, count


def _features(total: np.ndarray, count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(count), np.log1p(100.0 * total / np.maximum(words, 1)), np.minimum(count, 1)], axis=1)


class Model:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.lexicon.match(t) for t in texts]
        total, count = np.array([x for x, _ in found], float), np.array([n for _, n in found], np.int64)
        words = np.array([t.count(" ") + 1 if t else 0 for t in texts])
        z = _features(total, count, words) @ self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))), count


def _terms(text: str) -> dict[str, set[str]]:
    """Whole words and prefixes of a folded text, each with the words before it."""
    out: dict[str, set[str]] = {}
    before = ""
    for word in _WORD.findall(text):
        out.setdefault(word + " ", set()).add(before)
        for n in PREFIXES:
            if n < len(word):
                out.setdefault(word[:n], set()).add(before)
        before = word
    return out


def learn_lexicon(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Weights of the entries that set the toxic texts apart."""
    toxic, clean = sorted({fold(t) for t in toxic}), sorted({fold(t) for t in clean})
    if not toxic or not clean:
        return {}
    least = max(LEAST_CONTEXTS, math.ceil(CONTEXT_SHARE * len(toxic)))
    share = Counter()
    for t in toxic:
        share.update(_terms(t).keys())
    share = {k: n for k, n in share.items() if n >= least and len(k.strip()) > 2}
    against = Counter()
    for t in clean:
        words = set(_WORD.findall(t))
        against.update({k for w in words for k in (w + " ", *(w[:n] for n in PREFIXES if n < len(w))) if k in share})
    odds = {k: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((against[k] + 0.5) / (len(clean) + 1)) for k, n in share.items()}
    odds = {k: w for k, w in odds.items() if w >= LEAST_ODDS}
    contexts: dict[str, set[str]] = {}
    for t in toxic:
        for k, before in _terms(t).items():
            if k in odds:
                contexts.setdefault(k, set()).update(before)
    return {k: odds[k] for k in sorted(odds) if len(contexts[k]) >= least}


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        s = weight * p * (1 - p) + 1e-9
        grad = x.T @ (weight * (y - p)) - 0.05 * b
        b = b + np.linalg.solve((x * s[:, None]).T @ x + 0.05 * np.eye(len(b)), grad)
    return b


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether the row isn't to be learned from: crc32 of its id as text, modulo the folds."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn from the labelled documents that aren't held out (columns doc_id and text; doc_id and toxic). Of the texts of one id the least counts."""
    known = only(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).distinct()
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).unionAll(known.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    texts = only(docs, "doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    picked = texts.join(F.broadcast(some), "doc_id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    rows = picked.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").collect()  # as many as ids were picked
    toxic, clean = [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0]
    if not toxic or not clean:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        z = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(Lexicon({}, exceptions), np.array([z, 0, 0, 0, 0], float))
    lexicon = Lexicon(learn_lexicon(toxic, clean), exceptions)
    texts_, y = toxic + clean, np.array([1.0] * len(toxic) + [0.0] * len(clean))
    found = [lexicon.match(t) for t in texts_]
    x = _features(np.array([a for a, _ in found]), np.array([n for _, n in found]), np.array([t.count(" ") + 1 for t in texts_]))
    weight = np.where(y > 0, sizes[1] / len(toxic), sizes[0] / len(clean))
    return Model(lexicon, _curve(x, y, weight / weight.mean()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double), predicted (int) and n_matches (long), replacing columns of those names."""
    added = ("score", "predicted", "n_matches")
    own = [c for c in docs.columns if c not in added]
    docs = docs.select(*(F.col(f"`{c}`") for c in own))
    at, sc = own.index(text), docs.sparkSession.sparkContext
    shared = sc.broadcast((model.lexicon.weights, model.lexicon.exceptions, model.curve))
    built: list[Model] = []

    def run(batches):
        if not built:
            weights, exceptions, curve = shared.value
            built.append(Model(Lexicon(weights, exceptions), curve))
        for b in batches:
            s, n = built[0].scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(n)], names=[*own, *added])

    return map_batches(docs, run, extended(docs.schema, ("score", "double"), ("predicted", "int"), ("n_matches", "bigint")))
