"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Counts of character 4-grams are gathered over all training texts (each task sends what it has summed up,
so this grows with the corpus until all 4-grams are known). From all of them each language gets an interpolated
Kneser-Ney model of orders 4 to 1; discounts, continuation counts and probabilities are worked out by Spark.
For every n-gram that any language has, its log probability under
every language is worked out once; the table of an order is an array sorted by hash, searched through
a directory of the hashes' leading bits. An unseen n-gram costs its context's back-off weight and is
looked up one order down. The tables are dealt by hash into shards of bounded size, each broadcast on its own;
where there are more than KEPT_SHARDS, a worker holds one at a time and searches it for HELD characters of texts at once.

The answer is the language of the lowest cross-entropy per symbol. Rejection is calibrated on all distinct
training texts: `rejected` is set for texts whose best cross-entropy lies further above that
language's own mean than REJECT_SD standard deviations and REJECT_NATS (so odd but clean texts stay and most of other languages go),
and for texts without a letter. Texts under REJECT_SYMBOLS symbols are never rejected otherwise.

Symbols are lower-cased letters; all else is a space, and runs of spaces are one. Null texts and texts
without letters are `und` with score 0. Rows without a language or an id aren't learned from; with
nothing to learn from every text is `und`. Ties go to the language that sorts first. Texts of over
PIECE characters are worked through in pieces, each in the context of the one before, which changes no result.
More than MOST_LANGUAGES languages are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extended, map_batches, new_path, only, written

UNKNOWN = "und"
ORDER = 4
#: Characters held at a time.
PIECE = 1 << 18
MOST_LANGUAGES = 512
#: Numbers in a shard of the model (n-grams and contexts times languages), and shards that a worker keeps open.
SHARD_VALUES, KEPT_SHARDS = 4_000_000, 4
#: Characters of texts that are looked up at once in a model of more shards, for up to four languages (fewer for more).
HELD = 16 << 20
REJECT_SD, REJECT_NATS, REJECT_SYMBOLS = 10.0, 1.3, 20
#: What the score's sharpness is chosen from: how fast it falls when another language comes close, in nats per symbol.
SHARPNESS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_symbols: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Code point -> symbol: lower-case letters as themselves (those beyond 16 bits in a private area), else a space."""
    global _symbols
    if _symbols is None:
        out = np.full(0x110000, 32, np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                x = ord(low) if len(low) == 1 else cp
                out[cp] = x if x < 0x10000 else 0xE000 + x % 6400
        out[0] = 0
        _symbols = out
    return _symbols


def _groups(texts: list[str | None]):
    """Lists of (number of the text, a piece of it, whether more of it follows) of about PIECE characters in all. A piece that isn't its text's last is alone."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if "\0" in t:
            t = t.replace("\0", " ")
        for at in range(0, len(t), PIECE):
            piece, more = t[at : at + PIECE], at + PIECE < len(t)
            if group and (more or size + len(piece) > PIECE):
                yield group
                group, size = [], 0
            group.append((i, piece, more))
            size += len(piece)
            if more:
                yield group
                group, size = [], 0
    if group:
        yield group


def _grams(pieces: list[str], before: np.ndarray | None = None, more: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-grams, the piece that each belongs to, whether each piece has a letter, the last symbols), in order of the pieces.

    before: the last symbols of the piece that the first one goes on from; more: the last one goes on, so nothing ends there.
    """
    joined = ("\0\0\0 " if before is None else "") + " \0\0\0 ".join(pieces) + ("" if more else " ")
    s = symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = s == 32
    s = s[~(space & np.concatenate(([before is not None and before[-1] == 32], space[:-1])))].astype(np.uint64)
    known = 0
    if before is not None:
        s, known = np.concatenate((before, s)), len(before)
    packed = s.copy()
    for back in range(1, ORDER):
        packed[back:] |= s[:-back] << np.uint64(16 * back)
    zero = s == 0
    zero[:known] = False
    piece = np.cumsum(zero) // 3 - (0 if known else 1)
    real = s > 0
    real[:known] = False
    letters = np.bincount(piece[real & (s > 32)], minlength=len(pieces)) > 0
    return packed[real], piece[real], letters, s[1 - ORDER :]


def _each_group(texts: list[str | None]):
    """(numbers of the texts, packed 4-grams, place in the numbers, whether there is a letter) of each group; a text in pieces counts as the whole."""
    before = None
    for group in _groups(texts):
        packed, piece, letters, last = _grams([p for _, p, _ in group], before, group[-1][2])
        yield np.array([i for i, _, _ in group]), packed, piece, letters
        before = last if group[-1][2] else None


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): 4-grams of all texts by language."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                for _, packed, _, _ in _each_group(texts):
                    parts = held.setdefault(name, [])
                    parts.append(np.unique(packed, return_counts=True))
                    if len(parts) >= 8:
                        held[name] = [_summed(parts)]
        for name, parts in held.items():
            keys, n = _summed(parts)
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n[i : i + 100_000])], names=["lang", "gram", "n"])

    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null")
    return map_batches(known, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


class HashArray:
    """uint64 keys in order of their hash, with a directory of leading bits."""

    def __init__(self, keys: np.ndarray):
        h = keys * _MIX
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted((self.hashes >> self.shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the sorted array, or -1."""
        h = keys * _MIX
        top = (h >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(keys), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end, h = at[live], end[live], h[live]
        while len(live):
            hit = self.hashes[at] == h
            out[live[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end)
            live, at, end, h = live[on], at[on], end[on], h[on]
        return out


class Shard:
    """By order n..1, of some n-grams the log probabilities and of some contexts the logs of back-off weights, by language."""

    def __init__(self, probs: list[tuple[np.ndarray, np.ndarray]], weights: list[tuple[np.ndarray, np.ndarray]]):
        self.tables = [self._packed(*t) for t in probs]
        self.backoffs = [self._packed(*t) for t in weights]

    @staticmethod
    def _packed(keys: np.ndarray, values: np.ndarray) -> tuple[HashArray, np.ndarray]:
        table = HashArray(keys)
        return table, np.log(values)[table.order].astype(np.float32)


def _low(order: int) -> int:
    """The mask of an n-gram's last `order` symbols."""
    return (1 << 16 * order) - 1


class Model:
    """languages, what a symbol costs that none has, and the shards: Shard objects, or broadcasts of them."""

    def __init__(self, languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]]):
        """A model of one shard, of (4-grams, counts) by language that fit into memory; fit() makes those of tables."""
        count = len(languages)
        # counts by order: of occurrences at the top, below it of the distinct symbols in front
        levels = [grams]
        for order in range(ORDER, 1, -1):
            mask = np.uint64(_low(order - 1))
            levels.append([np.unique(k & mask, return_counts=True) for k, _ in levels[-1]])
        levels.reverse()
        self._begin(languages, len(np.unique(np.concatenate([k for k, _ in levels[0]]))) if count else 0, [])
        probs, weights = [], []
        for order in range(1, ORDER + 1):
            counted = levels[order - 1]
            union = np.unique(np.concatenate([k for k, _ in counted])) if count else np.zeros(0, np.uint64)
            contexts = np.unique(union >> np.uint64(16))
            prob = np.zeros((len(union), count))
            weight = np.ones((len(contexts), count))
            below = probs[-1][1][np.searchsorted(probs[-1][0], union & np.uint64(_low(order - 1)))] if probs else np.full((len(union), count), np.exp(self.floor))
            where = np.searchsorted(contexts, union >> np.uint64(16))
            for i, (keys, n) in enumerate(counted):
                discount = _discount(int((n == 1).sum()), int((n == 2).sum()))
                at = np.searchsorted(union, keys)
                own = np.bincount(where[at], weights=n, minlength=len(contexts))
                kinds = np.bincount(where[at], minlength=len(contexts))
                seen = own > 0
                weight[seen, i] = discount * kinds[seen] / own[seen]
                prob[at, i] = (n - discount) / own[where[at]]
                prob[:, i] += weight[where, i] * below[:, i]
            probs.append((union, prob))
            weights.append((contexts, weight))
        self.shards = [Shard(probs, weights)]

    @classmethod
    def of_shards(cls, languages: list[str], symbols: int, shards: list) -> Model:
        model = cls.__new__(cls)
        model._begin(languages, symbols, shards)
        return model

    def _begin(self, languages: list[str], symbols: int, shards: list) -> None:
        self.languages, self.shards = languages, shards
        #: Below the lowest order: the same for each symbol that any language has, and for all others together.
        self.floor = np.log(1.0 / (symbols + 1))
        #: language -> (mean, standard deviation) of its own texts' cross-entropy
        self.usual: dict[str, tuple[float, float]] = {}
        self.sharpness = SHARPNESS[-2]

    def _opened(self):
        """The shards, one after the other."""
        for s in self.shards:
            yield s.value if isinstance(s, Broadcast) else s
            if isinstance(s, Broadcast) and len(self.shards) > KEPT_SHARDS:
                s.__dict__.pop("_value", None)  # it is read again where it is asked for

    def held(self) -> int:
        """Characters of texts that should be looked up at once; 0: any number."""
        return HELD * 4 // max(4, len(self.languages)) if len(self.shards) > KEPT_SHARDS else 0

    def _score(self, packed: np.ndarray, order: int) -> np.ndarray:
        """Log probability of each gram's last symbol under each language."""
        keys, back = np.unique(packed, return_inverse=True)
        return self._scores(keys, order)[back]

    def _scores(self, keys: np.ndarray, order: int) -> np.ndarray:
        """The same of distinct grams in order. Each shard is opened once."""
        count = len(self.languages)
        needed = [keys]
        for o in range(order - 1, -1, -1):
            needed.append(np.unique(needed[-1] & np.uint64(_low(o))))
        needed.reverse()
        contexts = [np.unique(k >> np.uint64(16)) for k in needed[1:]]
        scores = [np.full((len(k), count), self.floor, np.float32) for k in needed]
        weights = [np.zeros((len(k), count), np.float32) for k in contexts]
        found = [np.zeros(len(k), bool) for k in needed]
        for shard in self._opened():
            for o in range(1, order + 1):
                (table, values), (backs, logs) = shard.tables[o - 1], shard.backoffs[o - 1]
                at = table.find(needed[o])
                hit = at >= 0
                scores[o][hit] = values[at[hit]]
                found[o] |= hit
                at = backs.find(contexts[o - 1])
                hit = at >= 0
                weights[o - 1][hit] = logs[at[hit]]
        for o in range(1, order + 1):
            lost = ~found[o]
            gram = needed[o][lost]
            context = np.searchsorted(contexts[o - 1], gram >> np.uint64(16))
            shorter = np.searchsorted(needed[o - 1], gram & np.uint64(_low(o - 1)))
            scores[o][lost] = weights[o - 1][context] + scores[o - 1][shorter]
        return scores[order]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy in nats per symbol by language, symbols, whether there is a letter) of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        size, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        keys = None
        if self.held():
            keys = np.zeros(0, np.uint64)
            for _, packed, _, _ in _each_group(texts):
                keys = np.union1d(keys, packed)
            scores = self._scores(keys, ORDER)
        for number, packed, piece, lettered in _each_group(texts):
            each = self._score(packed, ORDER) if keys is None else scores[np.searchsorted(keys, packed)]
            counts = np.bincount(piece, minlength=len(number))
            some = counts > 0  # of a piece that goes on, all may be spaces that were counted before
            starts = (np.cumsum(counts) - counts)[some]
            if len(starts):
                np.add.at(total, number[some], np.add.reduceat(each, starts, axis=0, dtype=np.float64))
            np.add.at(size, number, counts)
            letters[number[lettered]] = True
        return -total / np.maximum(size, 1)[:, None], size, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, best cross-entropy, rejected) of each text."""
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        h, size, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        least = h[np.arange(n), best]
        score = np.where(letters, 1.0 / np.exp(-self.sharpness * (h - least[:, None])).sum(axis=1), 0.0)
        limit = np.array([max(m + REJECT_SD * sd, m + REJECT_NATS) for m, sd in (self.usual.get(x, (np.inf, 0.0)) for x in self.languages)])
        rejected = ~letters | ((least > limit[best]) & (size >= REJECT_SYMBOLS))
        langs = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, score, np.where(letters, least, np.nan), rejected


def _discount(once, twice) -> float:
    return min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice)))


def _lists(values: np.ndarray) -> pa.Array:
    n, count = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(count)), pa.array(values.ravel(), pa.float64()))


def _dense(column, count: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, count)


def _entries(column) -> tuple[np.ndarray, ...]:
    """(row, each field) of a column of lists of structs."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return row, *(f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten())


def _order_tables(counts: DataFrame, order: int, below: DataFrame | None, discounts: np.ndarray, floor: float) -> tuple[DataFrame, DataFrame]:
    """(key, values): probabilities of an order's n-grams and back-off weights of its contexts, by language.

    counts: (i, gram, n), the language by number; below: the probabilities one order down.
    """
    count = len(discounts)
    context = F.shiftrightunsigned("gram", 16)
    seen = counts.groupBy(context.alias("context"), "i").agg(F.sum("n").alias("own"), F.count("*").alias("kinds"))
    seen = written(seen.groupBy("context").agg(F.collect_list(F.struct("i", "own", "kinds")).alias("seen")), "contexts")
    grams = counts.groupBy("gram").agg(F.collect_list(F.struct("i", "n")).alias("counts")).withColumn("c", context)
    joined = grams.join(seen, F.col("c") == F.col("context")).select("gram", "counts", "seen")
    if below is not None:
        shorter = below.select(F.col("key").alias("shorter"), F.col("values").alias("below"))
        joined = joined.join(shorter, F.col("gram").bitwiseAND(F.lit(_low(order - 1))) == F.col("shorter")).drop("shorter")

    def weigh(column) -> tuple[np.ndarray, np.ndarray]:
        row, i, own, kinds = _entries(column)
        total, weight = np.ones((len(column), count)), np.ones((len(column), count))
        total[row, i] = own
        weight[row, i] = discounts[i] * kinds / own
        return total, weight

    def probs(batches):
        for b in batches:
            total, prob = weigh(b.column(2))
            prob *= _dense(b.column(3), count) if b.num_columns > 3 else np.exp(floor)
            row, i, n = _entries(b.column(1))
            prob[row, i] += (n - discounts[i]) / total[row, i]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(prob)], names=["key", "values"])

    def weights(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(weigh(b.column(1))[1])], names=["key", "values"])

    kind = "key long, values array<double>"
    return written(map_batches(joined, probs, kind), "probabilities"), map_batches(seen.select("context", "seen"), weights, kind)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model of all 4-grams of all texts with a language. The driver sees a shard of it at a time."""
    spark = docs.sparkSession
    grams = written(count_grams(docs, lang, text), "grams")
    languages = sorted(r.lang for r in grams.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; at most those fit into a model")
    if not languages:
        return Model([], [])
    count = len(languages)
    number = (F.array_position(F.array(*(F.lit(x) for x in languages)), F.col("lang")) - 1).cast("int")
    levels = [grams.select(number.alias("i"), "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        # below the top, of the distinct symbols in front
        shorter = F.col("gram").bitwiseAND(F.lit(_low(order)))
        levels.append(written(levels[-1].groupBy("i", shorter.alias("gram")).agg(F.count("*").alias("n")), "counts"))
    levels.reverse()
    symbols = levels[0].select("gram").distinct().count()
    tables, below = [], None
    for order, counts in enumerate(levels, 1):
        rare = counts.groupBy("i").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
        discounts = np.ones(count)
        for r in rare:
            discounts[r.i] = _discount(r.once, r.twice)
        below, weights = _order_tables(counts, order, below, discounts, float(np.log(1.0 / (symbols + 1))))
        for kind, found in (("probs", below), ("weights", weights)):
            tables.append(found.select(F.lit(order).alias("order"), F.lit(kind).alias("kind"), "key", "values"))
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionAll(t)
    whole = written(whole, "model")
    shards = -(-whole.count() * count // SHARD_VALUES)
    if shards > 1:
        path = new_path(spark, "shards")
        dealt = whole.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        dealt.repartition(F.col("shard")).write.option("compression", "zstd").partitionBy("shard").parquet(path)
        whole = spark.read.parquet(path)
    made = []
    for s in range(shards):
        part = (whole.where(F.col("shard") == s) if shards > 1 else whole).select("order", "kind", "key", "values").toArrow().combine_chunks()
        orders, kinds = part.column("order").to_numpy(), np.array(part.column("kind").to_pylist(), object)
        keys = part.column("key").to_numpy().view(np.uint64)
        values = part.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, count)
        probs, weights = ([(keys[at], values[at]) for at in (np.flatnonzero((orders == o) & (kinds == k)) for o in range(1, ORDER + 1))] for k in ("probs", "weights"))
        made.append(spark.sparkContext.broadcast(Shard(probs, weights)))
    return Model.of_shards(languages, symbols, made)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, entropy and rejected, replacing columns of those names."""
    added = ("lang_pred", "score", "entropy", "rejected")
    own = [c for c in docs.columns if c not in added]
    docs = docs.select(*(F.col(f"`{c}`") for c in own))
    at = own.index(text)

    def gathered(batches):
        """Lists of batches that are worked through together."""
        most, some, size = model.held(), [], 0
        for b in batches:
            some.append(b)
            size += b.column(at).nbytes
            if size >= most:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(batches):
        for some in gathered(batches):
            langs, score, entropy, rejected = model.predict([t for b in some for t in b.column(at).to_pylist()])
            start = 0
            for b in some:
                part = slice(start, start + len(b))
                start += len(b)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs[part], pa.string()), pa.array(score[part]), pa.array(entropy[part]), pa.array(rejected[part])], names=[*own, *added])

    return map_batches(docs, run, extended(docs.schema, ("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("rejected", "boolean")))


def calibrate(model: Model, docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Learn the usual cross-entropy of each language, and the sharpness under which the texts' own languages are likeliest,
    from all distinct texts of the docs (told apart by hash and length)."""
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null")
    place = {x: i for i, x in enumerate(model.languages)}

    def run(batches):
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            h, _, letters = model.entropies(texts)
            own = np.array([place.get(x, -1) for x in names])
            use = np.flatnonzero(letters & (own >= 0))
            h, own = h[use], own[use]
            right = h[np.arange(len(use)), own] if len(use) else np.zeros(0)
            least = h.min(axis=1, initial=np.inf)
            fit = [s * (least - right) - np.log(np.exp(-s * (h - least[:, None])).sum(axis=1)) for s in SHARPNESS]
            rest = [b.column(i).take(pa.array(use)) for i in (0, 2, 3)]
            fits = pa.array(np.stack(fit, axis=1).tolist() if len(use) else [], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(right), pa.array(right <= least), fits], names=["lang", "h", "chars", "entropy", "best", "fits"])

    if not model.languages:
        return model
    rows = map_batches(known.select("lang", "text", F.xxhash64("text").alias("h"), F.length("text").alias("chars")), run, "lang string, h long, chars int, entropy double, best boolean, fits array<double>")
    # copies are left out behind the scores, so that no text is shuffled
    each = rows.groupBy("lang", "h", "chars").agg(F.first("entropy").alias("entropy"), F.first("best").alias("best"), F.first("fits").alias("fits"))
    mine = F.when(F.col("best"), F.col("entropy"))
    sums = [F.sum(F.col("fits")[i]).alias(f"fit{i}") for i in range(len(SHARPNESS))]
    found = each.groupBy("lang").agg(F.avg(mine).alias("m"), F.stddev_pop(mine).alias("sd"), *sums).collect()
    model.usual = {r.lang: (r.m, r.sd) for r in found if r.m is not None}
    if found:
        model.sharpness = max(SHARPNESS, key=lambda s: sum(r[f"fit{SHARPNESS.index(s)}"] for r in found))
    return model


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether the row isn't to be learned from: crc32 of its id as text, modulo the folds."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """The model of the documents that aren't held out."""
    learn = only(docs, "doc_id", "lang", "text").where(~held_out() & F.col("doc_id").isNotNull()).select("lang", "text")
    return calibrate(fit(learn), learn)
