"""Masked pseudo-likelihood of documents by a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NON_ALNUM, Words, batch_words, byte_values, signed
from ._work import materialise, temporary

REACH = (-2, -1, 1, 2)  # the words around a masked one
CLASS = 64  # buckets of rare words, and the fewest words of a class of the output layer
SHARED = 1 << 18  # words below the vocabulary whose counts every task gets; counts of the others are joined
_TABLE = byte_values(NON_ALNUM)
CHUNK = 1 << 14
GROWTH = 0.45
BATCH = 1 << 14
ROWS = 1 << 11  # of a softmax at a time, which fit a core's cache


@dataclass
class Vocabulary:
    """The most frequent words, most frequent first; all others fall into buckets.

    A rare word's probability is its bucket's, times its share of the bucket's words in
    all documents: ``buckets`` counts these, ``rest`` and ``rest_n`` are rare words and
    their counts. ``n`` counts the frequent words.
    """

    hashes: np.ndarray
    rest: np.ndarray
    rest_n: np.ndarray
    buckets: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]
        order = np.argsort(self.rest)
        self.rest, self.rest_n = self.rest[order], self.rest_n[order]
        size = len(self.hashes) + CLASS
        self.per_class = -(-int(np.ceil(np.sqrt(size))) // CLASS) * CLASS
        self.size = -(-size // self.per_class) * self.per_class

    def counts(self) -> np.ndarray:
        """How often each token stands in all documents; the last ones fill up a class and never do."""
        out = np.zeros(self.size)
        out[:CLASS] = self.buckets
        out[CLASS : CLASS + len(self.n)] = self.n
        return out

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """The first CLASS numbers are the buckets, then come the words."""
        out = (hashes % np.uint64(CLASS)).astype(np.int32)
        if len(self.sorted):
            place = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[place] == hashes
            out[known] = CLASS + self.order[place[known]]
        return out

    def log_shares(self, hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the words' shares of their tokens, and the places where the word's own log count is yet to be added."""
        out = np.zeros(len(tokens))
        rare = np.flatnonzero(tokens < CLASS)
        out[rare] = -np.log(np.maximum(self.buckets, 1))[tokens[rare]]
        if len(self.rest) and len(rare):
            place = np.minimum(np.searchsorted(self.rest, hashes[rare]), len(self.rest) - 1)
            known = self.rest[place] == hashes[rare]
            out[rare[known]] += np.log(self.rest_n[place[known]])
            rare = rare[~known]
        return out, rare


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in batch_words(batch.column("text"), _TABLE, 1 << 22):
                word, n = np.unique(words.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, words: int, counts: DataFrame | None = None) -> Vocabulary:
    """The most frequent words of all documents: their number of words to the power of ``GROWTH``, at least ``words``.

    Only these and the counts of at most ``SHARED`` others come to the driver. Documents
    without words, and an empty table, give a vocabulary of buckets only.
    """
    counts = count_words(docs) if counts is None else counts
    sizes = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    size = max(words, int(np.ceil(sum(n * k for n, k in sizes) ** GROWTH)))
    so_far = np.cumsum([k for _, k in sizes])
    # The count of the last word of the vocabulary, and the least one of which all words fit the driver.
    last = sizes[min(int(np.searchsorted(so_far, size)), len(sizes) - 1)][0] if sizes else 1
    fits = int(np.searchsorted(so_far, size + SHARED, "right"))
    least = sizes[fits - 1][0] if fits else last + 1
    top = counts.filter(F.col("n") >= last).orderBy(F.desc("n"), "word").limit(size).toArrow()
    hashes = top.column("word").to_numpy().view(np.uint64)
    rest = counts.filter(F.col("n").between(least, last)).toArrow() if least <= last else top.slice(0, 0)
    word, n = rest.column("word").to_numpy().view(np.uint64), rest.column("n").to_numpy()
    rare = ~np.isin(word, hashes)
    buckets = np.zeros(CLASS, np.int64)
    for r in counts.groupBy(F.pmod("word", F.lit(CLASS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        buckets[r["bucket"]] = r["n"]
    np.subtract.at(buckets, (hashes % np.uint64(CLASS)).astype(np.int64), top.column("n").to_numpy())
    return Vocabulary(hashes, word[rare], n[rare], buckets, top.column("n").to_numpy())


def contexts(first: np.ndarray, tokens: np.ndarray, edge: int) -> np.ndarray:
    """The tokens around each word, one row per place of ``REACH``; ``edge`` beyond the ends of a text.

    ``first`` is the place of each text's first word, and their number behind the last.
    """
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1][docs], first[1:][docs]
    at = np.arange(len(tokens))
    rows = []
    for k in REACH:
        near = at + k
        inside = (near >= begin) & (near < end)
        rows.append(np.where(inside, tokens[np.clip(near, 0, max(0, len(tokens) - 1))], edge))
    return np.stack(rows).astype(np.int32)


def _order(numbers: np.ndarray, size: int) -> np.ndarray:
    """A stable order of numbers below ``size``; sixteen bits are sorted by counting."""
    return np.argsort(numbers.astype(np.uint16) if size <= 1 << 16 else numbers, kind="stable")


class Network:
    """h = tanh(sum of a vector per neighbour, by place); the word's class and the word in it are softmaxes of h."""

    SHAPES = ("inputs", "bias", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, size: int, width: int, seed: int = 1, per_class: int = CLASS, counts: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        classes = size // per_class
        self.size, self.width, self.per_class = size, width, per_class
        self.inputs = rng.normal(0, 0.1, (len(REACH), size + 1, width)).astype("f4")
        self.bias = np.zeros(width, "f4")
        self.to_class = rng.normal(0, 0.1, (width, classes)).astype("f4")
        self.class_bias = np.zeros(classes, "f4")
        self.to_word = rng.normal(0, 0.1, (classes, width, per_class)).astype("f4")
        self.word_bias = np.zeros((classes, per_class), "f4")
        if counts is not None:  # the biases begin as the words' frequencies
            counts = counts.reshape(classes, per_class) + 0.1
            self.class_bias[:] = np.log(counts.sum(1) / counts.sum())
            self.word_bias[:] = np.log(counts / counts.sum(1, keepdims=True))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.SHAPES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for name in self.SHAPES:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype("f4"))
            at += old.size
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """With a last column of ones, by which products with ``_with_bias`` add the bias."""
        out, near = np.ones((around.shape[1], self.width + 1), "f4"), np.empty((ROWS, self.width), "f4")
        for at in range(0, len(out), ROWS):
            rows = slice(at, min(at + ROWS, len(out)))
            h, some = self.inputs[0].take(around[0, rows], axis=0), near[: rows.stop - at]
            h += self.bias
            for k in range(1, len(REACH)):
                h += np.take(self.inputs[k], around[k, rows], axis=0, out=some, mode="clip")
            np.tanh(h, out=out[rows, :-1])
        return out

    @staticmethod
    def _exp(x: np.ndarray) -> np.ndarray:
        """In place, up to a factor per row: weights that could overflow have their largest taken out."""
        if len(x) and x.max() > 60:
            x -= x.max(1, keepdims=True)
        return np.exp(x, out=x)

    @staticmethod
    def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return np.concatenate([weights, bias[..., None, :]], axis=-2)

    def _by_word(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An order by target, the classes and words in it, and where each class begins."""
        order = _order(target, self.size)
        cls, word = np.divmod(target[order], self.per_class)
        return order, cls, word, np.searchsorted(cls, np.arange(self.size // self.per_class + 1))

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each masked word given its neighbours; over all words they sum to 1."""
        order, cls, word, cuts = self._by_word(target)
        h, out, found = self.hidden(around[:, order]), np.empty(len(target), "f4"), np.empty(len(target), "f4")
        to_class, to_word = self._with_bias(self.to_class, self.class_bias), self._with_bias(self.to_word, self.word_bias)
        for at in range(0, len(target), ROWS):
            x = self._exp(h[at : at + ROWS] @ to_class)
            found[at : at + ROWS] = x[np.arange(len(x)), cls[at : at + ROWS]] / (x @ np.ones(x.shape[1], "f4"))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            for at in range(cuts[c], cuts[c + 1], ROWS):
                rows = slice(at, min(at + ROWS, cuts[c + 1]))
                x = self._exp(h[rows] @ to_word[c])
                found[rows] *= x[np.arange(len(x)), word[rows]] / (x @ np.ones(x.shape[1], "f4"))
        out[order] = np.log(np.maximum(found, np.float32(1e-37)))
        return out

    def _layer(self, h: np.ndarray, weights: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of a softmax's weights, with the bias as last row, and of h."""
        d = self._exp(h @ weights)
        d /= (d @ np.ones(d.shape[1], "f4"))[:, None]
        d[np.arange(len(d)), target] -= 1
        return h.T @ d, d @ weights[:-1].T

    def gradients(self, around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of log-losses."""
        order, cls, word, cuts = self._by_word(target)
        around = around[:, order]
        h = self.hidden(around)
        g = {name: np.zeros(getattr(self, name).shape, "f4") for name in self.SHAPES}
        to_class, to_word = self._with_bias(self.to_class, self.class_bias), self._with_bias(self.to_word, self.word_bias)
        dh = np.empty((len(target), self.width), "f4")
        for at in range(0, len(target), ROWS):
            mine, dh[at : at + ROWS] = self._layer(h[at : at + ROWS], to_class, cls[at : at + ROWS])
            g["to_class"] += mine[:-1]
            g["class_bias"] += mine[-1]
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            for at in range(cuts[c], cuts[c + 1], ROWS):
                rows = slice(at, min(at + ROWS, cuts[c + 1]))
                mine, more = self._layer(h[rows], to_word[c], word[rows])
                g["to_word"][c] += mine[:-1]
                g["word_bias"][c] += mine[-1]
                dh[rows] += more
        h = h[:, :-1]
        dh *= 1 - h * h
        g["bias"] = dh.sum(0)
        for k in range(len(REACH)):
            order = _order(around[k], self.size + 1)
            near = around[k][order]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            g["inputs"][k][near[first]] = np.add.reduceat(dh.take(order, axis=0), first, axis=0) if len(first) else 0
        return g


class Adam:
    """Steps along mean gradients; what is small beside its tensor's usual size, such as rounding, moves little."""

    def __init__(self, net: Network, steps: int, rate: float):
        self.net, self.steps, self.rate, self.step = net, steps, rate, 0
        self.mean = np.zeros(len(net.flat()))
        self.square = np.zeros(len(self.mean))

    def move(self, grad: np.ndarray) -> None:
        self.step += 1
        self.mean += 0.2 * (grad - self.mean)
        self.square += 0.1 * (grad * grad - self.square)
        mean, square = self.mean / (1 - 0.8**self.step), self.square / (1 - 0.9**self.step)
        flat, at = self.net.flat(), 0
        for name in self.net.SHAPES:
            part = slice(at, at + getattr(self.net, name).size)
            least = 1e-3 * np.sqrt(square[part].mean()) + 1e-12
            flat[part] -= self.rate * (1 - 0.7 * (self.step - 1) / self.steps) * mean[part] / (np.sqrt(square[part]) + least)
            at = part.stop
        self.net.load(flat)


TOKENS = "doc_id {}, a long, b long, n_tokens long, shares double, tokens binary, rare array<struct<word:long,times:int>>, block int"


def tokenise(docs: DataFrame, words: Vocabulary, steps: int) -> DataFrame:
    """Every document as tokens (little-endian 32-bit numbers), dealt to ``steps`` blocks by a hash of its text.

    ``shares`` is the sum of log shares of rare words as far as ``words`` knows them, and
    ``rare`` the others with their numbers in the document. a and b are hashes of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    pairs = pa.struct([("word", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            n, shares, kept, ends, rare_words, times = [], [], [], [np.zeros(1, np.int32)], [], []
            for _, _, found in batch_words(batch.column("text"), _TABLE, 1 << 20):
                tokens = words.tokens(found.hashes)
                logs, rare = words.log_shares(found.hashes, tokens)
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                n += found.counts().tolist()
                shares += (sums[found.first[1:]] - sums[found.first[:-1]]).tolist()
                raw = memoryview(tokens.astype("<i4").tobytes())
                kept += [raw[4 * x : 4 * y].tobytes() for x, y in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)]
                doc, word = found.docs()[rare], found.hashes[rare]
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))[: len(doc)])
                rare_words.append(signed(word[new]))
                times.append(np.diff(np.append(new, len(doc))).astype(np.int32))
                ends.append(ends[-1][-1] + np.searchsorted(doc[new], np.arange(len(found.first) - 1), "right").astype(np.int32))
            struct = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip((rare_words, times), pairs, strict=True)], fields=list(pairs))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), struct)
            columns = [*(batch.column(c) for c in ("doc_id", "a", "b")), pa.array(n, pa.int64()), pa.array(shares, pa.float64()), pa.array(kept, pa.binary()), rare, batch.column("block")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "n_tokens", "shares", "tokens", "rare", "block"])

    # Texts are known by two hashes: rows may repeat, and doc_id may be null.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), "text").alias("b"), F.pmod(F.xxhash64(F.lit("block"), "text"), F.lit(steps)).cast("int").alias("block"))
    return keyed.mapInArrow(run, TOKENS.format(docs.schema["doc_id"].dataType.simpleString()))


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a binary column, and the place of each text's first."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i4"), np.cumsum([0, *(len(x) // 4 for x in raw)])


def fit(tokens: DataFrame, words: Vocabulary, *, width: int = 24, steps: int = 16, rate: float = 0.1) -> Network:
    """Train on all documents: in each of ``steps`` steps on those of one block.

    A step is synchronous: tasks sum up gradients of the same weights, the sums meet in
    Spark in chunks, and the driver, which holds one network, moves the weights by their
    mean. So the result depends neither on how the table is laid out nor on the number of
    tasks, but for rounding (tested to 1e-4 of a mean log-likelihood). Biases begin as the
    words' frequencies. An empty table gives the untrained network.

    A network has about 120 weights per word of the vocabulary: 2 MB at 0.5 GB of text,
    0.4 GB at 100 TB, for which the driver and each task need room.
    """
    spark = tokens.sparkSession
    net = Network(words.size, width, per_class=words.per_class, counts=words.counts())
    adam = Adam(net, steps, rate)
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
    ddl = "chunk int, part int, n long, sums binary"

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        total = sum(np.frombuffer(table.column("sums")[int(k)].as_py(), "f4").astype(float) for k in order)
        n, part = int(table.column("n").to_numpy().sum()), int(table.column("part").to_numpy().min())
        return pa.table([table.column("chunk").slice(0, 1), pa.array([part], pa.int32()), pa.array([n]), pa.array([total.astype("f4").tobytes()], pa.binary())], schema=schema)

    for step in range(steps):
        shared = spark.sparkContext.broadcast((net.flat(), words.size, words.per_class))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, size, per_class = shared.value
            own = Network(size, width, per_class=per_class).load(flat)
            total, n = None, 0
            for one in batches:
                found, first = _read(one.column("tokens"))
                around = contexts(first, found, size)
                for at in range(0, len(found), BATCH):
                    part = slice(at, at + BATCH)
                    grads = own.gradients(around[:, part], found[part])
                    mine = np.concatenate([grads[name].ravel() for name in own.SHAPES])
                    total = mine.astype(float) if total is None else np.add(total, mine, out=total)
                    n += len(found[part])
            if n:
                part, total = TaskContext.get().partitionId(), total.astype("f4")
                yield pa.RecordBatch.from_pylist([{"chunk": at // CHUNK, "part": part, "n": n, "sums": total[at : at + CHUNK].tobytes()} for at in range(0, len(total), CHUNK)], schema)

        sums = tokens.filter(F.col("block") == step).select("tokens").mapInArrow(run, ddl)
        sums = sums.groupBy("chunk", F.floor(F.col("part") / 256).alias("some")).applyInArrow(add, ddl).groupBy("chunk").applyInArrow(add, ddl).collect()
        if sums:
            grad = np.zeros(len(net.flat()))
            for row in sums:
                grad[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"], "f4")
            adam.move(grad / sums[0]["n"])
        shared.destroy()
    return net


def score(tokens: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document, from its whole text.

    Every word is masked in turn and predicted from its neighbours on both sides; the log
    probabilities are summed up. A word outside the vocabulary has its share of its bucket's
    probability, by ``counts`` (a word that isn't in them counts once). Null texts and texts
    without words have no tokens, a sum of 0 and a null mean. Repeated rows are each scored;
    an empty table gives no rows; other columns are ignored.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found, first = _read(batch.column("tokens"))
            around, sums = contexts(first, found, net.size), np.zeros(len(found) + 1)
            for at in range(0, len(found), BATCH):
                sums[at + 1 : at + 1 + BATCH] = net.log_probabilities(around[:, at : at + BATCH], found[at : at + BATCH])
            sums = np.cumsum(sums)
            total = batch.column("shares").to_numpy() + sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "a", "b", "n_tokens")), pa.array(total), batch.column("rare")], ["doc_id", "a", "b", "n_tokens", "total", "rare"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    given = tokens.select("doc_id", "a", "b", "n_tokens", "shares", "tokens", "rare")
    scored = materialise(given.mapInArrow(run, f"doc_id {kind}, a long, b long, n_tokens long, total double, rare array<struct<word:long,times:int>>"), "scores", keep=True)
    some, none = scored.filter(F.size("rare") > 0), scored.filter(F.size("rare") == 0)
    each = some.select("a", "b", F.inline("rare")).groupBy("a", "b", "word").agg(F.max("times").alias("times"))
    more = each.join(counts, "word", "left").groupBy("a", "b").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(1)))).alias("more"))
    whole = none.select("doc_id", "n_tokens", "total").unionAll(some.join(more, ["a", "b"]).select("doc_id", "n_tokens", F.col("total") + F.col("more")))
    mean = F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", F.col("total").alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, *, words: int = 1024, steps: int = 16, **options) -> DataFrame:
    """Count the words of all documents, train on all of them, and score all of them: see ``score``.

    Texts are read twice, to count and to tokenise; training and scoring read the tokens.
    Very long texts are read whole. Columns other than doc_id and text are ignored.
    """
    with temporary(docs.sparkSession):
        counts = materialise(count_words(docs), "words", keep=True)
        known = vocabulary(docs, words, counts)
        tokens = materialise(tokenise(docs, known, steps), "tokens", by="block")
        return score(tokens, fit(tokens, known, steps=steps, **options), counts)
