"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import slices, struct_field, utf8

WINDOW = 128  # bytes that are read in one run of the network
LANES = 512  # windows that are read side by side
NONE = "und"


def _softsign(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.abs(x, out=out)
    out += 1
    np.divide(x, out, out=out)
    return out


@dataclass
class Network:
    """Weights of both directions: input rows per byte, recurrent matrix, and the output layer."""

    langs: list[str]
    inputs: list[np.ndarray]  # two of 256 x 3H: reset, update, candidate
    recur: list[np.ndarray]  # two of H x 3H
    heads: list[np.ndarray]  # two of H x C
    bias: np.ndarray  # C
    none_from: float = 1.0  # texts whose probability of ``NONE`` is less may be of some language

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recur, *self.heads, self.bias]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        small = lambda *shape: rng.normal(0, 0.3, shape).astype("f4")
        return cls(langs, [small(256, 3 * hidden) for _ in "fb"], [small(hidden, 3 * hidden) for _ in "fb"], [small(hidden, len(langs)) for _ in "fb"], np.zeros(len(langs), "f4"))

    def logits(self, text: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Scores of every position. text: bytes, T x B; result T x B x C. trace: gets what training needs."""
        T, B = text.shape
        H = self.recur[0].shape[0]
        total = np.empty((T, B, len(self.langs)), "f4")
        total[:] = self.bias
        pre, act = np.empty((B, 3 * H), "f4"), np.empty((B, 3 * H), "f4")
        for way, order in ((0, range(T)), (1, range(T - 1, -1, -1))):
            state = np.zeros((B, H), "f4")
            steps = []
            for t in order:
                np.matmul(state, self.recur[way], out=pre)
                row = self.inputs[way].take(text[t], axis=0)
                gates = pre[:, : 2 * H] + row[:, : 2 * H]
                _softsign(gates, act[:, : 2 * H])
                gates = act[:, : 2 * H] * np.float32(0.5) + np.float32(0.5)
                inner = pre[:, 2 * H :] * gates[:, :H] + row[:, 2 * H :]
                candidate = np.empty((B, H), "f4")
                _softsign(inner, candidate)
                new = state + gates[:, H:] * (candidate - state)
                if trace is not None:
                    steps.append((t, state, gates, pre[:, 2 * H :].copy(), candidate, new))
                state = new
                total[t] += state @ self.heads[way]
            if trace is not None:
                trace.append(steps)
        return total


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def gradients(net: Network, text: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions of ``mask`` and its gradients, by backpropagation through time."""
    trace: list = []
    p = _softmax(net.logits(text, trace))
    T, B = text.shape
    H = net.recur[0].shape[0]
    lanes = np.arange(B)
    scale = mask.astype("f4") / max(1, mask.sum())
    loss = -float((np.log(np.maximum(p[:, lanes, label], 1e-9)) * scale).sum())
    d = p
    d[:, lanes, label] -= 1
    d *= scale[..., None]
    grads = [np.zeros_like(x) for x in net.parameters()]
    grads[6] += d.sum((0, 1))
    for way in (0, 1):
        d_pre_in = np.empty((T, B, 3 * H), "f4")
        d_pre_re = np.empty((T, B, 3 * H), "f4")
        states = np.empty((T, B, H), "f4")
        d_state = np.zeros((B, H), "f4")
        for t, before, gates, recurrent, candidate, after in reversed(trace[way]):
            grads[4 + way] += after.T @ d[t]
            d_state = d_state + d[t] @ net.heads[way].T
            reset, update = gates[:, :H], gates[:, H:]
            d_candidate = d_state * update * (1 - np.abs(candidate)) ** 2
            d_update = d_state * (candidate - before) * 0.5 * (1 - np.abs(2 * update - 1)) ** 2
            d_reset = d_candidate * recurrent * 0.5 * (1 - np.abs(2 * reset - 1)) ** 2
            d_pre_in[t] = np.concatenate([d_reset, d_update, d_candidate], 1)
            d_pre_re[t] = np.concatenate([d_reset, d_update, d_candidate * reset], 1)
            states[t] = before
            d_state = d_state * (1 - update) + d_pre_re[t] @ net.recur[way].T
        flat = d_pre_in.reshape(-1, 3 * H)
        order = np.argsort(text.ravel(), kind="stable")
        seen, first = np.unique(text.ravel()[order], return_index=True)
        grads[way][seen] += np.add.reduceat(flat[order], first, axis=0)
        grads[2 + way] += states.reshape(-1, H).T @ d_pre_re.reshape(-1, 3 * H)
    return loss, grads


def train(texts: list[bytes], labels: list[str], *, hidden: int = 8, epochs: int = 4, least_steps: int = 225, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit a network by Adam on windows of the texts; every position of a window carries its text's label.

    Few windows are read in smaller batches, of 32 at least, and more often: a network
    needs some ``least_steps`` steps to leave the most frequent language.
    """
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = Network.fresh(langs, hidden, rng)
    windows, label, length = [], [], []
    for text, lang in zip(texts, labels, strict=True):
        for at in range(0, len(text), WINDOW):
            piece = text[at : at + WINDOW]
            if at and len(piece) < WINDOW // 2:
                continue
            windows.append(np.frombuffer(piece.ljust(WINDOW, b" "), np.uint8))
            label.append(langs.index(lang))
            length.append(len(piece))
    if not windows:
        return net
    data, label, length = np.stack(windows), np.array(label), np.array(length)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in net.parameters()]
    batch = min(batch, max(32, len(data) // 50))
    per_epoch = -(-len(data) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(data), batch):
            pick = order[at : at + batch]
            mask = np.arange(WINDOW)[:, None] < length[pick][None, :]
            _, grads = gradients(net, np.ascontiguousarray(data[pick].T), label[pick], mask)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            now = rate * (1 - (step - 1) / steps) + 1e-4
            for weight, grad, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                grad = grad * min(1.0, 1.0 / max(norm, 1e-9))
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                weight -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """The trained network laid out for reading: features by windows, in buffers that are used again."""

    def __init__(self, net: Network):
        H = net.recur[0].shape[0]
        self.H, self.C = H, len(net.langs)
        half = np.ones(3 * H, "f4")
        half[2 * H :] = 0.5  # of the reset gate, (1 + softsign) / 2
        self.recur = [np.ascontiguousarray((u * half).T) for u in net.recur]
        self.inputs = [np.ascontiguousarray(x.T) for x in net.inputs]
        self.heads = [np.ascontiguousarray(v.T) for v in net.heads]
        self.bias = net.bias[:, None]

    def probabilities(self, text: np.ndarray) -> np.ndarray:
        """T x C x B from bytes, T x B: the same as softmax over ``Network.logits``."""
        T, B = text.shape
        H = self.H
        total = np.empty((T, self.C, B), "f4")
        total[:] = self.bias
        pre, row, act = (np.empty((3 * H, B), "f4") for _ in range(3))
        state, head = np.empty((H, B), "f4"), np.empty((self.C, B), "f4")
        for way, order in ((0, range(T)), (1, range(T - 1, -1, -1))):
            state[:] = 0
            for t in order:
                np.matmul(self.recur[way], state, out=pre)
                np.take(self.inputs[way], text[t], axis=1, out=row, mode="clip")
                gates = act[: 2 * H]
                pre[: 2 * H] += row[: 2 * H]
                _softsign(pre[: 2 * H], gates)
                gates += 1
                inner = pre[2 * H :]
                inner *= gates[:H]
                inner += row[2 * H :]
                candidate = act[2 * H :]
                _softsign(inner, candidate)
                candidate -= state
                candidate *= gates[H:]
                candidate *= np.float32(0.5)
                state += candidate
                np.matmul(self.heads[way], state, out=head)
                total[t] += head
        np.clip(total, -30, 30, out=total)
        np.exp(total, out=total)
        total /= total.sum(1, keepdims=True)
        return total


def predict(net: Network | Reader, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of all positions of each text. Every byte is labelled exactly once."""
    reader = net if isinstance(net, Reader) else Reader(net)
    sizes = np.diff(offsets)
    pooled = np.zeros((len(sizes), reader.C))
    # Windows cover a text without gaps; the last one is moved back to end with the text,
    # and positions that the window before it has labelled don't count again.
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    whole = nth * WINDOW
    begin = np.maximum(0, np.minimum(whole, sizes[doc] - WINDOW))
    spaced = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
    steps = np.arange(WINDOW)[:, None]
    for at in range(0, len(doc), LANES):
        part = slice(at, at + LANES)
        inside = begin[part][None, :] + steps
        size = sizes[doc[part]][None, :]
        index = offsets[doc[part]][None, :] + np.minimum(inside, size)
        text = np.where(inside < size, spaced[index], np.uint8(32))
        p = reader.probabilities(text)
        p *= ((inside >= whole[part][None, :]) & (inside < size))[:, None, :]
        np.add.at(pooled, doc[part], p.sum(0).T)
    return pooled / np.maximum(sizes, 1)[:, None]


def scrambled(texts: list[str], n: int, seed: int = 7) -> list[str]:
    """``n`` texts of no language, from characters of the given ones drawn evenly: in place of the letters of a text, or of all of it."""
    rng = np.random.default_rng(seed)
    seen = sorted(set("".join(texts)))
    dense, letters = [c for c in seen if not c.isspace()], [c for c in seen if c.isalpha()]
    if not letters:
        return []
    small, out = [c for c in letters if not c.isupper()] or letters, []
    for k in range(n):
        text = texts[int(rng.integers(len(texts)))]
        drawn = rng.choice([dense, letters, small][k % 3], len(text))
        out.append("".join(b if k % 3 == 0 or a.isalpha() else a for a, b in zip(text, drawn, strict=True)))
    return out


def fit(labelled: DataFrame, *, per_language: int = 1200, most_languages: int = 200, excerpt: int = 384, none: bool = False, **options) -> Network:
    """Train on at most ``per_language`` excerpts (characters, somewhere in the text) of each language.

    ``labelled`` has doc_id, text and lang. Only the ``most_languages`` values of lang with
    the most texts (ties by code point) are learned. The sample is the texts with the smallest
    hash of their ids, so reruns agree; it is the only thing that comes to the driver.
    Null langs and null or empty texts teach nothing; without any text, nothing is learned.
    Repeated rows have one hash and are taken or left alike, up to the bound.

    With ``none`` the network also learns ``NONE``, from as many ``scrambled`` excerpts as a
    language has on average, and ``none_from`` is the least probability of it at which a
    text is of no language: no language is as likely as all of them together, and no more
    than a thousandth of the excerpts reach it.
    """
    spread = F.xxhash64(F.lit("lang-sample"), "doc_id")
    place = F.pmod(F.shiftrightunsigned(spread, 8), F.greatest(F.lit(1), F.length("text") - excerpt)).cast("int") + 1
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    rows = rows.select("lang", spread.alias("spread"), F.substring(F.col("text"), place, F.lit(excerpt)).alias("part"))
    # Hashes are even: a share of them that holds per_language texts, and some to spare, is known from counts.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return train([], [], **options)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.25 * per_language + 100) / n))))
    near = rows.filter(F.pmod("spread", F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40)).collect()  # null share: not learned
    chosen: dict[str, list] = {}
    for lang, spread, part in sorted((r["lang"], r["spread"] % (1 << 40), r["part"]) for r in near):
        if len(chosen.setdefault(lang, [])) < per_language:
            chosen[lang].append(part)
    texts, langs = [part for parts in chosen.values() for part in parts], [lang for lang, parts in chosen.items() for _ in parts]
    extra = scrambled(texts, max(1, len(texts) // len(chosen))) if none and texts else []
    net = train([text.encode() for text in texts + extra], langs + [NONE] * len(extra), **options)
    if extra:
        p = predict(net, *utf8(pa.array(texts)))[:, net.langs.index(NONE)]
        net.none_from = max(0.5, float(np.nextafter(np.quantile(p, 0.999, method="higher"), 1)))
    return net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """Row (the columns of ``docs``), lang_pred and score of every document, from its whole text.

    The network labels each byte position, reading windows of 128 bytes from a fresh state; a document's probabilities are the means over
    its positions, and score is that of the language predicted. Texts that are null or
    have no letter are ``und`` with score 0, as is all if no language was learned.
    Repeated rows are each scored. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        reader = Reader(net)
        for batch in batches:
            column = struct_field(batch.column("row"), "text")
            data, offsets = utf8(column)
            best, scores = [], []
            for a, b in slices(offsets):
                p = predict(reader, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if net.langs else np.zeros((b - a, 1))
                lettered = [t is not None and any(map(str.isalpha, t)) for t in column.slice(a, b - a).to_pylist()]
                top = p.argmax(1)
                best += [net.langs[k] if ok and net.langs else NONE for k, ok in zip(top, lettered, strict=True)]
                scores += [float(x) if ok else 0.0 for x, ok in zip(p[np.arange(b - a), top], lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.struct("*").alias("row")).mapInArrow(score, T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out_fold(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string")) % mod


def languages(docs: DataFrame, *, mod: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Learn from labelled documents outside the held-out fold and predict every document.

    doc_id, held_out, lang_pred and score, as in ``identify``. A null doc_id is not held out
    and not learned from; null langs and empty texts teach nothing. Repeated rows are each
    predicted; very long texts are read whole, in windows of 128 bytes in each of which the
    network's state begins anew; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    fold = held_out_fold(F.col("doc_id"), mod)
    net = fit(docs.filter(fold != held_out).select("doc_id", "text", "lang"), **options)
    found = identify(docs.select("doc_id", "text"), net).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, least_score: float = 0.0, **options) -> DataFrame:
    """The documents in which some learned language is recognised.

    Those without letters go (null and empty texts among them), those that are surely of no
    language, as the network knows it from scrambled texts (``none_from`` of ``fit``; in texts
    of less than two windows a number or an address weighs too much, so they stay), and those in which nothing reaches ``least_score``. By default there is no such threshold:
    scores of short clean texts and of random letters overlap, so any threshold would lose
    clean texts. Columns stay as they are, whatever their names; repeated rows stay or go
    alike; an empty table gives no rows, and without any lang nothing is recognised.
    """
    net = fit(docs.select("doc_id", "text", "lang"), none=True, **options)
    found = identify(docs, net)
    enough = F.octet_length("row.text") >= 2 * WINDOW
    surely_none = (F.col("lang_pred") == NONE) & ((F.col("score") == 0) | (enough & (F.col("score") >= net.none_from)))
    return found.filter(~surely_none & (F.col("score") >= least_score)).select("row.*")
