"""Language identification: a bidirectional gated recurrent network over the bytes of a text.

A text is read as UTF-8 bytes in chunks of CHUNK; in each, one recurrent layer runs forward and one backward, and from both
states every position (every byte of the whole text) gets a probability for each language. A document's probabilities are
the means over its positions; the largest names the language and is the score.

The network is trained in numpy by backpropagation through time with Adam on a bounded sample: for each language the
SAMPLE_TEXTS different texts with the smallest hashes, of each SAMPLE_CHUNKS chunks spread evenly over the text, so that a
frequent language or a group of copies weighs no more than others. One task trains; the sample and the weights are
written, so a lost executor repeats only this step. Only prediction reads all rows, each text whole.

Fixed seeds make runs equal. Defined results: a null text, or one without a letter (Unicode letters), is `und` with score
0, as is everything if no labelled text is there to learn from. Of equal probabilities the language first by name wins. A
null id is neither held out nor learnt from. Repeated rows get equal results. Texts of any length are read whole in
bounded memory beside the text. An empty table gives an empty result, extra columns are left out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import checked_broadcast, durable, query, small_batches

CHUNK = 128
HIDDEN = 8
#: Bounds of the training sample: texts of a language and chunks of a text.
SAMPLE_TEXTS = 400
SAMPLE_CHUNKS = 6
#: Parts of a language in which the smallest hashes are looked for first.
SLOTS = 64
EPOCHS = 6
BATCH = 128
RATE = 0.02
#: Chunks that run side by side.
SIDE = 1024
NO_LANGUAGE = "und"


class Network:
    """`inputs` (2, 3, 256, H): what a byte adds to each gate, by direction; `states` (2, 3, H, H): what the state adds;
    `out` (2, H, C) and `bias` (C): languages from the states of both directions."""

    NAMES = ("inputs", "states", "out", "bias")

    def __init__(self, inputs: np.ndarray, states: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.inputs, self.states, self.out, self.bias = inputs, states, out, bias

    @classmethod
    def fresh(cls, hidden: int, classes: int, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)

        def draw(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(draw(0.3, 2, 3, 256, hidden), draw(hidden ** -0.5, 2, 3, hidden, hidden), draw(hidden ** -0.5, 2, hidden, classes),
                   np.zeros(classes, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def states_of(self, chunks: np.ndarray, lengths: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, 2, chunks, H) at every position; chunks are padded at their ends, where states mean nothing.

        With a `trace` list each step leaves what the way back needs."""
        steps, hidden = int(lengths.max()), self.bias.dtype.type
        count, width = len(chunks), self.states.shape[-1]
        gates = np.arange(6).reshape(2, 3, 1) * 256
        table = self.inputs.reshape(-1, width)
        uneven = bool((lengths < steps).any())
        state = np.zeros((2, 1, count, width), hidden)
        held = np.empty((steps, 2, count, width), hidden)
        half = hidden(0.5)
        for t in range(steps):
            back = steps - 1 - t
            where = gates + np.stack([chunks[:, t], chunks[:, back]]).astype(np.int64)[:, None]
            x = table.take(where, axis=0)
            moved = np.matmul(state, self.states)
            both = x[:, :2]
            both += moved[:, :2]
            both *= half
            np.tanh(both, out=both)
            both *= half
            both += half  # update and reset gates
            fresh = moved[:, 2] * both[:, 1]
            fresh += x[:, 2]
            np.tanh(fresh, out=fresh)
            if trace is not None:
                trace.append((where, state[:, 0].copy(), both.copy(), moved[:, 2].copy(), fresh.copy()))
            fresh -= state[:, 0]
            fresh *= both[:, 0]
            state[:, 0] += fresh
            if uneven:
                state[1, 0] *= (back < lengths)[:, None]  # the way back starts at a chunk's last byte
            held[t, 0], held[back, 1] = state[0, 0], state[1, 0]
        return held

    def probabilities(self, held: np.ndarray) -> np.ndarray:
        """(steps, chunks, C): languages of every position."""
        made = held[:, 0] @ self.out[0]
        made += held[:, 1] @ self.out[1]
        made += self.bias
        made -= made.max(-1, keepdims=True)
        np.exp(made, out=made)
        made /= made.sum(-1, keepdims=True)
        return made

    def gradients(self, chunks: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, by backpropagation through time."""
        trace: list = []
        held = self.states_of(chunks, lengths, trace)
        made = self.probabilities(held)
        steps, count, classes = made.shape
        mask = np.arange(steps)[:, None] < lengths
        total = mask.sum()
        loss = -np.log(np.maximum(np.take_along_axis(made, labels[None, :, None], 2)[..., 0], 1e-30))[mask].sum() / total
        up = made
        up[:, np.arange(count), labels] -= 1
        up *= (mask / total).astype(up.dtype)[..., None]
        flat = up.reshape(-1, classes)
        d_out = np.stack([held[:, d].reshape(-1, held.shape[-1]).T @ flat for d in (0, 1)])
        d_held = np.stack([up @ self.out[d].T for d in (0, 1)], 1)
        d_states, d_state = np.zeros_like(self.states), np.zeros_like(held[0])
        seen, pushed = [], []
        for t in reversed(range(steps)):
            where, before, both, recalled, fresh = trace[t]
            back = steps - 1 - t
            d = d_state
            d[0] += d_held[t, 0]
            d[1] += d_held[back, 1]
            d[1] *= (back < lengths)[:, None]
            update, reset = both[:, 0], both[:, 1]
            d_fresh = d * update * (1 - fresh * fresh)
            d_gates = np.stack([d * (fresh - before) * update * (1 - update), d_fresh * recalled * reset * (1 - reset), d_fresh], 1)
            by_state = d_gates.copy()
            by_state[:, 2] *= reset
            d_states += before[:, None].swapaxes(-1, -2) @ by_state
            d_state = d * (1 - update) + (by_state @ self.states.swapaxes(-1, -2)).sum(1)
            seen.append(where)
            pushed.append(d_gates)
        at, rows = np.stack(seen).ravel(), np.stack(pushed).reshape(-1, held.shape[-1])
        order = np.argsort(at, kind="stable")
        at, rows = at[order], rows[order]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        d_inputs = np.zeros_like(self.inputs)
        d_inputs.reshape(-1, held.shape[-1])[at[begins]] = np.add.reduceat(rows, begins, axis=0)
        return float(loss), [d_inputs, d_states, d_out, flat.sum(0)]


def train(chunks: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: int, hidden: int = HIDDEN, epochs: int = EPOCHS,
          seed: int = 0) -> Network:
    """Adam over shuffled batches, with gradients cut to a norm of 1 and a rate that falls to zero."""
    net, rng = Network.fresh(hidden, classes, seed), np.random.default_rng(seed + 1)
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    batches = max(1, len(chunks) // BATCH)
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(chunks)), batches):
            step += 1
            _, grads = net.gradients(chunks[some], lengths[some], labels[some])
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
            rate = RATE * (1 - (step - 1) / steps)
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                g *= min(1.0, 1 / max(norm, 1e-12))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def chunked(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks padded with zero bytes, their lengths, number of the text) of whole texts."""
    joined = b"".join(t + bytes(-len(t) % CHUNK) for t in texts)
    counts = np.array([-(-len(t) // CHUNK) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    lengths = np.full(len(of), CHUNK, np.int64)
    some = counts > 0
    lengths[np.cumsum(counts)[some] - 1] = np.array([len(t) for t in texts], np.int64)[some] - (counts[some] - 1) * CHUNK
    return np.frombuffer(joined, np.uint8).reshape(-1, CHUNK), lengths, of


def document_probabilities(net: Network, texts: Sequence[bytes]) -> np.ndarray:
    """(texts, C): means over all positions; zero for an empty text."""
    chunks, lengths, of = chunked(texts)
    sums = np.zeros((len(chunks), len(net.bias)))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), SIDE):
        some = order[at:at + SIDE]
        made = net.probabilities(net.states_of(chunks[some], lengths[some]))
        if lengths[some[-1]] < len(made):
            made *= (np.arange(len(made))[:, None] < lengths[some])[..., None]
        sums[some] = made.sum(0)
    pooled = np.zeros((len(texts), len(net.bias)))
    np.add.at(pooled, of, sums)
    return pooled / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def sample_chunks(texts: pd.Series) -> pd.Series:
    """At most SAMPLE_CHUNKS chunks of each text, spread evenly."""
    out = []
    for text in texts:
        raw = (text or "").encode()
        count = -(-len(raw) // CHUNK)
        picked = range(count) if count <= SAMPLE_CHUNKS else [i * (count - 1) // (SAMPLE_CHUNKS - 1) for i in range(SAMPLE_CHUNKS)]
        out.append([raw[i * CHUNK:(i + 1) * CHUNK] for i in picked])
    return pd.Series(out)


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, chunk) of the bounded sample of `docs` (lang, text)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    picked = rows.select("lang", "h").distinct().withColumn("slot", F.pmod("h", F.lit(SLOTS)))
    for keys in (["lang", "slot"], ["lang"]):  # a frequent language is cut down in slots before it meets in one task
        order = Window.partitionBy(*keys).orderBy("h")
        picked = picked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_TEXTS).drop("place")
    picked = durable(picked.drop("slot"))
    chosen = small_batches(rows).join(checked_broadcast(picked, picked.count()), ["lang", "h"], "left_semi")
    found = chosen.withColumn("chunks", sample_chunks("text")).groupBy("lang", "h").agg(F.first("chunks").alias("chunks"))
    return found.select("lang", F.explode("chunks").alias("chunk"))


_MODEL = "langs array<string>, hidden int, weights binary"


def _train_task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = [p for p in parts if len(p)]
    if not found:
        return
    sample = pd.concat(found, ignore_index=True).sort_values(["lang", "chunk"], kind="stable")
    langs = sorted(set(sample["lang"]))
    chunks, lengths, _ = chunked(list(sample["chunk"]))
    labels = sample["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    net = train(chunks, lengths, labels, len(langs))
    yield pd.DataFrame({"langs": [langs], "hidden": [HIDDEN], "weights": [b"".join(p.astype("<f4").tobytes() for p in net.parts())]})


def fit(docs: DataFrame) -> DataFrame:
    """One row with the trained network; none if `docs` (lang, text) has nothing to learn from."""
    sample = durable(training_sample(docs))
    return durable(sample.coalesce(1).mapInPandas(_train_task, _MODEL))


def network(langs: Sequence[str], hidden: int, weights: bytes) -> Network:
    flat, parts = np.frombuffer(weights, "<f4"), []
    for shape in ((2, 3, 256, hidden), (2, 3, hidden, hidden), (2, hidden, len(langs)), (len(langs),)):
        size = int(np.prod(shape))
        parts.append(flat[:size].reshape(shape).copy())
        flat = flat[size:]
    return Network(*parts)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _predict(langs: list[str], hidden: int, weights: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = network(langs, hidden, weights) if langs else None
        for batch in batches:
            texts = [t.encode() if net and has_letter(t) else b"" for t in batch["text"]]
            preds, scores = np.full(len(texts), NO_LANGUAGE, object), np.zeros(len(texts))
            if net and any(texts):
                pooled = document_probabilities(net, texts)
                some = np.array([bool(t) for t in texts])
                preds[some] = np.array(langs, object)[pooled[some].argmax(1)]
                scores[some] = np.minimum(pooled[some].max(1), 1.0)
            yield batch.drop(columns="text").assign(lang_pred=preds, score=scores)
    return run


def predict(docs: DataFrame, model: DataFrame) -> DataFrame:
    """`docs` (any narrow columns and text) with lang_pred and score instead of the text."""
    found = model.first()  # one row of a few kilobytes
    langs, hidden, weights = (list(found.langs), found.hidden, bytes(found.weights)) if found else ([], 0, b"")
    kept = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return small_batches(docs).mapInPandas(_predict(langs, hidden, weights), kept)


@query("op13_language")
def _op13(table):
    docs = table("documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out).select("lang", "text"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
