"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

#: Units of each direction; bytes of a window that are labelled, and bytes on either side over which the states run in
#: before: a byte's label follows from these at least.
UNITS, WINDOW, CONTEXT = 6, 128, 32
#: Training: rows for each language, windows from each (at random places of the whole text), their bytes, windows a
#: step, steps, rate.
ROWS, CUTS, SPAN, BATCH, STEPS, RATE = 400, 4, 96, 64, 250, 0.03
#: Share of a text's positions, in probabilities, that its language must have: a document under it has none that was learned.
FLOOR = 0.4
#: Bytes of texts that are scored at once, and windows that step together.
CHUNK, TOGETHER = 4 << 20, 2048
OUT = "doc_id long, lang_pred string, score double"


def _soft(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step: input part x (rows, 3 n), state h. Activations are the soft sign a / (1 + |a|), for gates halved and
    raised to 0..1: a fifth of the time of tanh, in training and scoring alike."""
    a = h @ u
    zr = _soft(x[:, : 2 * n] + a[:, : 2 * n]) * np.float32(0.5) + np.float32(0.5)
    z, r = zr[:, :n], zr[:, n:]
    c = _soft(x[:, 2 * n :] + r * a[:, 2 * n :])
    return z, r, c, h + z * (c - h)


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, back: bool) -> np.ndarray:
    """States (time, rows, n) of one direction over byte codes x (time, rows)."""
    n = u.shape[0]
    out = np.empty((*x.shape, n), np.float32)
    h = np.zeros((x.shape[1], n), np.float32)
    for t in range(len(x))[:: -1 if back else 1]:
        h = out[t] = _gates(w[x[t]], h, u, n)[3]
    return out


def _back(x: np.ndarray, states: np.ndarray, grad: np.ndarray, w: np.ndarray, u: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of w and u from those of the states."""
    n = u.shape[0]
    gw, gu, carried = np.zeros_like(w), np.zeros_like(u), np.zeros_like(states[0])
    order = range(len(x))[:: -1 if back else 1]
    for i in range(len(x) - 1, -1, -1):
        t = order[i]
        h = states[order[i - 1]] if i else np.zeros_like(carried)
        z, r, c, _ = _gates(w[x[t]], h, u, n)
        g = grad[t] + carried
        dc = g * z * (1 - np.abs(c)) ** 2
        inner = h @ u[:, 2 * n :]
        da = np.concatenate([g * (c - h) * (1 - np.abs(2 * z - 1)) ** 2 / 2, dc * inner * (1 - np.abs(2 * r - 1)) ** 2 / 2, dc], 1)
        du = da.copy()
        du[:, 2 * n :] *= r
        np.add.at(gw, x[t], da)
        gu += h.T @ du
        carried = g * (1 - z) + du @ u.T
    return gw, gu


def _probabilities(states: np.ndarray, v: np.ndarray, b: np.ndarray) -> np.ndarray:
    e = states @ v + b
    e -= e.max(-1, keepdims=True)
    np.exp(e, e)
    return e / e.sum(-1, keepdims=True)


def train(texts: list[tuple[bytes, str]], seed: int = 7) -> dict:
    """(window of SPAN bytes, language) to a model: both directions' weights, the output layer, the languages. Cross-entropy at
    every position of windows, Adam."""
    langs = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(seed)
    x, y = [], []
    for raw, lang in texts:
        x.append(np.frombuffer(raw[:SPAN].ljust(SPAN, b"\0"), np.uint8))
        y.append(langs.index(lang))
    x, y = np.array(x), np.array(y)
    n, k = UNITS, max(1, len(langs))
    p = {"w0": rng.normal(0, 0.3, (256, 3 * n)), "w1": rng.normal(0, 0.3, (256, 3 * n)), "u0": rng.normal(0, 0.3, (n, 3 * n)), "u1": rng.normal(0, 0.3, (n, 3 * n)), "v": rng.normal(0, 0.3, (2 * n, k)), "b": np.zeros(k)}
    p = {name: value.astype(np.float32) for name, value in p.items()}
    m, s = ({name: np.zeros_like(value) for name, value in p.items()} for _ in range(2))
    by = [np.flatnonzero(y == i) for i in range(len(langs))]
    for step in range(1, STEPS + 1 if len(langs) > 1 else 1):
        rows = np.concatenate([rng.choice(i, -(-BATCH // k)) for i in by])
        xt, real = x[rows].T, (x[rows].T > 0)[..., None]
        states = [_run(xt, p[f"w{i}"], p[f"u{i}"], bool(i)) for i in (0, 1)]
        both = np.concatenate(states, -1)
        g = _probabilities(both, p["v"], p["b"])
        g[:, np.arange(len(rows)), y[rows]] -= 1
        g = (g * real / max(1, real.sum())).astype(np.float32)
        gb = g @ p["v"].T
        grads = {"v": np.einsum("trn,trk->nk", both, g), "b": g.sum((0, 1))}
        for i in (0, 1):
            grads[f"w{i}"], grads[f"u{i}"] = _back(xt, states[i], gb[..., n * i : n * i + n], p[f"w{i}"], p[f"u{i}"], bool(i))
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for name, grad in grads.items():
            m[name] = 0.9 * m[name] + 0.1 * grad
            s[name] = 0.999 * s[name] + 0.001 * grad * grad
            p[name] = (p[name] - rate * m[name] / (np.sqrt(s[name]) + 1e-8)).astype(np.float32)
    return p | {"langs": langs}


def _votes(x: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, back: bool, logits: np.ndarray) -> None:
    """Adds one direction's part of the output layer to logits (time, languages, rows) for byte codes x (CONTEXT + time +
    CONTEXT, rows), of which 256 is no byte: there the state stays zero. As _gates and _run, but with the rows last, so
    that each gate is contiguous; w and u are (3 n, .) here."""
    n, last = u.shape[1], len(logits) + CONTEXT
    w, u = np.ascontiguousarray(w), np.ascontiguousarray(u)
    h = np.zeros((n, x.shape[1]), np.float32)
    g, a, d = (np.empty((3 * n, x.shape[1]), np.float32) for _ in range(3))
    for t in range(len(x) - 1, CONTEXT - 1, -1) if back else range(last):
        there = x[t] < 256
        if not there.any():
            continue
        np.take(w, x[t], axis=1, out=g, mode="clip")
        np.dot(u, h, out=a)
        zr, c, e = g[: 2 * n], g[2 * n :], d[: 2 * n]
        zr += a[: 2 * n]
        np.abs(zr, e)
        e += np.float32(1)
        zr /= e
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        a[2 * n :] *= zr[n:]
        c += a[2 * n :]
        np.abs(c, e[:n])
        e[:n] += np.float32(1)
        c /= e[:n]
        c -= h
        c *= zr[:n]
        h += c
        if not there.all():
            h *= there
        if CONTEXT <= t < last:
            logits[t - CONTEXT] += v @ h


def pooled(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probabilities (texts, languages): the mean over all positions of each whole text. Texts are cut into windows that
    are run beside each other, each with CONTEXT bytes of its text before and after it."""
    k, n = len(model["langs"]), UNITS
    total = np.zeros((len(texts), k), np.float64)
    lengths = np.array([len(t) for t in texts], np.int64)
    windows = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), windows)
    if not len(owner) or not k:
        return total
    number = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    left = lengths[owner] - WINDOW * number
    # each text is followed by CONTEXT places without a byte, and so are windows at a text's end
    data = np.concatenate([np.full(CONTEXT, 256, np.int16), *(y for t in texts for y in (np.frombuffer(t, np.uint8).astype(np.int16), np.full(CONTEXT, 256, np.int16))), np.full(WINDOW + CONTEXT, 256, np.int16)])
    begins = (np.cumsum(lengths + CONTEXT) - lengths)[owner] + WINDOW * number - CONTEXT
    w = [np.ascontiguousarray(model[f"w{i}"].T) for i in (0, 1)]
    steps = np.arange(WINDOW + 2 * CONTEXT)[:, None]
    for at in range(0, len(owner), TOGETHER):
        first, rest = begins[at : at + TOGETHER], left[at : at + TOGETHER]
        x = data[first + steps].astype(np.intp)
        x[steps >= rest + CONTEXT] = 256
        logits = np.repeat(np.repeat(model["b"][None, :, None], WINDOW, 0), x.shape[1], 2)
        for i in (0, 1):
            _votes(x, w[i], model[f"u{i}"].T, np.ascontiguousarray(model["v"][n * i : n * i + n].T), bool(i), logits)
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, logits)
        logits /= logits.sum(1, keepdims=True)
        logits *= (np.arange(WINDOW)[:, None] < rest)[:, None]
        np.add.at(total, owner[at : at + TOGETHER], logits.sum(0).T)
    return total / np.maximum(1, lengths)[:, None]


def _score(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs = model["langs"]
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(ids):
            part, size = [], 0
            while at + len(part) < len(ids) and (not part or size < CHUNK):
                t = texts[at + len(part)].as_py()
                part.append(t.encode("utf-8", "surrogatepass") if t and langs and any(map(str.isalpha, t)) else None)
                size += len(part[-1] or b"")
            p = pooled(model, [t or b"" for t in part])
            best = p.argmax(1) if langs else [0] * len(part)
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array([langs[b] if t is not None else "und" for t, b in zip(part, best)], pa.string()), pa.array([float(min(1, row[b])) if t is not None else 0.0 for t, b, row in zip(part, best, p)], pa.float64())], ["doc_id", "lang_pred", "score"])
            at += len(part)


def learn(docs: DataFrame, rows: int = ROWS) -> dict:
    """A model from the text and lang of rows whose crc32(doc_id) mod 4 is not 2: about `rows` of each language, drawn by a
    hash of doc_id and text, and of each CUTS windows of SPAN bytes at places of the whole text drawn by the same hash. That
    bounds what the driver gets, however long the texts are."""
    known = docs.where("text is not null and lang is not null and crc32(coalesce(cast(doc_id as string), '')) % 4 <> 2").select("doc_id", "lang", "text")
    rates = {r.lang: rows / r["count"] for r in known.groupBy("lang").count().collect()}
    if not rates:
        return train([])
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    drawn = known.where((F.xxhash64("doc_id", "text") % 2**20 + 2**20) / 2**21 < rate).select("lang", F.xxhash64("doc_id", "text").alias("h"), F.encode("text", "UTF-8").alias("b"))
    cuts = drawn.select("lang", "h", "b", F.explode(F.sequence(F.lit(1), F.lit(CUTS))).alias("i"))
    windows = cuts.selectExpr("lang", f"substring(b, cast(1 + pmod(xxhash64(h, i), greatest(1, octet_length(b) - {SPAN - 1})) as int), {SPAN}) as w").where("octet_length(w) > 0")
    return train(sorted((bytes(r.w), r.lang) for r in windows.collect()))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, lang_pred, score), a row for each input row. The network labels every byte of
    the whole text and the document's probabilities are their mean. `und` with score 0: null texts, texts without a
    letter, and all texts if no language was learned. Null doc_ids are kept; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _score(model, batches), OUT)


def identified(docs: DataFrame, model: dict, floor: float = FLOOR) -> DataFrame:
    """docs whose language the network tells, with all their columns: those that are `und` go, and those of which no
    learned language has `floor` of the positions' probability. If no language was learned, all are `und` and go."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(batch.schema.get_field_index("text"))], ["doc_id", "text"])
            said = [x for b in _score(model, iter([pair])) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield batch.filter(pa.array([lang != "und" and score >= floor for lang, score in said], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out")
    return identify(docs, learn(docs)).select("doc_id", held, "lang_pred", "score")
