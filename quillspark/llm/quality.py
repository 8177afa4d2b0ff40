"""Quality classifier: a sparse rule ensemble over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, table

#: Labelled rows to fit on, about; the driver gets no more.
ROWS = 20_000
#: Trees, their depth, the rows a leaf needs, cuts of a statistic that are tried.
TREES, DEPTH, LEAF, CUTS = 24, 3, 20, 32
#: Lasso penalties that are tried, and steps of the fit.
PENALTIES, STEPS = (0.0003, 0.001, 0.003), 300
#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Bytes of texts that are measured at once.
CHUNK = 4 << 20

CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "stops": b".!?",
    "commas": b",;:",
    "signs": b"#$%&*@^~_=+<>\\{}[]",
    "bars": b"|/",
    "lines": b"\n",
    "beyond_ascii": bytes(range(128, 256)),
}
STATS = ["log_bytes", "log_words", "word_bytes", "longest_word", *[f"{c}_share" for c in CLASSES], "stops_per_word", "repeated_next", "distinct_words", "top_word"]

#: What words' hashes are made of.
_ODD, _BYTES = np.uint64(0x9E3779B97F4A7C15 | 1), np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)


def measure(texts: list[bytes]) -> np.ndarray:
    """(texts, STATS): statistics of whole UTF-8 texts. A text without words has 0 for what is per word."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((n, len(STATS)))
    counts = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]).reshape(n, 256)
    for i, members in enumerate(CLASSES.values()):
        out[:, 4 + i] = counts[:, list(members)].sum(1) / np.maximum(1, size)
    # each text ends with a space, so that no word crosses texts
    b = np.frombuffer(b" ".join([*texts, b" "]), np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    inside = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate([[0], edge]) if inside[0] else edge
    begins, ends = edge[::2], edge[1::2]
    out[:, 0] = np.log1p(size)
    if not len(begins):
        return out
    length = ends - begins
    words = np.diff(np.searchsorted(begins, [*start, len(b)]))
    owner = np.repeat(np.arange(n), words)
    per = np.maximum(1, words)
    some = words > 0
    first = (np.cumsum(words) - words)[some]
    out[:, 1], out[:, 2] = np.log1p(words), np.bincount(owner, length, n) / per
    out[some, 3] = np.maximum.reduceat(length, first)
    k = 4 + len(CLASSES)
    out[:, k] = counts[:, list(CLASSES["stops"])].sum(1) / per
    # a word is known by a 64-bit hash of all its bytes: sums of random values of the bytes times powers of an odd number,
    # brought to the power of the word's first byte
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(len(b), _ODD))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * power)])
        h = (sums[ends] - sums[begins]) * power[len(b) - 1 - begins] + length.astype(np.uint64)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        key = (h ^ owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    out[:, k + 1] = np.bincount(owner[1:][same], minlength=n) / per
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    o = owner[order[new]]
    out[:, k + 2] = np.bincount(o, minlength=n) / per
    np.maximum.at(out[:, k + 3], o, np.diff([*new, len(key)]))
    out[:, k + 3] /= per
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        while at < len(ids):
            part, size = [], 0
            while at + len(part) < len(ids) and (not part or size < CHUNK):
                part.append((texts[at + len(part)].as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(part[-1])
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *map(pa.array, measure(part).T.copy())], ["doc_id", *STATS])
            at += len(part)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) to doc_id and STATS of the whole text; null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measured, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


def _grow(x: np.ndarray, g: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, found: list, step: np.ndarray) -> None:
    """A tree on gradients g with curvatures w; each node but the root gives its path as a rule."""
    if path:
        found.append(path)
    best = (1e-9, None)
    if depth and len(rows) >= 2 * LEAF:
        for j, at in enumerate(cuts):
            bins = np.searchsorted(at, x[rows, j], "left")
            sums = [np.cumsum(np.bincount(bins, v, len(at) + 1))[:-1] for v in (g[rows], w[rows], np.ones(len(rows)))]
            gs, ws, total_g, total_w = sums[0], sums[1], g[rows].sum(), w[rows].sum()
            gain = gs**2 / (ws + 1) + (total_g - gs) ** 2 / (total_w - ws + 1) - total_g**2 / (total_w + 1)
            gain[(sums[2] < LEAF) | (len(rows) - sums[2] < LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (j, float(at[gain.argmax()])))
    if best[1] is None:
        step[rows] = g[rows].sum() / (w[rows].sum() + 1)
        return
    j, c = best[1]
    low = x[rows, j] <= c
    _grow(x, g, w, cuts, rows[low], depth - 1, (*path, (j, c, True)), found, step)
    _grow(x, g, w, cuts, rows[~low], depth - 1, (*path, (j, c, False)), found, step)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, c, low in rule:
        out &= (x[:, j] <= c) == low
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal steps; the intercept is free."""
    r = np.column_stack([r, np.ones(len(r))])
    rate = 4 / max(1e-9, np.linalg.norm(r.T @ r / len(r), 2))
    b = z = np.zeros(r.shape[1])
    b[-1] = z[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    t = 1.0
    for _ in range(STEPS):
        step = z - rate * (r.T @ (1 / (1 + np.exp(-(r @ z))) - y)) / len(y)
        new = np.sign(step) * np.maximum(0, np.abs(step) - rate * penalty)
        new[-1] = step[-1]
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, b, t = new + (t - 1) / nt * (new - b), new, nt
    return b[:-1], float(b[-1])


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Statistics and labels to {"rules": [(conditions, weight)], "base": intercept}. Small boosted trees propose their
    paths as rules, lasso logistic regression weighs them; the penalty is the best on a fifth of the rows.
    Without rows of both labels there are no rules and the base is the labels' log odds."""
    odds = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) < 4 * LEAF or y.min() == y.max():
        return {"rules": [], "base": odds}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    cuts = [np.unique(np.append(c, np.quantile(x[y == 0, j], [0.1, 0.5, 0.9]))) for j, c in enumerate(cuts)]
    f, found = np.full(len(y), odds), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        _grow(x, y - p, np.maximum(p * (1 - p), 1e-4), cuts, np.arange(len(y)), DEPTH, (), found, step)
        f += 0.3 * step
    rules = list(dict.fromkeys(found))
    r = np.column_stack([_holds(x, rule) for rule in rules]).astype(np.float64)
    test = np.arange(len(y)) % 5 == 4
    loss = {}
    for penalty in PENALTIES:
        w, b = _lasso(r[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(r[test] @ w + b))), 1e-6, 1 - 1e-6)
        loss[penalty] = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
    w, b = _lasso(r, y, min(loss, key=loss.get))
    return {"rules": [(rule, float(v)) for rule, v in zip(rules, w) if abs(v) > 1e-6], "base": b}


def compiled(model: dict) -> Column:
    """The score as one column expression over STATS."""
    total = F.lit(float(model["base"]))
    for rule, weight in model["rules"]:
        holds = F.lit(True)
        for j, c, low in rule:
            holds = holds & (F.col(STATS[j]) <= F.lit(c) if low else F.col(STATS[j]) > F.lit(c))
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, ...), (doc_id, quality, ...) to one row per input row: doc_id, held_out, score, predicted.

    Statistics of all whole texts are taken once and kept in the shared folder. The rules are fitted on about
    `rows` labelled rows, drawn by a hash, of those whose crc32(doc_id) mod 5 is not 0; only statistics are
    inputs. Null texts are scored as empty ones. A null doc_id counts as an empty one (held out); null labels
    and labels of unknown documents are ignored. Without labels every score is one half.
    """
    stats = cut(statistics(docs))
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    learn = stats.join(known, "doc_id").where(remainder != 0)
    n = max(1, learn.count())
    drawn = learn.where((F.xxhash64("doc_id") % 2**20 + 2**20) / 2**21 < rows / n).select("doc_id", "quality", *STATS).toPandas().sort_values(["doc_id", *STATS])
    model = fit(drawn[STATS].to_numpy(float), (drawn["quality"].to_numpy() == 1).astype(float)) if len(drawn) else {"rules": [], "base": 0.0}
    return stats.select("doc_id", (remainder == 0).alias("held_out"), compiled(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
