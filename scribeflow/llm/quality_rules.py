"""Quality rules: counts over whole texts, fixed limits, and a hashed n-gram logistic regression.

The model sees hashed words, pairs of words, and runs of three and of four characters (code points, digits
folded into one), each as the logarithm of its count, scaled to length 1; words, pairs and runs have tables
of their own. It is fitted on at most ``train_rows`` labelled rows, chosen by hash; a fifth of them is held
back for Platt scaling, so that the output is a calibrated probability of label 1. Documents are then
scored in Arrow batches against the fixed threshold.

Defined results: null or empty texts have all counts 0 and fail the base rules; a null id takes no part in
fitting; of labels repeated for an id the largest counts, of texts the least; without any label, or with
labels of one kind only, the model keeps everything that passes the base rules; equal texts get equal
results; other columns are ignored or, in ``keep_quality``, kept as is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _STEP, map_batches, mapped, mix, windows5, word_hashes

#: Entries of the tables of words, of pairs of words and of runs of characters, as powers of two.
WORD_BITS, PAIR_BITS, RUN_BITS = 17, 17, 18
#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 2500
#: A document is kept if its calibrated probability of label 1 reaches this.
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOLS = b"#*$%&|<>"
_SIZE = (1 << WORD_BITS) + (1 << PAIR_BITS) + (1 << RUN_BITS)
_ODD = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))


class Text:
    """A text's bytes, words and word hashes, cut once for the counts and the model."""

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.hashes = word_hashes(self.words)


def counts(t: Text) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    n = len(t.words)
    if not n:
        return 0, 0, 0, 0, 0
    body = b"".join(t.words)
    chars = len(body) if body.isascii() else len(body.decode("utf-8", "surrogatepass"))
    symbols = len(t.raw) - len(t.raw.translate(None, _SYMBOLS))
    lines = [x for x in t.raw.split(b"\n") if x and not x.isspace()] if b"\n" in t.raw else []
    repeat = 0
    if n >= 6:
        w = windows5(t.hashes)
        s = np.sort(w)
        if (s[1:] == s[:-1]).any():
            order = np.argsort(w, kind="stable")
            s = w[order]
            same = s[1:] == s[:-1]
            cover = np.zeros(n + 1, np.int64)
            at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int(np.count_nonzero(np.cumsum(cover)[:n] > 0))
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def fails_base(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def features(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids and their scaled weights."""
    ids = [(t.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)]
    if len(t.hashes) >= 2:
        pairs = mix(t.hashes[:-1] * _STEP[0] + t.hashes[1:] * _STEP[1])
        ids.append((pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int32) + np.int32(1 << WORD_BITS))
    if t.raw.isascii():
        a = np.frombuffer(t.raw, np.uint8).astype(np.uint32)
    else:
        a = np.frombuffer(t.raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    for width in (3, 4):
        n = len(a) - width + 1
        if n > 0:
            h = np.full(n, width, np.uint32)
            for k in range(width):
                h += a[k : k + n] * _ODD[k]
                h ^= h >> np.uint32(15)
            h *= _ODD[0]
            ids.append((h >> np.uint32(32 - RUN_BITS)).astype(np.int32) + np.int32((1 << WORD_BITS) + (1 << PAIR_BITS)))
    every = np.sort(np.concatenate(ids))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
    w = np.log1p(np.diff(np.append(first, len(every)))).astype(np.float32)
    norm = float(np.sqrt((w * w).sum()))
    return every[first], (w / norm if norm else w)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(ids: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, epochs: int = 60) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, shift): L2-regularised logistic regression by Nesterov steps, then Platt scaling."""
    n = len(labels)
    back = np.arange(n) % 5 == 4
    back &= bool(len(np.unique(labels[~back])) == 2 and len(np.unique(labels[back])) == 2)

    def pack(rows: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """The rows in blocks of about half a million features, (features, weights, rows), and their labels."""
        take = np.flatnonzero(rows)
        ends = np.cumsum([len(ids[i]) for i in take])
        blocks = []
        for part in np.split(np.arange(len(take)), np.flatnonzero(np.diff(ends // 500_000)) + 1):
            blocks.append((np.concatenate([ids[take[i]] for i in part]), np.concatenate([weights[take[i]] for i in part]), np.repeat(part, [len(ids[take[i]]) for i in part]).astype(np.int32)))
        return blocks, labels[take].astype(np.float64)

    def sums(blocks: list[tuple], w: np.ndarray, n: int) -> np.ndarray:
        return sum((np.bincount(r, weights=w[x] * v, minlength=n) for x, v, r in blocks), np.zeros(n))

    blocks, y = pack(~back)
    # Both labels weigh the same, else the rare one is hardly learnt; scaling undoes the shift.
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, bias, l2 = np.zeros(_SIZE, np.float32), 0.0, 1e-5
    vw, vb = w.copy(), bias
    for t in range(epochs):
        g = ((sigmoid(sums(blocks, vw, len(y)) + vb) - y) * share).astype(np.float32)
        gw = np.float32(l2) * vw
        for x, v, r in blocks:
            gw += np.bincount(x, weights=g[r] * v, minlength=_SIZE).astype(np.float32)
        nw, nb = vw - np.float32(4.0) * gw, vb - 4.0 * g.sum()
        m = np.float32(t / (t + 3))
        vw, vb = nw + m * (nw - w), nb + m * (nb - bias)
        w, bias = nw, nb
    slope, shift = 1.0, 0.0
    if back.any():
        blocks, y = pack(back)
        z = sums(blocks, w, len(y)) + bias
        up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        goal = np.where(y > 0, up, down)
        for _ in range(200):  # Newton steps on two numbers
            p = sigmoid(slope * z + shift)
            d, h = p - goal, p * (1 - p) + 1e-6
            ga, gb = (d * z).sum() + 1e-3 * (slope - 1), d.sum()
            haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-6
            det = haa * hbb - hab * hab
            if det <= 0:
                break
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            slope, shift = slope - da, shift - db
            if abs(da) + abs(db) < 1e-9:
                break
    return w.astype(np.float32), float(bias), float(slope), float(shift)


def train_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """The fitted model, or None where the labels can't teach one. ``labels``: doc_id, quality."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(train_rows)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows rows
    # Of rows that share an id the least text stands for it, whatever the order they come in.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, quality, x, v = [], [], [], []
        for d, t, q in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "quality")), strict=True):
            at, w = features(Text(t))
            ids.append(d)
            quality.append(q)
            x.append(at.astype(np.int32).tobytes())
            v.append(w.tobytes())
        yield {"doc_id": ids, "quality": quality, "x": x, "v": v}

    got = map_batches(rows, run, "doc_id long, quality int, x binary, v binary").toArrow().to_pandas()
    got = got.sort_values("doc_id", key=lambda s: mix(s.to_numpy(np.uint64)))
    y = got["quality"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    return fit([np.frombuffer(b, np.int32) for b in got["x"]], [np.frombuffer(b, np.float32) for b in got["v"]], y)


def judge(text: Text, model) -> float:
    """Calibrated probability of label 1."""
    w, bias, slope, shift = model
    at, v = features(text)
    return float(sigmoid(slope * (float(w[at] @ v) + bias) + shift))


def score_rules(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: its id, counts, base_failed, probability and kept."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # 2^19 floats

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")}
        for text in batch.column("text").to_pylist():
            text = Text(text)
            c = counts(text)
            failed = fails_base(c[0], c[4])
            p = judge(text, held.value) if held.value is not None else 1.0
            for k, x in zip(out, (*c, failed, p, not failed and p >= threshold), strict=True):
                out[k].append(x)
        yield {"doc_id": batch.column("doc_id"), **out}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns unchanged."""
    model = train_rules(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("text")):
                text = Text(text.as_py())
                c = counts(text)
                keep.append(not fails_base(c[0], c[4]) and (held.value is None or judge(text, held.value) >= threshold))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_rules(docs, train_rules(docs, labels))
