"""Quality classifier: random-indexing word vectors, pooled by document, under a two-layer network.

Random indexing: every feature of a word (the whole word, its last letters, its shape) owns a sparse random
vector of +1 and -1, drawn from its hash. The context vector of a word is the sum of the random vectors of
its neighbours over the whole corpus; sums are integers, so that their order does not matter. Context
vectors are kept by 18 bits of the whole word's hash: words that share a bucket share its sum, in which the
frequent ones weigh most, and the table's size is fixed. A document is the mean of its words' own and
context vectors, beside which stand four numbers of its form: the squared length of the sum of its words' vectors,
its distinct words against its length, its share of words said twice in a row, and its length. A network with one hidden layer, trained in numpy on at most ``train_rows`` labelled
rows, scores it; a temperature fitted on rows held back from training calibrates the probability.

Labels, lang, source and doc_id are never inputs of a score. Defined results: null and empty texts pool
to the zero vector and get the network's score for it; where labels of only one kind are there, the
score is their rate, smoothed; of labels repeated for an id the largest counts, of texts the least; other
columns are ignored, or, in ``keep_scored``, kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, mapped, mix, slices

#: Buckets of endings and shapes.
BUCKETS = 4096
OWN, CONTEXT = 64, 24
#: Context vectors go by this many bits of the whole word's hash: 2^18 rows, 6 MB, are broadcast.
CONTEXT_BITS = 18
#: Ranges of buckets that are added up apart.
PARTS = 256
HIDDEN = 24
#: Most labelled rows that the network is trained on.
TRAIN_ROWS = 8000

_CLASS = np.zeros(256, np.uint64)
for _c in range(33, 128):
    _CLASS[_c] = _c
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A random number for each byte, an odd factor and its inverse modulo 2^64.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _index_vectors(owners: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Sparse random vectors of numbers, six entries of +1 or -1 each, the same in every process."""
    table = np.zeros((len(owners), dims), np.int8)
    for k in range(6):
        h = mix(owners * np.uint64(8) + np.uint64(k + 1000003 * seed))
        table[np.arange(len(owners)), (h % np.uint64(dims)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1).astype(np.int8)
    return table


_OWN = _index_vectors(np.arange(BUCKETS, dtype=np.uint64), OWN, 1).astype(np.float32)


def word_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole words, buckets of each word's ending and shape (2 x words), and the words of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raws])
    a = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[a]
    s = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(a) and not space[0]:
        s = np.concatenate(([0], s))
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(len(texts), np.int64)
    e = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = e - s
    # A polynomial over the word's bytes, from sums over all bytes before its start and its end.
    powers = np.full(len(a), _FACTOR, np.uint64)
    powers[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * np.cumprod(powers), dtype=np.uint64)))
    powers[1:] = _INVERSE
    words = mix((sums[e] - sums[s]) * np.cumprod(powers)[s] + size.astype(np.uint64))
    kind = _CLASS[a]

    def near(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        return np.where(size >= k, values[np.clip(at, 0, len(a) - 1)], 0).astype(np.uint64)

    last = [near(a, e - k, k) for k in (1, 2, 3)]
    ending = last[0] | (last[1] << np.uint64(8)) | (last[2] << np.uint64(16)) | np.uint64(1 << 60)
    shape = np.uint64(2 << 60) | np.minimum(size >> 1, 7).astype(np.uint64)
    for k, x in enumerate((near(kind, s, 1), near(kind, s + 1, 2), near(kind, e - 1, 1), near(kind, e - 2, 2), near(kind, e - 3, 3))):
        shape ^= x << np.uint64(8 + 9 * k)
    h = np.stack([(mix(x) >> np.uint64(52)).astype(np.int64) for x in (ending, shape)])
    return words, h, np.diff(np.searchsorted(s, starts))


def bucket_of(words: np.ndarray) -> np.ndarray:
    """The context bucket of each whole word's hash."""
    return (words >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)


def neighbour_sums(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words, and the sums of the random vectors of their words' neighbours."""
    words, _, n = word_features(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros((0, CONTEXT), np.int32)
    known, at = np.unique(words, return_inverse=True)
    vectors = _index_vectors(known, CONTEXT, 2)[at]
    inner = np.ones(len(words), bool)
    inner[np.cumsum(n[n > 0]) - 1] = False  # a text's last word has none on its right
    inner = inner[:-1, None]
    near = np.zeros((len(words), CONTEXT), np.int8)  # twice six entries of one at most
    near[:-1] += vectors[1:] * inner
    near[1:] += vectors[:-1] * inner
    return _added(bucket_of(words), near)


def _added(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(rows[order], starts, dtype=np.int32)


def corpus_contexts(docs: DataFrame) -> np.ndarray:
    """The unit context vector of every bucket, over all texts, in steps of 1/127.

    Tasks add up what they read and send it packed, a row for each of ``PARTS`` ranges of buckets; a range is
    added up as its rows stream by. The table has 2^``CONTEXT_BITS`` rows whatever the corpus.
    """
    width = (1 << CONTEXT_BITS) // PARTS
    sent = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, sums = _added(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            edges = np.searchsorted(keys, np.arange(PARTS + 1) * width)
            rows = []
            for part in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[part], edges[part + 1]
                # Signs fold into the lowest bit, so that small sums have small bytes; planes of bytes pack well.
                x = ((sums[lo:hi] << 1) ^ (sums[lo:hi] >> 31)).astype(np.uint32)
                planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T)
                at = (keys[lo:hi] - part * width).astype(np.uint16)
                rows.append((part, int(hi - lo), at.tobytes(), pa.Codec("zstd", 1).compress(planes, asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), sent, strict=True)], schema=sent)

        for batch in batches:
            for piece in slices(batch, mb=0.5):
                keys, sums = neighbour_sums(piece.column(0).to_pylist())
                if len(keys):
                    held.append((keys, sums))
                if sum(len(k) for k, _ in held) > 120_000:
                    yield from flush()
        yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out() -> pa.RecordBatch:
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            raw = np.rint(127 * sums / np.where(norm > 0, norm, 1)).astype(np.int8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([raw], pa.binary())], names=["part", "unit"])

        for batch in batches:
            for part, n, at, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, sums = part, np.zeros((width, CONTEXT), np.int64)
                planes = np.frombuffer(pa.Codec("zstd").decompress(packed, decompressed_size=4 * n * CONTEXT), np.uint8)
                x = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(n, CONTEXT)
                sums[np.frombuffer(at, np.uint16)] += (x >> 1).astype(np.int64) ^ -(x & 1).astype(np.int64)
        if now is not None:
            yield out()

    parts = mapped(docs.select("text"), run, "part int, n int, at binary, sums binary")
    parts = mapped(parts.repartition("part").sortWithinPartitions("part"), total, "part int, unit binary")
    table = np.zeros((1 << CONTEXT_BITS, CONTEXT), np.int8)
    for r in parts.toLocalIterator():  # PARTS rows at most
        table[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["unit"], np.int8).reshape(width, CONTEXT)
    return table


def pool(texts: list[str | None], contexts: np.ndarray) -> np.ndarray:
    """For each text the mean of its words' own and context vectors, how much it repeats words, and log length."""
    m = len(texts)
    out = np.zeros((m, OWN + CONTEXT + 4), np.float32)
    words, f, n = word_features(texts)
    if len(words):
        doc = np.repeat(np.arange(m), n)
        known, at = np.unique(words, return_inverse=True)
        both, count = np.unique(doc * len(known) + at, return_counts=True)
        of, word = both // len(known), both % len(known)
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        vectors = np.concatenate((_index_vectors(known, OWN, 1).astype(np.float32), contexts[bucket_of(known)].astype(np.float32) / 127), axis=1)
        for i in range(0, len(starts), 64):
            lo, hi = starts[i], starts[i + 64] if i + 64 < len(starts) else len(of)
            out[of[starts[i : i + 64]], :-4] = np.add.reduceat(vectors[word[lo:hi]] * count[lo:hi, None].astype(np.float32), starts[i : i + 64] - lo)
        ends = np.cumsum(n)
        for i in range(0, m, 64):
            k = min(64, m - i)
            lo, hi = (ends[i - 1] if i else 0), ends[i + k - 1]
            kinds = np.bincount(((doc[lo:hi] - i) * BUCKETS + f[:, lo:hi]).ravel(), minlength=k * BUCKETS).reshape(k, BUCKETS)
            out[i : i + k, :OWN] += kinds.astype(np.float32) @ _OWN
        size = np.maximum(n, 1)
        # The squared length of the sum of the words' own vectors tells how much a text repeats its words.
        out[:, -4] = np.log1p(np.bincount(of, weights=count.astype(np.float64) ** 2, minlength=m)) / np.log(2 + size)
        out[:, -3] = np.bincount(of, minlength=m) / size**0.8
        out[:, -2] = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=m) / size
    out[:, :-4] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n) / 4
    return out


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 120, seed: int = 3) -> dict:
    """Two-layer network by Adam on cross-entropy, then the temperature that fits rows held back."""
    rng = np.random.default_rng(seed)
    y = y.astype(np.float64)
    if len(np.unique(y)) < 2:
        return {"rate": float((y.sum() + 1) / (len(y) + 2))}
    order = rng.permutation(len(y))
    back = np.zeros(len(y), bool)
    back[order[: len(y) // 5]] = True
    if len(np.unique(y[~back])) < 2:
        back[:] = False
    mean, std = x[~back].mean(0), x[~back].std(0) + 1e-3
    z = ((x - mean) / std).astype(np.float64)
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    train = np.flatnonzero(~back)
    t = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 128):
            b = train[i : i + 128]
            h = np.tanh(z[b] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[b]) / len(b)
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [z[b].T @ dh + 2e-3 * w[0], dh.sum(0), h.T @ d + 2e-3 * w[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]
    temperature = 1.0
    if back.any():
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 80))
        loss = [np.logaddexp(0, -np.where(y[back] > 0, 1, -1) * logit[back] / g).mean() for g in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return {"mean": mean, "std": std, "w": w, "temperature": temperature}


def predict(x: np.ndarray, net: dict) -> np.ndarray:
    if "rate" in net:
        return np.full(len(x), net["rate"])
    z = (x - net["mean"]) / net["std"]
    w = net["w"]
    logit = (np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]) / net["temperature"]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train_classifier(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict]:
    """(context vectors, network). ``labels``: doc_id and quality of the rows to learn from."""
    contexts = corpus_contexts(docs)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(train_rows)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows rows
    # Of rows that share an id the least text stands for it, whatever the order they come in.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": [v.tobytes() for v in pool(batch.column("text").to_pylist(), held.value)]}

    got = map_batches(rows, run, "doc_id long, quality int, x binary", mb=0.5).toArrow().to_pandas().sort_values("doc_id")
    held.destroy()
    if not len(got):
        return contexts, {"rate": 0.5}
    return contexts, train_network(np.stack([np.frombuffer(b, np.float32) for b in got["x"]]), got["quality"].to_numpy())


def score_quality(docs: DataFrame, model: tuple[np.ndarray, dict]) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        contexts, net = held.value
        yield {"doc_id": batch.column("doc_id"), "score": predict(pool(batch.column("text").to_pylist(), contexts), net)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double", mb=0.5)


def keep_scored(docs: DataFrame, model: tuple[np.ndarray, dict], threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score under the threshold, columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, net = held.value
        for batch in batches:
            for piece in slices(batch, mb=0.5):
                x = pool(piece.column(text).to_pylist(), contexts)
                yield piece.filter(pa.array(predict(x, net) >= threshold, pa.bool_()))

    return mapped(docs, run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, train_classifier(docs, learnable(labels)))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
