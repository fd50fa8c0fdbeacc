"""Language-model scoring by prediction by partial matching over bytes.

Counting: every training text is cut into runs of ``ORDER`` + 1 bytes; runs are counted by task and
added up over the corpus. Shorter contexts get their counts from the same table. Every counted run stays in
the model, which grows with the corpus: it is cut into shards by the two bytes before the predicted one, so
that a shard has all longer contexts of its positions. Counts of single bytes and of pairs go to every task.
The positions of the texts to score are sent to the shards, and sums by text come back.

Prediction: the longest known context of the bytes before predicts the next symbol. Escape
probability is estimated as in method D (half a count from each distinct symbol), and symbols that a longer
context has ruled out are excluded from the shorter ones, down to a uniform order -1. Counts follow update
exclusion: a context of two to four symbols counts a symbol once for each longer context that it was new in,
so that it tells what to expect after an escape; pairs and single symbols count all occurrences.
As the counts don't change while scoring, every context's escape is worked out once, and a distinct run of a
batch costs a look-up or a few. ``AdaptiveModel`` is the same model updated while it reads, for a text on its
own.

A text ends with an end symbol, so that the score of the empty text is the end's at the start.

Defined results: null texts count as empty; a null id hashes as the empty text for the fold; repeated rows
are scored each; an empty training set leaves the uniform model; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, free_shuffles, mapped
from .common import slices as pieces_of

ORDER = 5
#: Bytes of training text for each shard of the model, and the fewest shards.
SHARD_BYTES, LEAST_SHARDS = 128_000_000, 24
#: Most frequent tokens whose counts go to every task; the others' counts are joined by shuffle.
HEAD_TOKENS = 50_000
#: Texts, and MB of them, whose positions are sorted and sent together; the more, the better they pack.
PIECE_ROWS, PIECE_MB = 1000, 6.0
#: What each distinct symbol of a context gives to escape.
DISCOUNT = 0.5
END = 0
#: Symbols are bytes plus one; 0 ends a text and fills the contexts before its start.
SYMBOLS = 257
_WIDTH = np.uint64(9)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, each text between ORDER ends before it and one end after; the texts' lengths with end."""
    pad = np.zeros(ORDER, np.uint16)
    parts, sizes = [], []
    for t in texts:
        a = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16) + np.uint16(1)
        parts += [pad, a, pad[:1]]
        sizes.append(len(a) + 1)
    return np.concatenate(parts) if parts else pad, np.array(sizes, np.int64)


def positions(sizes: np.ndarray) -> np.ndarray:
    """Where the predicted symbols are in what ``encode`` returns."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    starts = np.cumsum(np.concatenate(([0], sizes[:-1] + ORDER))) + ORDER
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)


class AdaptiveModel:
    """The same prediction with counts that grow as a text is read; for single texts and as a check."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.counts = order, {}

    def log10_of(self, history: list[int], symbol: int) -> float:
        p, ruled = 1.0, set()
        for k in range(min(self.order, len(history)), -1, -1):
            c = self.counts.get(tuple(history[len(history) - k :]))
            if not c:
                continue
            left = {x: n for x, n in c.items() if x not in ruled}
            if not left:
                continue
            total, d = sum(left.values()), len(left)
            if len(ruled) + d == SYMBOLS:
                return math.log10(p * left[symbol] / total)
            if symbol in left:
                return math.log10(p * (left[symbol] - DISCOUNT) / total)
            p *= DISCOUNT * d / total
            ruled |= set(left)
        return math.log10(p / (SYMBOLS - len(ruled)))

    def learn(self, history: list[int], symbol: int) -> None:
        new = True
        for k in range(min(self.order, len(history)), -1, -1):
            c = self.counts.setdefault(tuple(history[len(history) - k :]), Counter())
            was_new = symbol not in c
            if new or k <= 1:
                c[symbol] += 1
            new = new and was_new

    def score(self, text: str | None, learn: bool = True) -> float:
        history, total = [END] * self.order, 0.0
        for symbol in [b + 1 for b in (text or "").encode("utf-8", "surrogatepass")] + [END]:
            total += self.log10_of(history, symbol)
            if learn:
                self.learn(history, symbol)
            history = (history + [symbol])[-self.order :] if self.order else []
        return total


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The run at each predicted position: context symbols newest first, then the predicted one; the texts' sizes."""
    a, sizes = encode(texts)
    wide = a.astype(np.uint64)
    n = max(0, len(wide) - ORDER)
    code = np.zeros(n, np.uint64)
    for k in range(1, ORDER + 1):
        code = (code << _WIDTH) | wide[ORDER - k : ORDER - k + n]
    code = (code << _WIDTH) | wide[ORDER : ORDER + n]
    return code[positions(sizes) - ORDER], sizes


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, their counts added up, and which of them each code is."""
    order = np.argsort(codes, kind="stable")
    c = codes[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    where = np.empty(len(c), np.int64)
    where[order] = np.cumsum(new) - 1
    return c[new], np.add.reduceat(counts[order], np.flatnonzero(new)) if len(c) else counts, where


def squeeze(x: np.ndarray, rising: bool) -> bytes:
    """An array of uint64 by planes of bytes, rising ones by differences."""
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    return pa.Codec("zstd", 3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def swell(raw: bytes, n: int, rising: bool) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, decompressed_size=8 * n), np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def by_shard(codes: np.ndarray, shard_of: np.ndarray, shift: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, where its codes are, in order); the two newest symbols of a context choose the shard."""
    shard = shard_of[(codes >> np.uint64(shift)).astype(np.int64)]
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(int(shard_of.max()) + 2))
    for k in np.flatnonzero(np.diff(bounds)):
        yield int(k), order[bounds[k] : bounds[k + 1]]


class Roots:
    """What every shard needs: counts of single symbols and of pairs (at most SYMBOLS squared)."""

    def __init__(self, pairs: np.ndarray) -> None:
        """``pairs[c * 512 + s]``: how often s follows c."""
        self.pairs = pairs
        table = pairs.reshape(512, 512)
        self.single = table.sum(0)
        self.total, self.distinct = float(self.single.sum()), int((self.single > 0).sum())
        self.totals, self.kinds = table.sum(1), (table > 0).sum(1)
        self.left = self.total - ((table > 0) @ self.single)
        self.escape, self.onward = escapes(self.totals, self.kinds, self.left, self.distinct)

    def shards(self, n: int) -> np.ndarray:
        """The shard of each pair of newest symbols, so that shards have like numbers of positions."""
        out = (np.arange(1 << 18) % n).astype(np.int16 if n < 1 << 15 else np.int32)
        often = self.pairs.reshape(512, 512).T.ravel()  # newest first
        load = [(0, k) for k in range(n)]
        seen = np.flatnonzero(often)
        for i in seen[np.lexsort((seen, -often[seen]))].tolist():
            size, k = heapq.heappop(load)
            out[i] = k
            heapq.heappush(load, (size + int(often[i]), k))
        return out


def escapes(totals: np.ndarray, kinds: np.ndarray, left: np.ndarray, parent_kinds: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of leaving each context, and of passing through the next shorter one after it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.log10(DISCOUNT * kinds / totals)
        onward = np.where(left > 0, np.log10(DISCOUNT * (parent_kinds - kinds) / left), 0.0)
    return escape, onward


class Shard:
    """All contexts whose two newest symbols fall to a shard, as sorted tables by length."""

    def __init__(self, roots: Roots, codes: np.ndarray, counts: np.ndarray) -> None:
        """``codes``: distinct sorted runs as ``packed``, with ``counts`` (float64)."""
        self.roots, self.levels = roots, []
        nine = np.uint64(511)
        below = []
        for k in range(ORDER, 1, -1):
            up = ((codes >> np.uint64(18)) << _WIDTH) | (codes & nine)  # the run without its oldest symbol
            where = None
            if k > 2:
                more, sums, where = added(up, np.ones(len(up)))
            ctx = codes >> _WIDTH
            new = np.ones(len(ctx), bool)
            new[1:] = ctx[1:] != ctx[:-1]
            first = np.flatnonzero(new)
            shorter = sums[where] if k > 2 else roots.pairs[up.astype(np.int64)].astype(np.float64)
            add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            below.append((codes, counts, ctx[first], add(counts), np.diff(np.append(first, len(ctx))), add(shorter)))
            if k > 2:
                codes, counts = more, sums
        kinds_of, totals_of, names = roots.kinds, roots.totals, None
        for codes, counts, ctx, totals, kinds, taken in below[::-1]:
            parent = (ctx >> _WIDTH).astype(np.int64) if names is None else np.searchsorted(names, ctx >> _WIDTH)
            left = totals_of[parent] - taken
            self.levels.append((codes, counts, ctx, totals, left, *escapes(totals, kinds, left, kinds_of[parent])))
            kinds_of, totals_of, names = kinds, totals, ctx

    def log10_of(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each of the sorted runs."""
        r = self.roots
        if not r.total:
            return np.full(len(codes), -math.log10(SYMBOLS))
        out = np.zeros(len(codes))
        left = np.full(len(codes), np.nan)  # what the shorter context counts without the symbols ruled out
        onward = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        symbol = codes & np.uint64(511)

        def meet(known: np.ndarray, count: np.ndarray, total: np.ndarray, escape: np.ndarray, next_left: np.ndarray, next_onward: np.ndarray) -> None:
            """Of the open runs: whether the context is known, and how often the symbol follows it."""
            nonlocal open_
            i = open_[known]
            began = ~np.isnan(left[i])
            found = count > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i] += np.where(found, np.log10((count - DISCOUNT) / np.where(began, left[i], total)), np.where(began, onward[i], escape))
            left[i], onward[i] = next_left, next_onward
            rest = ~known
            rest[np.flatnonzero(known)[~found]] = True
            open_ = open_[rest]

        for k in range(ORDER, 1, -1):
            runs_, counts, ctx, totals, lefts, escape, on = self.levels[k - 2]
            if not len(ctx):
                continue
            want = codes[open_] >> np.uint64(9 * (ORDER + 1 - k))
            at = np.minimum(np.searchsorted(ctx, want), len(ctx) - 1)
            known = ctx[at] == want
            at, run = at[known], (want[known] << _WIDTH) | symbol[open_[known]]
            j = np.minimum(np.searchsorted(runs_, run), len(runs_) - 1)
            meet(known, np.where(runs_[j] == run, counts[j], 0.0), totals[at], escape[at], lefts[at], on[at])
        last = (codes[open_] >> np.uint64(9 * ORDER)).astype(np.int64)
        known = r.totals[last] > 0
        last = last[known]
        meet(known, r.pairs[last * 512 + symbol[open_[known]].astype(np.int64)].astype(np.float64), r.totals[last], r.escape[last], r.left[last], r.onward[last])
        n = len(open_)
        meet(np.ones(n, bool), r.single[symbol[open_].astype(np.int64)].astype(np.float64), np.full(n, r.total), np.full(n, math.log10(DISCOUNT * r.distinct / r.total)), np.zeros(n), np.zeros(n))
        out[open_] -= math.log10(SYMBOLS - r.distinct)
        return out


def count_corpus(train: DataFrame, scratch: Scratch) -> tuple[np.ndarray, DataFrame, int]:
    """Counts of pairs of symbols, (token, count), and the bytes of all texts of ``train``, from one reading of it."""
    schema = pa.schema([("pair", pa.int64()), ("token", pa.binary()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs = np.zeros(1 << 18, np.int64)

        def out_words() -> Iterator[pa.RecordBatch]:
            items = list(words.items())
            words.clear()
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], schema=schema)

        for batch in batches:
            for piece in pieces_of(batch, mb=1.0):
                texts = piece.column(0).to_pylist()
                a, sizes = encode(texts)
                at = positions(sizes)
                pairs += np.bincount((a[at - 1].astype(np.int64) << 9) | a[at], minlength=1 << 18)
                for t in texts:
                    words.update(tokens(t))
                if len(words) > 200_000:
                    yield from out_words()
        yield from out_words()
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(pairs[at])], schema=schema)

    both = mapped(train.select("text"), run, "pair long, token binary, count long").groupBy("pair", "token").agg(F.sum("count").alias("count"))
    both = scratch.write(both, "counts")
    got = both.where("token is null").select("pair", "count").toArrow()  # at most SYMBOLS squared
    pairs = np.zeros(1 << 18, np.int64)
    pairs[got["pair"].to_numpy()] = got["count"].to_numpy()
    return pairs, both.where("token is not null").select("token", "count"), int(pairs.sum())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of up to PIECE_ROWS rows and PIECE_MB."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in pieces_of(batch, PIECE_ROWS, PIECE_MB):
            if held and (sum(x.num_rows for x in held) + piece.num_rows > PIECE_ROWS or sum(x.nbytes for x in held) + piece.nbytes > PIECE_MB * 1e6):
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
            held.append(piece)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_SENT = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("n", pa.int64()), ("texts", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_SENT_DDL = "shard int, kind int, batch long, n long, texts int, a binary, b binary"
#: Kinds of rows: runs counted in training, positions of a batch of texts, the batch's other columns, sums by text.
_COUNTED, _ASKED, _TEXTS, _SUMS = 0, 1, 2, 3


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT, strict=True)], schema=_SENT)


def send_counts(train: DataFrame, held) -> DataFrame:
    """Rows of counted runs by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shard_of, _ = held.value
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if kept:
                codes, counts, _ = added(np.concatenate([c for c, _ in kept]), np.concatenate([n for _, n in kept]))
                kept.clear()
                yield _sent([(k, _COUNTED, 0, len(i), 0, squeeze(codes[i], True), squeeze(counts[i].astype(np.uint64), False)) for k, i in by_shard(codes, shard_of, 36)])

        for batch in batches:
            for piece in pieces_of(batch, mb=PIECE_MB):
                kept.append(np.unique(packed(piece.column(0).to_pylist())[0], return_counts=True))
                if sum(len(c) for c, _ in kept) > 2_000_000:
                    yield from out()
        yield from out()

    return mapped(train.select("text"), run, _SENT_DDL)


def send_texts(docs: DataFrame, held, bottom: int, ends: int) -> DataFrame:
    """Rows of positions by shard for each batch of texts, and its ids, token counts and unknown tokens."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rest", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shard_of, top = held.value
        number = TaskContext.get().partitionId() << 33
        for piece in gathered(batches):
            texts = piece.column("text").to_pylist()
            codes, sizes = packed(texts)
            keys = np.sort((codes << np.uint64(10)) | np.repeat(np.arange(len(texts), dtype=np.uint64), sizes))
            rows = [(k, _ASKED, number, len(i), len(texts), squeeze(keys[i], True), None) for k, i in by_shard(keys, shard_of, 46)]
            del codes, keys
            n_tokens, n_known, base, rest, times = [], [], [], [], []
            for t in texts:
                words = tokens(t)
                part, seen, tail = 0.0, 0, []
                for w, n in Counter(words).items():
                    c = top.get(w)
                    if c is None:
                        tail.append((w, n))
                    else:
                        part += n * math.log10((c + 1) / bottom)
                        seen += n
                n_tokens.append(len(words) + 1)
                n_known.append(seen + (1 if ends else 0))
                base.append(part + math.log10((ends + 1) / bottom))
                rest.append([w for w, _ in tail])
                times.append([n for _, n in tail])
            columns = [pa.array(x, f.type) if not isinstance(x, pa.Array) else x for x, f in zip((piece.column("doc_id"), n_tokens, n_known, base, rest, times), out, strict=True)]
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, out, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=out))
                rows.append((number % (int(shard_of.max()) + 1), _TEXTS, number, 0, len(texts), sink.getvalue().to_pybytes(), None))
            yield _sent(rows)
            number += 1

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SENT_DDL)


def answer(sent: DataFrame, held) -> DataFrame:
    """Rows of sums by text for each batch and shard, from rows sorted by shard and kind; rows of texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, _, _ = held.value
        now, model = None, None
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            codes, counts, _ = added(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
            parts[:] = [(codes, counts)]

        for received in batches:
            for at in range(received.num_rows):
                shard, kind, batch, n, texts, a, b = (received.column(i)[at].as_py() for i in range(7))
                if shard != now:
                    now, model = shard, None
                    parts.clear()
                if kind == _COUNTED:
                    parts.append((swell(a, n, True), swell(b, n, False).astype(np.float64)))
                    if len(parts) > 1 and sum(len(c) for c, _ in parts[1:]) > max(1_000_000, len(parts[0][0]) // 2):
                        merge()
                    continue
                if kind == _TEXTS:
                    yield _sent([(shard, kind, batch, n, texts, a, b)])
                    continue
                if model is None:
                    if parts:
                        merge()
                    model = Shard(roots, *(parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0))))
                    parts.clear()
                keys = swell(a, n, True)
                codes = keys >> np.uint64(10)
                new = np.ones(n, bool)
                new[1:] = codes[1:] != codes[:-1]
                each = model.log10_of(codes[new])[np.cumsum(new) - 1]
                sums = np.bincount((keys & np.uint64(1023)).astype(np.int64), weights=each, minlength=texts)
                yield _sent([(shard, _SUMS, batch, n, texts, sums.tobytes(), None)])

    return mapped(sent, run, _SENT_DDL)


def gather(answers: DataFrame) -> DataFrame:
    """A row for each text, from rows sorted by batch and kind: the texts of a batch, then its sums."""
    ddl = "doc_id long, n_tokens long, n_known long, base double, score double, rest array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, score = None, None

        def out() -> pa.RecordBatch:
            return texts.append_column("score", pa.array(score)).select(["doc_id", "n_tokens", "n_known", "base", "score", "rest", "times"])

        for received in batches:
            for at in range(received.num_rows):
                kind, a = received.column("kind")[at].as_py(), received.column("a")[at].as_py()
                if kind == _SUMS:
                    score += np.frombuffer(a, np.float64)
                    continue
                if texts is not None:
                    yield out()
                texts = pa.ipc.open_stream(a).read_next_batch()
                score = np.zeros(texts.num_rows)
        if texts is not None:
            yield out()

    return mapped(answers, run, ddl)


def score_documents(docs: DataFrame, train: DataFrame) -> DataFrame:
    """For each of ``docs`` (doc_id, text): n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    pairs, token_counts, size = count_corpus(train, scratch)
    roots = Roots(pairs)
    n_shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    ends = train.count()
    known = token_counts.agg(F.count("*").alias("v"), F.sum("count").alias("n")).first()
    n_train = (known["n"] or 0) + ends
    bottom = n_train + known["v"] + (1 if ends else 0) + 1
    head = {bytes(r["token"]): r["count"] for r in token_counts.orderBy(F.desc("count"), "token").limit(HEAD_TOKENS).collect()}
    held = spark.sparkContext.broadcast((roots, roots.shards(n_shards), head))  # all of bounded size
    del head
    free_shuffles(spark)  # the counts are written
    sent = send_counts(train, held).unionAll(send_texts(docs, held, bottom, ends))
    sent = sent.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "kind", "batch")
    scored = gather(answer(sent, held).repartition("batch").sortWithinPartitions("batch", "kind"))
    scored = scratch.write(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    free_shuffles(spark)
    tail = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    met = tail.join(token_counts, "token", "left").select("row", "times", F.coalesce("count", F.lit(0)).alias("c"))
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(bottom)))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, docs.where(crc_mod(F.col("doc_id"), 7) != 2))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
