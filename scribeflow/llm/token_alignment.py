"""Cross-tokenizer alignment: groups of tokens between byte offsets where two tokenizers' tokens both end.

Both tokenizers start a new token at a space that follows a character that isn't white space: the byte-level
model cuts texts into words before it merges, and no piece of the piece model crosses a space (``load_pair``
checks both). The same holds between a letter and a mark behind it, and around a line feed, as far as no piece
holds both (``fine_cut``). So the alignment of a text is that of the parts between such cuts, its words, one
after the other, and each distinct word is aligned once for the whole corpus:

1. Texts are cut into words, in blocks of texts; a block keeps its distinct words once (Arrow).
2. Each distinct word of the corpus is encoded by both tokenizers (Arrow). All that follows about words is
   relational: ``posexplode`` of the tokens, windowed sums of their lengths, an equi-join on word and end,
   a running count of the joint ends as group id, and a join on word that gives each group the range of ids
   between one joint end and the next; links are the pairs of a group. All of it keeps one partitioning by word number.
3. Blocks get their words' links back by a join on word numbers and say how many documents hold each id pair;
   counts are summed over blocks. Words get the sums of their links' counts, and blocks add them up by document.

Exchanges are by word, by word number, by pair and by block; no key is a document's or a source's. A word or
pair has at most one row a block, which an adaptive sort-merge join can split.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have
no tokens: zeros and an empty digest. Rows with equal ids or texts are documents of their own; null ids stay.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles, give_back, mapped

#: Both tokenizers cut at a space that follows a character that isn't white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Letters and digits that are so in every version of Unicode.
LATIN = [chr(c) for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)) for c in range(lo, hi + 1)]
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 32_000_000
#: Pairs of ids, some 50 bytes each, that may be broadcast.
BROADCAST_PAIRS = 1_000_000
#: Rounds in which blocks get their words' groups and sums.
ROUNDS = 4
#: (document, word) pairs whose links are told apart at once.
STEP = 200_000

BLOCKS = "block long, doc_id long, n int, ix binary, nth int, word string"
TOKENS = "word string, bad boolean, a array<struct<id:int,len:int>>, b array<struct<id:int,len:int>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: Lets joins on (word, end) use a partitioning by word alone, and aggregates by word use the order of the joins before them.
BY_WORD = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}


def default_pair() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pair:
    """Two tokenizers with the bytes of their tokens."""

    a: object
    b: object
    a_bytes: dict[int, bytes]
    b_bytes: list[bytes]


def _byte_chars() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    same = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pair(a: bytes, b: bytes) -> Pair:
    """The tokenizers of a byte-level BPE file and of a piece model; both must cut where marked words begin."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Tokenizer

    conf = json.loads(a)
    cutter = conf.get("pre_tokenizer") or {}
    if conf.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("the first tokenizer has to be a byte-level one that cuts words and adds nothing")
    first = Tokenizer.from_str(a.decode())
    first.encode_special_tokens = True
    to_byte = _byte_chars()
    a_bytes = {i: bytes(map(to_byte.__getitem__, w)) for w, i in conf["model"]["vocab"].items() if all(c in to_byte for c in w)}
    model = pb.ModelProto()
    model.ParseFromString(b)
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("the second tokenizer has to put a space in front of texts and leave them alone otherwise")
    if any("▁" in p.piece.lstrip("▁") for p in model.pieces if p.type in (1, 4)):
        raise ValueError("a piece of the second tokenizer crosses words")
    model.normalizer_spec.add_dummy_prefix = False  # words come with their space
    b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() if p.type in (1, 4) else b"" for p in model.pieces]
    return Pair(first, SentencePieceProcessor(model_proto=model.SerializeToString()), a_bytes, b_bytes)


def fine_cut(pieces: list[str]) -> str:
    """A pattern for further cuts that no piece crosses and the byte-level model makes as well.

    A mark after a letter begins a new word there, and so does a line feed after anything but white space, and
    a letter after such a line feed.
    """
    crossed = {p: set() for p in MARKS}
    for piece in pieces:
        for left, right in zip(piece, piece[1:]):
            if right in crossed:
                crossed[right].add(left)
    alike: dict[str, str] = {}
    for mark, left in crossed.items():
        letters = "".join(c for c in LATIN if c not in left)
        alike[letters] = alike.get(letters, "") + mark
    cuts = [f"(?<=[{re.escape(letters)}])(?=[{re.escape(marks)}])" for letters, marks in alike.items() if letters]
    if not any("\n" in p for p in pieces):
        cuts += [r"(?<=\S)(?=\n)", rf"(?<=\S\n)(?=[{re.escape(''.join(LATIN))}])"]
    return "|".join(cuts)


def pieces_of(model: bytes) -> list[str]:
    from sentencepiece import sentencepiece_model_pb2 as pb

    found = pb.ModelProto()
    found.ParseFromString(model)
    return [p.piece for p in found.pieces if p.type in (1, 4)]


_LOADED: dict[bytes, Pair] = {}


def _loaded(files: tuple[bytes, bytes]) -> Pair:
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _LOADED:
        _LOADED[key] = load_pair(*files)
    return _LOADED[key]


class _Words(dict):
    """The numbers of the parts of each space-marked word; parts are numbered as they come up."""

    def __init__(self, fine: re.Pattern) -> None:
        super().__init__()
        self.fine, self.parts = fine, defaultdict(count().__next__)

    def __missing__(self, word: str) -> list[int]:
        parts = [word] if word[1:].isalnum() else self.fine.split(word)
        found = self[word] = [self.parts[p] for p in parts]
        return found


def _packed(ix: np.ndarray) -> bytes:
    """Numbers of words by byte planes, compressed: most of the upper bytes are alike."""
    return pa.compress(ix.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words of all documents, one after the other, and where each document's end (from 0)."""
    sizes = docs.column("n").to_numpy()
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    out = np.empty(ends[-1], np.int32)
    for i, packed in enumerate(chain.from_iterable(docs.column("ix").chunks)):
        planes = pa.decompress(packed.as_buffer(), decompressed_size=4 * int(sizes[i]), codec="zstd") if sizes[i] else b""
        out[ends[i] : ends[i + 1]] = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return out, ends


def _blocks(cut) -> callable:
    """Rows of documents (numbers of their words in order) and of distinct words, by block."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("ix", pa.binary()), ("nth", pa.int32()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine = re.compile(cut.value)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        rows: list[np.ndarray] = []
        held, size = _Words(fine), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, held, size, number
            for at in range(0, len(ids), 2000):
                some = rows[at : at + 2000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(ids[at : at + 2000], pa.int64()), pa.array(list(map(len, some)), pa.int32()), pa.array(list(map(_packed, some)), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=schema)
            words = list(held.parts)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(np.arange(at, at + m), pa.int32()), pa.array(part, pa.string())], schema=schema)
            ids, rows, held, size, number = [], [], _Words(fine), 0, number + 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if size and size + len(text or "") > BLOCK_CHARS:
                    yield from flush()
                words = CUT.split(" " + text) if text else []
                ids.append(doc_id)
                rows.append(np.array(list(chain.from_iterable(map(held.__getitem__, words))), np.int32))
                size += len(text or "")
        yield from flush()

    return run


def _encoder(files) -> callable:
    """Tokens of distinct words by both tokenizers, with byte lengths; ``bad`` where either doesn't give the word back."""
    pair_type = pa.list_(pa.struct([("id", pa.int32()), ("len", pa.int32())]))
    schema = pa.schema([("word", pa.string()), ("bad", pa.bool_()), ("a", pair_type), ("b", pair_type)])

    def tokens(found: list[list[int]], sizes) -> pa.Array:
        flat = [i for ids in found for i in ids]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array([len(sizes[i]) for i in flat], pa.int32())], names=["id", "len"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(files.value)
        a_bytes, b_bytes = pair.a_bytes, pair.b_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                words = batch.column("word").slice(at, 5000).to_pylist()
                a = [x.ids for x in pair.a.encode_batch_fast(words, add_special_tokens=False)]
                b = pair.b.encode(words, num_threads=1)
                whole = [w.encode() for w in words]
                bad = [b"".join(a_bytes.get(i, b"") for i in x) != w or b"".join(map(b_bytes.__getitem__, y)) != w for x, y, w in zip(a, b, whole)]
                a, b = ([[] if no else x for x, no in zip(side, bad)] for side in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(bad), tokens(a, a_bytes), tokens(b, b_bytes)], schema=schema)

    return run


def encode_words(words: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """Both tokenizers' tokens of each row of ``word``."""
    return mapped(words.select("word"), _encoder(words.sparkSession.sparkContext.broadcast(files)), TOKENS)


def _ends(tokens: DataFrame, side: str, n: int) -> DataFrame:
    """A row for each token of a side: its position and the byte offset where it ends."""
    sizes = tokens.select("w", F.col(side)["len"].alias("sizes")).repartition(n, "w")
    up_to = Window.partitionBy("w").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.select("w", F.posexplode("sizes").alias("pos", "len"))
    return rows.select("w", F.sum(F.col("len").cast("long")).over(up_to).alias("end"), F.col("pos").alias(f"to_{side}"))


def group_tokens(tokens: DataFrame) -> DataFrame:
    """w, grp, a, b: a row for each group of a word, with both sides' ids in order.

    ``tokens``: w (number of the text or word), a and b (arrays of structs of id and len). The equi-join gives the
    offsets where both sides end, a running count numbers them, and the ids between one and the next are
    the range of positions behind the one before. An inner join and windows by w keep the exchange by w.
    """
    n = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _ends(tokens, "a", n).join(_ends(tokens, "b", n), ["w", "end"])
    in_word = Window.partitionBy("w").orderBy("end")
    since = {side: F.coalesce(F.lag(f"to_{side}").over(in_word), F.lit(-1)).alias(f"from_{side}") for side in ("a", "b")}
    cuts = cuts.select("w", F.row_number().over(in_word).alias("grp"), "to_a", "to_b", *since.values())
    ids = tokens.select("w", F.col("a")["id"].alias("ids_a"), F.col("b")["id"].alias("ids_b")).repartition(n, "w")

    def between(side: str) -> Column:
        return F.slice(f"ids_{side}", F.col(f"from_{side}") + 2, F.col(f"to_{side}") - F.col(f"from_{side}")).alias(side)

    return cuts.join(ids, "w").select("w", "grp", between("a"), between("b"))


def _counted(ids: str) -> Column:
    """The distinct ids of a list, and how often each comes up."""
    return F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), F.size(F.filter(ids, lambda y: y == x)).cast("long").alias("n")))


def _pairs() -> Column:
    """Linked ids of a group with their number: pair is a * 2^32 + b."""

    def pair(a: Column, b: Column) -> Column:
        return (F.shiftleft(a.cast("long"), 32) + b).alias("pair")

    one = F.array(F.struct(pair(F.get("a", F.lit(0)), F.get("b", F.lit(0))), F.lit(1).cast("long").alias("n")))
    many = F.flatten(F.transform(_counted("a"), lambda x: F.transform(_counted("b"), lambda y: F.struct(pair(x["id"], y["id"]), (x["n"] * y["n"]).alias("n")))))
    return F.when((F.size("a") == 1) & (F.size("b") == 1), one).otherwise(many)


def link_tokens(grouped: DataFrame) -> DataFrame:
    """w, pair, n: how often tokens a and b share a group."""
    return grouped.select("w", F.explode(_pairs()).alias("x")).groupBy("w", "x.pair").agg(F.sum("x.n").alias("n"))


def _texts() -> list[Column]:
    """Aggregates of a word's groups: their text and sizes."""
    a, b = (F.array_join(F.col(side).cast("array<string>"), ",") for side in ("a", "b"))
    listed = F.concat(a, F.lit("|"), b)
    text = F.array_join(F.sort_array(F.collect_list(F.struct("grp", listed.alias("text"))))["text"], ";")
    return [text.alias("groups"), F.sum(F.size("a")).alias("n_a"), F.sum(F.size("b")).alias("n_b"), F.count("*").alias("n_groups")]


def group_texts(grouped: DataFrame) -> DataFrame:
    """w, groups (``a1,a2|b1;a3|b2,b3``), n_a, n_b, n_groups."""
    return grouped.groupBy("w").agg(*_texts())


def align_words(tokens: DataFrame) -> DataFrame:
    """w, groups, n_a, n_b, n_groups, n_links, links (pair and n by group) of each word with tokens.

    A pair that several groups of a word hold is in ``links`` once for each.
    """
    links = F.flatten(F.collect_list(_pairs()))
    found = group_tokens(tokens).groupBy("w").agg(*_texts(), links.alias("links"))
    return found.withColumn("n_links", F.aggregate("links", F.lit(0).cast("long"), lambda total, x: total + x["n"]))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and row ends (from 0) of a list column."""
    col = table.column(name).combine_chunks()
    col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0), np.int64)
    return np.asarray(col.flatten(), np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _pairs_of_block(docs: pa.Table, words: pa.Table) -> pa.Table:
    """How many documents of a block hold each pair linked."""
    words = words.sort_by("nth")
    flat, ends = _lists(words, "pairs")
    kinds, flat = np.unique(flat, return_inverse=True)
    bad = words.column("bad").to_numpy().astype(bool)
    del words
    ix, rows = _unpacked(docs)
    n, w, k = docs.num_rows, max(len(bad), 1), max(len(kinds), 1)
    total = np.zeros(k, np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + STEP, "right")) - 1)
        here = ix[rows[at] : rows[to]]
        doc = np.repeat(np.arange(to - at), np.diff(rows[at : to + 1]))
        out = np.zeros(to - at, bool)
        out[doc[bad[here]]] = True
        both = np.unique((doc * w + here)[~out[doc]])
        doc, here = np.divmod(both, w)
        sizes = ends[here + 1] - ends[here]
        spots = np.repeat(ends[here] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(here) else np.zeros(0, np.int64)
        held = np.unique(np.repeat(doc, sizes) * k + flat[spots])
        total += np.bincount(held % k, minlength=k)
        at = to
    some = total > 0
    give_back()
    return pa.table({"pair": pa.array(kinds[some[: len(kinds)]], pa.int64()), "n": pa.array(total[some], pa.int64())})


#: What a word adds to its documents; the rest is in the text of its groups.
SUMS = ("n_a", "n_links", "n_best", "count_sum")


def _docs_of_block(keep_text: bool) -> callable:
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("nth")
        groups = words.column("groups").to_pylist()
        bad = np.array([g is None for g in groups], bool)
        sums = {c: np.asarray(words.column(c), np.int64) for c in SUMS}
        sums["n_groups"] = np.array([g.count("|") if g else 0 for g in groups], np.int64)
        sums["n_b"] = np.array([g.count(",") if g else 0 for g in groups], np.int64) + 2 * sums["n_groups"] - sums["n_a"]
        del words
        ix, rows = _unpacked(docs)
        out: dict[str, list] = {c: [] for c in sums}
        digests, texts = [], []
        for i in range(docs.num_rows):
            here = ix[rows[i] : rows[i + 1]]
            if not len(here) or bad[here].any():
                text, here = "", here[:0]
            else:
                text = ";".join(map(groups.__getitem__, here.tolist()))
            for c, of_word in sums.items():
                out[c].append(int(of_word[here].sum()))
            digests.append(hashlib.sha256(text.encode()).hexdigest() if len(here) else "")
            if keep_text:
                texts.append(text)
        columns = {"doc_id": docs.column("doc_id"), **{c: pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}, "groups_sha256": pa.array(digests, pa.string())}
        if keep_text:
            columns["groups"] = pa.array(texts, pa.string())
        give_back()
        return pa.table(columns)

    return run


def align_documents(docs: DataFrame, files: tuple[str, str] | None = None, groups: bool = False) -> DataFrame:
    """A row for each document: tokens, groups and links of both tokenizers, and a digest of the groups.

    ``docs``: doc_id and text. ``files``: paths of a byte-level BPE file and of a piece model. ``groups``: the
    groups' text too (``a1,a2|b1;a3|b2,b3``, ids in decimal).
    """
    spark = docs.sparkSession
    data = tuple(open(f, "rb").read() for f in files or default_pair())  # read by the driver; executors get the bytes
    scratch = Scratch(spark, "align")
    fine = spark.sparkContext.broadcast(fine_cut(pieces_of(data[1])))
    cut = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _blocks(fine), BLOCKS).withColumn("of", F.when(F.isnull("nth"), "docs").otherwise("words"))
    cut.write.option("compression", "zstd").partitionBy("of").parquet(f"{scratch.path}/blocks")
    scratch.make("blocks/of=docs", "blocks/of=words")
    held = cut.drop("of").schema
    rows = scratch.read("blocks/of=docs", held).select("block", "doc_id", "n", "ix")
    words = scratch.read("blocks/of=words", held).select("block", "nth", "word")
    tokens = scratch.write(encode_words(words.select("word").distinct(), data).withColumn("w", F.monotonically_increasing_id()), "tokens")
    places = scratch.write(words.join(tokens.select("word", "w", "bad"), "word").select("block", "nth", "w", "bad"), "places")
    scratch.drop("blocks/of=words")
    free_shuffles(spark)
    before = {c: spark.conf.get(c, None) for c in BY_WORD}
    for c, value in BY_WORD.items():
        spark.conf.set(c, value)
    try:
        aligned = scratch.write(align_words(tokens), "aligned")
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    scratch.drop("tokens")
    free_shuffles(spark)
    # The documents that hold each pair, by block and then over all.
    by_block = places.join(aligned.select("w", F.col("links.pair").alias("pairs")), "w", "left").drop("w")
    counts = rows.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(_pairs_of_block, "pair long, n long")
    counts = scratch.write(counts.groupBy("pair").agg(F.sum("n").alias("docs")), "counts")
    free_shuffles(spark)
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    best = scratch.write(counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "best")
    if best.count() <= BROADCAST_PAIRS:
        best = F.broadcast(best)
    # What a word adds to its documents.
    told = aligned.select("w", F.explode("links").alias("x")).select("w", "x.pair", "x.n").join(best, "pair")
    told = told.groupBy("w").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in SUMS]
    adds = scratch.write(aligned.select("w", "groups", "n_a", "n_links").join(told, "w", "left").select("w", "groups", *sums), "adds")
    scratch.drop("aligned", "counts", "best")
    # Blocks get their words in rounds, so that a share of them is on its way at a time.
    for k in range(ROUNDS):
        free_shuffles(spark)
        here = F.pmod(F.shiftright("block", 32) + F.col("block"), F.lit(ROUNDS)) == k
        by_block = places.where(here).join(adds, "w", "left")
        by_block = by_block.select("block", "nth", F.when(~F.col("bad"), F.coalesce("groups", F.lit(""))).alias("groups"), *sums)
        out = rows.where(here).groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(_docs_of_block(groups), RESULT + ", groups string" * groups)
        scratch.append(out, "result")
    scratch.drop("blocks", "places", "adds")
    free_shuffles(spark)
    return scratch.read("result", out.schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
