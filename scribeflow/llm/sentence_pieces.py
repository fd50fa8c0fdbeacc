"""SentencePiece encoding and decoding by forward scores shared over a trie of words.

A text gets a space in front and is cut into marked words: a run of spaces with a run of characters that
pieces may join, such as letters or marks (``word_cut``). No piece crosses such a cut, so that words are
encoded alone and each distinct one once. Distinct new words of a batch are sorted, which lays them out as a
depth-first walk of their trie; the forward table over a word's prefixes is kept down to the prefix it shares
with the word before. The pieces that may end a prefix are listed by its longest end that begins a piece
(``_node``), the step from one such end to the next by its character.

Unigram models: the forward score of a prefix is the best sum of piece scores (Viterbi). Models of
merges (BPE): a prefix has just one valid last piece, the one that is compatible with the last piece of
the prefix before it, since merging a text leaves the merges of its prefixes alone up to a piece's end;
the forward table holds that piece, and walking back gives what merging by score gives. The best sum of
scores is not that, so for merge models the walk is exact where plain Viterbi is not.

Characters without a piece fall back to bytes, the literal U+2581 too, so that decoding gives every
text back exactly.

Defined results: null and empty texts have no pieces and decode to the empty text; rows with equal ids or
texts are encoded each; in ``tokenize_documents`` other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

MARK = "▁"
#: Bytes of words and pieces that a task remembers before it starts anew.
REMEMBER = 16_000_000
#: Pairs of pieces, and steps between ends of prefixes, that a worker remembers of a vocabulary before it starts anew.
REMEMBER_PAIRS, REMEMBER_STEPS = 300_000, 100_000
#: Groups of characters that get a run of their own in ``word_cut``; the others share one.
GROUPS = 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """A vocabulary read from a model file, with what the walk needs."""

    merges: bool
    score: dict[str, float]
    ids: dict[str, int]
    text: list[bytes]
    byte_ids: list[int]
    prefix: bool
    unknown: int
    longest: int
    chars: frozenset[str]
    cut: re.Pattern
    rank: dict[str, float] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    codes: dict[str, int] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    splits: dict = field(default_factory=dict)
    alone: dict = field(default_factory=dict)
    nodes: dict = field(default_factory=dict)
    fits: dict = field(default_factory=dict)
    steps: int = 0
    pairs: int = 0
    words: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    held: int = 0

    def __post_init__(self) -> None:
        self.order = sorted(self.ids)
        #: Ids of pieces; -2 and below: characters that only longer pieces hold; -1: characters of no piece.
        self.codes = dict(self.ids) | {c: -2 - i for i, c in enumerate(sorted(self.chars - self.ids.keys()))}
        self.lengths = [1] * (len(self.text) + len(self.chars) + 1)
        for piece, code in self.codes.items():
            self.lengths[code] = len(piece)


def word_cut(pieces: Iterable[str]) -> re.Pattern:
    """Words of a text: spaces with what follows them as far as pieces may join it. Every character is in one word.

    Characters that stand side by side in a piece are of one group, so that no piece crosses from group to group;
    the ``GROUPS`` groups of most pieces are told apart. Characters that no piece joins go by three at most.
    """
    group: dict[str, str] = {}

    def find(c: str) -> str:
        while (up := group.setdefault(c, c)) != c:
            group[c] = c = group[up]
        return c

    weight: Counter[str] = Counter()
    line = "\n"
    for piece in pieces:
        line = "" if "\n" in piece else line
        bare = piece.lstrip(" ")
        for a, b in zip(bare, bare[1:]):
            group[find(a)] = find(b)
        weight.update(bare[:1] * (len(bare) > 1))
    members: dict[str, list[str]] = {}
    for c in sorted(group):
        members.setdefault(find(c), []).append(c)
    groups = sorted(members.values(), key=lambda m: (-sum(weight[c] for c in m), m))
    runs = [*groups[:GROUPS], *filter(None, [list(chain.from_iterable(groups[GROUPS:]))])]
    joined = [re.escape("".join(m)) for m in runs]
    runs = [f"[{m}]+" for m in joined] + [f"[^ {line}{''.join(joined)}]{{1,3}}"]
    return re.compile(f" *(?:{'|'.join(runs)})| +" + (f"|{line}" if line else ""))


def load(data: bytes) -> Pieces:
    """The vocabulary of a serialised model, unigram or BPE, with identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(data)
    kind = model.trainer_spec.model_type
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models can be walked")
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a model that normalises its input can't be decoded exactly")
    score, ids, text, byte_ids, unknown = {}, {}, [], [-1] * 256, 0
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[1:-1], 16)] = i
            text.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type in (1, 4):
            word = p.piece.replace(MARK, " ")
            if " " in word.lstrip(" "):
                raise ValueError(f"the piece {p.piece!r} crosses words")
            score[word], ids[word] = p.score, i
            text.append(word.encode())
        else:
            unknown = i if p.type == 2 else unknown
            text.append(b"")
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte fallback")
    chars = frozenset(c for w in ids for c in w)
    return Pieces(kind == 2, score, ids, text, byte_ids, model.normalizer_spec.add_dummy_prefix, unknown, max(map(len, ids)), chars, word_cut(ids), {w: -x for w, x in score.items() if len(w) > 1})


def merge(p: Pieces, word: str, until: int = 1) -> list[str]:
    """The pieces of a word by merging neighbours, best score first, then leftmost; stops at ``until`` pieces."""
    parts = list(word)
    while len(parts) > until:
        best = max(((p.score[m], -i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in p.score), default=None)
        if best is None:
            break
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _split(p: Pieces, piece: str) -> tuple[str, str] | None:
    """The two parts that a piece's last merge joins; None for a single character."""
    if len(piece) == 1:
        return None
    known = p.splits.get(piece)
    if known is None:
        known = p.splits[piece] = tuple(merge(p, piece, 2))
    return known


def _compatible(p: Pieces, left: str, right: str) -> bool:
    """Whether merging left + right ends in just these two, which both stand when merged alone.

    Goes back through the merges on both sides of the border, latest first: the two are apart at the end
    unless some pair across the border was due before a merge on either side took one of it away.
    """
    rank, due = p.rank, np.inf
    a, b = left, right
    while True:
        m = rank.get(a + b)
        if m is not None and m < due:
            break
        ra, rb = (rank[a] if len(a) > 1 else -1.0), (rank[b] if len(b) > 1 else -1.0)
        if ra < 0 and rb < 0:
            return True
        if ra > rb:
            due, a = ra, _split(p, a)[1]
        else:
            due, b = rb + 0.5, _split(p, b)[0]  # of equal merges the left one is first
    return False


def _node(p: Pieces, text: str) -> tuple[dict, tuple, str]:
    """The longest end of ``text`` that begins a piece, the pieces that end it, and steps from it by a character.

    Pieces are told longest first, with length, code and score (unigram models); for models of merges only those
    longer than a character that merging leaves whole, with codes of pieces before them that they are known to
    be compatible with or not.
    """
    while (i := bisect_left(p.order, text)) == len(p.order) or not p.order[i].startswith(text):
        text = text[1:]
    known = p.nodes.get(text)
    if known is None:
        ends = []
        for at in range(len(text)):
            piece = text[at:]
            if not p.merges:
                if piece in p.score:
                    ends.append((len(piece), p.codes[piece], p.score[piece]))
            elif piece in p.rank:
                alone = p.alone.get(piece)
                if alone is None:
                    alone = p.alone[piece] = merge(p, piece) == [piece]
                if alone:
                    ends.append((len(piece), p.codes[piece], p.fits.setdefault(p.codes[piece], {})))
        known = p.nodes[text] = ({}, tuple(ends), text)
    return known


def _forget_steps(p: Pieces) -> None:
    for node in p.nodes.values():
        node[0].clear()
    p.nodes.clear()
    p.steps = 0


def _forget_pairs(p: Pieces) -> None:
    for fits in p.fits.values():
        fits.clear()
    p.pairs = 0


def encode_words(p: Pieces, words: list[str]) -> dict[str, array]:
    """Piece ids of each of the distinct ``words``, walking them in order as a trie."""
    out: dict[str, array] = {}
    size = max(map(len, words), default=0) + 1
    #: For each prefix length: the node, the code of the last piece, and the forward score (unigram models).
    nodes, last, total = [_node(p, "")] * size, [-1] * size, [0.0] * (1 if p.merges else size)
    codes, lengths, merges = p.codes, p.lengths, p.merges
    worst = min(p.score.values(), default=0.0) - 10.0
    before = ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        before = word
        node, i = nodes[shared], shared
        for c in word[shared:]:
            i += 1
            step = node[0].get(c)
            if step is None:
                if p.steps >= REMEMBER_STEPS:
                    _forget_steps(p)
                step = _node(p, node[2] + c)
                if c in p.chars:  # other characters are too many to keep
                    node[0][c] = step
                    p.steps += 1
            nodes[i] = node = step
            if merges:
                for n, code, fits in node[1]:
                    left = last[i - n]
                    if left == -1:
                        break
                    fit = fits.get(left)
                    if fit is None:
                        if p.pairs >= REMEMBER_PAIRS:
                            _forget_pairs(p)
                        fit = fits[left] = _compatible(p, word[i - n - lengths[left] : i - n], word[i - n : i])
                        p.pairs += 1
                    if fit:
                        break
                else:
                    code = codes.get(c, -1)
            else:
                best, code = -np.inf, codes.get(c, -1)
                for n, piece, score in node[1]:
                    if total[i - n] + score > best:
                        best, code = total[i - n] + score, piece
                total[i] = best if best > -np.inf else total[i - 1] + worst
            last[i] = code
        ids = []
        while i:
            code = last[i]
            ids.append(code)
            i -= lengths[code]
        ids.reverse()
        if min(ids, default=0) < 0:
            ids = _with_bytes(p, word, ids)
        out[word] = array("i", ids)
    return out


def _with_bytes(p: Pieces, word: str, codes: list[int]) -> list[int]:
    """The ids of a word's pieces, bytes of characters without a piece among them."""
    ids, at = [], 0
    for code in codes:
        n = p.lengths[code]
        ids += [code] if code >= 0 else [p.byte_ids[b] for b in word[at : at + n].encode("utf-8", "surrogatepass")]
        at += n
    return ids


def encode(p: Pieces, texts: list[str | None]) -> list[np.ndarray]:
    """Piece ids of each text as int32 arrays."""
    cut = [p.cut.findall((" " if p.prefix else "") + t) if t else [] for t in texts]
    if p.held > REMEMBER // 2:  # what hasn't come up since the last turn goes, so that frequent words stay
        p.older, p.words, p.held = p.words, {}, 0
    fresh = []
    for w in set(chain.from_iterable(cut)).difference(p.words):
        ids = p.older.get(w)
        if ids is None:
            fresh.append(w)
        else:
            p.words[w] = ids
            p.held += 200 + 2 * len(w) + len(ids)
    new = {w: ids.tobytes() for w, ids in encode_words(p, fresh).items()}
    p.words.update(new)
    p.held += 200 * len(new) + 2 * sum(map(len, new)) + sum(map(len, new.values()))
    get = p.words.__getitem__
    return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]


def decode(p: Pieces, ids: np.ndarray) -> str:
    """The text of piece ids; what ``encode`` gave comes back exactly."""
    raw = b"".join(map(p.text.__getitem__, ids.tolist()))
    if p.prefix and raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "surrogatepass")


_LOADED: dict[bytes, Pieces] = {}


def _loaded(data: bytes) -> Pieces:
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED[key] = load(data)
    return _LOADED[key]


def forget() -> None:
    """Empties what a task remembered of words; the vocabularies stay, with the pairs and steps met so far."""
    for p in _LOADED.values():
        p.words.clear()
        p.older.clear()
        p.held = 0


def tokenize_documents(docs: DataFrame, model_path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (where asked for), ids_sha256 of little-endian int32, text_sha256 of the decoded text, round_trip."""
    with open(model_path or default_model(), "rb") as f:  # read by the driver; executors get the bytes
        data = f.read()
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        p = _loaded(held.value)
        texts = batch.column("text").to_pylist()
        found = encode(p, texts)
        back = [decode(p, x) for x in found]
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) for x in found],
            "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found],
            "text_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
            "round_trip": [(t or "") == b for t, b in zip(texts, back, strict=True)],
        }
        if ids:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
        yield out

    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * ids + "ids_sha256 string, text_sha256 string, round_trip boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, forget=(forget,))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
