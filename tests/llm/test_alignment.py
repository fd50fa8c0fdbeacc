"""Cross-tokenizer alignment against whole texts encoded by the tokenizers' own libraries."""

import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from scribeflow.llm import token_alignment

SF = "/root/testdata/sf0.001"


def plain_tokens(texts):
    """(A ids and ends, B ids and ends) of each whole text, or None."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = {}
    free = 0
    for x in range(256):
        if chr(x).isprintable() and not chr(x).isspace() and x != 0xAD:
            chars[chr(x)] = x
        else:
            chars[chr(256 + free)] = x
            free += 1
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        want = (" " + t).encode()
        ids_a = a.encode(" " + t, add_special_tokens=False).ids
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(t)
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        out.append((ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == b"".join(bytes_b) == want else None)
    return out


def plain_alignment(texts):
    links, shape = [], []
    for found in plain_tokens(texts):
        groups = []
        if found:
            ids_a, bytes_a, ids_b, bytes_b = found
            i = j = x = y = 0
            one, two = [], []
            while i < len(ids_a) or j < len(ids_b):
                if x <= y and i < len(ids_a):
                    x += len(bytes_a[i])
                    one.append(ids_a[i])
                    i += 1
                else:
                    y += len(bytes_b[j])
                    two.append(ids_b[j])
                    j += 1
                if x == y:
                    groups.append((one, two))
                    one, two = [], []
        shape.append(groups)
        links.append(Counter((p, q) for one, two in groups for p in one for q in two))
    held = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    rows = []
    for groups, c in zip(shape, links):
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        rows.append(
            (
                sum(len(one) for one, _ in groups),
                sum(len(two) for _, two in groups),
                len(groups),
                sum(c.values()),
                sum(n for (p, q), n in c.items() if held[p, q] == best[p]),
                sum(n * held[pair] for pair, n in c.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter(zip([d for d, _ in docs], plain_alignment([t for _, t in docs])))
    got = Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in token_alignment.op13_token_alignment(spark, folder).collect())
    assert got == want


def test_op13_odd_texts(spark, sf):
    check(spark, sf)


def test_op13_whole_table(spark):
    check(spark, SF)


ODD = [
    "", " ", "  ", " x ", "a  b   c", "\n\n x\n y \n", "    x  y", "\x1c a\x1c b", "it's they'll 'tis", "<|endoftext|> x<|endoftext|>", "<s> </s> <unk> <0x0A>", "a▁b", "▁", "日本語のテキスト です",
    "é́ ß ☃ 😀😀 x😀", "\x00 a\x00", "..., !!! ### +1 (499) 555-6503", "x" * 3000, " " * 700 + "y", "1234567 89", "\r\n a\r b", "\u0085 a\u0085 b", "Ünïcode　 wide",
]


def test_op13_white_space_and_marks(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(ODD)] + [(0, ODD[4], "x", 0), (None, ODD[4], "x", 0), (None, None, "x", 0)], "doc_id long, text string, block string, w long")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = token_alignment.align_documents(df, groups=True)
    got = Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in found.collect())
    assert got == Counter(zip([d for d, _ in rows], plain_alignment([t for _, t in rows])))
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in found.collect())


def test_op13_small_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7, t * (1 + i % 3), i) for i, t in enumerate(ODD * 4)], "doc_id long, text string, nth int").repartition(1)
    want = sorted(map(tuple, token_alignment.align_documents(df).collect()))
    monkeypatch.setattr(token_alignment, "BLOCK_CHARS", 50)
    monkeypatch.setattr(token_alignment, "STEP", 3)
    assert sorted(map(tuple, token_alignment.align_documents(df).collect())) == want


def test_op13_groups_within_a_text(spark):
    """Groups and links of hand-made tokens: ends 2, 5, 6, 9 and 2, 3, 6, 9."""
    kind = "array<struct<id:int,len:int>>"
    tokens = spark.createDataFrame([(1, [(7, 2), (8, 3), (9, 1), (7, 3)], [(4, 2), (5, 1), (6, 3), (4, 3)]), (2, [], [])], f"w long, a {kind}, b {kind}")
    grouped = token_alignment.group_tokens(tokens)
    assert {(r["w"], r["groups"], r["n_a"], r["n_b"], r["n_groups"]) for r in token_alignment.group_texts(grouped).collect()} == {(1, "7|4;8,9|5,6;7|4", 4, 4, 3)}
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF, r["n"]) for r in token_alignment.link_tokens(grouped).collect()} == {(7, 4, 2), (8, 5, 1), (8, 6, 1), (9, 5, 1), (9, 6, 1)}


def test_op13_documents_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in token_alignment.align_documents(docs).collect())
    assert got == Counter((d, (0, 0, 0, 0, 0, 0, "")) for d in (1, 2, None))
    assert token_alignment.align_documents(docs.limit(0)).count() == 0


def test_op13_fine_cuts_follow_the_pieces():
    import re

    fine = re.compile(token_alignment.fine_cut(["▁the", "n't", "e.", ".,"]))
    assert fine.split(" ate. a.b,c\nD") == [" ate. a", ".b", ",c", "\n", "D"]
    assert re.compile(token_alignment.fine_cut(["a\n"])).split("x\ny z,") == ["x\ny z", ","]


def test_op13_refuses_other_tokenizers():
    a, b = token_alignment.default_pair()
    with open(a, "rb") as f, open(b, "rb") as g:
        conf, model = json.loads(f.read()), g.read()
    conf["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.load_pair(json.dumps(conf).encode(), model)
