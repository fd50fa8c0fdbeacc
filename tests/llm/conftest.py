import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and river stone green light carries quiet morning over small harbour where boats wait for wind and rain to pass before they leave again with nets full of silver fish bound for markets far inland".split()


def sentence(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * (1 + k % 5)) % len(WORDS)] + (str((k * 31 + i) % 97) if i % 3 else "") for i in range(n))


def documents() -> list[tuple]:
    base = sentence(3, 80)
    near = base.split()
    near[40] = "changed"
    rows = [(i, sentence(i, 30 + i), "en", f"s{i % 4}") for i in range(1, 40)]
    rows += [(100, base, "en", "s1"), (101, base.upper(), "en", "s1"), (102, " ".join(near), "fr", "s2"), (103, "a b", "en", None), (104, "A  b\n", "en", None)]
    rows += [(105, None, None, "s1"), (106, "", "en", "s1"), (107, " \n\t ", "en", "s2"), (108, "one two three four", "en", "s9"), (109, "one\xa0two ▁ é ☃", "de", "s9")]
    rows += [(110, "x " * 30_000, "en", "s0"), (111, sentence(11, 3000), "en", "s0"), (7, sentence(7, 37), "en", "s3"), (None, sentence(50, 60), "en", "s1"), (None, None, None, None)]
    rows += [(112, "same line\nsame line\n" + "again and again and again and again and again and again " * 5, "en", "s2"), (113, "## $$ ** junk%% " * 12, "en", "s2")]
    return rows


def write(folder, docs, labels=(), pages=(), conversations=(), benchmark=()):
    text, long = pa.string(), pa.int64()
    cols = list(zip(*docs)) if docs else [(), (), (), ()]
    # Columns whose names operators use for themselves.
    more = {c: pa.array([i for i in range(len(docs))], long) for c in ("cls", "size", "pattern", "row", "part", "taken", "kept", "score", "n", "bucket", "before")}
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], long), "text": pa.array(cols[1], text), "lang": pa.array(cols[2], text), "source": pa.array(cols[3], text), **more}), f"{folder}/documents.parquet")
    cols = list(zip(*labels)) if labels else [(), ()]
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], long), "quality": pa.array(cols[1], pa.int32()), "toxic": pa.array([0] * len(cols[0]), pa.int32())}), f"{folder}/labels.parquet")
    cols = list(zip(*pages)) if pages else [(), (), ()]
    pq.write_table(pa.table({"page_id": pa.array(cols[0], long), "url": pa.array(cols[1], text), "html": pa.array(cols[2], text)}), f"{folder}/pages.parquet")
    cols = list(zip(*conversations)) if conversations else [(), (), (), ()]
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], long), "turn": pa.array(cols[1], long), "role": pa.array(cols[2], text), "text": pa.array(cols[3], text), "size": pa.array(list(range(len(cols[0]))), long)}), f"{folder}/conversations.parquet")
    cols = list(zip(*benchmark)) if benchmark else [(), ()]
    pq.write_table(pa.table({"item_id": pa.array(cols[0], long), "text": pa.array(cols[1], text), "doc_id": pa.array(list(range(len(cols[0]))), long)}), f"{folder}/benchmark.parquet")
    return str(folder)


CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s> there"), (1, 2, "assistant", "[INST]yes[/INST] <\\s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "a" * 5000), (None, 1, "assistant", "lone"), (3, None, None, "x"), (3, 2, "tool", "<s>\\"),
]
PAGES = [
    (1, "https://a.example/1", "<body><nav>menu</nav><div class='post post-1'><h1>T &amp; u</h1><p>Long  enough <b>bold</b> text here.<div class=ad>buy</div><p>two</div><footer>f</footer></body>"),
    (2, "https://a.example/2", "<body><nav>menu</nav><div class='post post-2'><p>Other text that is here</p></div><div class='comments'><p>very very long comment text that is longer than the rest</p></div></body>"),
    (3, None, None), (4, "x", ""), (5, "https://b.example", "plain &lt;text"), (5, "https://b.example", "plain &lt;text"), (6, "https://a.example/3", "<article><p>cut &am"), (None, "https://c.example/", "<p>" + "word " * 20_000),
]


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    docs = documents()
    labels = [(d[0], int(d[0] % 3 > 0)) for d in docs if d[0] is not None] + [(9999, 1), (None, 1)]
    return write(tmp_path_factory.mktemp("sf"), docs, labels, PAGES, CONVERSATIONS, [(1, "stone and river"), (1, "stone and river"), (None, None)])


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])
