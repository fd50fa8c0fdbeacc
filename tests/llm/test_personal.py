"""Personal data: base spans against the plain patterns, EM and classifier on known cases."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from scribeflow.llm import personal_data as pd_

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                ok = 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            elif kind == "phone":
                ok = 8 <= len(digits) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pd_.op11_personal_data(spark, folder).collect())
    want = Counter()
    for d, t in docs:
        spans = plain_base(t)
        n = Counter(s.split(":")[0] for s in spans)
        want[(d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert got == want


def test_op11_odd_texts(spark, sf):
    check(spark, sf)


def test_op11_whole_table(spark):
    check(spark, SF)


def test_op11_base_on_random_texts():
    rng = random.Random(4)
    alphabet = list("ab.@-+ 0123456789()%_\n") + ["é", "a@b.c", "4111 1111 1111 1111", "1.2.3.4", "+1 555 123 4567", "256.1.1.1", "５"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
        spans, _ = pd_.base_spans(text)
        assert pd_.written(spans) == ",".join(plain_base(text)), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a.b-" * 80_000 + "@", "@" * 200_000, "a@" * 150_000, "1 " * 150_000, "+" * 300_000, "a@b." * 80_000, "0:" * 100_000, "(at) " * 60_000])
def test_op11_long_texts_take_linear_time(text):
    began = time.thread_time()
    pd_.candidates(text)
    assert time.thread_time() - began < 20


def test_op11_adds_what_failed_as_a_whole(spark):
    """Two cards with a space between, a phone with an address behind it; decoys and clean texts stay as they are."""
    rng = random.Random(1)

    def card(ok=True):
        digits = [rng.randint(0, 9) for _ in range(15)]
        last = next(d for d in range(10) if pd_.luhn("".join(map(str, [*digits, d]))) == ok)
        return "".join(map(str, [*digits, last]))

    def phone():
        return f"+1 ({rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}"

    rows = [(i, f"words and more {card()} go on") for i in range(60)] + [(100 + i, f"a sum of {card(False)} here") for i in range(40)]
    rows += [(200 + i, f"ring {phone()} or so") for i in range(60)] + [(300 + i, f"see user{i}@mail.example.com now, from 10{i % 9}.20.30.{i}") for i in range(40)]
    one, two, tel = card(), card(), phone()
    rows += [(500, f"both {one} {two} end"), (501, f"at {tel} 170.106.47.218 end"), (502, "nothing of the kind, 12 boats and 3.5 tons in 2024"), (503, ""), (504, None), (500, "clean"), (None, f"x {one}")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    found = [r.asDict(recursive=True) for r in pd_.find_personal(df, masked=True).collect()]
    assert len(found) == len(rows)
    texts = {(d, t) for d, t in rows}
    added = {r["doc_id"]: [x for x in r["spans"] if not x["base"]] for r in found if any(not x["base"] for x in r["spans"])}
    by = {d: t for d, t in texts if d in (500, 501) and t != "clean"}
    assert {by[500][x["start"] : x["end"]] for x in added.pop(500)} == {one, two}
    assert {by[501][x["start"] : x["end"]] for x in added.pop(501)} == {tel}
    assert not added
    masked = {r["doc_id"]: r["masked"] for r in found}
    assert masked[501] == "at <PHONE> <IP> end" and masked[502] == by.get(502, "nothing of the kind, 12 boats and 3.5 tons in 2024") and masked[504] == ""


def test_op11_em_finds_reliabilities():
    rng = np.random.default_rng(3)
    good, bad = np.array([0.95, 0.9, 0.55, 0.8, 0.7]), np.array([0.05, 0.2, 0.45, 0.1, 0.4])
    truth = rng.random(20_000) < 0.3
    yes = rng.random((20_000, 5)) < np.where(truth[:, None], good, bad)
    silent = rng.random((20_000, 5)) < 0.2
    votes = ["".join("-" if s else "y" if v else "n" for v, s in zip(a, b)) for a, b in zip(yes, silent)]
    chance, rates = pd_.weigh_votes({(2, v): n for v, n in Counter(votes).items()})
    assert np.abs(rates[2][:, 1] - good).max() < 0.05 and np.abs(rates[2][:, 0] - bad).max() < 0.05
    right = np.mean([(chance[2, v] > 0.5) == t for v, t in zip(votes, truth)])
    plain = np.mean([(v.count("y") > v.count("n")) == t for v, t in zip(votes, truth)])
    assert right > plain + 0.02


def test_op11_classifier_learns_from_probabilities():
    rows = [([1, 40, 50, 60, 70, 80, 130 + i], 0.98, 5) for i in range(20)] + [([2, 41, 50, 61, 71, 80, 130 + i], 0.03, 5) for i in range(20)]
    w = pd_.fit_spans(rows)
    score = lambda f: 1 / (1 + np.exp(-(w[f].sum() + w[-1])))
    assert score([1, 40, 50, 60, 70, 80, 400]) > 0.9 > 0.1 > score([2, 41, 50, 61, 71, 80, 400])
    assert not pd_.fit_spans([]).any()
