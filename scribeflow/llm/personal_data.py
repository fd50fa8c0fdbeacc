"""Personal data in texts by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates of four kinds (email, ip, card, phone) are the base spans, which fixed patterns and checks give, and
spans of wider forms: parts of a match that failed as a whole (two card numbers with a space between, a phone number
with an address behind it), addresses written around the at sign, numbers without a plus. Five labelers say yes, no
or nothing about each: the base pattern, a checksum or range, a gazetteer (top-level domains, issuers, calling codes
with lengths, unicast ranges), words around, and the characters at the border.

How often each pattern of votes occurs is counted over all documents in Spark; expectation-maximisation over those
counts, at most 4 x 3^5 of them, estimates each labeler's reliability by kind and each pattern's probability. These
probabilities train a logistic span classifier on shape, border, neighbouring word and checks; it is fitted on
the ``TRAIN_ROWS`` most frequent combinations of features and votes with their counts. Spans beside the base are
added from ``THRESHOLD`` on, the best first where they overlap; base spans always stay and are never overlapped.

Texts are read once; votes and features go with their document's row, so that nothing is shuffled but counts.
All scanning takes time in proportion to the text's length.

Defined results: null and empty texts have no spans; rows with equal ids or texts and null ids are documents of
their own; offsets are code points, ends exclusive; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches

KINDS = ("email", "ip", "card", "phone")
#: Combinations of features and votes that train the classifier, most frequent first.
TRAIN_ROWS = 20_000
#: Probability from which a span beside the base is added.
THRESHOLD = 0.9

# Public lists that the gazetteer labeler knows.
TLDS = frozenset("com org net edu gov mil int info biz name io co dev app me tv ai eu uk de fr es it nl be ch at pl cz se no dk fi pt ie gr ru ua tr us ca mx br ar cl pe au nz jp cn kr in id th vn za ng ke eg il sa ae".split())
#: Calling code: digits of a national number.
CALLING = {"1": (10,), "7": (10,), "20": (9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "36": (8, 9), "39": (9, 10), "41": (9,), "43": (10, 11), "44": (10,), "45": (8,), "46": (7, 8, 9), "47": (8,), "48": (9,), "49": (10, 11), "51": (9,), "52": (10,), "54": (10, 11), "55": (10, 11), "56": (9,), "57": (10,), "61": (9,), "62": (9, 10, 11), "64": (8, 9), "65": (8,), "66": (9,), "81": (9, 10), "82": (9, 10), "84": (9, 10), "86": (11,), "90": (10,), "91": (10,), "351": (9,), "353": (9,), "358": (9, 10), "420": (9,)}
NEAR_YES = {
    0: frozenset("mail email e-mail contact write an correo courriel kontakt reply cc".split()),
    1: frozenset("ip host server address adresse client login from peer".split()),
    2: frozenset("card visa mastercard amex credit debit karte tarjeta carte cc payment".split()),
    3: frozenset("tel phone call fax mobile telefon teléfono téléphone whatsapp sms ring".split()),
}
NEAR_NO = frozenset("version section isbn issn order invoice build release chapter page figure table row line id sku serial rfc article total sum hash token commit".split())

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|-(?=[^\W\d_]))*")

# Wider forms. Their repetitions are bounded, so that each search is linear in the text.
AT_MARK = re.compile(r"[(\[{<] ?at ?[)\]}>]", re.IGNORECASE)
AROUND = re.compile(r"([\w.%+-]{1,64}) ?[(\[{<] ?at ?[)\]}>] ?([\w-]{1,63}(?: ?(?:\.|[(\[{<] ?dot ?[)\]}>]) ?[\w-]{1,63}){1,5})", re.IGNORECASE)
WIDE_EMAIL = re.compile(r"[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,5}")
SIX = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")
CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
PHONE_PART = re.compile(r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{2,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])")
NO_PLUS = re.compile(r"(?<![\w+.,-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w.-]|,[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain; each at sign is looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        end = found.end() if found else at + 1
        at = text.find("@", end)
    return out


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of base spans, and of matches of the patterns that fail their checks."""
    good, failed = [(0, a, b) for a, b in _emails(text)], []
    for m in IP.finditer(text):
        (good if _octets(m[0]) else failed).append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            (good if 16 <= len(digits) <= 19 and luhn(digits) else failed).append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            (good if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15 else failed).append((3, m.start(), m.end()))
    return good, failed


def _wider(text: str, failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, form) of candidates beside the base; form 0 is the base."""
    out = []
    for kind, a, b in failed:
        part = CARD_PART if kind == 2 else PHONE_PART if kind == 3 else None
        if part:
            out += [(kind, m.start(), m.end(), 1) for m in part.finditer(text, a, b)]
        if kind != 3:  # as it failed
            out.append((kind, a, b, 2))
    if AT_MARK.search(text):
        out += [(0, m.start(), m.end(), 3) for m in AROUND.finditer(text)]
    at = text.find("@")
    while at >= 0:  # letters beyond ASCII
        found = WIDE_EMAIL.search(text, max(0, at - 64), min(len(text), at + 400))
        if found and found.start() < at < found.end():
            out.append((0, found.start(), found.end(), 4))
        at = text.find("@", at + 1)
    if ":" in text:
        out += [(1, m.start(), m.end(), 5) for m in SIX.finditer(text)]
    out += [(3, m.start(), m.end(), 6) for m in NO_PLUS.finditer(text)]
    return out


def _issuer(digits: str) -> bool:
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return digits[0] == "4" and n in (13, 16, 19) or (51 <= two <= 55 or 2221 <= four <= 2720) and n == 16 or two in (34, 37) and n == 15 or (two in (60, 62, 64, 65, 35) and 16 <= n <= 19) or two in (30, 36, 38) and n == 14


def _votes(text: str, kind: int, start: int, end: int, form: int) -> tuple[str, str]:
    """Votes of the five labelers (y, n or -), and the nearest word before."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9") if kind > 1 else ""
    yes = lambda x: "y" if x else "n"
    if kind == 0:
        plain = re.sub(r" ?[(\[{<] ?dot ?[)\]}>] ?", ".", re.sub(r" ?[(\[{<] ?at ?[)\]}>] ?", "@", s, flags=re.IGNORECASE), flags=re.IGNORECASE)
        local, _, host = plain.partition("@")
        labels = host.split(".")
        check = yes(local[:1] not in ".-" and ".." not in local and all(x and x[0] != "-" and x[-1] != "-" for x in labels) and labels[-1].isalpha() and len(labels[-1]) > 1)
        known = yes(labels[-1].lower() in TLDS)
    elif kind == 1:
        check = yes(form == 5 or _octets(s))
        first = s.partition(".")[0].lstrip("0")
        known = "-" if form == 5 else yes(0 < len(first) <= 3 and int(first) <= 223 and first not in ("10", "127"))
    elif kind == 2:
        check = yes(13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1)
        known = yes(_issuer(digits))
    else:
        check = yes(8 <= len(digits) <= 15)
        code = next((c for n in (1, 2, 3) if (c := digits[:n]) in CALLING), None)
        known = "-" if s[0] != "+" else yes(code is not None and len(digits) - len(code) in CALLING[code])
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])]
    near = before[-3:] + [w.lower() for w in WORD.findall(text[end : end + 20])][:1]
    context = "y" if NEAR_YES[kind].intersection(near) else "n" if NEAR_NO.intersection(near) else "-"
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    border = yes(not (left.isalnum() or left in ("_", "+", "@") and left) and not (right.isalnum() or right in ("_", "@") and right))
    return ("y" if form == 0 else "-") + check + known + context + border, before[-1] if before else ""


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5 if c in "()[]{}<>\"'" else 6


FEATURES = 7
DIM = 4 * 512


def _features(text: str, kind: int, start: int, end: int, form: int, votes: str, word: str) -> list[int]:
    """A place in its own range for each of the features of a span; ranges are repeated by kind."""
    s = text[start:end]
    digits = min(24, sum("0" <= c <= "9" for c in s))
    found = (digits, 32 + _class(text[start - 1 : start] if start else ""), 40 + _class(text[end : end + 1]), 48 + min(7, sum(c in " -().:" for c in s)), 56 + 3 * "yn-".index(votes[1]) + "yn-".index(votes[2]), 72 + "yn-".index(votes[3]), 128 + xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % 256)
    return [512 * kind + x for x in found]


def candidates(text: str | None) -> list[tuple[int, int, int, int, str, list[int]]]:
    """(kind, start, end, form, votes, features), base spans first."""
    if not text:
        return []
    good, failed = base_spans(text)
    held = [(*x, 0) for x in good]
    taken = sorted((a, b) for _, a, b in good)
    starts = [a for a, _ in taken]
    # The furthest end of the base spans up to each, as spans of different kinds may overlap.
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for kind, a, b, form in sorted(set(_wider(text, failed))):
        i = int(np.searchsorted(starts, b)) - 1
        if i < 0 or ends[i] <= a:
            held.append((kind, a, b, form))
    out = []
    for kind, a, b, form in held:
        votes, word = _votes(text, kind, a, b, form)
        out.append((kind, a, b, form, votes, _features(text, kind, a, b, form, votes, word)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


CANDS = "array<struct<kind:int,start:int,end:int,form:int,votes:string,feats:array<int>>>"


def _scan(keep_text: bool):
    names = ("kind", "start", "end", "form", "votes", "feats")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [candidates(t) for t in batch.column("text").to_pylist()]
        out = {"doc_id": batch.column("doc_id"), "cands": [[dict(zip(names, c)) for c in cs] for cs in found]}
        yield out | ({"text": batch.column("text")} if keep_text else {})

    return run


def weigh_votes(patterns: dict[tuple[int, str], int], rounds: int = 100) -> tuple[dict[tuple[int, str], float], dict[int, np.ndarray]]:
    """EM over counts of vote patterns by kind: each pattern's probability, and reliabilities (labeler, class no or yes: share of yes votes)."""
    chance: dict[tuple[int, str], float] = {}
    rates: dict[int, np.ndarray] = {}
    for kind in sorted({k for k, _ in patterns}):
        keys = sorted(v for k, v in patterns if k == kind)
        n = np.array([patterns[kind, v] for v in keys], float)
        yes = np.array([[c == "y" for c in v] for v in keys], float)
        no = np.array([[c == "n" for c in v] for v in keys], float)
        cast = yes.sum(1) + no.sum(1)
        p = 0.5 + 0.45 * (yes.sum(1) - no.sum(1)) / np.maximum(cast, 1)
        for _ in range(rounds):
            share = (2 + n @ p) / (4 + n.sum())
            # Each labeler is held to be better than chance by a few imagined votes.
            good = (8 + (n * p) @ yes) / (10 + (n * p) @ (yes + no))
            bad = (2 + (n * (1 - p)) @ yes) / (10 + (n * (1 - p)) @ (yes + no))
            a = np.log(share) + yes @ np.log(good) + no @ np.log1p(-good)
            b = np.log1p(-share) + yes @ np.log(bad) + no @ np.log1p(-bad)
            p = 1 / (1 + np.exp(np.clip(b - a, -60, 60)))
        chance |= {(kind, v): float(x) for v, x in zip(keys, p)}
        rates[kind] = np.stack([bad, good], 1)
    return chance, rates


def fit_spans(rows: list[tuple[list[int], float, int]], steps: int = 300) -> np.ndarray:
    """Logistic weights (the last is the intercept) from (features, probability, count)."""
    w = np.zeros(DIM + 1)
    if not rows:
        return w
    ix = np.array([r[0] for r in rows])
    p, n = np.array([r[1] for r in rows]), np.log1p(np.array([r[2] for r in rows], float))
    n /= n.sum()
    speed = np.full(DIM + 1, 1e-8)
    for _ in range(steps):
        e = n * (1 / (1 + np.exp(-np.clip(w[ix].sum(1) + w[-1], -30, 30))) - p)
        g = np.bincount(ix.ravel(), np.repeat(e, FEATURES), DIM + 1)
        g[-1] = e.sum()
        g[:-1] += 1e-5 * w[:-1]
        speed += g * g
        w -= 0.3 * g / np.sqrt(speed)
    return w


def _decide(weights, keep_text: bool):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        w = weights.value
        out: dict[str, list] = {c: [] for c in ("base", "spans", "masked")}
        texts = batch.column("text").to_pylist() if keep_text else [None] * batch.num_rows
        for cands, text in zip(batch.column("cands").to_pylist(), texts):
            base = [c for c in cands if c["form"] == 0]
            rest = [(float(1 / (1 + np.exp(-np.clip(w[c["feats"]].sum() + w[-1], -30, 30)))), c) for c in cands if c["form"]]
            spans = [{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "score": 1.0, "base": True} for c in base]
            new: list[dict] = []
            for score, c in sorted(rest, key=lambda x: (-x[0], x[1]["start"] - x[1]["end"], x[1]["start"], x[1]["kind"])):
                if score >= THRESHOLD and c["votes"][1] != "n" and all(c["end"] <= x["start"] or x["end"] <= c["start"] for x in new):
                    new.append({"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "score": score, "base": False})
            spans = sorted(spans + new, key=lambda x: (KINDS.index(x["kind"]), x["start"], x["end"]))
            out["spans"].append(spans)
            out["base"].append(written([(c["kind"], c["start"], c["end"]) for c in base]))
            if keep_text:
                done, at = [], 0
                for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                    if x["start"] >= at:
                        done += [(text or "")[at : x["start"]], f"<{x['kind'].upper()}>"]
                    at = max(at, x["end"])
                out["masked"].append("".join([*done, (text or "")[at:]]))
        columns = {"doc_id": batch.column("doc_id"), "base": out["base"], "spans": out["spans"]}
        yield columns | ({"masked": out["masked"]} if keep_text else {})

    return run


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def find_personal(docs: DataFrame, masked: bool = False) -> DataFrame:
    """doc_id, base (base spans as kind:start:end, joined), spans (all, with scores), and the text with spans masked where asked for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "personal")
    more = ", text string" * masked
    found = scratch.write(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan(masked), f"doc_id long, cands {CANDS}" + more), "found")
    each = found.select(F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.feats").groupBy("kind", "votes", "feats").agg(F.count("*").alias("n"))
    each = scratch.write(each, "each")
    patterns = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}  # at most 4 x 3^5
    chance, _ = weigh_votes(patterns)
    most = each.orderBy(F.desc("n"), "kind", "votes", "feats").limit(TRAIN_ROWS).collect()
    weights = spark.sparkContext.broadcast(fit_spans([(r["feats"], chance[r["kind"], r["votes"]], r["n"]) for r in most]))
    out = map_batches(found, _decide(weights, masked), f"doc_id long, base string, spans {SPANS}" + ", masked string" * masked)
    out = scratch.write(out, "result")
    weights.destroy()
    scratch.drop("found", "each")
    return out


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the base spans, ``spans`` has those added too."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def counted(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")

    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(counted, KINDS), F.sha2("base", 256).alias("base_sha256"), text.alias("spans"))
