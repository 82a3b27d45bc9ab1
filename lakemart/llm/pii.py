"""Personal data: high-recall generators propose overlapping spans, boosted trees score them by format and context, and
a threshold calibrated for each kind selects what is redacted. Spans of the strict patterns are always selected.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.shared import cleared, written

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Where a run of one class of characters can't match from its first, it can't from a later one.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Generators: what may be personal data in some other format.
AT = re.compile(r"\s?(?:@|[(\[{]\s?at\s?[)\]}]|(?<=\s)at(?=\s))\s?", re.I)
LOCAL_LIKE = re.compile(r"[\w.%+-]{1,64}\Z")
DOMAIN_LIKE = re.compile(r"[\w-]{1,63}(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|(?<=\s)dot(?=\s))\s?[\w-]{1,63}){1,4}", re.I)
BREAK = re.compile(r"\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|(?<=\s)dot(?=\s))\s?", re.I)
IP_LIKE = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[.,·]\s?[0-9]{1,3}){3}(?![0-9])|(?<![0-9a-fA-F:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9a-fA-F:])")
CARD_LIKE = re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])")
PHONE_LIKE = re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])")
#: An address without an at sign needs one of these; without either no generator of addresses proposes anything.
BRACKETED, DOT = re.compile(r"[(\[{]\s?at\s?[)\]}]", re.I), re.compile("dot", re.I)
DIGITS_OR_COLON = re.compile("[0-9:]")
#: The ends of common domains.
ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "eu", "de", "fr", "es", "it", "uk", "us", "ch", "at", "nl")
#: Words that tell of a kind when they stand before it.
HINTS = {
    "email": re.compile(r"e-?mail|mailto|contact|write|correo|courriel|adresse", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|direcci", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|\btel|call|fax|mobil|ruf|appel|llam", re.I),
}
WINDOW = 40
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The strict patterns' matches, leftmost and non-overlapping for each kind; matches that fail their check are dropped."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and (text[left - 1].isascii() and text[left - 1].isalnum() or text[left - 1] in "._%+-"):
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            end = m.end()
            out.append(("email", left, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if least <= len(d := digits_of(m[0])) <= most and (kind == "phone" or luhn(d))]
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out: list[Span] = []
    for m in AT.finditer(text) if "@" in text or DOT.search(text) or BRACKETED.search(text) else ():
        left, right = LOCAL_LIKE.search(text, max(0, m.start() - 64), m.start()), DOMAIN_LIKE.match(text, m.end())
        if left and right and ("@" in m[0] or m[0].strip()[0] in "([{" or re.search(r"\bdot\b", right[0], re.I)):
            breaks = [x.start() for x in BREAK.finditer(text, m.end(), right.end())][1:]  # where what may be the domain's end could be the next sentence
            out += [("email", left.start(), end) for end in (right.end(), *reversed(breaks))]
    if DIGITS_OR_COLON.search(text):
        for kind, pattern in (("ip", IP_LIKE), ("card", CARD_LIKE), ("phone", PHONE_LIKE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    kind, a, b = span
    s, digits, groups = text[a:b], digits_of(text[a:b]), re.findall("[0-9]+", text[a:b])
    sizes = [len(g) for g in groups] or [0]
    beside = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(max(sizes)), float(min(sizes)),
        float(sizes[0]), float(sizes[-1]), float(len({c for c in s if not c.isalnum()})), float(s[:1] == "+"), float("(" in s),
        float(s.count("@")), float(sum(c.isalpha() for c in s)), float(len(re.split(r"\W+", s)[-1])), float(s.count(".")),
        beside(text[a - 1 : a]), beside(text[b : b + 1]), float(bool(HINTS[kind].search(text, max(0, a - WINDOW), a))),
        float(len(digits) >= 12 and luhn(digits)), float(all(len(g) < 4 and int(g) < 256 for g in groups)), float(s.count(":")),
        float(re.split(r"\W+", s)[-1].lower() in ENDS), float(s.count(",")), float(sum(c.isspace() for c in s)), float(s.count("-")),
    ]


def _number(rnd: random.Random, n: int) -> str:
    return str(rnd.randint(1, 9)) + "".join(str(rnd.randint(0, 9)) for _ in range(n - 1))


def _card(rnd: random.Random, valid: bool) -> str:
    head = _number(rnd, 15)
    last = next(d for d in range(10) if luhn(f"{head}{d}"))
    digits = f"{head}{last if valid else (last + rnd.randint(1, 9)) % 10}"
    return rnd.choice(("", " ", "-", ".", "/", "_")).join(digits[k : k + 4] for k in range(0, 16, 4))


def _email(rnd: random.Random, word: Callable[[], str]) -> str:
    at, dot = rnd.choice((("@", "."), (" (at) ", " dot "), ("[at]", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" {at} ", "."), (" @ ", ".")))
    text = f"{word()}{rnd.choice(('', '.', '_', '-'))}{word()}{at}{word()}{dot}{rnd.choice(ENDS)}"
    return text.upper() if rnd.random() < 0.2 else text


def _phone(rnd: random.Random) -> str:
    a, b, c = _number(rnd, 3), _number(rnd, 3), _number(rnd, 4)
    area = rnd.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b} {c}"))
    return rnd.choice(("+1 ", "+44 ", "0049 ", "00 1 ", "1-", "", "")) + area


def planted(rnd: random.Random, kind: str, real: bool, word: Callable[[], str]) -> str:
    """Made-up personal data of a kind in one of its formats, or what only looks like it."""
    byte = lambda: str(rnd.randint(0, 255))
    if kind == "email":
        return _email(rnd, word) if real else rnd.choice((
            lambda: f"{_number(rnd, 2)} @ {_number(rnd, 1)}.{_number(rnd, 2)}", lambda: f"{word()} @ {word()} . {word()}", lambda: f"{word()} at {word()} dot {word()}ing",
            lambda: f"{word()} (at) {word()}", lambda: f"{word()} [at] {word()}. {word()}",
        ))()
    if kind == "ip":
        return rnd.choice((".", " . ", " .", ". ")).join(byte() for _ in range(4)) if real and rnd.random() < 0.7 else ":".join(f"{rnd.randrange(65536):x}" for _ in range(8)) if real else rnd.choice((
            lambda: ", ".join(byte() for _ in range(4)), lambda: ".".join(str(rnd.randint(256, 999) if k == rnd.randrange(4) else rnd.randint(300, 999)) for k in range(4)), lambda: ":".join(f"{rnd.randrange(256):02x}" for _ in range(8)), lambda: ",".join(_number(rnd, 3) for _ in range(4)),
        ))()
    if kind == "card":
        return _card(rnd, real)
    return _phone(rnd) if real else rnd.choice((
        lambda: _number(rnd, rnd.randint(7, 15)), lambda: f"{_number(rnd, 1)}.{_number(rnd, rnd.randint(7, 12))}", lambda: f"a{_number(rnd, rnd.randint(7, 12))}f",
        lambda: f"978-{_number(rnd, 1)}-{_number(rnd, 2)}-{_number(rnd, 6)}-{_number(rnd, 1)}", lambda: f"20{_number(rnd, 2)}-1{rnd.randint(0, 2)}-{rnd.randint(10, 28)} {rnd.randint(10, 23)}", lambda: f"{_number(rnd, 4)}-{_number(rnd, 4)}",
    ))()


#: Words that may lead personal data in.
LEADS = {
    "email": ("email", "mail:", "contact", "write to", "correo", "courriel", "adresse"), "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "payment", "karte", "carte", "tarjeta"), "phone": ("call", "tel", "phone:", "fax", "mobil", "appel", "llame"),
}


def with_planted(text: str, rnd: random.Random, each: int = 2) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """The text with made-up personal data and look-alikes of each kind between its words, where the data are, and where all that was added is."""
    words = re.findall(r"[^\W\d_]{2,12}", text) or ["text"]
    word = lambda: rnd.choice(words).lower()
    gaps = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    todo = [(kind, real) for kind in KINDS for real in (True, False) for _ in range(each)]
    rnd.shuffle(todo)
    out, data, added, at = [], [], [], 0
    for where, (kind, real) in zip(sorted(rnd.choices(gaps, k=len(todo))), todo, strict=True):
        lead = rnd.choice(LEADS[kind]) if rnd.random() < (0.5 if real else 0.2) else word()
        out.append(f"{text[at:where]} {lead} ")
        begin = sum(map(len, out))
        out.append(planted(rnd, kind, real, word))
        added.append((begin, begin + len(out[-1])))
        if real:
            data.append((kind, *added[-1]))
        out.append(rnd.choice((" ", ", ", ". ")) + word())
        at = where
    return "".join([*out, text[at:]]), data, added


def same(a: Span, spans: list[Span]) -> bool:
    """Does the span share four fifths of what it and one of the spans, of its kind, cover?"""
    return any(a[0] == k and 5 * (min(a[2], y) - max(a[1], x)) >= 4 * (max(a[2], y) - min(a[1], x)) for k, x, y in spans)


class Taken:
    """Disjoint intervals, and whether others overlap them, by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        return bisect_right(self.ends, a) < bisect_left(self.starts, b)

    def add(self, a: int, b: int) -> None:
        """An interval that overlaps none."""
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def _examples(text: str, seed: int) -> list[tuple[Span, list[float], bool]]:
    """Labelled candidates of one text in which personal data and look-alikes were planted: those that are planted or strict spans of their kind, by and large, are personal data."""
    body, data, added = with_planted(text, random.Random(seed))
    made = Taken(added)
    truth = data + [s for s in base_spans(body) if not made.overlaps(s[1], s[2])]
    return [(c, features(body, c), same(c, truth)) for c in candidates(body)]


@dataclass
class Scorer:
    """Boosted trees as arrays: per tree (feature, threshold, left, right, value), and each kind's threshold."""

    trees: list[tuple[np.ndarray, ...]]
    weights: list[float]
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            margin += weight * value[node]
        return 1 / (1 + np.exp(-2 * margin))

    def select(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans; these and the candidates over their kind's threshold that overlap neither them nor a better candidate)."""
        base = base_spans(text)
        taken = Taken([s[1:] for s in base])
        more = [c for c in candidates(text) if not taken.overlaps(*c[1:])] if self.trees else []
        chosen = list(base)
        if more:
            p = self.probability(np.array([features(text, c) for c in more]))
            for k in np.argsort(-p, kind="stable"):
                if p[k] >= self.thresholds.get(more[k][0], 2.0) and not taken.overlaps(*more[k][1:]):
                    chosen.append(more[k])
                    taken.add(*more[k][1:])
        return base, chosen


def _arrays(root) -> tuple[np.ndarray, ...]:
    rows: list[list[float]] = []

    def add(node) -> int:
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        at = len(rows) - 1
        if node.subtreeDepth() > 0:
            rows[at][:2] = [node.split().featureIndex(), node.split().threshold()]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(root)
    x = np.array(rows)
    return x[:, 0].astype(np.int64), x[:, 1], x[:, 2].astype(np.int64), x[:, 3].astype(np.int64), x[:, 4]


def train(docs: DataFrame, sample_docs: int = 1200, sample_chars: int = 4000, rounds: int = 1200, trees: int = 16, depth: int = 5, precision: float = 0.99) -> Scorer:
    """Fit the trees on candidates of a sample with personal data planted in it, and calibrate each kind's threshold on as many others.

    The sample is of `sample_docs` distinct texts at most, by a hash of the text, of each a stretch of `sample_chars`
    characters from a random place; equal texts and equal stretches count once. Made-up personal data of every kind, in strict and in
    other formats, and look-alikes are put between the words, over so many rounds that `rounds` texts come together, so
    a small or clean corpus teaches as much as a large one. The corpus's own candidates count as well: those of strict
    patterns as personal data, others as none. Half of the texts fit the trees; on the other half each kind's threshold
    is the lowest with the given precision, and a kind that doesn't reach it adds nothing. Without any text there is no
    model, and base spans are all.
    """
    with cleared(docs.sparkSession):
        return _train(docs, sample_docs, sample_chars, rounds, trees, depth, precision)


def _train(docs: DataFrame, sample_docs: int, sample_chars: int, rounds: int, trees: int, depth: int, precision: float) -> Scorer:
    text = F.col("text").cast("string")
    draw = F.xxhash64(F.lit("sample"), text)
    begin = F.pmod(F.xxhash64(F.lit("begin"), text), F.greatest(F.lit(1), F.length(text) - sample_chars)) + 1
    texts = docs.where(text.isNotNull())
    # About four times the sample meets in the task that orders it, whatever the table's size and however often texts repeat.
    share = min(1.0, 4 * sample_docs / max(1, texts.agg(F.approx_count_distinct(draw)).first()[0]))
    drawn = texts.where(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30))
    some = drawn.select(draw.alias("draw"), F.substring(text, begin.cast("int"), F.lit(sample_chars)).alias("text"))
    sample = written(some.groupBy("text").agg(F.min("draw").alias("draw")).orderBy("draw", "text").limit(sample_docs), "sample")
    have = sample.count()
    if not have:
        return Scorer([], [], {})
    each = -(-rounds // have)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, draw in zip(b.column("text").to_pylist(), b.column("draw").to_pylist(), strict=True):
                for k in range(each):
                    fit = (draw + k) % 2 == 0  # of few texts, their rounds are dealt to both halves
                    rows += [(fit, c[0], x, float(y)) for c, x, y in _examples(text, draw * each + k)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.bool_(), pa.string(), pa.list_(pa.float64()), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["fit", "kind", "x", "label"])

    table = written(sample.repartition(8).mapInArrow(of, "fit boolean, kind string, x array<double>, label double"), "candidates").coalesce(4)  # of the sample alone
    if len(table.groupBy("fit", "label").count().collect()) < 4:
        return Scorer([], [], {})
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(table.where("fit").select(array_to_vector("x").alias("features"), "label"))
    scorer = Scorer([_arrays(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), {})
    held = table.where("not fit").toArrow()  # bounded by the sample
    kind, label = np.array(held.column("kind").to_pylist(), object), np.array(held.column("label").to_pylist())
    p = scorer.probability(np.array(held.column("x").to_pylist()))
    for k in KINDS:
        order = np.argsort(-p[kind == k], kind="stable")
        good, score = label[kind == k][order], p[kind == k][order]
        right = np.cumsum(good) / np.arange(1, len(good) + 1)
        last = np.flatnonzero((right >= precision) & (np.append(score[1:], -1) < score))
        if len(last):
            scorer.thresholds[k] = max(0.5, float(score[last[-1]]))
    return scorer


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of docs (doc_id, text), over whole texts.

    The counts and base_sha256 are those of the strict patterns; spans has all that is selected, as kind:start:end in
    code points. A null or empty text has no span. Null and repeated ids are kept, and repeated rows give repeated
    results. Other columns are ignored. An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)  # of fixed size

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            rows = []
            for x in b.column("text"):
                text = x.as_py() or ""
                base, chosen = model.select(text)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(chosen)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first covers the rest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, **options: float) -> DataFrame:
    """What find gives with a model fitted on docs (doc_id, text) themselves; see train for options.

    A null text is an empty one. Null and repeated ids are kept, and repeated rows give repeated results. Other columns
    are ignored. An empty table, or one without any text, gives base spans alone.
    """
    return find(docs, train(docs, **options))
