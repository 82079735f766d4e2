"""Personal data in whole texts: base spans by pattern and check, more spans by boosted trees over candidates.

Base spans are leftmost, non-overlapping for each kind (email, ip, card, phone); matches that fail their check are dropped
without another try. They always stay. Generators with high recall propose further, overlapping candidates: spelled-out
addresses, dotted or slashed card numbers, phone numbers without country code, defanged ip addresses. Boosted trees score
each from its format (digits, groups, separators, checks) and context (neighbouring characters, cue words); a candidate
is taken if its score reaches its kind's threshold, which held-out examples calibrate to a precision of 0.99. Of taken
candidates of a kind that overlap, the best stays; those that overlap a base span are left out.

The trees are trained on the driver from a seeded generator of labelled examples (`EXAMPLES` per kind): the corpus has no
span labels. Null or empty text: no spans. Positions are code points, ends exclusive. Patterns are linear in the text.
Repeated rows get the same spans. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.boosting import Boosted, calibrate

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION, SEED = 3000, 0.99, 11

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans."""
    found = []
    at, past = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, domain.end(), "email"))
                past = domain.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if m.end() - m.start() >= 9 and 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return found


#: Generators: what each kind may also look like.
_DOT = r"(?: ?[(\[{] ?dot ?[)\]}] ?| dot )"
_AT = re.compile(r" ?[(\[{] ?at ?[)\]}] ?| at |@", re.I)
_BEFORE = re.compile(rf"(?:[A-Za-z0-9._%+-]{{1,64}}{_DOT}){{0,3}}[A-Za-z0-9._%+-]{{1,64}}\Z", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_NEXT = re.compile(rf"(?:{_DOT}| ?\. ?)([A-Za-z0-9-]{{1,24}})", re.I)
_PART = r"(?: ?[(\[] ?(?:\.|dot) ?[)\]] ?| \. | dot |\.)"
_LOOSE = {
    "ip": re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_PART}[0-9]{{1,3}}){{3}}(?![0-9])", re.I),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[._/ -]{1,3}[0-9]{4}){2}[._/ -]{1,3}[0-9]{1,7}|[0-9]{4}[._/ -]{1,3}[0-9]{6}[._/ -]{1,3}[0-9]{5})(?![0-9A-Za-z])"),
}
#: Digits in groups; a phone number is a run of such groups.
_GROUPS = re.compile(r"(?<![0-9A-Za-z+@_=#.,/-])\(?[0-9]{1,12}\)?(?:[ ./-]{1,3}\(?[0-9]{1,8}\)?){0,6}(?![0-9A-Za-z@_])")
_GROUP = re.compile(r"\(?[0-9]+\)?")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that might be personal data; spans may overlap: an address may end at each of its dots, a
    number at each of its groups."""
    found = []
    for m in _AT.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 140), m.start())
        label = _LABEL.match(text, m.end())
        if not before or not label:
            continue
        starts = {before.start(), before.end() - len(re.search(r"[A-Za-z0-9._%+-]+\Z", before[0])[0])}
        end = label.end()
        for _ in range(4):
            more = _NEXT.match(text, end)
            if not more:
                break
            end = more.end()
            found += [(s, end, "email") for s in starts]
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE.items():
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
        for m in _GROUPS.finditer(text):
            digits = 0
            for g in _GROUP.finditer(text, m.start(), m.end()):
                digits += sum(map(str.isdigit, g[0]))
                if 7 <= digits <= 15:
                    found.append((m.start(), g.end(), "phone"))
                    if text[m.start()] == "(" and g[0][-1] == ")" and text.count(")", m.start(), g.end()) == 1:
                        found.append((m.start() + 1, g.end() - 1, "phone"))  # the number stands in brackets
    return found


#: Cue words of each kind, and words that say that a number is something else, as fixed values.
CUES = {
    "email": ("mail", "contact", "write", "reach", "address", "kontakt", "editor"),
    "ip": ("ip", "host", "server", "address", "login", "traffic", "firewall", "block"),
    "card": ("card", "visa", "credit", "payment", "account", "mastercard", "charge"),
    "phone": ("phone", "telephone", "call", "tel", "telefon", "teléfono", "téléphone", "mobile", "mobil", "móvil", "handynummer", "fax", "cell", "cellulare", "dial", "ring", "rufen", "appelez", "joindre", "llama", "whatsapp", "contact", "text"),
}
AGAINST = (
    "order", "invoice", "rechnung", "ref", "part", "article", "serial", "version", "release", "build", "firmware", "isbn", "issn", "page", "pages", "pp", "price", "cost", "section", "paragraph", "batch", "ticket",
    "case", "docket", "patent", "model", "tracking", "parcel", "code", "key", "lot", "log", "file", "route", "bus", "stock", "item", "table", "score", "sets", "between", "from", "dated", "born", "years", "coordinates", "room", "points",
)
_TOP_LEVEL = frozenset("com org net edu gov info io eu de fr es it nl ch at uk pl ca au jp".split())
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(x) for x in re.findall(r"[0-9]+", span)]
    seps = [x for x in re.split(r"[0-9A-Za-z]+", span) if x]
    words = re.findall(r"[A-Za-z0-9-]+", span.lower())
    left, right = _WORD.findall(before.lower())[-5:], _WORD.findall(after.lower())[:3]
    cue = lambda names, near: float(any(w in names or w.rstrip("s") in names for w in near))
    lone = re.search(r"(?:^|[^0-9A-Za-z])([0-9A-Za-z]+)[ .]*$", before)
    return [
        len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(set(seps)), len(seps),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(all(len(x) <= 3 and int(x) <= 255 for x in re.findall(r"[0-9]{1,9}", span))),
        float("(" in span), span.count("."), span.count("/"), span.count("-"), span.count(" "), float(digits[:1] == "0"), float(digits[:2] == "00"),
        float(groups[:1] == [4] and groups[1:2] == [2] and groups[2:3] == [2]), float(bool(re.search(r"[(\[{] ?at", span, re.I))),
        float("dot" in words), float(bool(words) and words[-1] in _TOP_LEVEL), float("@" in span), len(set(digits)),
        cue(CUES[kind], left[-2:]), cue(CUES[kind], left), cue(CUES[kind], right), cue(AGAINST, left[-2:]), cue(AGAINST, left), cue(AGAINST, right),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in ("$", "€", "=", "#", "v")),
        float(bool(re.match(r"[ ./-]{0,3}\(?[0-9]", after))), float(bool(re.match(r"(?:\.| dot | ?[(\[{] ?dot)[ )\]}]*[a-z0-9]", after, re.I))), float(bool(lone) and lone[1].isdigit()),
        float(groups[:3] == [3, 3, 4]), float(groups[1:4] == [4, 4, 4] or groups[:4] == [4, 4, 4, 4]), float(bool(re.search(r"\. ", span))), float(len(words)), groups[0] if groups else 0, groups[-1] if groups else 0,
        float(len(words[0]) if words else 0), float(bool(re.search(r"[._%+-][A-Za-z]", span.split(" ")[0]))),
        float(bool(re.search(r"\bdot[ )\]}]*$", before, re.I))), float(before[-1:] == "(" and after[:1] == ")"), span.count("(") - span.count(")"),
    ]


def examples(count: int = EXAMPLES, seed: int = SEED) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Features and labels of each kind, from generated texts: of a text's candidates, the one that is the data is good, and all
    others are bad. Numbers that look like data are data if the words about them say so."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(pick(*"bcdfghlmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 4)))
    words = lambda: " ".join(word() for _ in range(rng.integers(1, 4)))

    def card(good: bool) -> str:
        body = n(15)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)) == good)
        return pick(".", "/", "_", "  ", " - ").join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        sep = pick(" ", "-", ".", "/", " ")
        area = pick(n(3), "0" + n(2), "0" + n(3), "0" + n(1))
        return pick(
            f"({n(3)}) {n(3)}{pick('-', ' ')}{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(2)}{sep}{n(4)}{sep}{n(4)}", f"{pick('00', '00 ')}{n(2)} {n(2)} {n(4)} {n(4)}", f"00 {n(2)} {n(2)} {n(7)}",
            f"{area}{sep}{n(pick(6, 7, 8))}", f"({area}) {n(pick(6, 7))}", sep.join(["0" + n(1), *(n(2) for _ in range(4))]), sep.join([n(3), n(3), n(3)]), sep.join([n(2), n(3), n(2), n(2)]), sep.join(["0" + n(3), n(3), n(3)]),
            f"0{n(2)} {n(3)} {n(2)} {n(2)}", f"({area}) {n(3)} {n(4)}", f"0{n(4)} {n(6)}", f"0{n(4)} {n(3)} {n(3)}", n(10), f"0{n(9)}", f"1-{n(3)}-{n(3)}-{n(4)}", f"0{n(1)} {n(4)} {n(4)}", f"0{n(3)} {n(4)} {n(4)}",
        )

    def no_phone() -> str:
        year = lambda: str(rng.integers(1700, 2100))
        return pick(
            f"{year()}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(2)}.{n(2)}.{year()}", f"{n(4)} {n(4)}", f"{n(2)} {n(3)} {n(3)}", f"{n(5)}-{n(5)}-{n(5)}-{n(5)}", f"{n(1)} {n(3)} {n(3)}",
            f"{n(2)}.{n(3)}.{n(3)}", card(False), f"{year()}-{year()}", f"{year()}, {year()} {year()}", f"{year()} - {year()}", f"{n(3)}-{n(3)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", " ".join(n(3) for _ in range(rng.integers(3, 6))),
            " ".join(n(2) for _ in range(rng.integers(4, 7))), f"{n(2)}.{n(4)} {n(2)}.{n(4)}", f"{n(2)}-{n(2)} {n(2)}-{n(2)} {n(2)}-{n(2)}", f"{year()}/{year()}/{year()}", f"{year()}{n(4)} {n(6)}", f"{n(4)}-{n(4)} {n(4)}-{n(4)}", f"{n(4)} {n(3)} {n(4)} {n(3)}",
        )

    def spelled() -> str:
        name = pick(word(), f"{word()}.{word()}", f"{word()}_{word()}", word() + n(2), f"{word()} dot {word()}", f"{word()}-{word()}")
        at, dot = pick((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "{dot}"), (" (at) ", "."), ("(at)", "."), (" [at] ", "."))
        return name + at + dot.join([pick(word(), f"{word()}-{word()}"), *([word()] if rng.random() < 0.2 else []), pick(*sorted(_TOP_LEVEL))])

    def no_email() -> str:
        return pick(f"{word()} at {word()}{pick('.', '. ')}{word().title()} {word()}", f"{word()} at {word()} {word()} dot {word()}", f"{word()} dot {word()} at {word()} {word()}", f"{word()}@{word()}.{word()} {word()}", f"at {word()}. {word().title()}. {word().title()}", f"{word()} dot at {word()} dot")

    kinds = {
        "email": (spelled, no_email, 0.5),
        "ip": (lambda: pick("[.]", "(.)", "[dot]", "(dot)", " . ", " dot ").join(str(rng.integers(1, 255)) for _ in range(4)), lambda: pick(" . ", " dot ").join(pick(n(3), "7" + n(2), n(1)) for _ in range(4)), 0.7),
        "card": (lambda: card(True), lambda: card(False), 0.7),
        "phone": (lambda: f"({phone()})" if rng.random() < 0.05 else phone(), no_phone, 1.0),
    }
    out = {}
    for kind, (good, bad, cued) in kinds.items():
        x, y = [], []
        for i in range(count):
            label = i % 2
            # Half of the bad ones of digits look like data, but stand behind a word against it.
            against = not label and kind != "email" and rng.random() < 0.5
            # Data of one's own are spoken of, so a telephone number without such a word is taken to be another number.
            cue = pick(*AGAINST) if against or not label and rng.random() < 0.3 else pick(*CUES[kind]) if rng.random() < (cued if label else 0.05) else word()
            between = pick("", f" {word()}", f" {word()} {word()}") if rng.random() < 0.4 else ""
            left, middle = f"{words()} {cue}{between}{pick(':', '', ' is', '')} ", (good if label or against and (kind != "ip" or rng.random() < 0.8) or kind == "phone" and rng.random() < 0.2 else bad)()
            text = left + middle + pick(" ", ", ", ". ", "") + words()
            spans = [s for s in candidates(text) if s[2] == kind and s[0] < len(left) + len(middle) and s[1] > len(left)]
            x += [features(text, *s) for s in spans]
            whole = (len(left), len(left) + len(middle)) if not middle.startswith("(") or middle.count("(") == 1 and not middle.endswith(")") else (len(left) + 1, len(left) + len(middle) - 1)
            y += [float(label and s[:2] == whole) for s in spans]
        out[kind] = np.array(x), np.array(y, float)
    return out


class Model:
    """Trees and a threshold for each kind."""

    def __init__(self, count: int = EXAMPLES, precision: float = PRECISION, seed: int = SEED):
        self.kinds = {}
        for kind, (x, y) in examples(count, seed).items():
            held = np.arange(len(x)) % 3 == 0
            trees = Boosted().fit(x[~held], y[~held])
            self.kinds[kind] = trees, calibrate(trees.raw(x[held]), y[held], precision)

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and added ones."""
        base = base_spans(text)
        added = []
        loose = candidates(text)
        for kind in KINDS:
            mine = [s for s in loose if s[2] == kind]
            taken = sorted((s[0], s[1]) for s in base)
            if not mine:
                continue
            trees, least = self.kinds[kind]
            raw = trees.raw(np.array([features(text, *s) for s in mine]))
            kept: list[tuple[int, int, str]] = []
            for score, s in sorted(((-r, s) for s, r in zip(mine, raw, strict=True) if r >= least), key=lambda z: (z[0], z[1][0] - z[1][1])):
                if not any(a < s[1] and s[0] < b for a, b, _ in kept):
                    kept.append(s)
            added += [s for s in kept if not any(a < s[1] and s[0] < b for a, b in taken)]
        return base, added


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, every = [], [], []
            for text in batch.column("text"):
                base, added = model.value.spans(text.as_py() or "")
                counts.append([sum(s[2] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(base + added))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(table[:, i]) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(every, pa.string())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return run


@functools.lru_cache(maxsize=4)
def trained(count: int = EXAMPLES, precision: float = PRECISION, seed: int = SEED) -> Model:
    """The model of these parameters, trained once in a process."""
    return Model(count, precision, seed)


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, counts of base spans, digest of base spans, all spans."""
    model = docs.sparkSession.sparkContext.broadcast(trained(**options))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find(model), SCHEMA)


def redact(text: str, spans: str) -> str:
    """`text` with each span of the joined list replaced by its kind in brackets; of overlapping ones the first counts."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
            at = int(b)
    return "".join(out) + text[at:]
