"""Personal data by weak supervision.

Candidate spans come from patterns. Four labelers vote on each (for, against or abstaining): its
strict form, gazetteers, words of its context, and its boundaries. Expectation-maximisation over
the counts of all vote patterns estimates each labeler's reliability per kind without any labels;
a logistic span classifier is trained on the posteriors, from the votes and from the span's own shape
and what stands before it, and decides. Patterns of votes and shapes are at most 35,000, so only they
reach the driver, counted over all documents.

Spans of the base kinds are always reported. Null texts are empty and have no spans. Documents are
independent: repeated rows and equal ids are scanned one by one, texts of any length whole; spans that
tie on a start stand by kind. Columns of other names are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import ids_and_texts, map_arrow, materialise, slices

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "local_phone", "person")
BASE = 4
LABELERS = 4
#: How many values each part of a span's shape has.
SHAPE = (3, 2, 3, 3)
#: How many characters before a span are its context.
CONTEXT = 40
ACCEPT = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
EXTRA = (
    (4, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (5, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (6, re.compile(r"(?<![0-9)])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])")),
)
PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")
TITLES = ("Mr", "Ms", "Dr", "Herr", "Frau", "Mme", "Sr")

#: Gazetteers. Mail providers and reserved names, card issuers' leading digits,
#: country calling codes, given names.
MAIL = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "proton.me", "gmx.de", "web.de", "orange.fr", "example.com", "example.org", "example.net")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|36|38|6011|62|65|35")
CALLING = re.compile(r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}")
GIVEN = frozenset("Anna Ben Carlos Clara David Elena Emma Eva Felix Hans Hugo Ines Jack James Jean John Jose Juan Julia Karl Laura Leon Louis Lucas Luis Maria Marie Mark Mary Max Mia Michael Nina Noah Olga Otto Paul Peter Pierre Sara Sofia Thomas Tom".split())
#: Context words that speak for a kind, and those that speak against all.
CUES = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (r"mail|contact|@|write to|correo|courriel", r"\bip\b|address|host|server|adresse", r"card|visa|credit|karte|carte|tarjeta", r"phone|tel|call|mobile|fax|handy", r"ssn|social|security", r"iban|konto|account|bank", r"phone|tel|call|fax", r"dear|name|signed|von|from")
)
AGAINST = re.compile(r"version|isbn|order|sku|build|release|part no", re.IGNORECASE)

CANDIDATES = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("patterns", pa.list_(pa.int32()))])
FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:BASE]], ("base_sha256", pa.string()), ("spans", pa.string())])


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost matches, from each at sign outwards: no rescans of long words."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return found


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def part(text: str) -> int:
    return int(text) if len(text) < 20 else int(text.lstrip("0")[:20] or 0)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end); those of the base kinds are exact, the others are proposals."""
    found = emails(text)
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(part(g) <= 255 for g in m.groups())]
        for m in CARD.finditer(text):
            digits = digits_of(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
        for kind, pattern in EXTRA:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e in found)]
    if any(t in text for t in TITLES):
        found += [(7, m.start(), m.end()) for m in PERSON.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e in found)]
    return sorted(found)


def form(kind: int, span: str) -> int:
    """Strict form: 1 for, -1 against."""
    if kind == 0:
        local, _, domain = span.partition("@")
        return 1 if ".." not in local and local[0] != "." and local[-1] != "." and domain.rpartition(".")[2].isalpha() else -1
    if kind == 1:
        return 1 if all(p == str(part(p)) for p in span.split(".")) else -1
    if kind == 2:
        return 1 if len(digits_of(span)) in (14, 15, 16) else -1
    if kind == 3:
        return 1 if span.count("(") == span.count(")") and "  " not in span else -1
    if kind == 4:
        area, group, serial = span.split("-")
        return 1 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else -1
    if kind == 5:
        bare = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else -1
    if kind == 6:
        return 1 if span[1] in "23456789" else -1
    return 0


def gazetteer(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if span.partition("@")[2].lower().endswith(MAIL) else 0
    if kind == 1:
        return -1 if span.startswith(("0.", "127.", "255.")) else 0
    if kind == 2:
        return 1 if ISSUERS.match(span) else -1
    if kind == 3:
        return 1 if CALLING.match(digits_of(span)) else -1
    if kind == 7:
        return 1 if any(w in GIVEN for w in span.split()) else 0
    return 0


def boundary(before: str, after: str) -> int:
    return -1 if before[-1:].isalnum() or after[:1].isalnum() or after[:1] in ("_", "%") else 1


def pattern_of(text: str, kind: int, start: int, end: int) -> int:
    """The kind and the votes as one number: votes are base-3 digits, abstaining 0, for 1, against 2."""
    before, span = text[max(0, start - CONTEXT) : start], text[start:end]
    context = 1 if CUES[kind].search(before) else -1 if AGAINST.search(before) else 0
    number = kind
    for vote in (form(kind, span), gazetteer(kind, span), context, boundary(before, text[end : end + 1])):
        number = number * 3 + vote % 3
    for known, most in zip(shape(before, span), SHAPE):
        number = number * most + known
    return number


def shape(before: str, span: str) -> tuple[int, ...]:
    """What the classifier sees beside the votes: length, separators, digits, what stands before."""
    size = len(span)
    digits = sum("0" <= c <= "9" for c in span)
    lead = before[-1:]
    return (size >= 12) + (size >= 18), int(any(c in " -()" for c in span)), (digits > 0) + (2 * digits > size), 0 if lead in ("", "\n") else 1 if before.rstrip()[-1:] in (":", "=", "(") else 2


def shape_of(pattern: int) -> tuple[int, list[int]]:
    known = []
    for most in reversed(SHAPE):
        pattern, k = divmod(pattern, most)
        known.append(k)
    return pattern, known[::-1]


def votes_of(pattern: int) -> tuple[int, list[int]]:
    votes = []
    for _ in range(LABELERS):
        pattern, v = divmod(pattern, 3)
        votes.append(v if v < 2 else -1)
    return pattern, votes[::-1]


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM for one truth per span and, per kind and labeler, one accuracy; returns P(true) by pattern.

    Pseudo-counts keep accuracies at 0.8 until votes say otherwise.
    """
    n = len(KINDS)
    prior, right = np.full(n, 0.7), np.full((n, LABELERS), 0.8)
    true = np.full(len(counts), 0.5)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior))[kinds] + (votes * np.log(right / (1 - right))[kinds]).sum(1)
        true = 1 / (1 + np.exp(-logit))
        for k in range(n):
            w, t, v = counts[kinds == k], true[kinds == k], votes[kinds == k]
            prior[k] = (7 + (w * t).sum()) / (10 + w.sum())
            agree = (w[:, None] * ((v == 1) * t[:, None] + (v == -1) * (1 - t[:, None]))).sum(0)
            right[k] = np.clip((8 + agree) / (10 + (w[:, None] * (v != 0)).sum(0)), 0.55, 0.99)
    return true


def features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The kind, the votes, and the span's own shape by kind."""
    one = np.eye(len(KINDS))[kinds]
    own = np.hstack([np.eye(most)[shapes[:, k]] for k, most in enumerate(SHAPE)])
    by_kind = (one[:, :, None] * own[:, None, :]).reshape(len(kinds), -1)
    return np.hstack([one, votes == 1, votes == -1, (votes == 1).sum(1, keepdims=True) >= 2, own, by_kind]).astype(float)


def classifier(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w, share = np.zeros(x.shape[1]), counts / max(counts.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - soft)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def learn(counted: list[tuple[int, int]]) -> dict[int, float]:
    """Pattern to probability, from the counts of all patterns."""
    if not counted:
        return {}
    numbers, counts = (np.array(x) for x in zip(*counted))
    bare, shapes = zip(*map(shape_of, numbers.tolist()))
    kinds, votes = zip(*map(votes_of, bare))
    kinds, votes = np.array(kinds), np.array(votes)
    x = features(kinds, votes, np.array(shapes))
    w = classifier(x, reliabilities(kinds, votes, counts.astype(float)), counts.astype(float))
    return dict(zip(numbers.tolist(), (1 / (1 + np.exp(-(x @ w)))).tolist()))


def spans_of(documents: DataFrame) -> DataFrame:
    """Every document's candidate spans with their vote patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append([(k, s, e, pattern_of(text, k, s, e)) for k, s, e in candidates(text or "")])
            columns = [pa.array([[x[i] for x in row] for row in rows], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=CANDIDATES)

    return map_arrow(ids_and_texts(documents), run, "doc_id long, kinds array<int>, starts array<int>, ends array<int>, patterns array<int>")


def detect(documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    found = materialise(spans_of(documents))
    counted = found.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()  # at most 8 * 81 * 54 rows
    likely = learn([(r["p"], r["n"]) for r in counted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in FOUND.names}
            for doc, kinds, starts, ends, patterns in zip(*(c.to_pylist() for c in batch.columns)):
                base = [(k, s, e) for k, s, e in zip(kinds, starts, ends) if k < BASE]
                more = [(k, s, e) for k, s, e, p in zip(kinds, starts, ends, patterns) if k >= BASE and likely[p] >= accept]
                text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
                out["doc_id"].append(doc)
                for k in range(BASE):
                    out[f"n_{KINDS[k]}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(text(base).encode()).hexdigest())
                out["spans"].append(text(base + more))
            yield pa.RecordBatch.from_pydict(out, schema=FOUND)

    return map_arrow(found, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
