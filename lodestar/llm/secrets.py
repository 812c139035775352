"""Secret scan: fixed patterns, and random strings that a tokenizer compresses badly.

Words that people write have many characters per token under a BPE vocabulary; keys and passwords
have few. A string of 16 or more key characters that has a low ratio is reported, unless it is a known
digest (hexadecimal of a digest's length), an identifier (UUID, plain number, date or version of short
parts) or lies inside a span of a fixed pattern. Numbers that lead a name, as a date does, don't count.
Rare and compound words come near the ratio of keys, so a string of letters of one case, but for
capitals, needs a lower one; one of mixed cases does not.

Null texts count as empty: no spans. Documents are independent, so repeated rows, ties of doc_id
and very long texts need no care; columns of other names are ignored, and an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import by_text, ids_and_texts, map_arrow
from lodestar.llm.tokens import ranked

KINDS = ("assign", "access", "hex", "random")
#: The least characters per token of a string that isn't taken for random.
RATIO = 2.3
#: The same of a string without digits whose letters are of one case.
ONE_CASE_RATIO = 1.9

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
HINTS = ("passw", "secret", "token", "api")
DIGIT = re.compile(r"[0-9]")

#: Lengths of hexadecimal md5, sha1, sha224, sha256, sha384 and sha512 digests.
DIGESTS = {32, 40, 56, 64, 96, 128}
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_/+-]+|v?[0-9]{1,8}([._-]([0-9]{1,8}|[a-z]{1,3}[0-9]{0,3}|(alpha|beta|build|final|hotfix|patch|post|preview|release|snapshot|stable)[0-9]{0,3}|g[0-9a-f]{7,12}))+")
#: Numbers before a name, and the least characters of one that is tested.
LEADING, LEAST = re.compile(r"v?([0-9]{1,8}[_-])+"), 8
#: Upper case inside a word.
MIXED = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")

FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(run: str, encoding, ratio: float) -> bool:
    if len(run) in DIGESTS and HEXADECIMAL.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    lead = LEADING.match(run)
    name = run[lead.end() :] if lead else run
    if len(name) < LEAST:
        return False
    if not DIGIT.search(name) and not MIXED.search(name):
        ratio = min(ratio, ONE_CASE_RATIO)
    return len(name) < ratio * len(encoding.encode_ordinary(name))


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, ratio: float) -> list[tuple[int, int, int]]:
    runs = [(m.start(), 3, m.end()) for m in RUN.finditer(text) if is_random(m[0], encoding, ratio)]
    return [r for r in runs if not any(s <= r[0] and r[2] <= e for s, _, e in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, vocabulary: str, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""

    def work(ids: list, texts: list) -> dict:
        encoding = ranked(vocabulary)
        out: dict[str, list] = {k: [] for k in FOUND.names}
        for doc, text in zip(ids, texts):
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            out["doc_id"].append(doc)
            for k, name in enumerate(KINDS[:3]):
                out[f"n_{name}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + random_spans(text, base, encoding, ratio))))
        return out

    return map_arrow(ids_and_texts(documents), by_text(work, FOUND), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
