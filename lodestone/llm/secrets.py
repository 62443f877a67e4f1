"""Secret scans: patterns of known shapes, and strings that zstandard can't explain in sensitive places.

Base spans are matches of `ASSIGN`, `ACCESS` and `HEX`. The method adds candidates: strings of `LEAST` or more token
characters with a digit or mixed case that start at most `REACH` characters after a sensitive word, whole however
long. A candidate's novelty is
the number of bytes it adds to a zstandard frame primed with a dictionary of identifiers and the code around it,
for each of its characters; at `NOVELTY` or more it is reported as `novel`. Words, repeats of the context and
identifiers compress well; keys don't. A candidate's own copies don't explain it where they follow it or are
themselves in a sensitive place (a candidate or in a base span), and all copies of a candidate have one verdict, `novel` if
one of them is. Where several sensitive words stand in one string, it is reported once, from the first novel start. A copy before it that is in no sensitive place does explain it: such a string is used elsewhere.

Texts are scanned whole, in the task that reads them: nothing is shuffled, and candidates are looked for only in
texts that hold a sensitive word. Defined results: null counts as empty and has no spans; repeated rows are reported
each; of spans that start together the kind listed first comes first; an empty table gives an empty result; offsets
are code points, ends exclusive. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"(?:passw(?:or)?d|passphrase|secret|token|api[_-]?key|credential|bearer|authorization|private[_-]?key|access[_-]?key|client[_-]?id|signature)", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("passw", "passphrase", "secret", "token", "api", "credential", "bearer", "authorization", "private", "access", "client", "signature")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
LEAST, REACH, AROUND, NOVELTY = 16, 64, 512, 0.6
IDENTIFIERS = " ".join(
    "import export return function const static public private class struct interface string integer boolean true false null none self this "
    "password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer credential signature "
    "username user_name email address config configuration settings environment variable example placeholder your_token_here changeme "
    "localhost http:// https:// www. .com .org .net /api/v1/ /usr/local/bin /home/user/ index.html main.py __init__ def get_value set_value "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 abcdef0123456789 the and that with from have this which their would there".split()
)


def novelty(candidate: str, before: str, after: str) -> float:
    """Bytes that `candidate` adds to a frame primed with the identifiers and its surroundings, for each character."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + after + "\n" + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return max(0, len(pack.compress(candidate.encode())) - len(pack.compress(b""))) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, unsorted."""
    low = text.lower()
    spans = []
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of incompressible candidates that no base span covers."""
    low = text.lower()
    if not any(word in low for word in SENSITIVE_WORDS):
        return []
    found: dict[str, dict[int, None]] = {}
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends = [e for _, e in runs]
    sensitive: dict[int, int] = {}  # the first candidate's start in each run
    for word in SENSITIVE.finditer(text):
        for k in range(bisect_right(ends, word.end()), len(runs)):
            start, end = max(runs[k][0], word.end()), runs[k][1]
            if start > word.end() + REACH:
                break
            if end - start < LEAST:  # the word stands in the run
                continue
            sensitive[k] = min(start, sensitive.get(k, start))
            string = text[start:end]
            mixed = any(c.isdigit() for c in string) and any(c.isalpha() for c in string) or (string.lower() != string and string.upper() != string and not string.istitle())
            if mixed and not any(s <= start and end <= e for s, _, e in base):
                found.setdefault(string, {})[start] = None

    def blanked(lo: int, hi: int, core: str, all_copies: bool) -> str:
        """The text from `lo` to `hi` without copies of `core`; only those in sensitive places, if not `all_copies`."""
        chars, at = list(text[lo:hi]), text.find(core, max(0, lo - len(core) + 1))
        while 0 <= at < hi:
            end = at + len(core)
            k = bisect_right(ends, at)
            if all_copies or k in sensitive and sensitive[k] <= at or any(s <= at and end <= e for s, _, e in base):
                chars[max(at, lo) - lo : end - lo] = " " * (min(end, hi) - max(at, lo))
            at = text.find(core, end, hi + len(core))
        return "".join(chars)

    def novel(string: str, start: int) -> bool:
        end, core = start + len(string), string.strip("+/_.=-")
        before = blanked(max(0, start - AROUND), start, core, False)
        return novelty(string, before, blanked(end, min(len(text), end + AROUND), core, True)) >= NOVELTY

    spans: dict[int, int] = {}  # end -> start: candidates of one run, after one sensitive word or another, are one string
    for string, starts in found.items():
        if any(novel(string, start) for start in starts):
            for start in starts:
                spans[start + len(string)] = min(start, spans.get(start + len(string), start))
    return [(start, 3, end) for end, start in spans.items()]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_assign, n_access, n_hex, hashes, spans, n_novel = [], [], [], [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            novel = novel_spans(text, base)
            kinds = [k for _, k, _ in base]
            n_assign.append(kinds.count(0))
            n_access.append(kinds.count(1))
            n_hex.append(kinds.count(2))
            hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(base + novel))
            n_novel.append(len(novel))
        counts = [pa.array(x, pa.int64()) for x in (n_assign, n_access, n_hex)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(n_novel, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans ("kind:start:end", comma-joined) of each document."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
