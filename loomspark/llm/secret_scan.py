"""Secrets in texts: three fixed patterns, and random strings exposed by their token efficiency.

A subword vocabulary spends few tokens on anything that resembles language and many on random strings, so a run of key
characters with a low number of characters per token is reported, unless it is a known digest, an identifier (a UUID, a
number or date, a handle or host) or part of a span that a fixed pattern has found.  In the path of a link each segment
is a run of its own, so names in links don't hide a token there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm._tables import tune

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
#: A run is random below this many characters per token, or below this part of it if it has letters of one case only, as long words have.
RATIO, LETTERS = 2.0, 0.9

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # SHORTEST
#: Digests by their usual lengths, UUIDs, numbers and dates.  Words are left to the ratio.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|[-+/_=0-9]+"
)
#: The scheme, host and path of a link, up to what ends or parts it.
LINK = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]{0,30}://|www\.)[^\s\"'<>,;()\[\]{}?&=#|\\]+")
#: Characters of the shortest run.
SHORTEST = 20

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


@lru_cache(2)
def encoder(path: str):
    """A tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and without overlap within a kind."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the runs of key characters that are long enough; within links, of the segments of the path."""
    links = LINK.finditer(text) if "://" in text or "www." in text else iter(())
    link = next(links, None)
    for m in RUN.finditer(text):
        start, end = m.span()
        while link and link.end() <= start:
            link = next(links, None)
        at = start
        while link and link.start() < end:  # what lies before the link, its segments, and what comes after it
            if link.start() - at >= SHORTEST:
                yield at, link.start()
            at = max(at, link.start())
            until = min(end, link.end())
            for part in text[at:until].split("/"):
                if len(part) >= SHORTEST:
                    yield at, at + len(part)
                at += len(part) + 1
            at = until
            if link.end() >= end:
                break
            link = next(links, None)
        if end - at >= SHORTEST:
            yield at, end


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Runs that the vocabulary can't spell in few tokens."""
    found, k, covered = [], 0, 0
    for start, end in runs(text):
        # Spans are sorted by start: ``covered`` is the furthest end of those that start before this run's end.
        while k < len(base) and base[k][0] < end:
            covered = max(covered, base[k][2])
            k += 1
        run = text[start:end]
        if covered > start or text[start - 1 : start] == "@" or KNOWN.fullmatch(run):
            continue
        if len(run) < ratio * (LETTERS if run.isalpha() and (run.islower() or run.isupper()) else 1) * len(encode(run)):
            found.append((start, 3, end))
    return found


def listed(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ratio: float = RATIO) -> DataFrame:
    """Secrets of every text: counts by kind, a digest of the pattern spans, and all spans as ``kind:start:end``.

    Offsets are code points, ends exclusive.  ``random`` spans come from the token-efficiency test and never overlap a
    pattern span.  A null or empty text has no spans (the digest is that of the empty string); null ids stay null;
    repeated rows give repeated rows; an empty table gives no rows; other columns are not read.  A very long text is
    scanned whole, in time that grows with its length alone.  Map-only.
    """
    tune(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(public_tokenizers.path(vocabulary)).encode_ordinary
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                extra = random_spans(text, base, encode, ratio)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), len(extra), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + extra))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
