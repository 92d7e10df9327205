"""Secrets in texts: fixed patterns, and strings that a vocabulary of words can't shorten.

A vocabulary trained on text gives words and identifiers several characters a token; random strings get few. In runs of key
characters the parts between separators are judged first, from 16 characters on, then the run as a whole, then its longest
stretch of short tokens, so that words joined to a key do not hide it. What mixes letters and digits, or changes case often,
and stays below a ratio is a span of kind ``random``, unless it is a digest or UUID or lies in a span of the patterns. Short
strings, and strings that look like names, must stay below a smaller ratio.

* Null and empty texts have no spans. Texts are taken whole; spans are code points, end exclusive.
* Repeated rows are scanned each for itself; an empty table gives an empty result. Other columns are carried along; one
  that has the name of an output is replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.llm.common import kept, tidy, with_outputs

#: The kinds in order of listing and their patterns. Letters of ``assign`` keys stand in either case.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Runs that can hold keys, their parts between separators, and what a key must hold: letters and digits, or many changes of case.
RUN_CHARS, LONG_CHARS = 16, 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
CHANGE = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])")
CHANGES = 4
#: Digests by their number of hex digits, UUIDs, and names made of words and short numbers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
                    r"|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})")
IDENTIFIER = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[-_/+]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*[-_/+]*")
#: Characters per token below which a string counts as random: long ones, short ones, and those that look like a name.
MAX_CHARS_PER_TOKEN, MAX_SHORT, MAX_NAMED = 2.2, 1.9, 1.8

_HEX_MAP = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN_MAP = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))


@kept
def _encoding(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def _mixed(part: str) -> bool:
    """Letters and digits, not just an end of digits, or case that changes as names do not."""
    return len(CHANGE.findall(part)) >= CHANGES


def _sized(part: str, ranks: str) -> list[int]:
    return [len(t) for t in _encoding(ranks).decode_tokens_bytes(_encoding(ranks).encode_ordinary(part))]


def _random(part: str, ranks: str, ratio: float) -> bool:
    """Whether the tokens of a string are too short for words."""
    if DIGEST.fullmatch(part) or not _mixed(part):
        return False
    most = ratio if len(part) >= LONG_CHARS else min(ratio, MAX_SHORT)
    if IDENTIFIER.fullmatch(part.rstrip("=")):
        most = min(most, MAX_NAMED)
    return len(part) < most * len(_sized(part, ranks))


def _stretch(run: str, ranks: str, ratio: float) -> tuple[int, int]:
    """The longest stretch of whole tokens whose mean length is below the ratio."""
    ends = [0]
    for n in _sized(run, ranks):
        ends.append(ends[-1] + n)
    sums = [e - ratio * i for i, e in enumerate(ends)]
    tops = [0]  # places of rising prefix sums: where the longest stretch can begin
    for i, x in enumerate(sums):
        if x > sums[tops[-1]]:
            tops.append(i)
    best = (0, 0)
    for j in range(len(sums) - 1, 0, -1):
        while tops and sums[tops[-1]] > sums[j]:
            i = tops.pop()
            if i < j and ends[j] - ends[i] > best[1] - best[0]:
                best = (ends[i], ends[j])
    return best


def _keys(run: str, at: int, ranks: str, ratio: float) -> list[tuple[int, int]]:
    """Random strings of a run of key characters: its parts between separators, or the run, or its best stretch."""
    if DIGEST.fullmatch(run):
        return []
    parts = [(m.start(), m.end()) for m in PART.finditer(run) if _random(m[0], ranks, ratio)]
    if parts:
        return [(at + a, at + b) for a, b in parts]
    if len(run) < LONG_CHARS or any(DIGEST.fullmatch(m[0]) for m in PART.finditer(run)) or not _mixed(run):
        return []
    if _random(run, ranks, ratio):
        return [(at, at + len(run))]
    a, b = _stretch(run, ranks, ratio)
    while a < b and run[a] in "-_/+":
        a += 1
    return [(at + a, at + b)] if b - a >= LONG_CHARS and _random(run[a:b], ranks, ratio) else []


def find(text: str, ranks: str, ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then by kind."""
    spans: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    data = text.encode("utf-8", "surrogatepass")
    if b"x" * HEX_CHARS in data.translate(_HEX_MAP):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if b"x" * RUN_CHARS in data.translate(_RUN_MAP):
        base = list(spans)
        for m in RUN.finditer(text):
            spans += [("random", a, z) for a, z in _keys(m[0], m.start(), ranks, ratio) if not any(c <= a and z <= d for _, c, d in base)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(df: DataFrame, ranks: str, text: str = "text", out: str = "secrets", ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The table with ``out``: an array of (kind, start, end) for every text. ``ranks`` is a tiktoken rank file."""
    rows = with_outputs(df, out)
    columns = rows.columns
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t, ranks, ratio)] if t else []
                     for t in batch.column(columns.index(text)).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, arrow)], names=[*columns, out])

    return rows.mapInArrow(tidy(run), schema)


def joined(spans):
    """Spans as kind:start:end, comma-joined, as a column."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
