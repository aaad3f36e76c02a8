"""Secrets in texts: fixed patterns, and strings that a byte-pair vocabulary can't compress.

A vocabulary learned from prose and code spends a token on about every four characters of what
people write, and one on fewer than two of a random string. A run of 20 or more key-like characters,
or what base spans leave of one, with at most `ratio` characters a token is a
span of kind `token`, unless it is a digest of a known form, a UUID, a number, or an identifier
made of words, which are single tokens.

Edge cases: null counts as empty; an empty text has no spans and the digest of the empty string;
repeated rows get the same answer; places are code points, the end exclusive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import util

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")  # one of them stands in every match of ASSIGN
LEAST = 20  # characters of a run
LONG = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
DIGEST = re.compile(
    r"(?:sha(?:1|224|256|384|512)-)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|sha1-[A-Za-z0-9+/]{27}=|sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}=="
)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
RANK = {"assign": 0, "access": 1, "hex": 2, "token": 3}


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


@lru_cache(maxsize=65_536)
def word(part: str, vocabulary: str) -> bool:
    """Whether the vocabulary has these letters as one token, as they are, in lower case, or after a space."""
    e = encoding(vocabulary)
    return any(len(e.encode_ordinary(x)) == 1 for x in (part, part.lower(), " " + part, " " + part.lower()))


def known(run: str, vocabulary: str) -> bool:
    """A digest, a UUID, a number, or an identifier: parts of words, few digits."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
        return True
    worded = sum(len(p) for p in PART.findall(run) if len(p) >= 4 and word(p, vocabulary))
    return worded >= 0.7 * sum(c.isalnum() for c in run)


def outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches of start to end that no base span, in order of their starts, takes."""
    out = []
    for s, e, _ in taken:
        if s >= end:
            break
        if e > start:
            out.append((start, s))
            start = max(start, e)
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= LEAST]


def token_spans(text: str, taken: list[tuple[int, int, str]], vocabulary: str, ratio: float) -> list[tuple[int, int, str]]:
    out = []
    for m in LONG.finditer(text):
        for a, b in outside(m.start(), m.end(), taken):
            run = text[a:b]
            if len(run) <= ratio * len(encoding(vocabulary).encode_ordinary(run)) and not known(run, vocabulary):
                out.append((a, b, "token"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], RANK[s[2]])))


def scan(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ratio: float = 2.0) -> DataFrame:
    """(doc_id, base array<struct<start,end,kind>>, added array<...>) of each row; vocabulary names a file of public_tokenizers."""

    def run(batches):
        for pdf in batches:
            base, added = [], []
            for t in pdf["text"]:
                t = t if isinstance(t, str) else ""
                base.append(found := base_spans(t))
                added.append(token_spans(t, found, vocabulary, ratio))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "base": [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in base], "added": [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in added]})

    span = "array<struct<start:long,end:long,kind:string>>"
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, base {span}, added {span}")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for pdf in batches:
            out = {"doc_id": pdf["doc_id"].astype("Int64"), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_token": []}
            for base, added in zip(pdf["base"], pdf["added"]):
                b, a = ([(x["start"], x["end"], x["kind"]) for x in y] for y in (base, added))
                for kind in ("assign", "access", "hex"):
                    out[f"n_{kind}"].append(sum(k == kind for _, _, k in b))
                out["base_sha256"].append(hashlib.sha256(joined(b).encode()).hexdigest())
                out["spans"].append(joined([*b, *a]))
                out["n_token"].append(len(a))
            yield pd.DataFrame(out)

    found = scan(util.table(spark, sf_dir, "documents"))
    return found.mapInPandas(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")
