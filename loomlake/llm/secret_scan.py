"""Secret scanning with corpus-wide ownership frequency.

Candidates are found in every whole text: assignments to secret-like names, access keys and long hexadecimal runs (the base),
and tokens by known prefixes, signed web tokens, credentials in addresses and runs of mixed characters with high entropy.
A candidate's value is hashed; over the corpus, its hash is counted by distinct owners and distinct repositories. A value that
many owners or many repositories hold is a copied example; one of few that looks random is live. Base spans always
stay, with their status; further candidates become spans where they are live.

The scan runs once over the documents and writes its narrow result. Counting combines within each task first and shuffles hashes
only; a hash that a third of the corpus holds is one row for each owner and task, and its rows meet the counts in many tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import textkit as tk
from loomlake.llm.frames import NULL_ID, shown, spread
from loomlake.scratch import Scratch

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "jwt", "url", "random")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Further kinds: prefixes of tokens, web tokens, credentials in addresses, long runs of mixed characters.
_TOKEN = re.compile(r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_URL = re.compile(r"://([^\s:/@]+):([^\s/@]+)@")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Parts of a value that show a placeholder; those of passwords in addresses, which are short, go by more names.
_PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "xxxx", "1234567")
_PASSWORDS = ("password", "passwd", "secret", "username", "hunter2", "${", "{{", "<", "***")
_OUT = "k long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, found array<struct<kind: string, start: long, stop: long, hash: long, live: boolean>>"


def entropy(value: str) -> float:
    """Bits a character of a value's own distribution."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base rules, leftmost and non-overlapping for each kind."""
    out = []
    raw = text.encode().lower()
    if any(h in raw for h in _HINTS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in raw:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def further_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates beyond the base rules that overlap none of their spans, nor each other."""
    out, taken = [], bytearray(len(text))
    for _, a, b, _ in base:
        taken[a:b] = b"\1" * (b - a)
    for kind, rule, group in (("jwt", _JWT, 0), ("token", _TOKEN, 0), ("url", _URL, 2), ("random", _LONG, 0)):
        if kind == "url" and "://" not in text:
            continue
        for m in rule.finditer(text):
            a, b = m.span(group)
            value = m[group]
            if kind == "random" and not (re.search("[a-z]", value) and re.search("[A-Z]", value) and len(re.findall("[0-9]", value)) >= 2 and entropy(value) >= 4):
                continue
            if taken.find(1, a, b) < 0:
                out.append((kind, a, b, value))
                taken[a:b] = b"\1" * (b - a)
    return out


def looks_live(kind: str, value: str) -> bool:
    """Random enough for a generated value: many distinct characters and no placeholder.

    A password in an address may be short, so it needs four fifths of the entropy that its length allows, if that is less.
    """
    low, least = value.lower(), 3.0
    if kind == "url":
        least = min(least, 0.8 * math.log2(max(2, len(value))))
    return entropy(value) >= least and not any(x in low for x in (*_PLACEHOLDERS, *(_PASSWORDS if kind == "url" else ())))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches):
    from loomlake.llm.spans import listed

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.int64()), ("live", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            spans = base + further_spans(text, base)
            counts = Counter(k for k, *_ in base)
            found = [{"kind": k, "start": a, "stop": b, "hash": _hash(v), "live": looks_live(k, v)} for k, a, b, v in spans]
            rows.append((counts["assign"], counts["access"], counts["hex"], listed([s[:3] for s in base], KINDS), found))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.record_batch([batch.column(c) for c in ("k", "owner", "repo")] + [pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), kind))], names=["k", "owner", "repo", "n_assign", "n_access", "n_hex", "base", "found"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 2, max_repos: int = 3) -> DataFrame:
    """Secret spans of each document, and which of them are live.

    Returns ``id_col``, n_assign, n_access, n_hex, base (base spans as kind:start:end), spans (all spans, alike), statuses
    (kind:start:status of each candidate: live, copied, plain), where copied means that more than ``max_owners`` owners or
    more than ``max_repos`` repositories hold the value, live that fewer do and it looks random, plain neither; and holders
    (kind:start:owners:repositories of each candidate).

    Null text is empty; a null owner or repository counts as one of its own. A null id stays null. Rows that repeat an id are
    scanned one by one, each with its own spans. Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("\0"))
    base = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NULL_ID)).alias("k"), text(owner_col).alias("owner"), F.concat_ws("\1", *map(text, repo_cols)).alias("repo"), docs[text_col].cast("string").alias("text"))
    scanned = scratch.write(base.mapInArrow(tk.releasing(_scan), _OUT).withColumn("row", F.monotonically_increasing_id()), "scan")
    found = scanned.select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    held = found.select("hash", "owner", "repo").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    joined = spread(found, held, "hash", "row").select("row", "kind", "start", "stop", "live", "owners", "repos")
    status = F.when((F.col("owners") > max_owners) | (F.col("repos") > max_repos), "copied").when(F.col("live"), "live").otherwise("plain")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    judged = joined.withColumn("status", status).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "stop", "kind", "status", "owners", "repos"))).alias("all"))
    shown_spans = F.filter("all", lambda s: (s["place"] <= len(BASE)) | (s["status"] == "live"))
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    judged = judged.select("row", F.array_join(F.transform(shown_spans, as_text), ",").alias("spans"), F.array_join(F.transform("all", lambda s: F.concat_ws(":", s["kind"], s["start"], s["status"])), ",").alias("statuses"), F.array_join(F.transform("all", lambda s: F.concat_ws(":", s["kind"], s["start"], s["owners"], s["repos"])), ",").alias("holders"))
    out = scanned.drop("found").join(judged, "row", "left")
    return out.select(shown().alias(id_col), "n_assign", "n_access", "n_hex", "base", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("statuses", F.lit("")).alias("statuses"), F.coalesce("holders", F.lit("")).alias("holders"))
