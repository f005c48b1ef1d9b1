"""Secret scan with corpus-wide ownership of candidate values.

Texts are scanned once for base spans and for further credential shapes; only
spans and hashes of values go on.  For every hash the corpus is asked how many
owners (sources) and repositories (documents) hold it: counts per (value,
owner) are combined before the shuffle.  A value that many owners or very many
repositories hold is a copied example; one that few hold and that looks random
is live.  Spans
of further shapes are reported where their value is not a copied example; base
spans are always reported.

Cases: null and empty texts have no spans; a null source is an owner of its
own; repeated rows count as repositories of their own and get a row each; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import slices, stored

#: Base kinds, their patterns, the group that holds the value, its least length, texts one of which must be there.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6, ("password", "passwd", "secret", "token", "api")),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20, ("akia",)),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24, ()),
}
#: Further shapes, in the same form.
MORE = {
    "private_key": (re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*"), 0, 30, ("private key",)),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 30, ("eyj",)),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"), 0, 30, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    "slack": (re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}"), 0, 15, ("xox",)),
    "google": (re.compile(r"AIza[0-9A-Za-z_-]{35}"), 0, 39, ("aiza",)),
    "stripe": (re.compile(r"[srp]k_(?:live|test)_[0-9A-Za-z]{16,}"), 0, 24, ("k_live_", "k_test_")),
    "url": (re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]+://[^\s:/@]+:([^\s:/@]{3,})@[A-Za-z0-9.-]+"), 1, 3, ("://",)),
    "bearer": (re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)"), 1, 20, ("bearer ",)),
    "key_pair": (re.compile(r"""(?:access|client|consumer|private|signing|encryption)[_-](?:key|secret|token)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=-]{16,})""", re.A | re.I), 1, 16, ("key", "secret", "token")),
    "credential": (re.compile(r"""(?:pwd|passphrase|auth|credentials?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.A | re.I), 1, 8, ("pwd", "passphrase", "auth", "credential")),
}
KINDS = [*BASE, *MORE]
#: Owners from which on a value is a copied example.
COPIED_OWNERS = 3
#: Repositories from which on it is one, whatever its owners.
COPIED_REPOSITORIES = 100
#: Bits per character of a value that looks random.
LIVE_BITS = 2.5
PLACEHOLDERS = re.compile(r"example|sample|changeme|placeholder|dummy|your|xxxx|1234567|abcdef|\.\.\.|test", re.I)


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all kinds; each kind leftmost and without overlap."""
    low, found = text.lower(), []
    for kind, (pattern, group, least, needs) in (BASE | MORE).items():
        if not needs or any(n in low for n in needs):
            found += [(kind, *m.span(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


def looks_random(value: str) -> bool:
    n = len(value)
    bits = -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0
    return bits >= LIVE_BITS and not PLACEHOLDERS.search(value)


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, counts, base_sha256 and spans (kind, number of kind, start, end, hash, first of its value in the text, random)."""
    span = pa.struct([("kind", pa.string()), ("no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("first", pa.bool_()), ("random", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("found", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, source, text in zip(*(c.to_pylist() for c in part.select(["doc_id", "source", "text"]).columns)):
                spans, seen, found = find(text or ""), set(), []
                for kind, start, end, value in spans:
                    key = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)
                    found.append({"kind": kind, "no": KINDS.index(kind), "start": start, "end": end, "hash": key, "first": key not in seen, "random": looks_random(value)})
                    seen.add(key)
                counts = Counter(k for k, *_ in spans)
                base = join_spans([s[:3] for s in spans if s[0] in BASE])
                rows.append({"doc_id": doc, "source": source, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "found": found} | {f"n_{k}": counts[k] for k in BASE})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(
        run, "doc_id bigint, source string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "found array<struct<kind:string,no:int,start:bigint,end:bigint,hash:bigint,first:boolean,random:boolean>>"
    )


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories; ``spans``: source, hash, first."""
    per_owner = spans.groupBy("hash", "source").agg(F.count_if("first").alias("n"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def secret_scan(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners and most_repositories (of its values); one row per document."""
    rows = stored(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    spans = rows.where(F.size("found") > 0).select("row", "source", F.explode("found").alias("s")).select("row", "source", "s.*")
    judged = spans.join(ownership(spans.select("source", "hash", "first")), "hash").withColumn(
        "copied", (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    )
    kept = F.when((F.col("no") < len(BASE)) | ~F.col("copied"), F.struct("start", "no", "end", "kind"))
    per_doc = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(kept)).alias("kept"), F.count_if(~F.col("copied") & F.col("random")).alias("n_live"), F.count_if("copied").alias("n_copied"),
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    text = F.array_join(F.transform("kept", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    return rows.drop("found", "source").join(per_doc, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
        F.coalesce("most_owners", zero).alias("most_owners"), F.coalesce("most_repositories", zero).alias("most_repositories"),
    )


def brute_force(docs: list[tuple[int, str | None, str | None]], copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> list[tuple]:
    """Plain reference for tests: docs are (doc_id, source, text)."""
    owners, repositories = {}, Counter()
    for _, source, text in docs:
        values = {value for *_, value in find(text or "")}
        repositories.update(values)
        for value in values:
            owners.setdefault(value, set()).add(source)
    out = []
    for doc, _, text in docs:
        spans = find(text or "")
        base = [s[:3] for s in spans if s[0] in BASE]
        more = [s[:3] for s in spans if s[0] in MORE and len(owners[s[3]]) < copied_owners and repositories[s[3]] < copied_repositories]
        n = Counter(s[0] for s in base)
        out.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + more)))
    return out
