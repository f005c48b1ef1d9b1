"""License scan: ordered signature rules behind a keyword gate.

A text becomes lower-case words with one space between.  One pass of a keyword
automaton finds which rules can match at all; only their patterns run.
Detections are word intervals.  By priority, then length, then start, each is
kept unless a kept one contains it, so "apache license" inside a grant with a
version says nothing of its own.

Phrases of the base list are always reported, overlapping ones too; suppression
never drops their labels.

Cases: null and wordless texts have no places, empty labels, null first and last
word and score 0; repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from panelscope.llm.common import WORD_BYTES, rows_of, slices
from panelscope.llm.license_rules import Rule, build

#: Phrase and label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Confidence of a base phrase.
BASE_CONFIDENCE = 0.9

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:bigint,end:bigint,priority:int,confidence:double>>"
)


@cache
def gate():
    """(automaton of keywords, rules by keyword number)."""
    import ahocorasick

    automaton, by_keyword = ahocorasick.Automaton(), {}
    for i, rule in enumerate(build()):
        by_keyword.setdefault(" " + rule.keyword, []).append((i, rule))
    for k, word in enumerate(by_keyword):
        automaton.add_word(word, k)
    automaton.make_automaton()
    return automaton, list(by_keyword.values())


def suppress(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """(start, end, order, rule): drops intervals inside a kept one of higher or equal rank."""
    kept: list[tuple[int, int, int, Rule]] = []
    number = {start: k for k, start in enumerate(sorted({d[0] for d in found}), 1)}
    furthest = [0] * (len(number) + 1)  # Fenwick tree: greatest end of kept intervals by start
    for one in sorted(found, key=lambda d: (-d[3].priority, d[0] - d[1], d[0], d[2])):
        k, end = number[one[0]], -1
        while k:
            end = max(end, furthest[k])
            k &= k - 1
        if end < one[1]:
            kept.append(one)
            k = number[one[0]]
            while k < len(furthest):
                furthest[k] = max(furthest[k], one[1])
                k += k & -k
    return sorted(kept, key=lambda d: d[:3])


def spaces_before(text, space, places) -> dict[int, int]:
    """How many spaces stand before each of ``places``; one pass over the text."""
    out, last, n = {}, 0, 0
    for at in sorted(set(places)):
        n += text.count(space, last, at)
        out[at], last = n, at
    return out


def detect(text: str) -> list[tuple[int, int, int, Rule]]:
    """Kept detections of word text with a space at both ends, as character intervals."""
    automaton, rules = gate()
    seen = {k for _, k in automaton.iter(text)}
    return suppress([(m.start(), m.end(), i, rule) for k in seen for i, rule in rules[k] for m in rule.pattern.finditer(text)])


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(byte position, label) of every base phrase in word text, overlapping ones too."""
    places = []
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = text.find(needle)
        while at >= 0:
            places.append((at, label))
            at = text.find(needle, at + 1)
    return places


def scan(text: bytes) -> dict:
    ws = text.translate(WORD_BYTES).split()
    flat = b" " + b" ".join(ws) + b" "
    places = base_places(flat)
    starts = list(spaces_before(flat, b" ", [at for at, _ in places]).values())
    plain = flat.decode(errors="replace")
    found = detect(plain)
    before = spaces_before(plain, " ", [x for s, e, *_ in found for x in (s, e)])
    spans = [{"label": r.label, "first": before[s] - 1, "end": before[e], "priority": r.priority, "confidence": r.confidence} for s, e, _, r in found]
    base = {label for _, label in places}
    return {
        "n_words": len(ws), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": max([BASE_CONFIDENCE * bool(base), *(s["confidence"] for s in spans)]), "spans": spans,
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document with SCHEMA's columns; no shuffle."""
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [{"doc_id": doc} | scan(text) for doc, text in zip(part.column(0).to_pylist(), rows_of(part))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
