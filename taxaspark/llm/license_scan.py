"""License detection by ordered signature rules.

Each rule is a regular expression over the text's words (lower-cased, joined by one
space), with a label, a priority, a confidence and a keyword: a word that must occur
for the rule to be tried.  The keyword prefilter is a set intersection over the words
the text has anyway, so texts without license words cost one pass.  Detections are
resolved in priority order; one whose word interval lies within an accepted interval
is suppressed (prefix maximum in a Fenwick tree, O(n log n)).

Contract phrases (``BASE``) are found at every place and their labels always stay.
A null or empty text has no words and no detections (score 0).  Texts are processed
whole.  Repeated rows and null ids give a row each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import GRANTED, SECTIONS, U

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules, best first."""
    out = []
    for priority, section in enumerate(SECTIONS):
        for line in section.strip().split("\n"):
            label, keyword, confidence, pattern = line.split(" | ")
            pattern = f"(?:{{U}})?{pattern}" if priority == GRANTED else pattern
            out.append(Rule(label, keyword, re.compile(f"(?<= ){pattern.replace('{U}', U)}(?= )"), priority, float(confidence)))
    return out


class Found(NamedTuple):
    start: int  # word
    end: int  # word after the last
    rule: int


def resolve(found: list[Found], ranks: list[int]) -> list[Found]:
    """Detections not contained in an accepted one of better or equal rank, in order of start."""
    order = sorted(found, key=lambda f: (ranks[f.rule], f.start - f.end, f.start, f.rule))
    starts = sorted({f.start for f in found})
    at = {s: i + 1 for i, s in enumerate(starts)}
    tree = [0] * (len(starts) + 1)
    kept = []
    for f in order:
        i, most = at[f.start], 0
        while i:
            most = max(most, tree[i])
            i &= i - 1
        if most >= f.end:
            continue
        kept.append(f)
        i = at[f.start]
        while i < len(tree):
            tree[i] = max(tree[i], f.end)
            i += i & -i
    return sorted(kept)


_WORDS = bytes.maketrans(bytes(range(256)), bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)))


class Scanner:
    """The compiled rules, grouped by keyword."""

    def __init__(self):
        self.rules = rules()
        self.ranks = [r.priority for r in self.rules]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_keyword.setdefault(r.keyword.encode(), []).append(i)
        self.base = [(f" {p} ".encode(), p.split()[0].encode(), label) for p, label in BASE]
        self.base_words = [frozenset(w.encode() for w in p.split()) for p, _ in BASE]

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
        have = set(words)
        base, found = [], []
        tried = [i for k, ids in self.by_keyword.items() if k in have for i in ids]
        due = [k for k, need in enumerate(self.base_words) if need <= have]
        if not tried and not due:
            return len(words), 0, None, None, "", "", 0.0
        line = b" " + b" ".join(words) + b" "
        for k in due:
            phrase, _, label = self.base[k]
            at, word, seen = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", seen, at)
                seen = at
                base.append((word, label))
                at = line.find(phrase, at + 1)
        if tried:
            chars = line.decode("utf-8", "surrogatepass")
            spans = [(m.start(), m.end(), i) for i in tried for m in self.rules[i].pattern.finditer(chars)]
            ends = sorted({p for s, e, _ in spans for p in (s, e)})
            number, seen, n = {}, 0, -1
            for p in ends:  # words begun before a character position
                n += chars.count(" ", seen, p)
                seen = p
                number[p] = n
            found = resolve([Found(number[s], number[e] + 1, i) for s, e, i in spans], self.ranks)
        labels = {label for _, label in base} | {self.rules[f.rule].label for f in found}
        doubt = 1.0
        for f in found:
            doubt *= 1 - self.rules[f.rule].confidence
        score = 1.0 if base else 1 - doubt
        starts = [w for w, _ in base]
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score

    def detections(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label) of the rules' resolved detections."""
        words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
        have = set(words)
        chars = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
        spans = [(m.start(), m.end(), i) for k, ids in self.by_keyword.items() if k in have for i in ids for m in self.rules[i].pattern.finditer(chars)]
        found = [Found(chars.count(" ", 0, s) - 1, chars.count(" ", 0, e), i) for s, e, i in spans]
        return [(f.start, f.end, self.rules[f.rule].label) for f in resolve(found, self.ranks)]


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[doc_id], docs[text]).mapInArrow(run, SCHEMA)
