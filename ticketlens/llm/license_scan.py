"""Short license notices in texts, found with a bounded number of edits.

A notice that may differ by k edits is cut into k + 1 parts; if the text holds the notice with at
most k edits, one part is untouched (pigeonhole). All parts of all notices are seeds of one
Aho-Corasick automaton, which reads each text once. Around every seed found, a window of the
notice's length plus k on either side is given to the regex library, which matches the notice
with at most k insertions, deletions and substitutions and reports where and with how many.

Texts are compared as their words, lower-cased in A-Z and joined by one space, so line breaks
and punctuation inside a notice cost nothing. A notice with k = 0 is one seed, and every place
where its words stand consecutively is reported. For k > 0 a place is a best match that begins
and ends at word borders; matches of one notice that overlap count once, with the fewest edits.

Defined results: null counts as the empty text, with no word and no place; equal texts have
equal results; an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import slices, text_of


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int = 0


#: Exact phrases, then notices that may differ by a few characters.
NOTICES = (
    Notice("cc-by", "cc by"),
    Notice("gpl", "general public license"),
    Notice("reserved", "all rights reserved"),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "gnu general public license", 3),
    Notice("gpl", "gnu lesser general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("apache", "apache license version 2 0", 3),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("reserved", "no part of this publication may be reproduced", 4),
)

SPANS = (
    "array<struct<notice:int,label:string,first_word:int,last_word:int,edits:int,"
    "matched:string>>"
)
_SPAN_TYPE = pa.list_(
    pa.struct(
        [
            ("notice", pa.int32()),
            ("label", pa.string()),
            ("first_word", pa.int32()),
            ("last_word", pa.int32()),
            ("edits", pa.int32()),
            ("matched", pa.string()),
        ]
    )
)
#: Word bytes stay (A-Z in lower case), all others become spaces. Bytes from 0x80 are word bytes.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
    for c in range(256)
)


def cut(words: str, parts: int) -> list[tuple[int, str]]:
    """Cut a phrase into ``parts`` pieces of nearly equal length, each with its offset."""
    if parts > len(words):
        raise ValueError("a notice needs more characters than edits")
    ends = [len(words) * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Scanner:
    """The automaton and the fuzzy patterns of a list of notices."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for n, notice in enumerate(notices):
            padded = f" {notice.words} "
            parts = cut(padded if not notice.edits else notice.words, notice.edits + 1)
            for offset, part in parts:
                found.setdefault(part, []).append((n, offset))
            fuzzy = rf"(?b)(?<= )(?:{regex.escape(notice.words, literal_spaces=True)}){{e<={notice.edits}}}(?= )"
            self.patterns.append(regex.compile(fuzzy) if notice.edits else None)
        for part, uses in found.items():
            self.seeds.add_word(part, (len(part), uses))
        self.seeds.make_automaton()

    def _matches(self, folded: str, n: int, windows: list[list[int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice's places in its seeds' windows; of overlapping ones the best stays.

        A window is about as long as the notice, however many seeds follow one another, so the cost is linear.
        """
        notice, pattern = self.notices[n], self.patterns[n]
        short, long = len(notice.words) - notice.edits, len(notice.words) + 4 * notice.edits + 4
        merged: list[list[int]] = []
        for low, high in sorted(windows):
            # The seeds of one place have windows that differ by a few characters.
            if merged and high - merged[-1][0] <= long:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        heap: list[tuple[int, int, int, int, int]] = []

        def search(low: int, high: int) -> None:
            if high - low >= short and (m := pattern.search(folded, low, high)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), low, high))

        for low, high in merged:
            search(low, high)
        taken: list[tuple[int, int, int]] = []
        while heap:
            edits, start, end, low, high = heapq.heappop(heap)
            i = bisect.bisect(taken, (start, end, edits))
            over = [t for t in taken[max(0, i - 1) : i + 1] if t[0] < end and t[1] > start]
            if not over:
                bisect.insort(taken, (start, end, edits))
                over = [(start, end, edits)]
            # What the better match hides in this window lies before or after it.
            search(low, over[0][0])
            search(over[-1][1], high)
        return taken

    def scan(self, text: str) -> tuple[int, list[tuple[int, str, int, int, int, str]]]:
        """The number of words, and (notice, label, first word, last word, edits, matched words)."""
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        folded = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        windows: dict[int, list[list[int]]] = {}
        spans = []
        for end, (length, uses) in self.seeds.iter(folded):
            start = end - length + 1
            for n, offset in uses:
                notice = self.notices[n]
                if not notice.edits:
                    spans.append((n, start + 1, start + 1 + len(notice.words), 0))
                    continue
                low = max(0, start - offset - notice.edits - 1)
                high = min(len(folded), start - offset + len(notice.words) + notice.edits + 1)
                windows.setdefault(n, []).append([low, high])
        for n, own in windows.items():
            spans += [(n, *m) for m in self._matches(folded, n, own)]
        out, seen, at = [], -1, 0
        for n, start, end, edits in sorted(spans, key=lambda s: (s[1], s[0])):
            seen += folded.count(" ", at, start)
            at = start
            last = seen + folded.count(" ", start, end)
            out.append((n, self.notices[n].label, seen, last, edits, folded[start:end]))
        return len(words), out


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def _scan(notices: tuple[Notice, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = ("notice", "label", "first_word", "last_word", "edits", "matched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(notices).scan
        for batch in batches:
            for part in slices(batch, "text"):
                results = [scan(t) for t in part.column("text").to_pylist()]
                spans = [[dict(zip(keys, s, strict=True)) for s in found] for _, found in results]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _ in results], pa.int64()),
                        pa.array(spans, _SPAN_TYPE),
                    ],
                    ["doc_id", "n_words", "spans"],
                )

    return run


def scan_licenses(
    docs: DataFrame,
    notices: Sequence[Notice] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words and spans (notice number, label, first and last word, edits, words) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scan(tuple(notices)), f"doc_id {kind}, n_words bigint, spans {SPANS}")


def summary(scanned: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """Per document: places of the exact notices, labels of them and of all, and a score.

    The score is the share of a notice's characters that are as they should be, of its best place.
    """
    exact = F.filter("spans", lambda s: s["edits"].isNull() | s["notice"].isin(
        [n for n, notice in enumerate(notices) if not notice.edits]
    ))
    lengths = F.array(*[F.lit(float(len(n.words))) for n in notices])
    joined = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    starts = F.transform(exact, lambda s: s["first_word"].cast("bigint"))
    closeness = F.transform(
        "spans", lambda s: 1 - s["edits"] / F.element_at(lengths, s["notice"] + 1)
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"),
    )
