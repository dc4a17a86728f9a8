"""Language spans in mixed text: scripts narrow the candidates, Viterbi labels the words.

Learning counts character n-grams (one to ``MAX_GRAM`` characters, with a mark at either end of
the word) of the labelled words, per language, in hashed cells: ``CELLS`` cells per language, a
fixed table whatever the corpus. Cells are counted in Spark with map-side sums; the model that
is sent to the tasks is CELLS x languages numbers. ``SAMPLE`` bounds the labelled documents per
language that are learned from (those whose hash of id falls in the first SAMPLE / n of its
range, so about SAMPLE of n); 0 takes all.

A word's score for a language is the mean over its longest n-grams of log p(n-gram | language),
with add-one smoothing, times its length up to ``EVIDENCE`` characters. Only languages that use
the word's script are candidates: scripts are ranges of code points, and a language uses a
script if at least ``SCRIPT_SHARE`` of its labelled letters are of it. If no language does, all
are candidates. A run of letters is cut where its script changes, as Han or kana run on into Latin
without a space, so each part is a word with candidates of its own. Viterbi then finds the labels of
all words of a text with the highest sum of scores minus ``SWITCH`` per change of language, over
the whole text; runs of one label are the spans. The text's language is the one with most
letters in its spans, and the score is that share of the letters.

Defined results: null, and text without a letter, is ``und`` with score 0; equal texts have equal
results; ties between languages go to the first in code-point order; with no labelled text at
all everything is ``und``; an empty table gives no rows. Only the named columns are read, so
others of any name do no harm; where rows are kept they keep all their columns.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import id_text, slices, text_of

MAX_GRAM = 3
CELLS = 1 << 15
#: Labelled documents per language that are learned from.
SAMPLE = 4_000
SCRIPT_SHARE = 0.01
EVIDENCE = 12
SWITCH = 12.0
UNKNOWN = "und"
#: Words a task remembers, to bound its memory.
MEMORY = 300_000
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

# First code points of script ranges of the Unicode standard.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0700, "other"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB07, "other"),
    (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def _script_run() -> re.Pattern[str]:
    """Matches characters of one script; apostrophes belong to any."""
    ranges: dict[str, str] = {}
    for (start, name), end in zip(SCRIPTS, [*_STARTS[1:], 0x110000], strict=True):
        ranges[name] = ranges.get(name, "") + f"\\U{start:08x}-\\U{end - 1:08x}"
    return re.compile("|".join(f"[{r}'’]+" for r in ranges.values()))


SCRIPT_RUN = _script_run()


def words_of(text: str) -> list[str]:
    """Runs of letters of one script, lower-cased and composed."""
    found = WORD.findall(unicodedata.normalize("NFC", text).lower())
    if text.isascii():
        return found
    out = []
    for w in found:
        if w.isascii():
            out.append(w)
        elif any(map(str.isalpha, w)):
            parts = SCRIPT_RUN.findall(w)
            out += parts if len(parts) == 1 else [p for p in (q.strip("'’") for q in parts) if any(map(str.isalpha, p))]
    return out


def grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of each word, and the word each belongs to.

    A word of n characters (with its two marks) has one n-gram per position: the longest that
    starts there, and the shorter ones at its end.
    """
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for k in range(MAX_GRAM):
        there = left > k
        shifted = np.zeros_like(codes)
        shifted[: len(codes) - k] = codes[k:]
        mixed = np.where(there, (mixed ^ shifted) * np.uint64(0x9E3779B97F4A7C15), mixed)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(CELLS)).astype(np.int64), owner


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: log p(cell | language), one row per cell.
    logp: np.ndarray
    #: script -> which languages use it
    scripts: dict[str, np.ndarray]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language; languages of other scripts are ruled out."""
        cells, owner = grams(words)
        total = np.zeros((len(words), len(self.langs)))
        count = np.bincount(owner, minlength=len(words))
        for j in range(len(self.langs)):
            total[:, j] = np.bincount(owner, weights=self.logp[cells, j], minlength=len(words))
        sizes = np.fromiter((min(len(w), EVIDENCE) for w in words), dtype=float, count=len(words))
        scores = total / count[:, None] * sizes[:, None]
        for i, w in enumerate(words):
            # Most words are plain Latin letters; the others look their script up.
            used = self.scripts.get("latin" if w.isascii() else script_of(w[0]))
            if used is not None and not used.all():
                scores[i, ~used] = -1e6
        return scores - scores.max(axis=1, keepdims=True)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    scripts: dict[tuple[str, str], int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                cells, _ = grams(words)
                own = counts.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
                own += np.bincount(cells, minlength=CELLS)
                for w in words:
                    key = (lang, "latin" if w.isascii() else script_of(w[0]))
                    scripts[key] = scripts.get(key, 0) + len(w)
    schema = ["lang", "kind", "cell", "n"]
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(["gram"] * len(at)), pa.array([str(c) for c in at]), pa.array(own[at])],
            schema,
        )
    if scripts:
        langs, names = zip(*scripts, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs), pa.array(["script"] * len(langs)), pa.array(names), pa.array(scripts.values(), pa.int64())],
            schema,
        )


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of rows (id, text, lang); rows without text or language are left out."""
    rows = labelled.filter("text is not null and lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.md5(F.concat(F.lit("language|"), id_text(F.col("id")))).alias("place"), "text"
    )
    if sample:
        # The model has a column per language, so their number is small by design.
        sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
        share = F.lit(1.0)
        for lang, n in zip(sizes["lang"], sizes["n"], strict=True):
            share = F.when(F.col("lang") == lang, sample / n).otherwise(share)
        near = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(16.0**8)
        rows = rows.filter(near < share)
    counted = (
        rows.select("lang", "text")
        .mapInArrow(_count_grams, "lang string, kind string, cell string, n bigint")
        .groupBy("lang", "kind", "cell")
        .agg(F.sum("n").alias("n"))
    )
    found = counted.toArrow().to_pydict()
    langs = tuple(sorted(set(found["lang"])))
    place = {lang: j for j, lang in enumerate(langs)}
    table = np.ones((CELLS, len(langs)))
    letters: dict[str, np.ndarray] = {}
    for lang, kind, cell, n in zip(*(found[c] for c in ("lang", "kind", "cell", "n")), strict=True):
        if kind == "gram":
            table[int(cell), place[lang]] += n
        else:
            letters.setdefault(cell, np.zeros(len(langs)))[place[lang]] += n
    logp = np.log(table / table.sum(axis=0)) if langs else table
    total = sum(letters.values()) if letters else np.zeros(len(langs))
    scripts = {s: used for s, n in letters.items() if (used := n >= SCRIPT_SHARE * total).any()}
    return Model(langs, logp.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of all words of many texts at once.

    ``words`` indexes rows of ``scores`` (at most 0, best language 0), text after text. Texts run
    side by side, longest first, one word per step.
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    labels = np.zeros(len(words), dtype=np.int32)
    # A path that changes costs at least one switch. Where the best unchanging path costs no
    # more, it is the best one.
    filled = lengths > 0
    constant = np.zeros((len(lengths), scores.shape[1]))
    if filled.any():
        constant[filled] = np.add.reduceat(scores[words], starts[filled], axis=0)
    best = constant.argmax(axis=1)
    plain = constant.max(axis=1) >= -switch
    labels[:] = np.repeat(best, lengths)
    todo = np.flatnonzero(~plain & filled)
    if not len(todo):
        return labels
    todo = todo[np.argsort(-lengths[todo], kind="stable")]
    begin, size = starts[todo], lengths[todo]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    value = np.zeros((len(todo), scores.shape[1]))
    stays, froms = [], []
    for t, k in enumerate(active):
        now = value[:k]
        top = now.argmax(axis=1)
        jump = now[np.arange(k), top] - switch
        stay = now >= jump[:, None]
        stays.append(stay)
        froms.append(top.astype(np.int32))
        value[:k] = np.maximum(now, jump[:, None]) + scores[words[begin[:k] + t]]
    state = np.zeros(len(todo), dtype=np.int64)
    done = len(todo)
    state[:done] = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = state[:k]
        labels[begin[:k] + t] = at
        stay = stays[t][np.arange(k), at]
        state[:k] = np.where(stay, at, froms[t])
    return labels


SPANS = "array<struct<lang:string,first_word:int,last_word:int,letters:int>>"
_SPAN_TYPE = pa.list_(
    pa.struct(
        [("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("letters", pa.int32())]
    )
)


class Labeller:
    """Labels texts with a model; remembers the scores of words it has seen."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs)))
        self.letters = np.zeros(0, dtype=np.int64)

    def _indices(self, texts: list[list[str]]) -> np.ndarray:
        fresh = list({w for words in texts for w in words} - self.known.keys())
        if len(self.known) + len(fresh) > MEMORY:
            self.known, self.scores, self.letters = {}, self.scores[:0], self.letters[:0]
            fresh = list({w for words in texts for w in words})
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.word_scores(fresh)))
            self.letters = np.concatenate((self.letters, np.fromiter(map(len, fresh), np.int64, len(fresh))))
        get = self.known.__getitem__
        total = sum(map(len, texts))
        return np.fromiter((get(w) for words in texts for w in words), np.int64, total)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """Per text its language, score and spans."""
        langs = self.model.langs
        lists = [words_of(t) for t in texts] if langs else [[] for _ in texts]
        words = self._indices(lists)
        if not len(words):
            return [(UNKNOWN, 0.0, []) for _ in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        labels = viterbi(self.scores, words, lengths, self.switch)
        letters = self.letters[words]
        text_of_word = np.repeat(np.arange(len(texts)), lengths)
        by_lang = np.bincount(
            text_of_word * len(langs) + labels, weights=letters, minlength=len(texts) * len(langs)
        ).reshape(len(texts), -1)
        new = np.ones(len(words), dtype=bool)
        new[1:] = (labels[1:] != labels[:-1]) | (text_of_word[1:] != text_of_word[:-1])
        first = np.flatnonzero(new)
        size = np.add.reduceat(letters, first)
        last = np.append(first[1:], len(words)) - 1
        begin = np.cumsum(lengths) - lengths
        owner = text_of_word[first]
        spans: list[list[dict]] = [[] for _ in texts]
        for o, a, b, j, n in zip(
            owner.tolist(), (first - begin[owner]).tolist(), (last - begin[owner]).tolist(), labels[first].tolist(), size.tolist(), strict=True
        ):
            spans[o].append({"lang": langs[j], "first_word": a, "last_word": b, "letters": n})
        top, whole = by_lang.argmax(axis=1), by_lang.sum(axis=1)
        return [
            (langs[j], float(by_lang[i, j] / whole[i]), spans[i]) if whole[i] else (UNKNOWN, 0.0, [])
            for i, j in enumerate(top.tolist())
        ]


def _identify(model: Model, switch: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch)
        for batch in batches:
            for part in slices(batch, "text"):
                found = labeller.label(part.column("text").to_pylist())
                langs, scores, spans = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPAN_TYPE)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return run


def identify(
    docs: DataFrame,
    model: Model,
    switch: float = SWITCH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        _identify(model, switch), f"doc_id {kind}, lang_pred string, score double, spans {SPANS}"
    )


def _kept(model: Model, switch: float, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array([lang != UNKNOWN for lang, _, _ in labeller.label(texts)]))

    return run


def kept_documents(docs: DataFrame, model: Model, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns."""
    # Positional names, as a column's own may hold a dot.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"
    return plain.mapInArrow(_kept(model, switch, text), plain.schema).toDF(*docs.columns)
