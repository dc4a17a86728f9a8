"""Token counts, licenses, HTML, language and SentencePiece sampling against brute force."""

from __future__ import annotations

import itertools
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from ticketlens.llm import html_extraction, language_id, license_scan, token_counts  # noqa: E402
from ticketlens.llm import sentencepiece_sampling as sps  # noqa: E402

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


# --- token counts ------------------------------------------------------------------------


def test_counts_are_the_library_s_and_cached(spark, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = Counter(
        (i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in edge.rows()
    )
    for _ in range(2):
        got = token_counts.count_tokens(edge.frame(spark), cache).collect()
        assert Counter(tuple(r) for r in got) == want
    stored = spark.read.parquet(f"{cache}/{token_counts.tokenizer_digest(MODEL)}")
    assert stored.count() == len({t or "" for _, t, *_ in edge.rows()})
    assert token_counts.count_tokens(edge.empty(spark), f"{cache}-2").collect() == []


def test_repeats_of_id_and_text_are_encoded_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = [(None, "one text")] * 300 + [(7, "one text")] * 5 + [(7, "another")] * 40 + [(None, None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = token_counts.count_tokens(docs, cache).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    folder = f"{cache}/{token_counts.tokenizer_digest(MODEL)}"
    assert spark.read.parquet(folder).count() == 3
    # A cache that other corpora filled gives only this one's counts.
    other = token_counts.count_tokens(spark.createDataFrame([(1, "another")], docs.schema), cache).collect()
    assert [(r.doc_id, r.n_bytes) for r in other] == [(1, 7)]
    assert spark.read.parquet(folder).count() == 3


def test_json_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.count_tokens(edge.frame(spark), f"file://{tmp_path}/c", tokenizer="byte_bpe_50k.json").collect()
    want = Counter((i, len(model.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in edge.rows())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want


# --- licenses ----------------------------------------------------------------------------

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_exact_places(spark):
    texts = [
        "Licensed under CC BY-NC 4.0. cc, by; CC\nBY!", "GNU General  Public\tLicense, all rights reserved", "ccc by cc byé",
        "All Rights RESERVED all rights reserved", None, "", "cc", "the general public license of the general public license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan_licenses(df)).collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, text in enumerate(texts):
        words = LICENSE_WORD.findall((text or "").translate(FOLD))
        places = [
            (k, label) for phrase, label in phrases.items() for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_every_bounded_edit_is_found():
    rng, scanner = random.Random(3), license_scan.Scanner(license_scan.NOTICES)
    for n, notice in enumerate(license_scan.NOTICES):
        for _ in range(30 if notice.edits else 1):
            letters = list(notice.words)
            for _ in range(notice.edits):
                i = rng.choice([j for j, c in enumerate(letters) if c != " " and 0 < j < len(letters) - 1])
                letters[i] = rng.choice("qxz")
            _, spans = scanner.scan("foo bar " + "".join(letters) + " baz")
            mine = [s for s in spans if s[0] == n]
            assert mine and mine[0][2] == 2 and mine[0][4] <= notice.edits, (notice, "".join(letters))
    assert scanner.scan("plain words without any notice " * 50)[1] == []


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def places(notice, text: str) -> list[tuple[int, int]]:
    """(first word, edits) of the places of a notice by brute force; of overlapping ones the best stays."""
    words, found, kept = text.split(), [], []
    for i in range(len(words)):
        for j in range(i, len(words)):
            part = " ".join(words[i : j + 1])
            if abs(len(part) - len(notice.words)) <= notice.edits:
                edits = edit_distance(notice.words, part)
                found += [(edits, i, j)] if edits <= notice.edits else []
    for edits, i, j in sorted(found):
        if all(j < a or i > b for _, a, b in kept):
            kept.append((edits, i, j))
    return sorted((i, edits) for edits, i, _ in kept)


def test_near_notices_are_all_found():
    rng, scanner = random.Random(4), license_scan.Scanner(license_scan.NOTICES)
    texts = [(13, "mozila public license or mozilla public license")]
    for _ in range(150):
        n = rng.choice([i for i, x in enumerate(license_scan.NOTICES) if x.edits])
        parts = []
        for _ in range(rng.randint(2, 5)):
            letters = list(license_scan.NOTICES[n].words)
            for _ in range(rng.randint(0, license_scan.NOTICES[n].edits)):
                letters[rng.choice([j for j, c in enumerate(letters) if c != " "])] = rng.choice("qxz")
            parts += ["".join(letters), *rng.choices(["or", "and", "license", "public"], k=rng.randint(0, 2))]
        texts.append((n, " ".join(parts)))
    for n, text in texts:
        got = sorted((s[2], s[4]) for s in scanner.scan(text)[1] if s[0] == n)
        assert got == places(license_scan.NOTICES[n], text), text


def test_many_chained_notices_take_linear_time():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    few = "mozila public license or mozilla public license and license public "
    one, _ = len(scanner.scan(few)[1]), scanner.scan(few * 50)
    start = time.perf_counter()
    found = scanner.scan(few * 15_000)[1]
    assert len(few) * 15_000 > 1_000_000 and time.perf_counter() - start < 60
    assert len(found) == one * 15_000


# --- HTML --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this now, it is very good.</div>
<%(open)s><h1>A title</h1><p>First &amp; <b>bold paragraph with several
 words.</p><div class="advert">Another advert in the middle.</div><p>Second&nbsp;paragraph, x &lt; y.<ul><li>one item<li>two
items</ul><blockquote>A quote.</blockquote><p>Short.</%(close)s>
<aside><p>Sidebar text, long enough to look like a real paragraph of text.</p></aside>
<section id="comments"><p>A reader said something about this article.</p></section>
<form><label>Mail</label><input name=m><button>Send</button></form><footer>&copy; 2024 Site</footer><!-- <p>gone</p> --></body>"""
TEXT = "A title\nFirst & bold paragraph with several words.\nSecond paragraph, x < y.\none item\ntwo items\nA quote.\nShort."


@pytest.mark.parametrize("box", [("article", "article"), ("main", "main"), ('div class="content"', "div")])
def test_main_text(box):
    assert html_extraction.extract(PAGE % {"open": box[0], "close": box[1]}) == TEXT


@pytest.mark.parametrize(
    ("middle", "text"),
    [
        ('<svg width="3"/>', None),
        ("<svg><title>An icon</title><path d='x'></svg>", None),
        ("<svg><text>open", None),
        ("<math/>", None),
        ("<object>", None),
        ("<template><p>Never shown at all, a template of a page.</p></template>", None),
        ("<p>The sum <math><mi>e</mi><mo>=</mo><mn>2</mn></math> is <svg><text>x</text></svg>well known.</p>", "The sum e=2 is well known."),
    ],
)
def test_embedded_elements_keep_the_text_around_them(middle, text):
    page = f"<article><p>The first paragraph of the text.</p>{middle}<p>The second paragraph of the text.</p></article>"
    want = ["The first paragraph of the text.", *([text] if text else []), "The second paragraph of the text."]
    assert html_extraction.extract(page) == "\n".join(want)


def test_broken_tags_take_linear_time():
    start = time.perf_counter()
    for page in ("<a x='y' " * 60_000, "<p>text</p>" + "<b " * 150_000):
        html_extraction.extract(page)
    assert time.perf_counter() - start < 20


def test_pages_and_edge_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_extraction.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [
            " ".join(html_extraction.entities.unescape(re.sub("<[^>]*>", " ", b)).split())
            for b in re.split("<h1>|</h1>|<p>|</p>", inner)
        ]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = [(1, "u", None), (2, None, ""), (None, "u", "<"), (4, "u", "<p>a<b>c</i></p></p> &bogus; <div class='x>"), (5, "u", "plain")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract_pages(df).collect()}
    assert len(got) == 5 and got[1] == got[2] == ""
    assert html_extraction.extract_pages(df.limit(0)).collect() == []


def test_minimum_cut_against_all_labellings():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(keep, scores=scores, edges=edges):
            own = sum(max(0, z) * (not k) + max(0, -z) * k for z, k in zip(scores, keep, strict=True))
            return own + sum(c for a, b, c in edges if keep[a] != keep[b])

        least = min(cost(keep) for keep in itertools.product((False, True), repeat=n))
        assert abs(cost(html_extraction.min_cut(scores, edges)) - least) < 1e-9


# --- language ----------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.learn(docs.filter(~held).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = language_id.identify(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    found = language_id.identify(edge.frame(spark), model).collect()
    assert len(found) == len(edge.rows())
    for r in found:
        assert r.lang_pred in (*model.langs, "und")
    none = {i for i, t, *_ in edge.rows() if not any(map(str.isalpha, t or ""))}
    assert {r.doc_id for r in found if r.lang_pred == "und"} == none
    assert language_id.identify(edge.empty(spark), model).collect() == []
    kept = language_id.kept_documents(edge.frame(spark), model)
    assert kept.schema == edge.frame(spark).schema and kept.count() == sum(r.lang_pred != "und" for r in found)


def test_nothing_to_learn_from(spark):
    model = language_id.learn(edge.empty(spark).select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(edge.frame(spark), model).collect()} == {"und"}


def test_more_languages_than_a_byte_holds():
    scores = -np.ones((200, 200), dtype=np.float32)
    scores[np.arange(200), np.arange(200)] = 0
    words = np.array([199, 199, 150, 150])
    assert language_id.viterbi(scores, words, np.array([4]), 0.5).tolist() == [199, 199, 150, 150]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(0, 7, size=4)
        scores = -rng.uniform(0, 4, size=(int(lengths.sum()) + 1, 3))
        scores -= scores.max(axis=1, keepdims=True)
        words = np.arange(int(lengths.sum()))
        labels = language_id.viterbi(scores, words, lengths, 2.5)
        at = 0
        for n in lengths.tolist():
            def value(path, at=at):
                return sum(scores[at + i, j] for i, j in enumerate(path)) - 2.5 * sum(a != b for a, b in itertools.pairwise(path))

            if n:
                best = max(value(p) for p in itertools.product(range(3), repeat=n))
                assert abs(value(labels[at : at + n].tolist()) - best) < 1e-9
            at += n


def test_spans_of_mixed_text_and_scripts(spark):
    rows = [(i, "the and with that have this from they " * 5, "en") for i in range(20)]
    rows += [(100 + i, "der und mit nicht sich auch für einen " * 5, "de") for i in range(20)]
    rows += [(200 + i, "это что как они было только если " * 5, "ru") for i in range(20)]
    model = language_id.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    text = "the and with that have this from they der und mit nicht sich auch für einen это что как они"
    (lang, _, spans), = language_id.Labeller(model).label([text])
    assert [(s["lang"], s["first_word"], s["last_word"]) for s in spans] == [("en", 0, 7), ("de", 8, 15), ("ru", 16, 19)]
    assert lang in ("en", "de")


def test_words_are_cut_where_the_script_changes(spark):
    assert language_id.words_of("Über l’été it's п'ять") == ["über", "l’été", "it's", "п'ять"]
    assert language_id.words_of("日本語のPythonコードs") == ["日本語", "の", "python", "コード", "s"]
    assert language_id.words_of("abc'где") == ["abc", "где"]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab'’éжд日本のコ한ø \U00020001") for _ in range(20))
        words = language_id.words_of(text)
        letters = [c for c in text if c.isalpha()]
        assert [c for w in words for c in w if c.isalpha()] == letters
        assert all(len({language_id.script_of(c) for c in w if c.isalpha()}) == 1 for w in words)
    # A sentence without spaces has spans of both its scripts.
    rows = [(i, "日本語の文章を書くことはとても楽しい", "ja") for i in range(9)]
    rows += [(50 + i, "the quick brown fox and the lazy dog", "en") for i in range(9)]
    model = language_id.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    labeller = language_id.Labeller(model)
    ((_, _, spans),) = labeller.label(["日本語の文章を書くthequickbrownfoxandthelazydog楽しいことは"])
    assert [s["lang"] for s in spans] == ["ja", "en", "ja"]


# --- SentencePiece -----------------------------------------------------------------------


def segmentations(vocab: sps.Vocabulary, library, text: str) -> dict[tuple, float]:
    """All segmentations of a short text with their log-probabilities."""
    marked = sps.MARK + text.replace(" ", sps.MARK)
    pieces = {library.id_to_piece(i): i for i in range(library.vocab_size()) if np.isfinite(vocab.logits[i])}
    out = []

    def extend(at: int, ids: tuple, weight: float) -> None:
        if at == len(marked):
            out.append((ids, weight))
            return
        for size in range(1, 17):
            piece = marked[at : at + size]
            if len(piece) == size and piece in pieces:
                extend(at + size, (*ids, pieces[piece]), weight + vocab.logits[pieces[piece]])
        if marked[at] not in pieces:
            spelled = marked[at].encode()
            extend(at + 1, (*ids, *(int(vocab.byte_id[b]) for b in spelled)), weight + vocab.alpha * sps.BYTE_LOGIT * len(spelled))

    extend(0, (), 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: w - total for ids, w in out}


@pytest.mark.parametrize("text", ["the th", "in  on", "a\n一b"])
def test_samples_follow_gumbel_top_k(library, text):
    vocab = sps.vocabulary(MODEL, 0.5)
    exact = segmentations(vocab, library, text)
    n, k = 3000, 3
    drawn = sps.Sampler(vocab, k).sample([text] * n, sps.row_keys(list(range(n)), 1))
    first, pairs, weighed = Counter(), Counter(), Counter()
    for samples in drawn:
        ids = [tuple(s[0].tolist()) for s in samples]
        assert len(set(ids)) == len(ids) == min(k, len(exact))
        assert all(abs(exact[i] - s[1]) < 1e-9 for i, s in zip(ids, samples, strict=True))
        first[ids[0]] += 1
        pairs[tuple(ids[:2])] += 1
        for i, s in zip(ids, samples, strict=True):
            weighed[i] += 1 / s[2]
    best = sorted(exact, key=exact.get, reverse=True)[:2]
    for i in best:
        assert abs(first[i] / n - np.exp(exact[i])) < 0.04
    a, b = (np.exp(exact[i]) for i in best)
    assert abs(pairs[tuple(best)] / n - a * b / (1 - a)) < 0.05
    # Inclusion scores make sums over samples unbiased.
    assert abs(sum(np.exp(exact[i]) * weighed[i] for i in exact) / n - 1) < 0.02


def test_encode_and_decode_edge_rows(spark):
    docs = edge.frame(spark)
    got = sps.encode(docs, k=3)
    rows = got.collect()
    assert all(r.round_trip and 0 < r.inclusion <= 1 and r.log_prob <= 0 for r in rows)
    want = Counter((i, (t or "").replace(sps.MARK, " ")) for i, t, *_ in edge.rows())
    assert Counter((r.doc_id, r.text) for r in sps.decode(got).filter("sample = 1").collect()) == want
    again = sps.encode(docs.repartition(4), k=3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.sample, r.ids)
    assert sorted(rows, key=key) == sorted(again, key=key)
    by_row = Counter((r.doc_id, r.sample) for r in rows)
    assert by_row[(5, 1)] == 1 and (5, 2) not in by_row
    assert sps.encode(edge.empty(spark)).collect() == []
