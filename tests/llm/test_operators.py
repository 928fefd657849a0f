"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evistrata.llm import bpe, chat, components, dedup, html, language, lines, ngrams, packing, quality, tokenfile, tokens
from evistrata.llm.base import labelled_sample, scratch_path, worker_state

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- chat formatting ----------------------------------------------------------

def turns_of(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string, number int")


def text(value):
    return ("text", value, None, None, None, None, None)


def test_parts_become_placeholders_with_attachments(spark):
    parts = [text("see "), ("image", None, "a.png", 56, 29, None, None), text(" and "), ("audio", None, "b.wav", None, None, 1.5, None),
             ("document", None, "c.pdf", None, None, None, 2), ("video", None, "d", None, None, None, None), (None, None, None, None, None, None, None)]
    row = chat.format_conversations(turns_of(spark, [(1, 0, "user", parts, "x", 1)])).first()
    assert row.formatted == "<|im_start|>user\nsee <|image|> and <|audio|><|document|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens, a.turn_index) for a in row.attachments] == [("image", "a.png", 4, 1), ("audio", "b.wav", 38, 1), ("document", "c.pdf", 1152, 1)]
    assert (row.attachment_tokens, row.n_unknown_parts) == (4 + 38 + 1152, 2)


def test_control_strings_in_texts_and_roles_read_back(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|", "<", "<|", "a<b|c", "", None, "|x", "<|newline|>", "end<"]
    rows = [(1, i, role, [text(value)], "x", 1) for i, (role, value) in enumerate(zip(["assistant", "us\ner", "<|im_end|>", None] * 3, texts))]
    parsed = chat.read_back(chat.format_conversations(turns_of(spark, rows))).first().parsed
    assert [p.text for p in parsed] == [t or "" for t in texts]
    assert [p.role for p in parsed] == [(r[2] or "") for r in rows]
    assert [p.loss_text for p in parsed] == [(t or "") if r[2] == "assistant" else None for r, t in zip(rows, texts)]


def test_turn_order_nulls_repeats_and_empty_table(spark):
    rows = [(1, 2, "user", [text("b")], "", 1), (1, 2, "user", [text("a")], "", 1), (1, None, "user", None, "", 1), (None, 1, "assistant", [], "", 1), (1, 2, "user", [text("a")], "", 1)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns_of(spark, rows))).collect()}
    assert [p.text for p in got[1].parsed] == ["", "a", "a", "b"]
    assert got[1].n_turns == 4 and got[None].n_turns == 1
    for r in got.values():
        assert [r.formatted[t.text_start : t.text_end] for t in r.turns] == [p.text for p in r.parsed]
    assert chat.format_conversations(turns_of(spark, [])).count() == 0


# --- exact de-duplication ---------------------------------------------------------

@pytest.mark.parametrize("digest", [dedup.content_hash, lambda c: F.length(c)], ids=["md5", "colliding"])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, awkward, digest, keep):
    rows = [(r.doc_id, r.text or "") for r in awkward.select("doc_id", "text").collect()]
    want = []
    for doc_id, value in rows:
        ids = [d for d, t in rows if t == value]
        known = [d for d in ids if d is not None]
        best = (min if keep == "min" else max)(known) if known else None
        want.append((doc_id, best, len(ids), doc_id == best, hashlib.sha256(value.encode()).hexdigest()))
    got = [tuple(r) for r in dedup.exact_groups(awkward, keep=keep, digest=digest).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_keep_one_row_of_each_text(awkward, no_docs):
    kept = dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.schema["n_chars"].dataType == awkward.schema["n_chars"].dataType
    rows = awkward.collect()
    assert Counter(r.text or "" for r in kept.collect()) == Counter({r.text or "" for r in rows})
    by_text = {r.text or "": r.doc_id for r in kept.collect()}
    assert by_text["The cat and the dog are in the house of the old man. "] == 5 and by_text[""] == 1
    assert {r.doc_id for r in dedup.keep_one(awkward, keep="max").collect() if (r.text or "") == ""} == {2}
    assert dedup.keep_one(no_docs).count() == 0 and dedup.exact_groups(no_docs).count() == 0


def test_normalised_texts_are_equal(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup.exact_groups(rows, normalise=F.lower).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


# --- n-gram join ------------------------------------------------------------------

def brute_components(rows, s):
    sets = []
    for doc_id, value in rows:
        words = (value or "").encode().lower().split()
        grams = {tuple(words[i : i + s.width]) for i in range(len(words) - s.width + 1)} if len(words) >= s.width else ({tuple(words)} if words else set())
        sets.append((doc_id, grams))
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and s.denominator * len(a & b) >= s.numerator * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(sets, label):
        if doc_id is not None:
            least[x] = min(least.get(x, doc_id), doc_id)
    return sorted(repr((d, len(g), least.get(x) if d is not None or g else None)) for (d, g), x in zip(sets, label))


@pytest.mark.parametrize("s", [
    ngrams.Settings(), ngrams.Settings(3, 9, 10), ngrams.Settings(2, 1, 2, short=2, frequent=2), ngrams.Settings(3, 4, 5, longest=1, short=3, frequent=1), ngrams.Settings(1, 3, 4, longest=6, short=2),
    ngrams.Settings(2, 4, 5, short=2, frequent=3, levels=0), ngrams.Settings(3, 9, 10, short=3, frequent=10**6), ngrams.Settings(2, 2, 3, longest=1, short=1, frequent=2, levels=3),
], ids=str)
def test_links_equal_brute_force(spark, s):
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[vocabulary[i] for i in draw.integers(0, 60, draw.integers(1, 45))] for _ in range(8)]
    rows = [(None, "a b c d e f g"), (900, "A b C d e f g"), (901, None), (902, ""), (903, " \n"), (904, "w1"), (905, "W1"), (906, "w1 w2")]
    for n in range(220):
        words = list(bases[n % len(bases)])
        for _ in range(draw.integers(0, 3)):
            words[draw.integers(0, len(words))] = vocabulary[draw.integers(0, 60)]
        rows.append((int(n * 3 + 1), " ".join(words)))
    rows.append(rows[-1])
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, token string, rep long").repartition(5)
    got = sorted(repr((r.doc_id, r.n_tokens, r.component_id)) for r in ngrams.jaccard_components(frame, s).collect())
    assert got == brute_components(rows, s)


def test_marked_places_take_one_bitmap_a_task(spark):
    rows = spark.range(0, 40_000, 1, 4)

    def mark(batch, marks):
        marks[batch.column("id").to_numpy() * 7 % (1 << ngrams.PLACE_BITS)] = True

    seen = ngrams._marked_places(rows, mark)
    assert sorted(np.flatnonzero(seen)) == sorted({i * 7 % (1 << ngrams.PLACE_BITS) for i in range(40_000)})
    assert not ngrams._marked_places(rows.limit(0), mark).any()


@pytest.mark.parametrize("tasks", [1, 9])
def test_a_list_with_one_member_that_is_not_linked_needs_no_pivot_of_its_own(spark, monkeypatch, tasks):
    base, shared = list(range(1, 41)), [999, *range(501, 509)]
    sets = {0: base, 9: [*base, *shared, *range(601, 607)]} | {i: [*base, *shared, 700 + i] for i in range(1, 6)}
    rows = [(node, len(x), np.array(sorted(x), np.uint64).tobytes()) for node, x in sets.items()]
    table = spark.createDataFrame(rows, "node long, n long, tokens binary").repartition(tasks)
    lists = spark.createDataFrame([(7, node, node) for node in sets], "token long, node long, rare long")
    names, keep = [], ngrams.stage
    monkeypatch.setattr(ngrams, "stage", lambda df, name, *path: names.append(name) or keep(df, name, *path))
    links, pairs = ngrams._links_in_long_lists(lists, table, ngrams.Settings(3, 3, 4, short=4))
    assert {(r.a, r.b) for r in links.collect()} == {(0, i) for i in range(1, 6)}
    assert {(r.a, r.b) for r in pairs.collect()} == {(9, i) for i in range(1, 6)}
    assert names.count("differences") == 1


def test_ids_with_several_texts_are_judged_by_each_text(spark):
    a, b = "a b c d e f g h i j k l", "n o p q r s t u v w x y z"
    rows = spark.createDataFrame([(1, a), (1, b), (0, b), (2, a + " m"), (1, a), (3, None), (3, "")], "doc_id long, text string")
    s = ngrams.Settings(3, 4, 5)
    got = Counter((r.doc_id, r.n_tokens, r.component_id) for r in ngrams.jaccard_components(rows, s).collect())
    assert got == Counter([(1, 10, 1), (1, 11, 0), (0, 11, 0), (2, 11, 1), (1, 10, 1), (3, 0, 3), (3, 0, 3)])
    kept = Counter((r.doc_id, r.text) for r in ngrams.keep_one(rows, s).collect())
    assert kept == Counter([(1, a), (1, a), (0, b), (3, None), (3, "")])


def test_join_of_awkward_and_no_rows(awkward, no_docs):
    s = ngrams.Settings(3, 9, 10)
    got = sorted(repr((r.doc_id, r.n_tokens, r.component_id)) for r in ngrams.jaccard_components(awkward, s).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in awkward.collect()], s)
    assert ngrams.jaccard_components(no_docs).count() == 0
    kept = ngrams.keep_one(awkward, s)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 6").count() == 0 and kept.filter("doc_id is null").count() == 2
    assert ngrams.keep_one(no_docs).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(7, 7), (None, 3), (301, 300), (300, 301)]
    got = dict(components.components(spark.createDataFrame(edges, "x long, y long")).collect())
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 300)} | {300: 300, 301: 300}
    assert got == want
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# --- tokens -------------------------------------------------------------------------

ALPHABET = " \n\t\r.,'abrstéÉßſΣ²٣　​\x1c\x85<|>!1中\U0001f600́"


@pytest.fixture(scope="module")
def encoders():
    import tiktoken
    from tokenizers import Tokenizer

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    found = [(bpe.encoder(RANKS, public_tokenizers.PATTERN)[1], own.encode_ordinary)]
    for path in (BYTE_BPE, WORD_BPE):
        library = Tokenizer.from_file(path)
        found.append((tokens.library_encoder(path), lambda t, library=library: library.encode(t, add_special_tokens=False).ids))
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=20), st.sampled_from(["<|endoftext|>a", "it's  we'll", "\n\n a\n"])), max_size=5))
def test_cached_chunks_encode_like_the_libraries(encoders, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for run, reference in encoders:
        ids, lengths = run(texts)
        assert [part.tolist() for part in np.split(ids, np.cumsum(lengths))[: len(texts)]] == [reference(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=8), st.permutations(["ab", "bc", "abc", "aa", "aaa", "ca", "bcab", "cab", "abca"]))
def test_merge_replay_is_lowest_rank_then_leftmost(words, order):
    ranks = {bytes([b]): b for b in range(256)} | {w.encode(): 256 + i for i, w in enumerate(order)}

    def plain(word):
        parts = [bytes([b]) for b in word.encode()]
        while True:
            ranked = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not ranked:
                return [ranks[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    replay = bpe.MergeReplay(ranks)
    got = replay.encode([w.encode() for w in words])
    assert got == [plain(w) for w in words]
    ids = np.array([i for part in got for i in part], np.int64)
    spelled, ends = replay.decode(ids, np.array(list(map(len, got)), np.int64))
    assert spelled.tobytes() == "".join(words).encode() and list(np.diff(np.append(0, ends))) == list(map(len, words))


def test_bpe_of_awkward_rows(awkward, no_docs):
    decoded = bpe.decode(bpe.encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, bytes(r.decoded)) for r in decoded.collect())
    assert got == Counter((r.doc_id, (r.text or "").encode()) for r in awkward.collect())
    assert bpe.decode(bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=12), max_size=6))
def test_values_survive_the_byte_code(rows):
    values, lengths = np.array([v for row in rows for v in row], np.uint32), np.array(list(map(len, rows)), np.int64)
    control, data, groups, sizes = tokenfile.pack_rows(values, lengths)
    assert groups.tolist() == [-(-n // 4) for n in lengths] and len(control) == groups.sum() and len(data) == sizes.sum()
    columns = pa.array([b"before", b""] + [bytes(p) for p in np.split(data, np.cumsum(sizes)[:-1])][: len(rows)], pa.binary())[2:]
    whole, starts = tokenfile.rows_of(tokenfile.binary_rows(data, sizes))
    assert whole.tobytes() == data.tobytes() and columns.to_pylist() == tokenfile.binary_rows(data, sizes).to_pylist()
    assert tokenfile.rows_of(columns)[0].tobytes() == data.tobytes()
    assert tokenfile.unpack_rows(control, whole, groups, starts[:-1], lengths).tolist() == values.tolist()


def test_token_files_of_awkward_rows(spark, awkward, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    path = scratch_path(spark, "corpus")
    tokenfile.write_corpus(awkward, path, BYTE_BPE, end_id=0)
    rows = sorted(tokenfile.read_corpus(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in awkward.collect()), key=lambda d: (d is not None, d))
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in awkward.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ranked = [r.times for r in spark.read.parquet(f"{path}/dictionary").orderBy("rank").collect()]
    assert ranked == sorted(ranked, reverse=True) and sum(ranked) == sum(r.n_tokens for r in rows)
    empty = scratch_path(spark, "corpus")
    tokenfile.write_corpus(no_docs, empty, BYTE_BPE)
    assert tokenfile.read_corpus(spark, empty).count() == 0


# --- packing ------------------------------------------------------------------------

def placed(histogram, capacity):
    decided = packing.plan(histogram, capacity)
    bins: dict[int, list] = {}
    for length, count in histogram.items():
        numbers = np.arange(count)
        for b, o in zip(*decided.place(np.full(count, length), numbers)):
            bins.setdefault(int(b), []).append((int(o), length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == decided.bins and sum(map(len, bins.values())) == sum(histogram.values())
    return bins


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_bins_are_gapless_and_few(histogram):
    bins = placed(histogram, 20)
    first_fit: list[int] = []
    for length in sorted((length for length, count in histogram.items() for _ in range(count)), reverse=True):
        at = next((i for i, gap in enumerate(first_fit) if gap >= length), None)
        if at is None:
            first_fit.append(20)
            at = -1
        first_fit[at] -= length
    assert len(bins) <= 1.1 * len(first_fit) + 1


def test_smallest_gives_way_to_two_that_fit():
    # greedy alone fills 10 with 6 + 3 and leaves a gap of 1; 2 + 2 fill the widened gap
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.fill(counts, 10) == [6, 2, 2] and counts[3] == 1


def test_pieces_of_awkward_rows(spark, awkward, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(awkward, WORD_BPE, end_id=1, capacity=64).collect()
    whole: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.piece)):
        assert r.start == r.piece * 64 and r.length <= 64 and len(r.ids) == 4 * r.length
        whole.setdefault(r.doc_id, Counter())[r.piece, bytes(r.ids)] += 1
    want: dict = {}
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 64):
            want.setdefault(r.doc_id, Counter())[i // 64, np.array(ids[i : i + 64], "<u4").tobytes()] += 1
    assert whole == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        assert all(o == sum(n for p, n in members if p < o) for o, _ in members) and sum(n for _, n in members) <= 64
    assert len(sequences) == -(-sum(r.length for r in got) // 64)
    assert packing.pack(no_docs, WORD_BPE).count() == 0


# --- line rules ---------------------------------------------------------------------

@pytest.mark.parametrize("line, fails", [
    ("The cat sat on the mat.", False), ("Home | About | Contact | Help.", True), ("no end here", True), ("THIS IS LOUD!! AND LOUD.", True),
    ("We use cookies to improve the site.", True), ("so so so so so so it goes.", True), ("a&&& b### c*** d.", True), ("", True), ("Yes.", False), ("€ \U0001f600.", False),
])
def test_line_rules(line, fails):
    assert lines.line_fails(line) is fails


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeated_words_by_brute_force(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    assert lines.repeated_words(words) == len({i + k for i, w in enumerate(windows) if w in many for k in range(8)})


def test_lines_of_awkward_rows(awkward, no_docs):
    got = {r.doc_id: r for r in lines.clean(awkward).filter("doc_id is not null").collect()}
    assert (got[1].n_words, got[1].kept, got[1].cleaned) == (0, False, "") and got[3].n_words == 0
    assert got[4].base_failed and got[4].n_repeat_words == got[4].n_words == 13 * 4000
    assert (got[10].n_words, got[10].word_chars) == (1, 100_000)
    assert lines.clean(awkward).count() == awkward.count() and lines.clean(no_docs).count() == 0
    assert "cleaned" not in lines.clean(awkward, with_text=False).columns


# --- html ---------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="page"><header>Site</header><nav><a href=/>Home</a></nav>
<div id="cookie-notice">We use cookies, and this is a long sentence about them and all the things that they do for you.</div>
<article><header><h1>Head &amp; tail</h1></header><p>First  <b>bold</b><br>line &lt;x&gt;.<p>Short.<script>var a = "</p>";</script>
<form><input><label>Mail</label></form><ul><li>One</li><li>Two</li></ul><aside>More</aside><div class="comments"><p>I think that this is the best of all.</p></div></article>
<footer>&copy; 2024</footer></body></html>"""


def test_article_without_chrome():
    assert html.main_text(PAGE) == "Head & tail\n\nFirst bold line <x>.\n\nShort.\n\nOne\n\nTwo"


def test_pages_without_article_inherit_from_neighbours():
    long = "The man and the dog were in the house when it was dark and they had to go to the town for the food."
    links = "<p>" + " ".join(f"<a href=/{i}>topic number {i}</a>" for i in range(12)) + "</p>"
    page = f"<body>{links}<p>Tiny</p><p>x</p><h2>Title</h2><p>{long}</p><p>Ok.</p><p>{long}</p><p>End.</p>{links}</body>"
    assert html.main_text(page) == f"x\n\nTitle\n\n{long}\n\nOk.\n\n{long}\n\nEnd."


LONG = "The man and the dog were in the house when it was dark and they had to go to the town for the food."


@pytest.mark.parametrize(
    "opening, closing",
    [('<section id="related-work">', "</section>"), ('<div class="entry-header">', "</div>"), ('<div class="share-prices">', "</div>"), ('<div class="header">', "</div>")],
)
def test_names_of_sections_are_no_chrome(opening, closing):
    assert html.main_text(f"<article>{opening}<h1>Title</h1><p>{LONG}</p>{closing}<p>End.</p></article>") == f"Title\n\n{LONG}\n\nEnd."


@pytest.mark.parametrize("heading", ['<h2 id="social-effects">', '<h2 id="share-prices">', '<h2 id="share">', '<h2 id="related-work">'])
def test_anchors_of_headings_are_no_chrome(heading):
    assert html.main_text(f"<article><p>{LONG}</p>{heading}Title</h2><p>{LONG}</p></article>") == f"{LONG}\n\nTitle\n\n{LONG}"


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "share-buttons", "siteFooter", "left sidebar", "related-posts", "nav_main", "comments", "advert", "sidebar"])
def test_chrome_names_drop_blocks_of_any_length(name):
    for body in (LONG, f"{LONG} {LONG} {LONG}"):
        assert html.main_text(f"<article><p>Text</p><div class='{name}'><p>{body}</p></div></article>") == "Text"
        assert html.main_text(f"<article><p>Text</p></article><div id='{name}'><p>{body}</p><p>{body}</p></div>") == "Text"


def test_comment_sections_go_and_other_sections_stay():
    for opening in ('<section id="comments">', '<section id="comment-list">', '<section class="comments">', '<div id="disqus">'):
        assert html.main_text(f"<article><p>{LONG}</p>{opening}<h2>Readers</h2><p>{LONG} {LONG} {LONG}</p>{'</section>' if 'section' in opening else '</div>'}</article>") == LONG


@pytest.mark.parametrize("page, text", [
    (f'<article><ul><li class="share">Share this<li>{LONG}</ul></article>', LONG),
    ('<article><table><tr><td class="ad">buy now<td>First cell<tr><td>Second</table></article>', "First cell\n\nSecond"),
    ('<article><p class="share">Share<div>text</div></article>', "text"),
    ("<article><dl><dt class=ad>a<dd>One<dt>Two</dl><ul><li>x<ul><li class=ad>y</ul><li>z</ul></article>", "One\n\nTwo\n\nx\n\nz"),
    ('<article><p>One <img alt="5" screen"> two</p><a title=\'x" y>z\' href=b>Three</a><p class= >Four</p></article>', "One two\n\nThree\n\nFour"),
    ("<p>Short text only.</p>", "Short text only."),
    ("<nav>Menu</nav><p>Short text only.</p>", "Short text only."),
    ("<article><p>a</p><a href=x><div>block in a link</div></a><p>b</p></article>", "a\n\nblock in a link\n\nb"),
    ('<article><p>Open "quote <a href="b>c</p><p>Next</p></article>', 'Open "quote c\n\nNext'),
])
def test_omitted_end_tags_stray_quotes_and_short_pages(page, text):
    assert html.main_text(page) == text


def test_most_blocks_are_decided_by_the_rules(spark):
    decided = kept = 0
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = html.blocks(row.html)
        labels = [html.classify(block) for block in page]
        for label, keep in zip(labels, html.decide(page, labels)):
            kept += keep
            decided += keep and (label == html.GOOD or html.GOOD in labels)
    assert decided >= 0.6 * kept


def test_deep_nesting_takes_no_time():
    import time

    start = time.time()
    assert html.main_text("<div>" * 20_000 + "</i></b>" * 10_000 + f"<p>{LONG}</p>" + "</span>" * 10_000) == LONG
    assert html.main_text("<p><b>" * 5000 + "x" + "<li>" * 5000 + "<table><tr><td>" * 2000) == "x"
    assert time.time() - start < 3


def test_text_outside_a_teaser_article_is_kept():
    page = f"<nav>Menu</nav><h1>Title</h1><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><nav>More</nav><article><p>Teaser</p></article><footer>{LONG}</footer>"
    assert html.main_text(page) == f"Title\n\n{LONG}\n\nShort.\n\n{LONG}\n\nTeaser"


@pytest.mark.parametrize(
    "skipped",
    [
        '<svg class="i"/>', "<math/>", '<svg viewBox="0 0 1 1" /><b></b>', "<object data=x>", "<iframe src=x>", "<iframe src=x />", "<canvas>", "<select>", "<noscript>",
        "<option>A<option>B</option>", "<svg><svg><text>in</text></svg><text>out</text></svg>", "<svg><!-- <svg> --><text>in</text></svg>", "<svg><text>in</text></svg>",
        '<span class="ad">', '<span class="ad"><span>in</span> out</span>', "<span hidden><span>in</span><span>in</span> out</span>",
    ],
)
def test_skipped_elements_take_no_text_after_them(skipped):
    page = f"<article><p>Before {skipped} after</p><p>Next</p><svg><text>icon</text></svg><p>Last</p></article>"
    assert html.main_text(page) == "Before after\n\nNext\n\nLast"


def test_options_without_end_tag_stop_at_the_parents_end():
    assert html.main_text("<article><datalist><option>A<option>B <b>C</b></datalist><p>Text</p><option>D<p>More</p></article>") == "Text\n\nMore"


def test_script_without_end_takes_the_rest():
    assert html.main_text("<article><p>Text</p><script>var a = 1; <p>b</p></article>") == "Text"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<a href='x'>", "</a>", "<div class=ad>", "</div>", "<", ">", "&amp", "&#x41;", "a b", "<!--", "-->", "<script>", "</script>", "<article>", "\n"]), max_size=25))
def test_broken_pages_do_not_fail(parts):
    html.main_text("".join(parts))


def test_pages_with_nulls_and_none(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (None, "v", PAGE, "t"), (3, "w", "<p>" + "a b " * 200_000, "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert html.extract(pages.unionByName(pages)).filter("page_id = 1").count() == 2
    assert (got[1].text, got[1].n_chars, got[2].text) == ("", 0, "") and got[None].text.startswith("Head & tail")
    assert html.extract(pages.filter("false")).count() == 0


# --- language and quality -------------------------------------------------------------

def test_language_of_awkward_rows(spark, docs, awkward, no_docs):
    learned = language.learn(docs)
    assert set(learned) == {"de", "en", "es", "fr"}
    rows = language.identify(awkward, learned).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == awkward.count()
    for key in (1, 2, 3, 7):
        assert (got[key].lang_pred, got[key].score, got[key].accepted) == ("und", 0.0, False)
    assert got[9].lang_pred in learned and all(0 <= r.score <= 1 for r in rows)
    kept = language.keep_identified(awkward, learned)
    assert kept.columns == awkward.columns and kept.filter("text is null").count() == 0
    assert language.identify(no_docs, learned).count() == 0 and language.learn(no_docs) == {}
    assert {r.lang_pred for r in language.identify(awkward, {}).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(awkward, {"en": b"the"}).collect()} == {"en", "und"}


def test_mixed_and_unknown_languages_are_rejected_and_clean_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and length(text) between 400 and 4000").orderBy("doc_id")
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = language.learn(docs)
    draw, of = random.Random(3), {}
    for row in rows:
        of.setdefault(row.lang, []).append(row.text)
    mixed = [of["en"][i][:600] + " " + of["fr"][i][:600] + " " + of["de"][i][:600] + " " + of["es"][i][:600] for i in range(20)]
    noise = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (300, 600, 1200, 2400, 4800) for _ in range(8)]
    cases = [(i, text) for i, text in enumerate(mixed + noise)] + [(1000 + i, row.text) for i, row in enumerate(rows)]
    found = language.identify(spark.createDataFrame(cases, "doc_id long, text string"), learned).collect()
    share = lambda low, high: np.mean([r.accepted for r in found if low <= r.doc_id < high])
    assert share(20, 60) == 0 and share(0, 20) <= 0.1 and share(1000, 10**9) >= 0.99


def test_a_difference_of_one_byte_is_no_margin():
    judge = language._judge({"a": b"the cat and the dog", "b": b"le chat et le chien"}, language.Settings(min_bytes=1000))
    assert not judge("the cat and the dog")[3]


def test_language_is_right_on_held_out_rows(spark):
    from evistrata.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op10_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(F.col("accepted").cast("double")).alias("accepted")).first()
    assert row.right >= 0.96 and row.accepted >= 0.97


def test_factorised_sum_equals_all_pairs():
    draw = np.random.default_rng(1)
    size = 8 + len(quality.DENSE)
    model = quality.Model(0.3, draw.normal(size=size), draw.normal(size=(size, 3)), np.zeros(len(quality.DENSE)), np.ones(len(quality.DENSE)))
    vectors = [(np.array([1, 4]), np.array([0.5, 0.2]), draw.normal(size=len(quality.DENSE))), (np.array([], int), np.array([]), draw.normal(size=len(quality.DENSE)))]
    at, value, starts = model.rows(vectors)
    ends = np.append(starts[1:], len(at))
    for got, a, b in zip(model.margins(at, value, starts)[0], starts, ends):
        x = np.zeros(size)
        x[at[a:b]] = value[a:b]
        want = 0.3 + model.weights @ x + sum(model.latent[i] @ model.latent[j] * x[i] * x[j] for i in range(size) for j in range(i))
        assert got == pytest.approx(want)


def test_quality_of_awkward_rows(spark, docs, awkward, no_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.learn(docs, labels)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.score(no_docs, model).count() == 0
    empty = quality.learn(docs, labels.filter("false"))
    assert {r.score for r in quality.score(awkward, empty).collect()} == {0.5}
    assert {r.predicted for r in quality.score(awkward, quality.learn(docs, labels.filter("quality = 1"))).collect()} == {1}
    odd = spark.createDataFrame([(None, 1), (-5, 0), (1, None), (0, 1), (0, 1)], "doc_id long, quality int")
    assert quality.learn(docs, odd).bias == 30.0


def test_ids_with_several_texts_teach_the_same_in_any_order(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.col("text"), F.lit(" and more words of another text."))).filter("doc_id % 3 = 0"))
    first, again = (quality.learn(rows, labels) for rows in (twice.repartition(3), twice.repartition(7).orderBy(F.desc("text"))))
    assert first.bias == again.bias and (first.weights == again.weights).all() and (first.latent == again.latent).all()
    one, two = (language.learn(rows) for rows in (twice.repartition(3), twice.repartition(7)))
    assert dict(one) == dict(two)


def test_shares_hold_when_long_documents_cannot_be_drawn(spark):
    """Half of label 0 is too long to teach; the score still is the share of the labels."""
    rows = spark.range(1400).select(
        F.col("id").alias("doc_id"), (F.col("id") % 7 > 0).cast("int").alias("quality"),
        F.when(F.col("id") % 14 == 0, F.repeat(F.lit("x "), 40_000)).otherwise("some words that both labels share").alias("text"))
    found = quality.score(rows.filter("length(text) < 100").limit(5), quality.learn(rows, rows)).collect()
    assert all(abs(row.score - 6 / 7) < 0.05 for row in found)


def test_quality_is_right_on_held_out_rows(spark):
    from evistrata.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality_classifier"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.95


def test_quality_scores_hold_when_the_sample_is_far_smaller_than_the_labels(spark):
    """Texts that say nothing about the label: the score is the share of label 1, however few rows of each label are drawn."""
    rows = spark.range(2100).select(F.col("id").alias("doc_id"), F.lit("some words that both labels share").alias("text"), (F.col("id") % 7 > 0).cast("int").alias("quality"))
    for per_label in (40, 200, 4000):
        settings = quality.Settings(per_label=per_label)
        found = quality.score(rows.limit(5), quality.learn(rows, rows, settings=settings), settings).collect()
        assert all(abs(row.score - 6 / 7) < 0.05 and row.predicted for row in found), (per_label, found)


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("label"))
    first, again = (labelled_sample(rows.repartition(n), "label", 50) for n in (3, 7))
    assert sorted(first) == sorted(again) and Counter(r["label"] for r in first) == {0: 50, 1: 50, 2: 50}


def test_crc32_is_zlibs(spark):
    assert spark.sql("select crc32(X'01020304')").first()[0] == zlib.crc32(b"\x01\x02\x03\x04")


# --- worker caches ------------------------------------------------------------

def test_a_worker_keeps_the_caches_of_one_operator_only():
    ngrams.tokens_of([b"a", b"b", b"c"], 3)
    kept = worker_state("word-hashes")
    assert set(kept) == {b"a", b"b", b"c"}
    worker_state("tokens", "one")["x"] = 1
    assert worker_state("tokens", "two") == {} and worker_state("tokens", "one") == {"x": 1}
    assert worker_state("word-hashes") == {} and worker_state("tokens", "one") == {}
