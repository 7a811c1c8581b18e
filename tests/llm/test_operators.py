"""The training-data operators against brute force, on hand-made and on the smallest given tables."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from ampliframe.llm import bpe, decontaminate, html, line_dedup, ngram_join, packing, quality, queries, spans, token_files, toxicity
from ampliframe.llm.components import components
from ampliframe.session import scratch_dir

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
V, P, END = queries.VOCABULARY, queries.PATTERN, queries.END_ID
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, h1 int, line string, key string, n long"
LONG = " ".join(f"w{i}" for i in range(9000))
SHARED = "one common line that many documents hold, here it is"


def corner_cases(spark):
    """Nulls in every column, an empty, a wordless and a very long text, ties, repeated rows, and extra
    columns with names that the operators use themselves."""
    texts = [None, "", " \n\t ", LONG, "a b", "a b", f"{SHARED}\nx1", f"  {SHARED.upper()} \nx2", f"{SHARED}\nx3", LONG + " end"]
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1, "y", "z", 5) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, f"{SHARED}\nnull id", None, None, None, None, None, None, None, None),
             (3, "another text under the same id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def tokens(texts):
    ranks = bpe.parse_ranks(bpe.read_vocabulary(V))
    own = tiktoken.Encoding("own", pat_str=P, mergeable_ranks=ranks, special_tokens={})
    return own, {i: own.encode_ordinary(t) for i, t in texts.items()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------------------- 1

def test_decontamination_finds_planted_items(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = {i: " " + " ".join(re.findall(r"\w+", t.lower())) + " " for i, t in texts.items()}
    planted = {(i, k) for i, t in plain.items() for k, b in items.items()
               if " " + " ".join(re.findall(r"\w+", b.lower())) + " " in t}
    found = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, SF).collect()}
    assert planted and found == planted


def test_decontamination_of_edited_items_and_corner_cases(spark):
    item = " ".join(f"word{i}" for i in range(60))
    near, far = item.replace("word30 ", "other "), " ".join(f"word{i}" for i in range(0, 60, 2))
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    extra = spark.createDataFrame([(100, f"x y {near} z"), (101, far), (102, "a tiny, item here")], "doc_id long, text string")
    rows = decontaminate.contaminated(corner_cases(spark).select("doc_id", "text").unionAll(extra), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(100, 1), (102, 2)}
    assert 0.8 <= next(r.similarity for r in rows if r.doc_id == 100) < 1
    kept = decontaminate.drop_contaminated(extra, bench)
    assert [r.doc_id for r in kept.collect()] == [101] and kept.columns == extra.columns
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(extra, bench.limit(0)).count() == 0


def test_decontamination_of_documents_shorter_than_an_item(spark):
    words = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, " ".join(words[:38])), (2, " ".join(words[1:39])), (3, " ".join(words[:25])), (4, "word1 word2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(frame, bench).collect()}
    assert set(found) == {1, 2} and abs(found[1].similarity - 34 / 36) < 1e-9 and found[1].n_words == 38
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()) == [3, 4]


def test_decontamination_does_not_depend_on_passes(spark, monkeypatch):
    frame = " ".join(f"frame{i}" for i in range(20))
    items = [(i, f"{frame} " + " ".join(f"item{i}x{j}" for j in range(20))) for i in range(12)] + [(50, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} behind".replace("x18 ", f"y{i} ")) for i, t in items], "doc_id long, text string")
    once = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    several = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    assert [r[:3] + r[4:] for r in once] == [r[:3] + r[4:] for r in several] and len(once) >= 5
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(once, several))


def test_fingerprints_within_radius_are_all_candidates():
    make = random.Random(3)
    items = [(i, " ".join(make.choice("abcdefghij") * 3 + str(make.randrange(50)) for _ in range(40))) for i in range(30)]
    index = decontaminate.Index(items)
    group = index.sizes[5, 40]
    for j in range(len(items)):
        bits = np.unpackbits(group["prints"][j])
        for flips in (0, 7, decontaminate.RADIUS):
            other = bits.copy()
            other[make.sample(range(decontaminate.BITS), flips)] ^= 1
            blocks = np.packbits(other)
            assert any(group["near"][b, blocks[b], j] for b in range(decontaminate.BLOCKS))


# ------------------------------------------------------------------------------- 2

def test_bpe_equals_the_library(spark, tokens, texts):
    _, ids = tokens
    rows = queries.op2_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        packed = np.array(ids[r.doc_id], "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_texts_appends_and_edits(tokens):
    own, _ = tokens
    codec, make = bpe.codec(bpe.read_vocabulary(V), P), random.Random(5)
    for _ in range(300):
        text = "".join(make.choice(make.choice(["aab", "xyz é日\U0001F600", " \n\t", "0123.!?'s"])) for _ in range(make.randrange(80)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)
    table = bpe.PrefixTable(codec.vocabulary, b"incompre")
    table.append(b"hensibilities")
    assert table.ids() == bpe.PrefixTable(codec.vocabulary, b"incomprehensibilities").ids()
    for _ in range(60):
        data = bytes(make.choice(b"abcther ing") for _ in range(400))
        i = make.randrange(400)
        edited = bpe.PrefixTable(codec.vocabulary, data)
        edited.replace(i, i + 3, b"xy")
        assert edited.last == bpe.PrefixTable(codec.vocabulary, data[:i] + b"xy" + data[i + 3:]).last


def test_codec_remembers_no_more_than_it_is_told(tokens, texts):
    own, _ = tokens
    codec = bpe.codec(bpe.read_vocabulary(V), P, 300)
    for text in list(texts.values())[:60]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == own.encode_ordinary(text)
        assert max(map(len, (codec.pieces, codec.pieces.older, codec.vocabulary.prefixes))) <= 300
    assert len(codec.pieces.older) == 300


def test_batches_for_python_are_closed_by_their_size(spark):
    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches)

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.col("id").cast("string"), 2000).alias("text"))
    found = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in found) == 3000
    assert max(r.size for r in found) < 5 << 20


def test_bpe_corner_cases(spark):
    rows = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(corner_cases(spark), V, P).collect()}
    assert {(0, 0), (1, 0)} <= rows and bpe.round_trip(empty(spark), V, P).count() == 0
    coded = bpe.encode_texts(corner_cases(spark), V, P)
    back = bpe.decode_ids(coded, V, P).select(F.col("decoded").cast("string")).collect()
    assert sorted(r[0] for r in back) == sorted(r.text or "" for r in corner_cases(spark).collect())


# ------------------------------------------------------------------------------- 3

PAGES = {
    '<body><div class="menu"><a href=x>Home</a></div><article><h1>T&amp;t</h1><p>One  two,\n three.<p>Four, five.</article>'
    '<footer>c 2024</footer>': "T&t\nOne two, three.\nFour, five.",
    '<body><nav><a href="/">Menu</a></nav><div class="post"><h1>My title</h1><p>A long paragraph, with much text. It goes on, and on.</p>'
    '<p>Another paragraph of text, long enough to count as one.</p></div><aside><p>Aside text, as long as that of the article.</p></aside>'
    '<div id="comments"><div class="comment"><p>I liked this article, says a reader.</p></div></div></body>':
        "My title\nA long paragraph, with much text. It goes on, and on.\nAnother paragraph of text, long enough to count as one.",
    "": "", "no markup at all, just a text. It is here.": "no markup at all, just a text. It is here.",
    "<script>var x = '<p>no</p>';</script>": "",
}


def test_html_extraction(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    trees = html.fit(given)
    rows = [(i, "u", h) for i, h in enumerate(PAGES)] + [(None, None, None), (0, "u", next(iter(PAGES)))]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()
    wanted = list(PAGES.values())
    assert all(r.text == (wanted[r.page_id] if r.page_id is not None else "") and r.n_chars == len(r.text) for r in got)
    assert len(got) == len(rows)
    for r in queries.op3_extract_html(spark, SF).join(given, "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.entities.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<!--.*?-->", "", article)))
        assert r.text == "\n".join(b for b in blocks if b)


def article_of(source):
    article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", source, re.S)[1]
    blocks = (" ".join(html.entities.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split())
              for b in re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<!--.*?-->", "", article)))
    return "\n".join(b for b in blocks if b)


def test_html_of_names_never_trained(spark):
    """Frames and articles under names that no training page has, on pages kept out of training."""
    sources = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    trees = html.train(sources[::2])
    some = "Some closing words of the site stand here and nothing more. All rights reserved."
    talk = f'<div class="kommentare"><h3>Kommentare</h3><div class="k"><p>{some}</p></div><div class="k"><p>{some[::-1]}</p></div></div>'
    plain = lambda h: h.replace("<article>", '<div class="xq-3">').replace("</article>", "</div>")
    styles = {
        "closing div": lambda h: h.replace("</body>", '<div class="zone-z">All rights reserved. Contact us.</div></body>'),
        "comments": lambda h: h.replace("</article>", f"</article>{talk}"),
        "sidebar": lambda h: h.replace("<article>", f'<div class="seitenleiste"><p>{some}</p><p>{some[:30]}</p></div><article>'),
        "all divs": lambda h: plain(h).replace("<nav>", '<div class="oben">').replace("</nav>", "</div>").replace(
            "<footer>", '<div class="unten">').replace("</footer>", "</div>").replace('class="ad"', 'class="werb"'),
        "divs and comments": lambda h: plain(h).replace("<footer>", f"{talk}<footer>"),
        "nested": lambda h: h.replace("<article>", f'<div id="w1"><div id="w2"><div class="zz">{some}</div><div class="inhalt">').replace(
            "</article>", "</div></div></div>")}
    for name, style in styles.items():
        # Without any naming element an article of fewer words than the comments cannot be told from them.
        held = [h for h in sources[1::2] if name != "divs and comments" or len(article_of(h)) > 2 * len(some)]
        assert len(held) > 15
        exact = sum(got == article_of(h) for got, h in zip(html.extract([style(h) for h in held], trees), held))
        assert exact >= 0.95 * len(held), (name, exact, len(held))


def test_html_work_grows_with_the_page_alone():
    for piece in ("<div>", "<span class=a>", "<p><div>", "<ul><li>", "<table><tr><td>"):
        took = []
        for n in (4_000, 16_000):
            source = piece * n + "text" + "</b></i>" * n
            start = time.process_time()
            assert html.extract([source], html.Trees()) == ["text"]
            took.append(time.process_time() - start)
        assert took[1] < 8 * took[0] + 0.5 and took[1] < 10


def test_html_of_empty_and_long_pages(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    assert html.extract_pages(given.limit(0), html.fit(given.limit(0))).count() == 0
    trees = html.fit(given, max_pages=40)
    long = "<html><body><nav><a href='/'>home</a></nav><article>" + "".join(
        f"<p>Paragraph {i} of a very long page, with words enough.</p>" for i in range(20_000)) + "</article><footer>end</footer></body></html>"
    frame = spark.createDataFrame([(1, "u", long, "x", 2), (1, "u", long, "x", 2), (None, None, "", None, None)],
                                  "page_id long, url string, html string, text string, n_chars int")
    got = sorted(html.extract_pages(frame, trees).collect(), key=repr)
    assert [(r.page_id, r.text.count("\n"), r.text.startswith("Paragraph 0 "), r.n_chars) for r in got[:2]] == [(1, 19_999, True, len(got[0].text))] * 2
    assert got[2].text == ""


def test_html_without_any_article_element(spark):
    pages = [(1, "u", "<body><div><p>One text.</p></div><script>var x;</script><div>More.</div></body>"), (2, "u", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(frame, html.fit(frame)).collect()}
    assert got == {1: "One text.\nMore.", 2: ""}


def test_decoding_has_no_contradiction():
    page = html.parse("<div><p>a text</p><div><p>more</p><div><p>deep</p></div></div></div>" * 3)
    make = np.random.default_rng(1)
    for _ in range(200):
        chosen = html.decode(page, make.normal(size=len(page.tag)) * 3, make.integers(0, 200, len(page.tag)).astype(float))
        for i in range(1, len(chosen)):  # what is in again below something out has nothing in above it
            above, at = [], page.parent[i]
            while at >= 0:
                above.append(chosen[at])
                at = page.parent[at]
            assert not (chosen[i] and not above[0] and True in above)


# ------------------------------------------------------------------------------- 4, 7

def test_packing_is_lossless_and_best_fit(spark, docs, tokens):
    _, ids = tokens
    parts = defaultdict(dict)
    for r in packing.write_packed(docs, V, P, END, 256).collect():
        row = np.frombuffer(r.ids, "<u2")
        assert len(row) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1]
        assert not np.any(row[r.n_tokens:] != END)
        assert packing.position_ids(r.cu_seqlens, 256)[r.position_resets].tolist() == [0] * len(r.position_resets)
        for doc, no, a, b in zip(r.doc_ids, r.part_nos, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[doc][no] = row[a:b].tolist()
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in parts.items()} == {i: x + [END] for i, x in ids.items()}


def test_packed_rows_are_made_a_column_at_a_time():
    long, short = pa.list_(pa.int64()), pa.list_(pa.int32())
    fields = pa.schema([("pack_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("doc_ids", long), ("part_nos", short),
                        ("cu_seqlens", short), ("position_resets", short), ("position_starts", long)])
    ids = [np.arange(n, dtype="<u2") for n in (5, 3, 2, 1)]
    pieces = [(doc, no, x.tobytes()) for (doc, no), x in zip([(7, 0), (7, 1), (None, 0), (9, 0)], ids)]
    got = packing._batch(40, [[0], [1, 2], [3]], pieces, [5, 3, 2, 1], 5, np.array([99], "<u2").tobytes(), fields).to_pylist()
    assert [np.frombuffer(r.pop("ids"), "<u2").tolist() for r in got] == [[0, 1, 2, 3, 4], [0, 1, 2, 0, 1], [0, 99, 99, 99, 99]]
    assert [tuple(r.values()) for r in got] == [(40, 5, [7], [0], [0, 5], [0], [0]), (41, 5, [7, None], [1, 0], [0, 3, 5], [0, 3], [5, 0]),
                                                (42, 1, [9], [0], [0, 1], [0], [0])]


def test_best_fit_takes_the_fullest_row():
    make = random.Random(2)
    for _ in range(50):
        sizes, free, rows = [make.randrange(1, 33) for _ in range(60)], [], []
        for i in sorted(range(60), key=lambda i: (-sizes[i], i)):
            fit = [r for r in range(len(rows)) if free[r] >= sizes[i]]
            if not fit:
                rows.append([]), free.append(32)
                fit = [len(rows) - 1]
            least = min(free[r] for r in fit)
            r = [r for r in fit if free[r] == least][-1]
            rows[r].append(i)
            free[r] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, 32)
        assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(sum(sizes[i] for i in r) for r in rows)


def test_packing_and_counting_corner_cases(spark):
    cases = corner_cases(spark)
    assert packing.packed_rows(empty(spark), V, P, END).count() == 0
    assert sum(len(r.doc_ids) for r in packing.packed_rows(cases, V, P, END, 100_000).collect()) == cases.count()
    counted = [(r.doc_id, r.n_tokens) for r in token_files.token_counts(cases, V, P, END, block_bytes=64).collect()]
    assert sorted(counted, key=str) == sorted(((r.doc_id, r.n_tokens) for r in bpe.round_trip(cases, V, P).collect()), key=str)
    assert token_files.token_counts(empty(spark), V, P, END).count() == 0


def test_separator_scan_over_small_blocks(spark, docs, tokens, tmp_path):
    _, ids = tokens
    files, order = token_files.write_flat(docs, V, P, END)
    for block in (2, 50, 1 << 20) if len(ids) < 50 else (50, 1 << 20):
        got = order.join(token_files.count_tokens(files, END, 2, block), ["file", "doc_no"])
        assert {(r.doc_id, r.n_tokens) for r in got.collect()} == {(i, len(x)) for i, x in ids.items()}
    path = str(tmp_path / "open.bin")
    np.array([5, 6, END, END, 7], "<u2").tofile(path)
    one = spark.createDataFrame([(path, 10)], "file string, bytes long")
    for block in (2, 4, 64):
        assert sorted((r.doc_no, r.n_tokens) for r in token_files.count_tokens(one, END, 2, block).collect()) == [(0, 2), (1, 0), (2, 1)]


# ------------------------------------------------------------------------------- 5

def brute_spans(texts):
    """Repeated spans by a dictionary, in the order of ids and places."""
    seen, ended, gone = {}, set(), defaultdict(set)
    for doc in sorted(texts):
        data = texts[doc].encode()
        _, words, at = spans.sentences(data)
        parts = [data[a:b].decode().split() for a, b in zip(at[:-1], at[1:])]
        for first in range(len(words) - 1):
            last, n = first, len(parts[first])
            while last + 1 < len(parts) and (last - first + 1 < spans.MIN_SENTENCES or n < spans.MIN_WORDS):
                last += 1
                n += len(parts[last])
            if last - first + 1 < spans.MIN_SENTENCES or n < spans.MIN_WORDS:
                break
            key = tuple(w.encode().lower() for p in parts[first:last + 1] for w in p)
            if key in seen:
                gone[doc].update(range(first, last + 1))
            seen.setdefault(key, doc)
        # The shortest long enough run up to each sentence, as well.
        for last in range(len(parts)):
            first, n = last, len(parts[last])
            while first and (last - first + 1 < spans.MIN_SENTENCES or n < spans.MIN_WORDS):
                first -= 1
                n += len(parts[first])
            if last - first + 1 < spans.MIN_SENTENCES or n < spans.MIN_WORDS:
                continue
            key = tuple(w.encode().lower() for p in parts[first:last + 1] for w in p)
            if key in ended:
                gone[doc].update(range(first, last + 1))
            ended.add(key)
    out = {}
    for doc, places in gone.items():
        data = texts[doc].encode()
        at = spans.sentences(data)[2]
        out[doc] = (len(places), b"".join(data[a:b] for i, (a, b) in enumerate(zip(at[:-1], at[1:])) if i not in places).decode())
    return out


def test_span_dedup_equals_brute_force(docs, texts):
    got = {r.doc_id: (r.n_removed, r.kept) for r in spans.span_report(docs).collect()}
    assert got and got == brute_spans(texts)


def all_repeated_runs(texts):
    """The number of sentences that any long enough run covers, of all lengths, whose words came before."""
    seen, gone = set(), defaultdict(set)
    for doc in sorted(texts):
        data = texts[doc].encode()
        at = spans.sentences(data)[2]
        parts = [data[a:b].lower().split() for a, b in zip(at[:-1], at[1:])]
        for first in range(len(parts)):
            key, n = 0, 0
            for last in range(first, len(parts)):
                for word in parts[last]:
                    key, n = hash((key, word)), n + 1
                if last - first + 1 >= spans.MIN_SENTENCES and n >= spans.MIN_WORDS:
                    if (n, key) in seen:
                        gone[doc].update(range(first, last + 1))
                    seen.add((n, key))
    return {doc: len(places) for doc, places in gone.items()}


def test_span_dedup_removes_all_of_each_repeated_run(spark, docs, texts):
    assert {r.doc_id: r.n_removed for r in spans.span_report(docs).collect()} == all_repeated_runs(texts)
    words = lambda c, n: " ".join(f"{c}{j}" for j in range(n)) + ". "
    run = words("a", 15) + words("b", 5) + words("c", 5) + words("d", 3)
    frame = spark.createDataFrame([(1, words("x", 9) + run + words("y", 9)), (2, run + words("z", 9))], "doc_id long, text string")
    assert [(r.doc_id, r.kept) for r in spans.span_report(frame).collect()] == [(2, words("z", 9))]


def test_span_dedup_finds_runs_of_words_at_any_place_of_a_text_without_stops(spark):
    make, rows, passages = random.Random(8), [], {}
    for i in range(100):
        words = lambda c, n: [f"{c}{i}x{j}" for j in range(n)]
        passages[i] = words("p", make.randrange(50, 80))
        rows += [(i + 1000 * k, " ".join([*words(f"{k}a", make.randrange(20, 60)), *passages[i], *words(f"{k}b", 40)])) for k in (0, 1)]
    left = {r.doc_id: r.kept.split() for r in spans.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(left) == {i + 1000 for i in range(100)}
    # What stays of a passage are the words of the cut pieces at its two ends; own words all stay.
    assert sum(w in set(passages[i]) for i in passages for w in left[i + 1000]) < sum(map(len, passages.values())) / 5
    assert all(set(rows[2 * i + 1][1].split()) - set(passages[i]) <= set(left[i + 1000]) for i in passages)


def test_span_dedup_finds_a_planted_passage(spark):
    passage = "Here begins the passage. It has some words, and then more words. A third sentence follows it here. The end of it."
    rows = [(i, f"Own words of text {i} stand here. {passage} And {i} behind.") for i in (4, 2, 9)] + [(20, "clean text. " * 2)]
    frame = spark.createDataFrame(rows + [rows[1]], "doc_id long, text string")
    report = spans.span_report(frame).collect()
    assert {r.doc_id for r in report} == {4, 9} and all(r.kept.startswith("Own words") and "third" not in r.kept for r in report)
    assert all(2 in r.earlier_docs or 4 in r.earlier_docs for r in report)
    cases = corner_cases(spark)
    assert spans.span_report(empty(spark)).count() == 0 and spans.span_report(cases).count() >= 1
    kept = spans.drop_repeated_spans(frame)
    assert kept.count() == 5 and {r.doc_id: r.text for r in kept.collect()}[2] == rows[1][1]
    assert spans.drop_repeated_spans(cases).columns == cases.columns


# ------------------------------------------------------------------------------- 6

def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        words = [w.lower() for w in (t or "").encode().split()]
        k = min(4, len(words))
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if words else set()
    holders, root = defaultdict(list), {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), top(i)) for i in texts}


def test_ngram_join_equals_brute_force(spark, texts):
    assert {tuple(r) for r in queries.op6_ngram_join(spark, SF).collect()} == brute_components(texts)


@pytest.mark.parametrize("small, run, block, hot", [(8, 64, 2048, 4096), (2, 4, 7, 5)])
def test_ngram_join_of_a_large_group(spark, monkeypatch, small, run, block, hot):
    for name, value in (("SMALL", small), ("RUN", run), ("BLOCK", block), ("HOT", hot)):
        monkeypatch.setattr(ngram_join, name, value)
    make, base = random.Random(4), [f"b{i}" for i in range(120)]
    rows = {}
    for i in range(160):
        words = base[:]
        for _ in range(make.choice([0, 1, 1, 2, 3, 5, 8])):
            words[make.randrange(120)] = f"n{make.randrange(10 ** 6)}"
        rows[i] = " ".join(words[make.choice([0, 0, 3]):])
    rows |= {200 + i: " ".join(base[:30]) + " " + " ".join(f"o{i}x{j}" for j in range(make.choice([4, 5, 6, 40]))) for i in range(40)}
    rows |= {300: rows[5].upper(), 301: "", 302: " \t", 303: "two words", 304: "Two  words"}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.similar_groups(frame).collect()} == brute_components(rows)


def test_ngram_join_of_groups_in_different_parts_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 5)
    rows = {}
    for f in range(8):  # twelve exact copies and one near copy: two groups, and all they share is hot
        words = [f"f{f}w{j}" for j in range(80)]
        rows |= {100 * f + c: " ".join(words) for c in range(12)} | {100 * f + 50: " ".join([*words[:-1], f"other{f}"])}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.similar_groups(frame).collect()}
    assert got == brute_components(rows) and {r[2] for r in got} == {100 * f for f in range(8)}


def test_ngram_join_finds_a_pair_behind_pairs_that_failed(spark):
    make = random.Random(6)
    blocks = [[f"b{b}w{j}" for j in range(100)] for b in range(40)]

    def text(chosen, i, own):  # ids in the order of sizes, so every list's hub is its smallest id
        chosen = make.sample(chosen, len(chosen))
        return " ".join([w for b in chosen for w in blocks[b]] + [f"t{i}o{j}" for j in range(own)])

    rows, halves = {}, []
    for i in range(0, 40, 2):  # a half of the blocks and the other half: each block in as many texts
        halves.append(make.sample(range(40), 20))
        rows[i] = text(halves[-1], i, i)
        rows[i + 1] = text([b for b in range(40) if b not in halves[-1]], i + 1, i + 1)
    del rows[18]
    rows |= {i: text(halves[9], i, i + 40) for i in (40, 41)}
    rows[42] = text([b for b in range(40) if b not in halves[9]], 42, 600)
    wanted = brute_components(rows)
    assert [(i, root) for i, _, root in wanted if i != root] == [(41, 40)]
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.similar_groups(frame).collect()} == wanted


def test_ngram_join_corner_cases(spark):
    cases = corner_cases(spark)
    got = [tuple(r) for r in ngram_join.similar_groups(cases).collect()]
    assert len(got) == cases.count() and {(0, 0, 0), (1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4)} <= set(got)
    assert (9, 8998, 3) in got and got.count((6, got[6][1], 6)) in (0, 3) and any(r[0] is None and r[2] is None for r in got)
    assert ngram_join.similar_groups(empty(spark)).count() == 0
    kept = ngram_join.drop_similar(cases)
    assert kept.columns == cases.columns and 9 not in {r.doc_id for r in kept.collect()}


def test_ngram_join_leaves_prefixes_of_heads_where_they_lie(spark):
    rows = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "id * 3 as _t", "spark_partition_id() as part")
    rows = rows.unionAll(rows.filter("doc_id = 5"))  # one that is repeated
    heads = rows.filter("doc_id % 10 <> 0").select("doc_id", "_t").distinct()
    got = ngram_join._rows_of(rows, heads).select("doc_id", "part", F.spark_partition_id().alias("now")).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(400) if i % 10]
    assert sum(r.part != r.now for r in got) <= 5  # the repeated one, and those that share a bit by chance


def test_ngram_join_leaves_only_its_results_stored(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:50 + i % 5])) for i in range(20)], "doc_id long, text string")

    def stored():
        return {n for n in os.listdir(scratch_dir(spark)) if os.path.isdir(os.path.join(scratch_dir(spark), n))}

    for job, left in ((ngram_join.similar_groups, ["components"]), (ngram_join.drop_similar, ["near-copies", "repeated"])):
        before = stored()
        found = job(docs)
        assert sorted(n.rsplit("-", 1)[0] for n in stored() - before) == left
        assert found.count() > 0


def test_drop_similar_judges_texts_under_one_id_apart(spark):
    words = {c: [f"{c}{j}" for j in range(60)] for c in "abcdefg"}
    whole, near = {c: " ".join(w) for c, w in words.items()}, {c: " ".join([*w[:-1], "other"]) for c, w in words.items()}
    rows = [(None, whole["a"]), (None, near["a"]), (None, whole["b"]), (None, near["g"]), (3, near["c"]), (7, whole["c"]), (7, whole["d"]),
            (8, whole["e"]), (8, near["e"]), (9, whole["f"]), (9, whole["f"]), (10, whole["g"])]
    kept = [tuple(r) for r in ngram_join.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one_of = [{(None, whole["a"]), (None, near["a"])}, {(8, whole["e"]), (8, near["e"])}]
    assert all(len(x & set(kept)) == 1 for x in one_of) and len(kept) == 7
    assert {(None, whole["b"]), (3, near["c"]), (7, whole["d"]), (9, whole["f"]), (10, whole["g"])} <= set(kept)
    plain_ids = spark.createDataFrame([(1, whole["a"]), (1, whole["a"]), (2, near["a"]), (3, whole["b"])], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.drop_similar(plain_ids).collect()) == [1, 3]


def test_components_of_a_path(spark):
    make = random.Random(1)
    names = make.sample(range(10_000), 300)
    links = spark.createDataFrame(list(zip(names[:199], names[1:200])) + list(zip(names[200:], names[201:])), "a long, b long")
    wanted = {(x, min(names[:200])) for x in names[:200]} | {(x, min(names[200:])) for x in names[200:]}
    assert {tuple(r) for r in components(links).collect()} == {w for w in wanted if w[0] != w[1]}
    assert components(links.limit(0)).count() == 0


# ------------------------------------------------------------------------------- 8

def test_toxicity_on_the_held_out_fold(spark):
    scored = queries.op8_toxicity(spark, SF.replace("0.001", "0.01")).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == (r.score >= 0.5) for r in scored)
    held = [(r.score, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.75


def test_toxicity_locates_the_sentence(spark):
    make, bad = random.Random(1), ["vile", "nasty"]
    rows, labels = [], []
    for i in range(300):
        said = [" ".join(make.choice("abcdefgh") * 3 + make.choice("xyz") for _ in range(8)) for _ in range(6)]
        if i % 3 == 0:
            said[2] += " " + make.choice(bad)
        rows.append((i, ". ".join(said) + "."))
        labels.append((i, int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.score_texts(frame, toxicity.train(frame, marks)).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in scored)
    assert all(r.worst == 2 and re.search("vile|nasty", r.sentence) for r in scored if r.predicted)
    blank = toxicity.score_texts(corner_cases(spark), toxicity.train(frame, marks)).collect()
    assert len(blank) == 14 and all(r.score == 0 and r.predicted == 0 for r in blank if r.doc_id in (0, 1))
    low = toxicity.train(empty(spark), marks)
    assert toxicity.score_texts(empty(spark), low).count() == 0 and low.score("any text.") < 0.5


# ------------------------------------------------------------------------------- 9, 10

def test_line_dedup_corner_cases(spark):
    cases = corner_cases(spark)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_report(cases).collect()), key=str)
    assert len(got) == 14 and {(0, 1, 0, ""), (1, 1, 0, ""), (7, 2, 1, "x2"), (8, 2, 0, f"{SHARED}\nx3"), (None, 2, 1, "null id")} <= set(got)
    assert got.count((6, 2, 1, "x1")) == 3
    assert line_dedup.line_report(empty(spark)).count() == 0
    kept = line_dedup.drop_shared_lines(cases)
    assert kept.columns == cases.columns and {r.n_chars for r in kept.collect() if r.doc_id == 7} == {2}
    assert [r.text for r in kept.collect() if r.doc_id == 0] == [None]
    plan = line_dedup.line_report(cases)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_corner_cases(spark):
    got = quality.quality_report(corner_cases(spark)).collect()
    assert len(got) == 14 and all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (0, 1, 2))
    assert all(r.kept for r in got if r.doc_id in (3, 9) and r.n_words > 100)
    assert quality.quality_report(empty(spark)).count() == 0
    kept = quality.keep_good(corner_cases(spark))
    assert kept.columns == corner_cases(spark).columns and {r.doc_id for r in kept.collect()} == {3, 9}


def test_repeated_words_equal_brute_force():
    make = random.Random(9)
    for _ in range(400):
        words = [make.choice("abc") for _ in range(make.randrange(60))]
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i:i + 8])].append(i)
        covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        assert quality.repeated_words(words) == len(covered)


def test_frequent_lines_deplete_a_text(spark):
    frame = " ".join(f"frame{i}" for i in range(18))
    words = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    rows = [(i, f"{frame}\n{words(i, 3 if i < 5 else 60)}", "h") for i in range(40)]
    copies = [(100 + i, words("c", 50), "h") for i in range(30)]
    got = quality.quality_report(spark.createDataFrame(rows + copies, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(5))


def brute_frequent(rows):
    """(host, line) of the lines over the limits; rows are (id, text, host)."""
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text)
        for line in text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if key:
                holders[host, key].add(text)
    return {k for k, held in holders.items() if len(held) > quality.MIN_DOCS and len(held) > quality.SHARE * len(texts[k[0]])}


def without_frequent(text, host, frequent):
    return "\n".join(x for x in text.split("\n") if (host, x.strip(" \t\n\x0b\x0c\r").lower()) not in frequent)


def test_quality_removes_frequent_lines(spark):
    frame = "A line that the whole host shows"
    words = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    rows = [(i, f"{frame}\n{words(i, 30)}\n {frame.upper()} ", "h") for i in range(40)]
    # One text and id under two hosts; its frame is frequent in one of them only.
    both = f"{words('b', 7)}\n{frame}\n{words('c', 7)}"
    rows += [(500, both, "h"), (500, both, "other"), (501, words("d", 40), None)]
    docs = spark.createDataFrame([(*r, len(r[1]), "z") for r in rows], "doc_id long, text string, source string, n_chars int, kept string")
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    frequent = brute_frequent([(i, t, h or "") for i, t, h in rows])
    assert frequent == {("h", frame.lower())}
    got = sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in left.collect()), key=repr)
    wanted = [(i, without_frequent(t, h or "", frequent), h) for i, t, h in rows if (i, h) != (500, "h")]
    assert got == sorted(((i, t, h, len(t)) for i, t, h in wanted), key=repr)
    assert {(r.doc_id, r.n_removed, r.kept) for r in quality.quality_report(docs).filter("doc_id >= 500").collect()} == {
        (500, 7, False), (500, 0, True), (501, 0, True)}
    # By id, sixty copies of one text are sixty documents.
    copies = spark.createDataFrame([(i, words("e", 40), "h") for i in range(60)], "doc_id long, text string, source string")
    assert quality.keep_good(copies).count() == 60 and quality.keep_good(copies, count_copies=True).count() == 0
