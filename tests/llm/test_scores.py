"""Language-model scores, ranked search and token alignment against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ampliframe.llm import cross_tokens, pitman_yor, queries, search
from ampliframe.session import scratch_dir

from .test_operators import SF, corner_cases, docs, empty, texts  # noqa: F401

A, B, P = queries.BYTE_TOKENS, queries.PIECE_TOKENS, queries.PATTERN


# ------------------------------------------------------------------------------- 11

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute_base(rows):
    """Per row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score); the end is None."""
    counts = Counter(w for doc, text in rows if not is_held(doc) for w in words_of(text) + [None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        tokens = words_of(text) + [None]
        out.append((doc, is_held(doc), len(tokens), sum(counts[w] > 0 for w in tokens), total,
                    sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)))
    return out


def same_base(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    found = sorted((tuple(r)[:6] for r in found), key=key)
    wanted = sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(found, wanted))


def test_scores_of_the_smallest_tables(spark, texts):  # noqa: F811
    rows = queries.op11_lm_score(spark, SF).collect()
    same_base(rows, brute_base(list(texts.items())))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_corner_cases(spark):
    cases = corner_cases(spark)
    same_base(pitman_yor.score_texts(cases).collect(), brute_base([(r.doc_id, r.text) for r in cases.collect()]))
    assert pitman_yor.score_texts(empty(spark)).count() == 0
    held = next(i for i in range(100) if is_held(i))
    alone = pitman_yor.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(3, 0, 0, 0.0, 0.0)]


def test_small_blocks_and_hot_words_change_no_probability_but_by_chance(spark, monkeypatch, docs):  # noqa: F811
    """Blocks of any size and words dealt out in parts: the same counts, hence the same tables, as draws
    depend on the pair alone."""
    one = {r.doc_id: r for r in pitman_yor.score_texts(docs).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(pitman_yor, "HOT_TOKENS", 200)
    monkeypatch.setattr(pitman_yor, "HOT_WORDS", 1 << 20)
    for r in pitman_yor.score_texts(docs.repartition(5)).collect():
        assert abs(r.score - one[r.doc_id].score) < 1e-4 * abs(r.score)
        assert abs(r.base_score - one[r.doc_id].base_score) < 1e-6 * abs(r.base_score)


def test_pairs_are_deleted_before_the_answers_are_made(spark, monkeypatch):
    seen, packed = [], pitman_yor._packed

    def watched(*args):
        seen.extend(n for n in os.listdir(scratch_dir(spark).removeprefix("file:")) if n.startswith(("pitman-yor-pairs", "pitman-yor-tables")))
        return packed(*args)

    monkeypatch.setattr(pitman_yor, "_packed", watched)
    rows = [(i, "a b a b c") for i in range(10)]
    same_base(pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute_base(rows))
    assert not seen


def test_scorer_gives_a_distribution():
    """The last step by itself: over all dishes and the unknown word the probabilities of a context are one."""
    import pyarrow as pa
    d, d0, strength = 0.6, 0.4, 1.0
    pairs = {(5, 6): (3, 2), (5, 7): (1, 1), (5, 1): (2, 1), (6, 5): (1, 1), (7, 5): (2, 2), (1, 5): (4, 2)}
    c0 = Counter()
    for (u, w), (c, t) in pairs.items():
        c0[w] += t
    t0 = {w: max(1, n // 2) for w, n in c0.items()}
    new = (strength + d0 * sum(t0.values())) / (len(c0) + 1)
    p = {w: (c0[w] - d0 * t0[w] + new) / (strength + sum(c0.values())) for w in c0}
    unseen = new / (strength + sum(c0.values()))
    assert abs(sum(p.values()) + unseen - 1) < 1e-12
    counts, tables = Counter(), Counter()
    for (u, w), (c, t) in pairs.items():
        counts[u] += c
        tables[u] += t
    words = np.array([1, 5, 6, 7, 9])
    tokens = np.array([1, 2, 1, 3, 1, 1, 1, 4, 0])  # 5 6 5 7 5 5 5 9 end
    keys = [w for w in words.tolist() if w in p]
    told = np.array([[p[w], strength + d * tables[w]] for w in keys], np.float32)
    told_pairs = {pair: c - d * t for pair, (c, t) in pairs.items() if pair in {(1, 5), (5, 6), (6, 5), (5, 7), (7, 5)}}
    pair_keys = pitman_yor._pair_key(*(np.array(x) for x in zip(*told_pairs)))
    none = {"docs": None, "held": None, "ends": None, "words": None, "tokens": None}
    rows = pa.Table.from_pylist([
        {"block": 0, "kind": 0, "keys": np.array(keys).tobytes(), "counts": np.array([counts[w] for w in keys]).tobytes(), "values": told.tobytes(), **none},
        {"block": 0, "kind": 1, "keys": pair_keys.tobytes(), "counts": None, "values": np.array(list(told_pairs.values()), np.float32).tobytes(), **none},
        {"block": 0, "kind": 2, "keys": None, "counts": None, "values": None, "docs": [8], "held": [True], "ends": [len(tokens)],
         "words": words.tolist(), "tokens": tokens.tolist()}], pa.schema([
             ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("values", pa.binary()),
             ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int32())), ("words", pa.list_(pa.int64())),
             ("tokens", pa.list_(pa.int32()))]))
    out = next(pitman_yor._scorer(d, strength, 1, [unseen], 100, len(c0))(iter(rows.to_batches()))).to_pylist()[0]

    def chance(u, w):
        c, t = pairs.get((u, w), (0, 0))
        return (c - d * t + (strength + d * tables[u]) * p.get(w, unseen)) / (strength + counts[u])

    for u in (1, 5, 6, 7, 9):
        assert abs(sum(chance(u, w) for w in [*p, 99]) - 1) < 1e-12
    sequence = [1, *words[tokens].tolist()]
    assert abs(out["score"] - sum(math.log10(chance(u, w)) for u, w in zip(sequence, sequence[1:]))) < 1e-5
    assert out["n_tokens"] == 9 and out["n_known"] == 8


def brute_tables(c, mass, p, d):
    """Distribution of the number of tables of c customers, by all ways to seat them one by one."""
    weights = {1: mass * p}
    for i in range(1, c):
        after = defaultdict(float)
        for t, w in weights.items():
            after[t] += w * (i - d * t)
            after[t + 1] += w * (mass + d * t) * p
        total = sum(after.values())
        weights = {t: w / total for t, w in after.items()}
    total = sum(weights.values())
    return np.array([weights.get(t, 0) / total for t in range(1, c + 1)])


@pytest.mark.parametrize("c,mass,p,d", [(2, 1.0, 0.1, 0.5), (7, 4.0, 0.3, 0.8), (40, 30.0, 0.05, 0.6), (250, 60.0, 0.02, 0.7), (250, 60.0, 0.3, 0.3)])
def test_tables_are_drawn_from_their_distribution(monkeypatch, c, mass, p, d):
    """By the exact numbers, and with customers enough for the series or for seating one by one."""
    n, wanted = 20_000, brute_tables(c, mass, p, d)
    seeds = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    columns = np.full(n, c), np.full(n, mass), np.full(n, p)
    for exact in (256, 20):
        monkeypatch.setattr(pitman_yor, "EXACT", exact)
        got = np.bincount(pitman_yor.seat(*columns, d, seeds), minlength=c + 1)[1:] / n
        assert np.abs(got - wanted).sum() < 0.08
        pitman_yor._stirling.clear()
    monkeypatch.setattr(pitman_yor, "SPARSE", 0)
    if mass * p > 3:
        got = np.bincount(pitman_yor.seat(*columns, d, seeds), minlength=c + 1)[1:] / n
        assert np.abs(got - wanted).sum() < 0.08


def test_tables_of_very_many_customers():
    seeds = np.arange(3).astype(np.uint64)
    got = pitman_yor.seat(np.array([3_000_000, 50_000_000, 1]), np.array([5e4, 2.0, 1.0]), np.array([0.01, 1e-4, 0.5]), 0.7, seeds)
    assert 500 < got[0] < 10_000 and got[1] == 1 and got[2] == 1


# ------------------------------------------------------------------------------- 12

def brute_search(rows, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(doc, split(text)) for doc, text in rows]
    found = [(doc, words, Counter(words)) for doc, words in found if words]
    n, length = len(found), sum(len(w) for _, w, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in sorted({(i, t or "") for i, t in items}, key=repr):
        scored = []
        for doc, words, counts in found:
            m = 10 + 90 * len(words) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
                        for t in dict.fromkeys(split(text)) if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def search_rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_brute_force(spark, texts, monkeypatch):  # noqa: F811
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = sorted(brute_search(list(texts.items()), items), key=repr)
    assert search_rows(queries.op12_ranked_search(spark, SF)) == wanted
    monkeypatch.setattr(search, "SEGMENT_DOCS", 17)
    monkeypatch.setattr(search, "ITEMS_PER_PASS", 13)
    assert search_rows(queries.op12_ranked_search(spark, SF)) == wanted


def test_search_of_corner_cases(spark):
    items = [(1, "common LINE w17 w18 w18"), (1, "common LINE w17 w18 w18"), (1, "x1"), (2, None), (3, ""), (4, "zzz absent"), (None, "a b"), (5, "!? ,")]
    bench = spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, rank int, score string")
    cases = corner_cases(spark)
    rows = [(r.doc_id, r.text) for r in cases.collect()]
    assert search_rows(search.ranked(cases, bench)) == sorted(brute_search(rows, items), key=repr)
    assert search.ranked(empty(spark), bench).count() == 0 and search.ranked(cases, bench.limit(0)).count() == 0


def test_few_accumulators_and_all_updates():
    """With one rare and one frequent term the frequent one makes no accumulators, but updates those there are."""
    rare = np.arange(20), np.full(20, 1000) + np.arange(20)
    frequent = np.arange(10_000), np.full(10_000, 7)
    places, scores, made = search.best_of_segment([rare, frequent], 10_000, 10, 1)
    assert made == 20 and sorted(scores.tolist()) == [1007 + i for i in range(20)]
    assert search.best_of_segment([frequent, rare], 10_000, 10, 1)[2] == 10_000


# ------------------------------------------------------------------------------- 13

def brute_alignment(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = cross_tokens.byte_alphabet()
    size_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    linked, out = [], []
    for doc, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta, tb = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia], [size_b(i) for i in ib]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            ia, ib, ta, tb = [], [], [], []
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in (ta, tb)]
        groups, left = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            right = [x.index(end) + 1 for x in ends]
            groups.append((ia[left[0]:right[0]], ib[left[1]:right[1]]))
            left = right
        linked.append(Counter((x, y) for p, q in groups for x in p for y in q))
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, len(ia), len(ib), len(groups), linked[-1].total(), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    held = Counter(pair for links in linked for pair in links)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*row, sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()))
            for row, links in zip(out, linked)]


def aligned_rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=repr)


def test_alignment_equals_brute_force(spark, docs, texts, monkeypatch):  # noqa: F811
    wanted = sorted(brute_alignment(list(texts.items())), key=repr)
    assert sum(r[1] > 0 for r in wanted) > 50 and any(r[6] < r[4] for r in wanted)
    assert aligned_rows(queries.op13_cross_tokens(spark, SF)) == wanted
    monkeypatch.setattr(cross_tokens, "HELD_COUNTS", 100)
    assert aligned_rows(cross_tokens.align_tokenizers(docs, A, B, P, max_pairs=0)) == wanted


def test_alignment_of_corner_cases(spark, monkeypatch):
    odd = ["<|endoftext|> plain <s></s><unk>", " leading", "two  spaces", "tab\tline\n", "▁piece", "<0x41>", "日本語 \U0001f600\U0001f601", "é", "\x00nul",
           "a" * 3000, "éè" * 700, "ﬁ ½"]
    cases = corner_cases(spark).select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    wanted = sorted(brute_alignment([(r.doc_id, r.text) for r in cases.collect()]), key=repr)
    assert aligned_rows(cross_tokens.align_tokenizers(cases, A, B, P)) == wanted
    assert aligned_rows(cross_tokens.align_tokenizers(corner_cases(spark), A, B, P)) == sorted(
        brute_alignment([(r.doc_id, r.text) for r in corner_cases(spark).collect()]), key=repr)
    assert cross_tokens.align_tokenizers(empty(spark), A, B, P).count() == 0
    # Groups of many links are counted before they are linked: the same rows.
    import ampliframe.llm.cross_tokens as module
    aligner = module.Aligner(open(A, "rb").read(), open(B, "rb").read(), P)
    lists = aligner.encode([r.text for r in cases.collect()])
    one = aligner.align(*lists)
    monkeypatch.setattr(module, "BIG_GROUP", 0)
    other = aligner.align(*lists)
    key = lambda out: [sorted(zip(*x)) for x in zip(*(out[n].to_pylist() for n in ("a", "b", "times")))]
    assert key(one) == key(other) and one["groups_sha256"] == other["groups_sha256"]


def test_long_texts_take_the_own_codec(monkeypatch):
    tokens = cross_tokens.ByteTokens(open(A, "rb").read(), P)
    texts = ["a long text, with words 123 and more", " x" * 50]
    short = tokens.encode(texts)
    monkeypatch.setattr(cross_tokens, "LONG_TEXT", 5)
    assert tokens.encode(texts) == short


def test_sweeps_are_thrown_away_before_any_counts():
    import inspect
    from ampliframe.llm import pitman_yor
    assert inspect.signature(pitman_yor.score_texts).parameters["burn_in"].default >= 1


def test_rows_are_gathered_by_their_bytes(monkeypatch):
    """A row that names thousands of blocks weighs as many numbers; rows of one block are put together as before."""
    def sizes(blocks, n=40):
        batch = pa.RecordBatch.from_pydict({"key": pa.array(range(n), pa.int64()), "blocks": pa.array([list(range(blocks))] * n, pa.list_(pa.int64()))})
        return [t.num_rows for t in pitman_yor._gathered(iter([batch] * 20))]

    assert sizes(1) == [800]
    heavy = sizes(20_000)
    assert sum(heavy) == 800 and max(heavy) < 200
    monkeypatch.setattr(pitman_yor, "ROWS", 100)
    assert sizes(1) == [120] * 6 + [80]


def test_restaurants_of_many_tables_are_sampled_in_parts(monkeypatch):
    """The tables drawn are the same, however many rows are held at a time."""
    n = 300
    rows = [np.full(n, 5000), np.full(n, 900.0), np.full(n, 0.2), 0.7, np.arange(n, dtype=np.uint64) * np.uint64(7919)]
    whole, widths, seat_many = pitman_yor.seat(*rows), [], pitman_yor._seat_many
    monkeypatch.setattr(pitman_yor, "CELLS", 50 * pitman_yor.PARTICLES)
    monkeypatch.setattr(pitman_yor, "_seat_many", lambda c, *rest: widths.append(len(c)) or seat_many(c, *rest))
    assert (pitman_yor.seat(*rows) == whole).all()
    assert sum(widths) == n and max(widths) == 50
