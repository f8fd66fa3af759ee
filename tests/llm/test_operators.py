"""Each operator against brute force on the small corpus, and on an empty table."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import classifier, decontaminate, line_dedup, mixing, ngram_join, ppm, quality_rules, rans, suffix_dedup, token_output, warc
from helixframe.llm.components import components
from helixframe.llm.text import LOWER
from helixframe.session import shared_dir


def words(t):
    return (t or "").encode().split()


def lower_words(t):
    return (t or "").encode().translate(LOWER).split()


def counted(values):
    return Counter(map(tuple, values))


# Line dedup

def line_seeds(lines, min_line, min_block):
    """(first, after) of lines that stand for themselves and of the shortest runs from each line on and up to each line."""
    n, sizes = len(lines), [len(x) for x in lines]
    out = {(i, i + 1) for i in range(n) if sizes[i] >= min_line}
    for i in range(n):
        if sizes[i]:
            out |= {(i, j) for j in range(i + 1, n + 1) if sum(sizes[i:j]) >= min_block and sum(sizes[i:j - 1]) < min_block}
            out |= {(j, i + 1) for j in range(i + 1) if sum(sizes[j:i + 1]) >= min_block and sum(sizes[j + 1:i + 1]) < min_block}
    return out


def brute_line_dedup(rows, min_line=20, min_block=40):
    docs = {}
    for r in rows:
        if r[1] is not None:
            docs[((r[0] is not None, r[0] or 0), r[1])] = [x.strip(" ") for x in r[1].split("\n")]
    first, gone = {}, defaultdict(set)
    for k in sorted(docs, key=lambda k: k[0]):
        lines = docs[k]
        shared = []
        for i, j in line_seeds(lines, min_line, min_block):
            earlier = first.setdefault(tuple(lines[i:j]), k)
            if earlier != k:
                shared.append((earlier, i, j))
        rest, full = shared, True
        while rest:
            new = set()
            for earlier in {e for e, _, _ in rest}:
                open_lines = {x for e, i, j in rest if e == earlier for x in range(i, j)}
                code = {x: n for n, x in enumerate({*lines, *docs[earlier]})}
                a = [code[x] if full or i in open_lines else ("masked", i) for i, x in enumerate(lines)]
                new |= set(line_dedup.common_blocks(a, [len(x) for x in lines], [code[x] for x in docs[earlier]], min_block))
            if not new - gone[k]:
                break
            gone[k] |= new
            rest, full = [(e, i, j) for e, i, j in shared if not set(range(i, j)) <= gone[k] and sum(len(x) for x in lines[i:j]) >= min_block], False
    return gone


def test_line_dedup(docs, rows):
    got = line_dedup.apply(docs)
    assert got.columns == docs.columns + ["n_lines", "n_removed"]
    gone = brute_line_dedup(rows)
    want = []
    for r in rows:
        g = gone.get(((r[0] is not None, r[0] or 0), r[1]), set())
        want.append((r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in g), len(g)))
    assert counted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == counted(want)
    assert sum(len(g) for g in gone.values()) > 20


def test_line_dedup_short_lines(spark):
    a, b = "all rights are reserved here", "read the terms of our service"  # 28 and 29 characters
    verse = ["so short a line", "", "and one more", "then the third", "and the end"]  # each under 20
    own = lambda i: f"document {i} has this line of its own"
    texts = {1: [a, own(1)], 2: [b, own(2)]}
    texts |= {i: [own(i), a, b] for i in range(100, 130)}
    texts |= {i: [*verse, own(i)] for i in range(200, 220)}
    # The tail of a block whose long lines stand earlier elsewhere.
    c, d, tail = "c" * 45, "d" * 45, "the tail"
    texts |= {300: [c, own(300)], 301: [own(301), d], **{i: [own(i), c, d, tail] for i in range(310, 330)}}
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.apply(df).collect()}
    whole = {1, 2, 100, 200, 300, 301}
    want = {i: "\n".join(t) if i in whole else own(i) for i, t in texts.items()} | {310: f"{own(310)}\n{tail}"}
    assert got == want


def test_run_hashes():
    h, n = np.arange(1, 7, dtype=np.int64), np.array([10, 0, 35, 10, 50, 5])
    seeds = line_dedup.run_hashes(h, n, 20, 40)
    again = line_dedup.run_hashes(h[2:5], n[2:5], 20, 40)
    assert list(zip(again[1].tolist(), again[2].tolist())) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    whole = dict(zip(zip(seeds[1].tolist(), seeds[2].tolist()), seeds[0].tolist()))
    assert [whole[i + 2, j + 2] for i, j in zip(*again[1:])] == again[0].tolist() and len(set(whole.values())) == len(whole)
    assert len(line_dedup.run_hashes(h[:0], n[:0], 20, 40)[0]) == 0


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([5, 6, 7], [7, 5, 6]) == [(0, 1), (1, 2)]
    assert line_dedup.patience([], [1]) == []


@pytest.mark.parametrize("n", [6, 14, 500])
def test_line_dedup_whatever_the_size(spark, n):
    """Lines that changed places are lost by every later document, however many hold them."""
    p, q = "p" * 50, "q" * 50
    rows = [(1, f"{q}\n{p}")] + [(i, f"{p}\n{q}\nan own line of document {i}") for i in range(2, n + 1)]
    got = {r.doc_id: r.text for r in line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1]} | {i: f"an own line of document {i}" for i in range(2, n + 1)}


def test_line_dedup_of_moved_blocks(spark):
    rng, blocks = np.random.default_rng(4), [[f"block {b} line {i} {'x' * 20}" for i in range(3)] for b in range(6)]
    rows = []
    for i in range(30):
        picked = rng.permutation(6)[:rng.integers(1, 6)]
        rows.append((i, "\n".join(x for b in picked for x in [*blocks[b][rng.integers(0, 2):], f"own {i}"])))
    got = line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = brute_line_dedup(rows)
    assert {r.doc_id: r.n_removed for r in got} == {i: len(gone.get(((True, i), t), ())) for i, t in rows}


# Columns of the input that carry the operators' own names

NAMES = ["key", "row", "id", "h", "n", "lines", "gone", "copy", "copies", "taken_key", "judged", "removed_lines", "left_text", "version", "text_hash", "first", "doc", "size",
         "_key", "_copy", "_copies", "_gone", "_bad", "_lines", "_lost", "_again", "_id", "_h", "class", "root", "node", "stays", "made_n_lines", "_lines_of_text", "row_key"]


def test_clashing_columns(spark, docs, rows):
    plain = docs.select("doc_id", "text", "source", "n_chars")
    odd = plain.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES], F.lit("own").alias("n_lines"), F.lit("own").alias("n_removed"))
    items = spark.createDataFrame([(1, rows[7][1])], "item_id long, text string")
    for apply in (line_dedup.apply, quality_rules.apply, mixing.apply, ngram_join.apply, lambda d: decontaminate.apply(d, items)):
        out, want = apply(odd), apply(plain)
        counts = [c for c in ("n_lines", "n_removed") if c in want.columns]
        assert sorted(out.columns) == sorted(odd.columns)
        same = ["doc_id", "text", "source", "n_chars", *counts]
        assert counted(out.select(*same).collect()) == counted(want.select(*same).collect())
        assert {tuple(r) for r in out.select(*NAMES).collect()} == {tuple(f"own {n}" for n in NAMES)}


# Quality classifier

def test_classifier(spark, rows):
    good = [(i, r[1]) for i, r in enumerate(rows) if r[1] and 60 < len(r[1]) < 3000 and "#" not in r[1]][:40]
    bad = [(1000 + i, t.replace(" ", "### ").upper()) for i, t in good]
    docs = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, "x"), good[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (7777, None), (7778, 5)], "doc_id long, quality int")
    got = classifier.score_quality(docs, labels).collect()
    assert len(got) == len(good) + len(bad) + 4
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    alone = classifier.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    x, y = classifier.isotonic(np.arange(4.0), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1]


# WARC

def test_warc(spark):
    pages = [(1, "http://M.Example.com:80/a?b#c", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "https://x.org", None), (4, "https://x.org", ""), (5, "bad url", "é" * 5000),
             (None, "http://n.org/", "<p>one</p>"), (6, "http://x.org/6", "solo"), (6, "http://x.org/6", "solo")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = shared_dir(spark, "warc-test")
    index = warc.build_index(warc.write(df, folder), folder)
    got = warc.fetch(warc.lookup(index, df)).collect()
    groups = defaultdict(list)
    for p, _, h in pages:
        groups[(h or "").encode()].append(p)
    want = []
    for b, ids in groups.items():
        top = max(-1 if i is None else i for i in ids)
        first = True
        for i in ids:
            response = i == top and first
            first &= not response
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else top))
    assert counted(got) == counted(want)
    assert [e[1] for e in index.find("https://x.org:443")] == [3, 4] and index.find("http://nowhere.org/") == []
    assert warc.capture_key("http://M.Example.com:80/a?b#c") == "com,example,m)/a?b"
    entry = index.find("http://m.example.com/a?b")[0]
    headers, payload = warc.parse(warc.files.read_range(entry[2], entry[3], entry[4]))
    assert headers["WARC-Type"] == "revisit" and headers["Refers-To-Page-Id"] == "2" and payload == b""
    small = [r.record_type for r in warc.round_trip(df, min_revisit=100_000).collect()]
    assert small == ["response"] * len(pages)


def test_index_of_many_blocks(spark):
    df = spark.range(900).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id) as url", "concat('t', id) as html")
    folder = shared_dir(spark, "warc-test")
    index = warc.build_index(warc.write(df, folder), folder)
    for i in (0, 450, 899):
        assert [e[1] for e in index.find(f"http://h{i % 7}.org/{i}")] == [i]
    finder = warc.Finder(index)
    keys = sorted(warc.capture_key(f"http://h{i % 7}.org/{i}") for i in range(100, 110))
    assert sum(len(list(finder.captures(k))) for k in keys) == 10
    assert finder.reads <= 2 * 7 + len(index.shards)  # directories and blocks of seven hosts, not of the whole index
    assert warc.lookup(index, df.filter("page_id < 50")).count() == 50


def test_hot_url_over_many_blocks(spark):
    df = spark.range(1500).selectExpr("id as page_id", "if(id < 900, 'http://hot.org/', concat('http://h.org/', id)) as url", "concat('t', id) as html")
    assert counted([r.page_id] for r in warc.round_trip(df).collect()) == counted([i] for i in range(1500))


# Mixing

def test_mixing(docs, rows):
    out = mixing.mix_sources(docs)
    got = out.collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    assert counted((r.doc_id, r["size"]) for r in got) == counted((r[0], len(words(r[1]))) for r in rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
    for s in order:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies for r in own) - target[s] / size[s] * len(own)) < 3
    assert counted(out.select("doc_id", "taken").collect()) == counted(mixing.mix_sources(docs).select("doc_id", "taken").collect())
    taken = mixing.apply(docs)
    assert taken.columns == docs.columns
    unique = {r.doc_id: r.copies for r in got}
    copies = Counter(r.doc_id for r in taken.collect())
    assert all(copies[i] == n for i, n in unique.items() if i not in (2,))


def test_largest_are_rounded_first(spark):
    """What a source takes differs from its target by a small document, not by its largest."""
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 60, 300), rng.integers(2_000, 6_000, 25)])
    rows = [(i, "w " * int(n), f"s{i % 3}") for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    errors = []
    for seed in range(6):
        got = mixing.mix_sources(df, seed=seed).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        errors += [r.taken - r.target for r in got]
    assert np.sqrt(np.mean(np.square(errors))) < 2_000


def test_mixing_of_repeated_rows(spark):
    df = spark.range(4_000).selectExpr("if(id < 3000, 7, id) as doc_id", "if(id < 3000, 'same words here', concat('text ', id)) as text", "'s' as source")
    got = mixing.mix_sources(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copies").alias("draws")).collect()
    assert len(got) == 1001 and {r.n for r in got if r.doc_id == 7} == {3000} and all(r.draws == 1 for r in got)


def test_pivot():
    rng = np.random.default_rng(1)
    p = rng.random(501)
    out = mixing.pivot(p.copy(), rng.integers(0, 2 ** 63, 501).astype(np.uint64), 3)
    assert ((out == 0) | (out == 1)).sum() >= 500 and out.sum() == pytest.approx(p.sum())


# Suffix dedup

@pytest.mark.parametrize("hot", [256, 0])
def test_suffix_dedup(docs, rows, hot):
    n = suffix_dedup.LENGTH
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    want = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((r[0], len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = suffix_dedup.remove_repeats(docs, hot_chunks=hot).collect()
    assert counted((*r[:5], bytes(r[5])) for r in got) == counted(want)
    assert sum(w[2] > 0 for w in want) > 10


def edited_variants(rng, n, length=1200):
    """Variants of one text that differ in a few bytes each, from the first byte on, and one passage with different surroundings."""
    letters = np.frombuffer(b"abcdefghij klmnop", np.uint8)
    base, passage = letters[rng.integers(0, len(letters), length)], letters[rng.integers(0, len(letters), 260)]
    out = []
    for k in range(n):
        t = base.copy()
        at = rng.integers(0, length, 1 + k % 5)
        t[at] = letters[rng.integers(0, len(letters), len(at))]
        around = letters[rng.integers(0, len(letters), 300)]
        out += [t.tobytes(), around[:150].tobytes() + passage.tobytes() + around[150:].tobytes()]
    return out


@pytest.mark.parametrize("n", [3, 20, 60])
def test_index_of_variants(n):
    size = suffix_dedup.LENGTH
    for seed in range(4):
        texts = edited_variants(np.random.default_rng([n, seed]), n)
        cuts = defaultdict(set)  # snippets as the buckets get them, all in one bucket
        for _, data, _, valid in suffix_dedup.windows_of(texts):
            for h, first, count in suffix_dedup.snippets(data, valid):
                for a, i, k in zip(h.tolist(), first.tolist(), count.tolist()):
                    cuts[a].add(data[i:i + k + size - 1].tobytes())
        strings = sorted(x for c in cuts.values() if len(c) > 1 for x in c)
        np.random.default_rng(seed).shuffle(strings)
        seen = Counter(x[i:i + size] for x in strings for i in range(len(x) - size + 1))
        stats, at = suffix_dedup.RunLengthIndex(strings, size).matching_statistics(), 0
        for x in strings:
            for i in range(len(x) - size + 1):
                assert (stats[at + i] >= size) == (seen[x[i:i + size]] > 1)
            at += len(x) + 1


def test_suffix_dedup_variants(spark):
    size = suffix_dedup.LENGTH
    texts = [t for k in (20, 60) for t in edited_variants(np.random.default_rng(k), k)]
    seen = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    want = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if seen[t[k:k + size]] > 1:
                gone[k:k + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, keep_text=False).drop("kept").collect()
    assert counted(got) == counted(want)


def test_matching_statistics():
    strings = [b"abracadabra" * 3, b"cadabrax", b"\x00\x00zz", b"abracad"]
    index = suffix_dedup.RunLengthIndex(strings)
    stats, at, whole = index.matching_statistics(), 0, b"|".join(strings)
    for k, s in enumerate(strings):
        for i in range(len(s)):
            best = 0
            for j, o in enumerate(strings):
                for q in range(len(o)):
                    m = 0
                    while (j, q) != (k, i) and i + m < len(s) and q + m < len(o) and s[i + m] == o[q + m]:
                        m += 1
                    best = max(best, m)
            assert min(stats[at + i], len(s) - i) >= best and (stats[at + i] == best or best == len(s) - i)
        at += len(s) + 1
    assert index.runs < len(whole)


# Language model

def test_ppm(docs, rows):
    got = sorted(ppm.score_texts(docs).collect(), key=str)
    counts, ends = Counter(), 0
    train = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2
    grams = defaultdict(Counter)
    for r in rows:
        if train(r):
            counts.update(lower_words(r[1]))
            ends += 1
            t = b"\n" * ppm.ORDER + (r[1] or "").encode().translate(LOWER) + b"\0"
            for i in range(ppm.ORDER, len(t)):
                for k in range(ppm.ORDER + 1):
                    grams[t[i - k:i]][t[i]] += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1

    def log_p(context, x):
        out, excluded = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            c = {s: n for s, n in grams[context[ppm.ORDER - k:]].items() if s not in excluded}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if x in c:
                return out + math.log10(c[x] / (n + d))
            out += math.log10(d / (n + d))
            excluded |= set(c)
        return out - math.log10(256 - len(excluded))

    want = []
    for r in rows:
        w = lower_words(r[1])
        t = b"\n" * ppm.ORDER + (r[1] or "").encode().translate(LOWER) + b"\0"
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((ends + 1) / (total + distinct + 1))
        score = sum(log_p(t[i - ppm.ORDER:i], t[i]) for i in range(ppm.ORDER, len(t)))
        want.append((r[0], not train(r), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, base, score))
    key = lambda v: (str(v[0]), v[2], round(v[5], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


# Quality rules

def brute_stats(t):
    w = words(t)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    full = [x for x in (t or "").split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(cover))


def test_quality_rules(docs, rows):
    got = quality_rules.judge(docs, min_line_docs=2, max_line_share=0.0, min_kept_share=0.5).collect()
    want = [(r[0], *brute_stats(r[1])) for r in rows]
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == counted(want)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_line_frequency(spark):
    fresh = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    letters = lambda i: fresh(i).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, f"All  RIGHTS reserved to us here\n{letters(i)}", "h") for i in range(6)]
    rows += [(10 + i, "all rights reserved to us here\nall rights reserved to us here", "h") for i in range(2)]
    rows += [(20 + i, letters(99), "h") for i in range(6)] + [(30, "all rights reserved to us here\n" + letters(5), "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df, min_line_docs=3, max_line_share=0.1).collect()}
    assert all(got[i].kept and got[i].removed_lines == [0] and got[i].removed_words == 6 for i in range(6))
    assert all(got[20 + i].kept and got[20 + i].removed_lines == [] for i in range(6))  # copies count once
    assert got[30].removed_lines == []
    out = {r.doc_id: r.text for r in quality_rules.apply(df, min_line_docs=3, max_line_share=0.1).collect()}
    assert out[0] == letters(0) and out[30] == rows[-1][1] and 10 not in out


def test_line_frequency_counts_documents(spark):
    line = lambda k: f"{k} " + " ".join(f"{k}{c}" for c in "abcdefghijk")
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    lines = sorted((line("x" + name(i)) for i in range(100)), key=lambda x: quality_rules.profile_text(x)[1][0])
    header, footer, own = lines[0], lines[1], lines[2:]  # header and footer have the smallest hashes
    rows = [(i, f"{header}\n{own[i]}\n{footer}", "h") for i in range(12)]
    rows += [(100 + i, own[50], "h") for i in range(300)]  # one document, however often
    rows += [(500 + i, f"{header}\n{own[60]}\n{footer}", "copies") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df, max_line_share=0.5).collect()}
    assert all(got[i].removed_lines == [0, 2] and got[i].kept for i in range(12))
    assert all(got[i].removed_lines == [] and got[i].kept for i in got if i >= 100)


# Token ids

def test_token_files(docs, rows):
    from tokenizers import Tokenizer

    from helixframe.llm.pieces import default_path
    encoder = Tokenizer.from_file(default_path())
    got = sorted(token_output.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    ids = defaultdict(set)
    for r in rows:
        e = np.array([*encoder.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        ids[r[0]].add((len(e), zlib.crc32(e.tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens


def test_rans():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, rans.BLOCK - 1, 2 * rans.BLOCK + 77):
        ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
        table = rans.Table.unpack(rans.Table.fit(np.bincount(ids, minlength=50_257)).pack())
        blocks = rans.encode(table, ids)
        assert (rans.decode(table, b"".join(blocks)) == ids).all()
        assert (rans.decode_part(table, blocks[0], n // 3, n // 2) == ids[n // 3:min(n // 2, rans.BLOCK)]).all()
    one = rans.Table.fit(np.array([0, 5]))
    assert (rans.decode(one, b"".join(rans.encode(one, np.ones(99, np.uint32)))) == 1).all()
    broken = bytearray(b"".join(blocks))
    broken[40] ^= 1
    with pytest.raises(ValueError):
        rans.decode(table, bytes(broken))


# Decontamination

def shingles(t, k):
    w = lower_words(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_decontaminate(spark, docs, rows):
    items = []
    for i in (7, 11, 20, 30):
        w = rows[i][1].split()
        items += [(i, " ".join(w[:18])), (100 + i, " ".join(w[2:14])), (200 + i, " ".join([*w[:9], "zzz", *w[9:40]]))]
    items += [(900, None), (901, ""), (902, "ONE two  three"), (903, "one two three four five six seven eight"), (7, " ".join(rows[7][1].split()[:18]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(docs, df).collect()
    want = set()
    for r in rows:
        for i, t in items:
            q = shingles(t, 5)
            common = len(q & shingles(r[1], 5))
            if q and common >= 0.8 * len(q):
                want.add((r[0], i, len(q), common))
    assert {tuple(r[:4]) for r in got} == want and len(got) == len(want) > 8
    kept = decontaminate.apply(docs, df)
    assert kept.columns == docs.columns
    bad = {r[1] for r in rows for i, t in items if shingles(t, 5) and len(shingles(t, 5) & shingles(r[1], 5)) >= 0.8 * len(shingles(t, 5))}
    assert counted((r.doc_id, r.text) for r in kept.collect()) == counted((r[0], r[1]) for r in rows if r[1] not in bad)
    assert decontaminate.find_items(docs, df.limit(0)).count() == 0


# N-gram join

def brute_components(rows, k=4, percent=85):
    sets, n = [shingles(r[1], k) for r in rows], len(rows)
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i in range(n):
        if rows[i][0] is not None:
            first[find(i)] = min(first.get(find(i), rows[i][0]), rows[i][0])
    return [(r[0], len(s), first.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_ngram_join(docs, rows):
    want = brute_components(rows)
    assert counted(ngram_join.similar_groups(docs).collect()) == counted(want)
    assert len({w[2] for w in want}) < len(rows) - 6
    kept = ngram_join.apply(docs)
    assert kept.columns == docs.columns
    assert counted([r.doc_id] for r in kept.collect()) == counted([i] for i in {w[0] for w in want if w[0] is None or w[0] == w[2]})


def test_combinations_of_frequent_tokens(spark):
    """With every shared token frequent, links come from combinations alone."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = base.copy()
        for _ in range(i % 9):
            w[rng.integers(300)] = f"u{i}x{rng.integers(999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for work in ({"frequent_share": 0.0}, {"frequent_share": 0.0, "combine_from": 1}, {"frequent_share": 1.0}):
        assert counted(ngram_join.similar_groups(df, **work).collect()) == counted(brute_components(rows))


def test_query_combines_frequent_tokens(spark):
    """With the query's own parameters the given table has frequent tokens, and they are only indexed in combinations."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    held = Counter(g for _, t in rows for g in shingles(t, 4))
    frequent = max(1, int(max(2, ngram_join.FREQUENT_SHARE * len(rows))).bit_length() - 1)
    assert sum(n >= 2 ** frequent for n in held.values()) > 100
    tokens = np.arange(1, 200, dtype=np.uint64)
    places = ngram_join.signatures(tokens, np.ones(199, bool), np.full(199, frequent), 85, frequent)
    single = ngram_join.signatures(tokens, np.ones(199, bool), np.full(199, frequent - 1), 85, frequent)
    assert len(places[0]) and not len(np.intersect1d(places[0], single[0]))
    assert counted(ngram_join.similar_groups(docs).collect()) == counted(brute_components(rows))


def test_one_id_with_several_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of its own"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None), (4, "")]
    kept = ngram_join.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted(kept) == counted([rows[0], rows[2], rows[5], rows[6], rows[7]])


def test_prefixes_share_a_signature():
    """Any two similar sets share a signature, whatever the frequencies are."""
    rng = np.random.default_rng(2)
    for n in (5, 7, 20, 70, 130, 600):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2 ** 64, n, np.uint64))
            drop = rng.integers(0, max(1, int(0.08 * n)) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2 ** 64, drop, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            frequency = dict(zip(np.union1d(a, b).tolist(), rng.integers(1, 14, 2 * n).tolist()))
            found = []
            for s in (a, b):
                found.append(ngram_join.signatures(s, np.ones(len(s), bool), np.array([frequency[x] for x in s.tolist()]), 85, 7)[0])
            assert len(np.intersect1d(*found))


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (202, 201), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(31), 100]) and got[200] == got[201] == got[202] == 200


# Empty tables

def test_empty(spark, empty):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (line_dedup.apply(empty), classifier.score_quality(empty, labels), warc.round_trip(none), mixing.mix_sources(empty), mixing.apply(empty),
                suffix_dedup.remove_repeats(empty), ppm.score_texts(empty), quality_rules.judge(empty), quality_rules.apply(empty), token_output.round_trip(empty),
                decontaminate.find_items(empty, empty.withColumnRenamed("doc_id", "item_id")), ngram_join.similar_groups(empty), ngram_join.apply(empty)):
        assert out.count() == 0
