"""Operators against brute force on small fixtures with nulls, empty and long texts, copies, and clashing columns."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from leafgrove.llm import _components, _shared, bpe_codec, curve_packing, embedding_dedup, host_quality, line_dedup, ngram_join, suffix_tree_lm, token_counts, toxicity, url_reputation  # noqa: E402
from leafgrove.llm._components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to river stone amber falcon meadow lantern copper willow harbor thunder velvet marble ember saffron cobalt juniper".split()


def texts():
    """Fixture: copies, near copies, repeated lines, odd characters, nulls, empties, one long text."""
    r = random.Random(7)
    own = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(5, 120))) for _ in range(30)]
    own = ["\n".join(" ".join(t.split()[k : k + 12]) for k in range(0, len(t.split()), 12)) for t in own]
    near = [own[0] + " extra", own[1].replace("the", "a", 1), own[0], own[2].upper(), own[2] + "\n" + own[3]]
    odd = [None, "", " \n\t ", "x", "It's 'RE <|endoftext|> a\x1cb ΑΣ ς É é", "a<|EndOfText|>b 日本 🎉", "word " * 9000, "x" * 5000, own[4].replace(" ", "\x0b"), "same line here today\nsame line here today"]
    return own + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # names that an operator makes itself
    return df.withColumns({c: F.lit("clash") for c in ("id", "n", "score", "kept", "component_id", "row", "host", "token", "size")})


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def test_token_counts(docs, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    assert got == {k: (len((t or "").encode()), len(library[0](t))) for k, t in enumerate(texts())}


def test_codec_round_trip(docs, library):
    for r in bpe_codec.encode_decode(docs).collect():
        ids = library[0](texts()[r.doc_id])
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), " ".join(map(str, ids)), library[1](ids))
    for r in bpe_codec.digests(docs).collect():
        ids = library[0](texts()[r.doc_id])
        assert (r.ids_sha256, r.decoded_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library[1](ids)))


def check_pieces(rows, want):
    """Each id of each document once and in order; sequences gapless, of 2048 ids or a power of two."""
    found, sequences = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(found) == set(want)
    for doc, pieces in found.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            ids = np.array(want[doc][p.start : p.start + p.length], "<u4")
            assert p.start == at and p.doc_tokens == len(want[doc]) and zlib.crc32(ids.tobytes()) == zlib.crc32(bytes(p.ids))
            at += p.length
        assert at == len(want[doc])
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(docs, library):
    check_pieces(curve_packing.pack(docs).collect(), {k: [*library[0](t), 1] for k, t in enumerate(texts())})


def test_a_full_memory_keeps_the_chunks_at_hand(library, monkeypatch):
    """Chunks that all texts have are parted once, whatever else comes and goes; words of ASCII letters get the library's ids."""
    monkeypatch.setattr(curve_packing, "MEMORY", 100)
    encoder, parted = curve_packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    parts = encoder.bpe.parts
    monkeypatch.setattr(encoder.bpe, "parts", lambda chunk: parted.append(chunk) or parts(chunk))
    common = [f"{w},{k}" for k, w in enumerate(WORDS)]
    for k in range(20):
        own = [*common, *(f"{w}{chr(97 + k)}{w[::-1]}" for w in WORDS), f"It's É{k} <|endoftext|> ΑΣ don't", *(f"x{k}.{j}" for j in range(20))]
        assert np.frombuffer(encoder.encode([" ".join(own)])[0], "<u2").tolist() == library[0](" ".join(own))
        assert len(encoder.known) < 200
    assert all(parted.count(c) == 1 for c in common)


def test_keys_wake_no_threads():
    """The linear algebra library's threads wait busily once they have been called."""

    class Single(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *args, **more):
            assert ufunc is not np.matmul
            return getattr(ufunc, method)(*(np.asarray(x) for x in args), **more)

    curve = curve_packing.Curve(50)
    documents = [np.array([1, 2, 2, 7], "<u2"), np.array([1], "<u2"), np.empty(0, "<u2")]
    want = curve.keys(documents)
    curve.project = curve.project.view(Single)
    assert (curve.keys(documents) == want).all() and len(set(want)) > 1


def test_hilbert_curve_visits_neighbours():
    bits, curve_packing.BITS = curve_packing.BITS, 3
    try:
        cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
        order = cells[np.argsort(curve_packing.hilbert(cells))]
    finally:
        curve_packing.BITS = bits
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_quality_counts(docs):
    got = {r.doc_id: r for r in host_quality.quality(docs).collect()}
    for k, t in enumerate(texts()):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_bad_host_goes(spark):
    good, junk = " ".join(f"w{k}" for k in range(40)), "# " * 300 + " ".join(f"v{k}" for k in range(40))
    rows = [(k, f"{junk} u{k}", None, "bad", 0) for k in range(60)] + [(100 + k, f"{good} u{k}", None, f"good{k % 20}", 0) for k in range(400)] + [(999, good, None, "bad", 0)]
    kept = {r.doc_id for r in host_quality.keep_good(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {100 + k for k in range(400)}


def brute_groups(docs, n, per_cent):
    sets = {}
    for k, t in docs.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]) and sets[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize(("n", "per_cent"), [(4, 85), (5, 80)])
def test_ngram_groups(docs, n, per_cent):
    got = {r.doc_id: (r.n_shingles, r["component_id"]) for r in ngram_join.groups(docs, n=n, per_cent=per_cent).collect()}
    assert got == brute_groups(dict(enumerate(texts())), n, per_cent)


def test_chains_of_links_are_one_group(spark):
    """Each text links with the next only: the ends are unlike."""
    base = [f"w{k}" for k in range(200)]
    own = [" ".join(base[4 * k :] + [f"x{k}_{j}" for j in range(4 * k)]) for k in range(12)]
    got = {r.doc_id: r.component_id for r in ngram_join.groups(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    assert got == {k: c for k, (_, c) in brute_groups(dict(enumerate(own)), 4, 85).items()}


def joined_rows(spark, since):
    """Rows that each join made in the executions after that of a number, most first; the number of the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, made, last = spark._jsparkSession.sharedState().statusStore(), [0], since
    executions = store.executionsList()
    for k in range(executions.size()):
        last = max(last, number := executions.apply(k).executionId())
        if number > since:
            values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
            for node in map(nodes.apply, range(nodes.size())):
                for m in map(node.metrics().apply, range(node.metrics().size())) if "Join" in node.name() else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return sorted(made, reverse=True), last


def test_near_copies_that_do_not_link_seldom_meet(spark):
    """Copies of a text with edits of their own are similar to it, seldom to each other: no join grows with their square, no link is lost."""
    r, own = random.Random(23), []
    for f in range(2):
        base = [f"b{f}_{k}" for k in range(150)]
        for k in range(180):
            words = list(base)
            for at in r.sample(range(3, 147), r.choice((2, 3, 3, 4))):
                words[at] = f"e{f}_{k}_{at}"
            own.append(" ".join(words))
        own += [own[-j].replace(f"b{f}_{j}", f"c{f}_{j}") for j in range(1, 40, 3)]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    _, last = joined_rows(spark, -1)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.groups(df).collect()}
    assert got == brute_groups(dict(enumerate(own)), 4, 85)
    made, _ = joined_rows(spark, last)
    assert made[0] and made[0] < 60 * len(own), made[:5]


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (5, "")]
    got = sorted(r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [1, 2, 5]


def brute_lines(own):
    gone, seen = set(), []
    for k in sorted(own):
        for i, line in enumerate((own[k] or "").split("\n")):
            w = {x for x in re.split("[\x20\x09-\x0d]+", line.lower()) if x}
            if w:
                if any(10 * len(w & v) >= 8 * len(w | v) for v in seen):
                    gone.add((k, i))
                seen.append(w)
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in own.items()}


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(dict(enumerate(texts())))


def test_embedding_links(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((120, 16)).astype(np.float32)
    x[1:6] = x[0] + 0.05 * r.standard_normal((5, 16)).astype(np.float32)
    x[10], x[11] = x[12], 2 * x[13]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, [1.0] * 3)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    label = np.arange(len(u))
    while True:
        new = np.minimum(label, np.where(linked, label[None], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    want = {k: (int(linked[k].sum()), int(label[k]), bool(label[k] == k)) for k in range(len(u))} | {k: (0, k, True) for k in range(200, 205)}
    assert got == want


def test_cells_lose_no_link(spark, monkeypatch):
    """Many small cells and blocks give what one cell gives."""
    r = np.random.default_rng(4)
    centers = r.standard_normal((40, 8))
    x = np.concatenate([c + 0.25 * r.standard_normal((12, 8)) for c in centers]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "GROUP", 60)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 50)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == one
    assert any(n for _, n, _, _ in one)


def test_groups_of_cells_are_compared_in_parts(spark, monkeypatch):
    """No part writes many more vectors than there are, and all parts give what one gives."""
    r, written = np.random.default_rng(8), []
    centers = r.standard_normal((40, 8))
    x = np.concatenate([c + 0.25 * r.standard_normal((12, 8)) for c in centers]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    for name, value in (("CELL", 20), ("GROUP", 60), ("ROWS", 100)):
        monkeypatch.setattr(embedding_dedup, name, value)
    write = embedding_dedup.materialize

    def counted(table, name="cut", **options):
        out = write(table, name, **options)
        if name == "cells":
            written.append(out.count())
        return out

    monkeypatch.setattr(embedding_dedup, "materialize", counted)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == one
    assert len(written) > 1 and max(written) <= len(x) < sum(written)


def test_vectors_of_all_lengths_in_double_precision(spark):
    """Each length by itself against brute force; a cosine just below the threshold is none in double precision."""
    r = np.random.default_rng(14)
    rows, k = [], 0
    for width, n in ((6, 300), (3, 40), (9, 2), (1, 3)):
        for _ in range(n):
            x = rows[-1][1] if rows and len(rows[-1][1]) == width and r.random() < 0.5 else None
            rows.append((k, (r.standard_normal(width) if x is None else np.array(x) + 0.1 * r.standard_normal(width)).tolist()))
            k += 1
    below = 0.94999999997
    rows += [(k, [1.0, 0.0]), (k + 1, [below, math.sqrt(1 - below * below)]), (k + 2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "vector", "key", "rep", "home", "width", "n")})
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(df).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    links = {a: [b for b, y in rows if b != a and x and y and len(x) == len(y) and cos(x, y) >= 0.95] for a, x in rows}
    label = {a: a for a in links}
    for _ in rows:
        label = {a: min([label[a], *(label[b] for b in links[a])]) for a in links}
    assert got == {a: (len(links[a]), label[a]) for a in links}
    assert got[k] == (0, k) and any(n for n, _ in got.values())


@pytest.mark.parametrize("at_once", [0, 50, 200_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(_components, "AT_ONCE", at_once)
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    label = {x: x for e in links for x in e if None not in e and e[0] != e[1]}
    for _ in range(300):
        for a, b in links:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()} == label


def test_language_model_base_and_gain(spark):
    r = random.Random(6)
    own = [" ".join(r.choice(["red fish swims", "blue bird sings", "old tree stands"]) for _ in range(r.randrange(20, 60))) for _ in range(80)] + [None, "", "zzz unseen words", "Red FISH"]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    train = zlib.crc32
    got = {x.doc_id: x for x in suffix_tree_lm.score(df, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2).collect()}
    tokens = {k: [*[x.lower() for x in (t or "").split()], ""] for k, t in enumerate(own)}
    c = Counter(x for k, w in tokens.items() if train(str(k).encode()) % 7 != 2 for x in w)
    total, distinct = sum(c.values()), len(c)
    for k, w in tokens.items():
        x = got[k]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(y in c for y in w), total)
        assert x.base_score == pytest.approx(sum(math.log10((c[y] + 1) / (total + distinct + 1)) for y in w))
    held = [k for k in range(80) if train(str(k).encode()) % 7 == 2]
    assert all(got[k].score > 0.7 * got[k].base_score for k in held)


def test_contexts_grow_with_the_corpus(spark):
    """A pair that occurs twice among 600,000 tokens is a context's gain, and the tables give what the tree in memory gives."""
    r = random.Random(16)
    own = [" ".join(r.choice(["red fish swims", "blue bird sings", "old tree stands"]) for _ in range(1000)) for _ in range(200)]
    own += [" ".join(f"alpha{k} beta{k} gamma{k}" for k in range(40)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {x.doc_id: x for x in suffix_tree_lm.score(df, F.lit(True)).collect()}
    texts = [[*suffix_tree_lm.words(t), suffix_tree_lm.END] for t in own]
    counts = Counter(w for t in texts for w in t)
    order = sorted(counts, key=suffix_tree_lm.hashed)
    number = {w: k for k, w in enumerate(order)}
    tree = suffix_tree_lm.Tree(np.array([suffix_tree_lm.hashed(w) for w in order]), np.array([counts[w] for w in order]), sum(counts.values()), len(counts))
    ids = np.array([number[w] for t in texts for w in t])
    first = np.array([k == 0 for t in texts for k in range(len(t))])
    for _ in range(2):
        places = tree.places(ids, first)[-1]
        before = np.concatenate([[-1], places[:-1]])
        keys, n = np.unique((before << 20 | ids)[~first & (before >= 0) & (places >= 0)], return_counts=True)
        tree.grow(keys[n > 1], n[n > 1])
    want = np.add.reduceat(tree.scores(ids, first), np.flatnonzero(first))
    assert [got[k].score for k in range(len(own))] == pytest.approx(want.tolist())
    a, b, c = (number[w] for w in (b"alpha1", b"beta1", b"gamma1"))
    assert (a << 20 | b) in tree.keys[0] and (b << 20 | c) in tree.keys[0]


def test_language_model_by_parts(spark, monkeypatch):
    """Many parts and short sendings give the same scores, and no batch of texts with more than 500 rows goes to a worker."""
    r = random.Random(26)
    own = [" ".join(r.choice(["red fish swims", "blue bird sings", f"old tree{r.randrange(30)} stands"]) for _ in range(r.randrange(200))) for _ in range(120)] + [None, "", "unseen once"]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    run = lambda: {x.doc_id: x for x in suffix_tree_lm.score(df, F.col("doc_id") % 7 != 2).collect()}
    want, batches, write = run(), {}, suffix_tree_lm.materialize

    def written(table, name, **options):
        batches[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return write(table, name, **options)

    monkeypatch.setattr(suffix_tree_lm, "materialize", written)
    for name, value in {"FEW": 1, "CHUNK": 700, "HOT": 20}.items():
        monkeypatch.setattr(suffix_tree_lm, name, value, raising=False)
    got = run()
    assert {name for name in ("texts", "sequences", "hot_sums", "slice_sums") if batches[name] > 500} == set()
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k][1:4] == x[1:4] and got[k].base_score == pytest.approx(x.base_score) and got[k].score == pytest.approx(x.score)
    assert any(x.score > x.base_score + 1 for x in want.values())


def test_sequences_grow_without_joins_of_rows(spark, monkeypatch):
    """Sequences meet their suffixes and contexts as packed parts; only values as frequent as the last broadcast one are put in order."""
    r, plans, write = random.Random(27), {}, suffix_tree_lm.materialize
    own = [" ".join(r.choice(["red fish swims", "blue bird sings", f"old tree{r.randrange(30)} stands"]) for _ in range(40)) for _ in range(30)]

    def written(table, name, **options):
        plans.setdefault(name, []).append(table._jdf.queryExecution().optimizedPlan().toString())
        return write(table, name, **options)

    monkeypatch.setattr(suffix_tree_lm, "materialize", written)
    monkeypatch.setattr(suffix_tree_lm, "HOT", 5)
    suffix_tree_lm.score(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), F.lit(True)).collect()
    assert plans["level"] and not any(re.search(r"\bJoin\b", x) for x in plans["level"])
    assert len(plans["hot"]) == 1 and re.search(r"c#\d+L >= ([2-9]|\d\d)", plans["hot"][0])


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_tables_clear_a_grown_heap_of_the_driver(spark, monkeypatch, share):
    """Before a table is written, garbage of the driver is collected if its heap is beyond the share, and not below it."""
    monkeypatch.setattr(_shared, "HEAP", share, raising=False)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    with _shared.scratch():
        assert _shared.materialize(spark.range(3)).count() == 3
    assert (full() > before) == (share == 0)


def test_sequence_hashes_are_those_of_the_engine(spark):
    a, b = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, (2, 50))
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()
    assert [x.h for x in rows] == suffix_tree_lm.mixed(a, b).tolist()


def test_suffix_tree_is_a_distribution():
    """Over all words, known and unknown, probabilities after any context add up to one."""
    r = np.random.default_rng(8)
    ids = r.integers(0, 12, 4000)
    ids[1::2] = (ids[::2] * 5 + 1) % 12
    tree = suffix_tree_lm.Tree(np.arange(12), np.bincount(ids, minlength=12), len(ids), 12)
    first = np.zeros(len(ids), bool)
    first[0] = True
    for _ in range(2):
        places = tree.places(ids, first)[-1]
        before = np.concatenate([[-1], places[:-1]])
        keys, counts = np.unique((before << 20 | ids)[~first & (before >= 0) & (places >= 0)], return_counts=True)
        tree.grow(keys[counts > 1], counts[counts > 1])
    assert len(tree.keys) == 2 and (tree.root_back < 0).any()
    for a in range(12):
        for b in range(12):
            p = [10 ** tree.scores(np.array([a, b, w]), np.array([True, False, False]))[2] for w in range(12)]
            unseen = 10 ** (tree.scores(np.array([a, b, -1]), np.array([True, False, False]))[2] - tree.unit)
            assert sum(p) + unseen == pytest.approx(1, abs=1e-6)


def test_maximal_segments():
    """Against the definition: segments of greatest score, each left and right of it again."""

    def brute(x):
        best = max(((sum(x[a : b + 1]), -(b - a), -a, a, b) for a in range(len(x)) for b in range(a, len(x))), default=(0,))
        if best[0] <= 0:
            return []
        a, b = best[3:]
        return brute(x[:a]) + [(a, b, best[0])] + [(s + b + 1, e + b + 1, v) for s, e, v in brute(x[b + 1 :])]

    r = random.Random(9)
    for _ in range(200):
        x = [float(r.choice([-1, -1, -1, 2, 3.25])) + (0 if r.random() < 2 else 0) for _ in range(r.randrange(0, 25))]
        got = toxicity.segments([(i, v) for i, v in enumerate(x) if v > 0], -1.0)
        assert [(a, b, pytest.approx(v)) for a, b, v in brute(x)] == got


def test_segments_take_linear_time():
    """Separated hits on a falling sum: each is a segment of its own, and no search looks at all those before."""
    looked = {}
    for n in (4_000, 8_000):
        hits = [(20 * k, 1.0) for k in range(n)]
        began = time.process_time()
        assert len(toxicity.segments(hits, -0.5)) == n
        looked[n] = time.process_time() - began
    assert looked[8_000] < 4 * looked[4_000] + 0.05


def test_toxicity_of_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 0
    some = spark.createDataFrame([(1, "a b", 9.0, "x"), (1, "a b", 9.0, "x"), (None, None, None, None)], "doc_id long, text string, score double, _y string")
    assert [r.score for r in toxicity.score(some, model).collect()] == [model.score(model.features(0, []))] * 3
    assert toxicity.keep_clean(some, model).columns == some.columns


def test_hosts_without_labels_get_what_lies_above(spark):
    """A sibling without labels under a bad domain is blocked, one under a good domain is not; ports, addresses and two-label suffixes."""
    bad = [(k, f"https://h{k % 3}.bad.test/{k}") for k in range(60)] + [(100 + k, f"http://h{k % 3}.fine.co.uk/{k}") for k in range(60)] + [(200 + k, f"http://10.0.0.{k % 2}:80/{k}") for k in range(40)]
    pages = [*bad, (500, "https://new.bad.test/"), (501, "http://new.fine.co.uk:8080/x"), (502, "http://10.0.0.9/"), (503, None), (504, "no scheme"), (500, "https://new.bad.test/"), (505, "http://new.bad.test/" + "y" * 100_000)]
    outcomes = spark.createDataFrame([(k, int(k < 100)) for k, _ in bad], "page_id long, bad int")
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"host": F.lit("clash"), "n": F.lit(1)})
    got = {r.page_id: (r.host, r.verdict) for r in url_reputation.judge(df, outcomes).collect()}
    assert got[500] == ("new.bad.test", "block") and got[505][1] == "block"
    assert got[501] == ("new.fine.co.uk:8080", "allow") and got[502] == ("10.0.0.9", "allow") and got[503] == ("", "allow") == got[504]
    levels = spark.createDataFrame([("a.b.co.uk:80",), ("x.y.com",), ("10.0.0.1",), ("",)], "h string").select(*url_reputation.levels(F.col("h"))).collect()
    assert [tuple(r) for r in levels] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("10.0.0.1", "10.0.0.1"), ("", "")]


@pytest.mark.parametrize("hot", [1, 2_048])
def test_lines_of_null_ids_repeated_rows_and_clashing_columns(spark, monkeypatch, hot):
    """Null ids come first and lose lines like others; equal rows keep the same lines; keys of many lines are cut anew."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(12)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(r.randrange(4, 100))) for _ in range(12)]
    edit = lambda t: " ".join(w if r.random() > 0.06 else "new" + str(r.randrange(99)) for w in t.split())
    own = [(None, base[0] + "\n" + base[0] + "\n" + base[1])] + [(k, "\n".join(edit(r.choice(base)) for _ in range(r.randrange(1, 6)))) for k in range(60)]
    own += [(70, edit(base[0])), (71, "same words here\nhere same words"), (72, ""), (73, None)]
    rows = [*own, own[5], own[9]]
    names = ("_d", "_t", "_lines", "_gone", "doc", "at", "line", "gone", "row", "text2", "_salt")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    want = brute_lines({-1 if k is None else k: t for k, t in own})
    got = out.collect()
    assert len(got) == len(rows) and all(r.text == want[-1 if r.doc_id is None else r.doc_id] and r["_d"] == r.gone == "clash" for r in got)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_near_copies_of_lines_meet_in_proportion(spark, monkeypatch):
    """Near copies of lines that have common words beside their own: pairs to verify grow with their number, not its square."""
    r, asked = random.Random(21), []
    common = [f"c{k}" for k in range(40)]
    lines = [" ".join(r.sample(common, 30) + [f"u{k}_{j}" for j in range(20)]) for k in range(100)]
    for k in range(6):
        base = r.sample(common, 30) + [f"t{k}_{j}" for j in range(30)]
        lines += [" ".join(w if x not in (j % 60, j * 7 % 60) else f"e{k}_{j}_{x}" for x, w in enumerate(base)) for j in range(200)]
    later = line_dedup.Verifier.later
    monkeypatch.setattr(line_dedup.Verifier, "later", lambda self, pairs: asked.append(pairs.count()) or later(self, pairs))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == brute_lines(dict(enumerate(lines)))
    assert sum(asked) < 5 * len(lines), asked


def test_lines_with_a_passage_in_common_seldom_meet(spark, monkeypatch):
    """Lines of one passage and own words, of a similarity of 0.75: few pairs are left to verify, whatever their number."""
    r, asked = random.Random(22), []
    passage = [f"p{k}" for k in range(47)]
    lines = [" ".join(passage + [f"o{k}_{j}" for j in range(8)]) for k in range(160)]
    lines += [" ".join(passage + lines[k].split()[47:52] + [f"e{k}_{j}" for j in range(3)]) for k in range(0, 160, 8)]
    r.shuffle(lines)
    later = line_dedup.Verifier.later
    monkeypatch.setattr(line_dedup.Verifier, "later", lambda self, pairs: asked.append(pairs.count()) or later(self, pairs))
    df = spark.createDataFrame([(k, "\n".join(lines[k::90])) for k in range(90)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == brute_lines({k: "\n".join(lines[k::90]) for k in range(90)})
    assert sum(asked) < 15 * len(lines), asked


def test_counts_of_one_slice_are_on_disk_at_a_time(docs, monkeypatch):
    """Counted sequences go once the level that is made of them is written; what is shorter goes with its size."""
    held, materialize, out = [], suffix_tree_lm.materialize, []

    def seen(df, name="cut", **more):
        own = materialize(df, name, **more)
        held.append((name, own.inputFiles()))
        there = [n for n, files in held if any(os.path.exists(f.removeprefix("file://")) for f in files)]
        out.append((there.count("sequences"), there.count("shorter")))
        return own

    monkeypatch.setattr(suffix_tree_lm, "materialize", seen)
    assert suffix_tree_lm.score(docs, F.lit(True)).count() == docs.count()
    assert max(x for x, _ in out) == max(x for _, x in out) == 1


def test_found_lines_are_not_looked_up_for_each_word(spark, monkeypatch):
    """Whether a line still asks is known before its prefix is cut into postings: no join of postings leaves lines out."""
    plans, materialize = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name="cut", *a, **b: plans.append((name, df._jdf.queryExecution().analyzed().toString())) or materialize(df, name, *a, **b))
    r = random.Random(23)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(30)]
    lines = [*base, *(" ".join(["new", *t.split()[1:]]) for t in base), *(" ".join(t.split()[3:]) for t in base)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == brute_lines(dict(enumerate(lines)))
    joins = [plan for name, plan in plans if name == "pairs" and "band" in plan]
    assert len(joins) >= line_dedup.SLICES and not any("LeftAnti" in plan for plan in joins)


def test_groups_of_null_ids_repeated_rows_and_clashing_columns(spark):
    own = {k: t for k, t in enumerate(texts()) if t}
    rows = [*own.items(), (None, own[0]), (3, own[3])]
    names = ("_goes", "goes", "row", "key", "rep", "own", "prefix", "_salt")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df).collect()}
    want = brute_groups(own, 4, 85)
    assert found == want | {None: (want[0][0], None)}
    kept = ngram_join.keep_one(df, n=4, per_cent=85)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(k for k, (_, c) in want.items() if c == k)
    assert kept.where("doc_id is null").count() == 1 and ngram_join.groups(df.limit(0)).count() == 0


def test_groups_send_small_batches_to_workers(spark, monkeypatch):
    """Every table of the join is written with small batches; the setting is as before at the end."""
    rows, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, write = spark.conf.get(key, None), ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, *a, **more: rows.append(int(spark.conf.get(key, "10000"))) or write(df, *a, **more))
    own = {k: t for k, t in enumerate(texts()) if t}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df).collect()} == brute_groups(own, 4, 85)
    assert rows and max(rows) <= 1000 and spark.conf.get(key, None) == before


def test_extreme_values_count_texts_without_a_segment():
    """Best scores drawn with a known K and lambda, those not above 0 seen as 0."""
    r = np.random.default_rng(17)
    n = r.integers(50, 400, 20_000)
    best = np.maximum(np.log(0.004 * n / -np.log(r.random(len(n)))) / 0.8, 0.0)
    assert 0.2 < (best == 0).mean() < 0.8
    assert toxicity.extreme_value(best, n) == (pytest.approx(0.004, rel=0.05), pytest.approx(0.8, rel=0.05))


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(10)
    bad = ["scoundrel", "vermin", "filth"]
    rows, labels = [], []
    for k in range(400):
        w = [r.choice(WORDS) + str(r.randrange(60)) for _ in range(r.randrange(20, 200))]
        toxic = k % 5 == 0
        for _ in range(4 * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels[:300], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    assert sum((got[k].score >= 0.5) == (k % 5 == 0) for k in range(300, 400)) >= 97
    assert got[900].score == got[901].score < 0.5 and not got[901].passages
    hit = next(x for x in got.values() if x.passages)
    assert any(w in bad for p in hit.passages for w in rows[hit.doc_id][1].split()[p.first_word : p.last_word + 1])
    assert {x.doc_id for x in toxicity.keep_clean(df, model).collect()} == {k for k, x in got.items() if x.score < 0.5}
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.score < 0.5 for x in toxicity.score(df, none).collect())


def test_url_rules_and_reputation(spark):
    urls = [(1, "http://A.Example.com/en/77?x"), (2, "https://x.net/en/1"), (3, None), (4, "no scheme"), (5, "http://sub.example.net/de/89#t"), (6, "http://y.net/de/1"), (7, "x://h?q://z/en/"), (8, "http://notcom/en/")]
    many = [(100 + k, f"http://evil.test/{k}") for k in range(80)] + [(300 + k, f"http://fine{k % 9}.test/{k}") for k in range(200)]
    outcomes = [(100 + k, 1) for k in range(60)] + [(300 + k, int(k % 20 == 0)) for k in range(200)]
    pages = spark.createDataFrame([*urls, *many], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_reputation.judge(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(1, 9)] == [
        ("a.example.com", "/en/77", "example.com/en/7", "allow"), ("x.net", "/en/1", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("sub.example.net", "/de/89", "example.net/de/8", "block"), ("y.net", "/de/1", "net/de/", "allow"), ("h", "", None, "allow"), ("notcom", "/en/", None, "allow"),
    ]
    assert all(got[100 + k].verdict == "block" for k in range(80)) and all(got[300 + k].verdict == "allow" for k in range(200))


def test_hosts_without_labels_fall_back(spark):
    """To the domain, then to the suffix, then to all pages."""
    urls = [f"http://a{k}.evil.test/{p}" for k in range(20) for p in range(10)] + [f"http://b{k}.fine{k % 9}.org/{p}" for k in range(40) for p in range(10)]
    new = {"http://new.evil.test/": "block", "http://new.fine1.org/": "allow", "http://new.other.test/": "block", "http://new.other.org/": "allow", "http://new.else/": "allow"}
    pages = spark.createDataFrame(list(enumerate([*urls, *new])), "page_id long, url string")
    outcomes = spark.createDataFrame([(k, int(".evil." in x)) for k, x in enumerate(urls)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_reputation.judge(pages, outcomes, rules=[]).collect()}
    assert {x: got[len(urls) + k] for k, x in enumerate(new)} == new


@pytest.mark.parametrize("run", [
    token_counts.count_tokens, bpe_codec.digests, curve_packing.pack, host_quality.quality, ngram_join.groups, line_dedup.dedup_lines,
    lambda df: suffix_tree_lm.score(df, F.lit(True)),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_vectors_and_pages(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert url_reputation.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
