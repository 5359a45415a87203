"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltbed.llm import components, cover_tree, dart_minhash, flac, mixing, ngrams, optimize, packing, quality, sharding, toxicity, url_filter, warc
from siltbed.llm.batches import shingle_hashes, word_hashes
from siltbed.llm.queries import RULES, byte_vocabulary, oracle_sql, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


# 1 --------------------------------------------------------------------------------------------


def glob_regex(glob):
    return re.compile("(?s:" + "".join(".*" if t == "**" else "[^/]*" if t == "*" else re.escape(t) for t in re.findall(r"\*\*|\*|[^*]+", glob)) + r")\Z")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/.*", min_size=1, max_size=40), min_size=1, max_size=12), st.lists(st.text("ab/.", max_size=30), max_size=20))
def test_automaton_against_regexes(globs, texts):
    expected = [next((i for i, g in enumerate(globs) if glob_regex(g).match(t)), -1) for t in texts]
    assert url_filter.ShiftAnd(globs).match([t.encode() for t in texts]).tolist() == expected


def test_rules_of_many_words():
    rules = [url_filter.Rule("block", f"host{i}.example.com", f"/p{i}/") for i in range(200)]
    globs = [g for r in rules for g in r.globs()]
    automaton = url_filter.ShiftAnd(globs)
    assert automaton.words > 50
    assert automaton.match([f".www.host{i}.example.com/p{i}/x".encode() for i in range(200)]).tolist() == list(range(200))


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_sql(spark, name):
    from test_entry import compare

    compare(spark, name, queries()[name], oracle_sql()[name])


# 2 --------------------------------------------------------------------------------------------


def poured(counts, ring, capacity):
    placed = collections.defaultdict(list)
    for cell, lo, hi, shard, slot in ring.pour(np.array(counts), capacity):
        placed[cell].append((lo, hi))
        placed["slots", shard].append((slot, slot + hi - lo))
    return placed


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 9), st.integers(0, 99))
def test_ring_fills_every_shard_gaplessly(rows, shards, seed):
    ring = sharding.Ring(shards, 8, 256)
    counts = np.bincount(np.random.default_rng(seed).integers(0, 256, rows), minlength=256)
    capacity = sharding.even_capacity(rows, shards)
    placed = poured(counts, ring, capacity)
    for s in range(shards):
        ends = 0
        for a, b in sorted(placed["slots", s]):
            assert a == ends
            ends = b
        assert ends == capacity[s]
    for c in range(256):
        assert sum(b - a for a, b in placed[c]) == counts[c]


def test_rows_stay_on_their_arc_while_it_has_room():
    ring = sharding.Ring(4, 16, 1024)
    where, shard = ring.nodes()
    counts = np.ones(1024, int)
    for cell, _, _, s, _ in ring.pour(counts, sharding.loose_capacity(1024, 4, 100.0)):
        assert s == shard[np.searchsorted(where, cell) % len(where)]
    more = sharding.Ring(5, 16, 1024).nodes()
    kept = dict(zip(*map(list, ring.nodes()), strict=True))
    moved = sum(kept.get(c) != s for c, s in zip(*more, strict=True) if s < 4)
    assert moved <= 2  # growing adds nodes


def test_hot_key_is_placed_in_parts(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text")).repartition(6)
    rows = sharding.shard_documents(df, hot_rows=100).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 16 and all(sorted(v) == list(range(250)) for v in by.values())
    assert rows[0]["text_crc32"] == zlib.crc32(b"t") and rows[0]["size"] == 2


# 3 --------------------------------------------------------------------------------------------


def brute_links(x, labels, ids, cosine=0.98):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (u @ u.T >= cosine) & (labels[:, None] == labels[None])
    np.fill_diagonal(hit, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(hit, comp[None], np.iinfo(np.int64).max).min(axis=1))
        if (new == comp).all():
            return hit.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_near_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(60, 16))
    x = (base[rng.integers(0, 60, 500)] + rng.normal(0, 0.06, (500, 16))).astype(np.float32)
    x[400:] = x[rng.integers(0, 400, 100)]
    labels, ids = rng.integers(0, 3, 500), rng.permutation(500).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist(), int(lb)) for i, v, lb in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<float>, label int")
    links, comp = brute_links(x.astype(float), labels, ids)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(df, block=block).collect()}
    assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, links, comp, strict=True)} and links.sum() > 100


def test_many_more_vectors_than_pivots(spark, monkeypatch):
    """Cells are split again and again: 4,000 vectors in blocks of 8, four pivots at a time, near copies in a large group, one direction at many lengths."""
    monkeypatch.setattr(cover_tree, "FAN", 4)
    monkeypatch.setattr(cover_tree, "SAMPLE", 64)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 6))
    x[1500:2500] = x[7] + rng.normal(0, 0.01, (1000, 6))
    x[2500:2600] = x[8] * rng.uniform(0.5, 2, (100, 1))
    labels, ids = np.where(np.arange(4000) % 5 == 0, 2, 1), np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), int(lb)) for i, v, lb in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int")
    links, comp = brute_links(x, labels, ids)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(df, block=8).collect()}
    assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, links, comp, strict=True)}


def test_links_of_repeated_ids_and_ties(spark):
    """Rows that repeat a vec_id under another label are vectors of their own; a cosine of exactly the threshold links."""
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (1, [0.0, 1.0], 2), (3, [5.0, 1.0], 2), (4, [3.0, 4.0], 3), (5, [1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    exact = float(cover_tree.unit(np.array([[3.0, 4.0]]))[0] @ np.array([1.0, 0.0]))
    got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_vectors(df.filter("label = 3"), exact).collect()}
    assert got == {4: 1, 5: 1}


def test_cover_tree_levels():
    x = cover_tree.unit(np.random.default_rng(0).normal(size=(300, 3)))
    todo = [cover_tree.build(x, 0.01, 4)]
    assert sorted(todo[0].points) == list(range(300))
    while todo:
        node = todo.pop()
        assert cover_tree.chord(x[[node.center]], x[node.points]).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points) and node.children[0].center == node.center
        todo += node.children


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4 --------------------------------------------------------------------------------------------

WORD = re.compile("[0-9_a-z\u0080-\U0010ffff]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return collections.Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_words_and_shingles_by_hand():
    texts = ["A b, c. D e f", "a B c", None, "", "éa éa", "x_1 2"]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [6, 3, 0, 0, 2, 2] and (hashes[:3] == hashes[6:9]).all() and hashes[9] == hashes[10]
    assert shingle_hashes(hashes, counts)[1].tolist() == [2, 1, 0, 0, 1, 1]
    long = " ".join(f"w{i}" for i in range(500_000))
    assert word_hashes([long])[1][0] == 500_000 and len(np.unique(word_hashes([long])[0])) == 500_000


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.5, 0.8, 0.95):
        a = [words[i] for i in rng.integers(0, 5000, 2000)]
        b = list(a)
        for i in rng.choice(2000, int(2000 * (1 - share) / 7), replace=False):
            b[i] = "new" + str(i)
        true = jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
        element, counts = dart_minhash.units([" ".join(a), " ".join(b)])
        assert dart_minhash.similarity(*(np.sort(u) for u in np.split(element, [counts[0]]))) == pytest.approx(true)
        sign = dart_minhash.signatures(element, counts, 2000)
        assert (sign[0] == sign[1]).mean() == pytest.approx(true, abs=0.05)


def test_signature_does_not_depend_on_its_batch():
    texts = ["one", "a b c d e f g h i", " ".join(map(str, range(3000)))]
    together = dart_minhash.signatures(*dart_minhash.units(texts))
    for i, t in enumerate(texts):
        assert (dart_minhash.signatures(*dart_minhash.units([t]))[0] == together[i]).all()


def near_corpus(seed=3):
    """A group of near copies around one text, a chain, exact copies and texts that share passages."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 100_000))
    base = [word() for _ in range(140)]
    texts = [" ".join(base)]
    for k in range(150):
        t = list(base)
        for i in rng.choice(140, rng.integers(1, 9), replace=False):
            t[i] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain = chain[:]
        for i in (3 + 16 * k, 9 + 16 * k):
            chain[i % 200] = word()
        texts.append(" ".join(chain))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(40)]) for _ in range(60)]
    texts += ["same old text here again now"] * 30 + ["line one two three four\n" * 3, "line one two three four\n" * 9, "hi", "HI!", "ho"]
    order = rng.permutation(len(texts))
    return [texts[i] for i in order]


def test_near_duplicates_against_brute_force(spark):
    texts = near_corpus()
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert len(set(got.values())) < len(texts) - 100


def test_every_banded_pair_is_judged(spark):
    """Thousands of pairs at 0.82, each alone in its buckets; sketches often agree in an earlier band by chance."""
    rng, rows = np.random.default_rng(7), []
    k, pairs = dart_minhash.BANDS * dart_minhash.ROWS, 4000
    sign = rng.integers(0, 2**64, (pairs, 2, k), np.uint64, endpoint=False)
    sign[:, 1] = np.where(rng.random((pairs, k)) < 0.82, sign[:, 0], sign[:, 1])
    keys = np.stack([dart_minhash.band_keys(s) for s in sign])
    sketch = (sign & np.uint64(255)).astype(np.uint8)
    element = np.sort(rng.integers(0, 2**63, (pairs, 11), np.uint64), axis=1)
    banded = [p for p in range(pairs) if (keys[p, 0] == keys[p, 1]).any() and dart_minhash._agree(*sketch[p]) >= 0.65]
    texts = [(2 * p + w, element[p, w : w + 10].astype("<u8").tobytes()) for p in banded for w in (0, 1)]
    for p in banded:
        for band in np.flatnonzero(keys[p, 0] == keys[p, 1]).tolist():
            rows += [(int(keys[p, w, band]), band, 2 * p + w, 2 * p + w, keys[p, w].tolist(), sketch[p, w].tobytes(), 10) for w in (0, 1)]
    members = spark.createDataFrame(rows, "bucket long, band int, node long, component long, bands array<long>, sketch binary, units long")
    elements = spark.createDataFrame(texts, "node long, elements binary")
    got = sorted((r["u"], r["v"]) for r in dart_minhash._cross_links(dart_minhash._blocks(members), elements, 0.65, 0.8).collect())
    assert got == [(2 * p, 2 * p + 1) for p in banded] and len(banded) > pairs * 0.99


def test_blocks_of_one_component_never_meet(spark, monkeypatch):
    """Of a bucket with a large component and a stranger, rows are copied for the stranger alone; all pairs of components meet."""
    monkeypatch.setattr(dart_minhash, "BLOCK", 8)
    comps = [1] * 400 + [2] * 30 + [1000 + i // 2 for i in range(37)]
    rows = [(5, i, c, 1) for i, c in enumerate(comps)] + [(6, 900 + i, 7, 1) for i in range(20)]
    got = dart_minhash._blocks(spark.createDataFrame(rows, "bucket long, node long, component long, units long")).collect()
    assert {r["bucket"] for r in got} == {5} and max(collections.Counter(r["block"] for r in got).values()) < 40
    met = {r["node"]: {b for b in range(r["blocks"]) if r["own"] is None or not r["own"] <= b < r["end"]} for r in got}
    block = {r["node"]: r["block"] for r in got}
    for a in range(len(comps)):
        for b in range(a):
            assert (block[b] in met[a] and block[a] in met[b]) or comps[a] == comps[b]
    assert not any(block[b] in met[a] for a in range(400) for b in range(400))


def test_ids_with_several_texts_lose_none(spark):
    a, b, c, d, e = (" ".join(f"{p}{i}" for i in range(60)) for p in "abcde")
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "x"), (7, c, "x"), (7, d, "y"), (7, d, "x"), (9, d.upper(), "x"), (None, a, "x"), (8, None, "x"), (8, "", "x"), (10, e, "z"), (10, e, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    classes = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in dart_minhash.near_duplicates(df).collect())
    assert classes == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (7, 7, True), (9, 7, False), (8, 8, True), (8, 8, True), (10, 10, True)])
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in dart_minhash.drop_near_duplicates(df).collect()))
    assert kept == sorted([(1, a), (5, b), (7, c), (7, d), (0, a), (8, ""), (8, ""), (10, e)])
    one, two = ({tuple(r) for r in dart_minhash.drop_near_duplicates(df.repartition(n)).collect()} for n in (1, 6))
    assert one == two


def test_similarity_of_exactly_the_threshold_is_a_link(spark):
    words = [f"w{i}" for i in range(94)]
    a, b = " ".join(words[:-9]), " ".join(words[9:])  # 81 shingles each, 72 shared
    assert jaccard(shingles(a), shingles(b)) == 72 / 90 == 0.8
    df = spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1)], "u long, v long")
    for least, n in ((0.8, 1), (0.8001, 0)):
        kinds = spark.createDataFrame([(0, 1, 2, 0), (1, 1, 1, 0)], "node long, n long, doc_id long, text_hash long").drop("text_hash")
        kinds = kinds.join(df.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id").select("node", "n", F.struct("doc_id", "text_hash").alias("rep"))
        assert dart_minhash._verify(pairs, kinds, df, least, 5).count() == n


# 5 --------------------------------------------------------------------------------------------


def filled(sizes, weights, cap):
    """Targets by clamping the source with the least clamp per weight first, one at a time."""
    left, targets, todo = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while todo:
        i = min(todo, key=lambda i: (cap * sizes[i] / weights[i], i))
        weight = sum(weights[j] for j in todo)
        if cap * sizes[i] * weight >= left * weights[i]:
            return [left * weights[j] / weight if j in todo else t for j, t in enumerate(targets)]
        targets[i] = float(cap * sizes[i])
        left -= cap * sizes[i]
        todo.remove(i)
    return targets


def test_water_fill(spark):
    rng = np.random.default_rng(2)
    cases = [([10, 10, 10], 3), ([1, 100, 99], 3), ([0, 0], 3), ([7], 1)] + [([int(v) for v in rng.integers(0, 10 ** int(rng.integers(1, 6)), int(rng.integers(1, 30)))], int(rng.integers(1, 5))) for _ in range(6)]
    for sizes, cap in cases:
        weights = [i % 3 + 1 for i in range(len(sizes))]
        rows = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "i int, words long, weight long")
        got = [r["target"] for r in mixing.water_fill(rows, cap).orderBy("i").collect()]
        assert got == pytest.approx(filled(sizes, weights, cap)) and sum(got) == pytest.approx(sum(sizes))
        assert all(t <= cap * s + 1e-9 for t, s in zip(got, sizes, strict=True))


@pytest.mark.parametrize("whole", [False, True])
def test_mix_takes_its_targets(spark, whole):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", None, "z", "hot"][min(4, int(rng.integers(0, 12)))]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mixing.mix_documents(df, whole=whole)
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n")).collect():
        assert abs(r["taken"] - r["target"]) <= (60 if whole else 1) and r["target"] <= 3 * r["n"]
    assert out.filter(F.col("taken") > 3 * F.col("size")).count() == 0
    if whole:
        assert out.filter("size > 0 and taken % size <> 0").count() == 0
    again = mixing.mix_documents(df.repartition(3), whole=whole)
    assert out.exceptAll(again).count() == 0


def test_many_sources_and_ties_mix_alike(spark, monkeypatch):
    """Plans that are joined by shuffle, cells of few rows and equal rows give what one sorted list gives."""
    rows = [(i % 50, " ".join(["w"] * (i % 7)), f"s{i % 9}" if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plain = sorted(map(tuple, mixing.mix_documents(df).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_documents(df).collect()), key=str) == plain
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    for r in mixing.mix_documents(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == round(r["target"])


def test_words_are_counted_as_defined(spark):
    texts = [" a\tb\nc ", "a b c", "\x0b\x0c", "", None, "é è"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# 6 --------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><script>var x = "<p>no</p>";</script><style>p{}</style></head>
<body><!-- <p>gone</p> --><h1>Head</h1><p>One <b>two</b>
three &lt;four&gt;</p><a href="/x?a=1&amp;b=2">link</a><img src='i.png'><br>last < 5"""


def test_derivatives_are_linked():
    source = warc.response("http://a.example/", PAGE, "2024-01-01T00:00:00Z", 1)
    headers, made = warc.derive(source)
    meta, text = made
    assert [d.kind for d in made] == ["metadata", "conversion"]
    assert text.block.decode() == "A & B\nHead\nOne two three <four>\nlink\nlast < 5"
    for d in made:
        got, block, end = warc.parse(d.record)
        assert warc.first(got, "WARC-Refers-To") == warc.first(headers, "WARC-Record-ID") and warc.first(got, "WARC-Target-URI") == "http://a.example/"
        assert warc.first(got, "WARC-Block-Digest") == warc.digest(block) and end == len(d.record)
    import json

    body = json.loads(meta.block)
    assert body["warc"] == [list(h) for h in headers]
    assert body["html"] == {"title": "A & B", "links": [{"path": "a@href", "url": "/x?a=1&b=2"}, {"path": "img@src", "url": "i.png"}]}
    assert body["payload"]["digest"] == warc.digest(PAGE.encode()) == warc.first(headers, "WARC-Payload-Digest") and body["conversion"] == warc.first(text.headers, "WARC-Record-ID")
    records = [source, *(d.record for d in made)]
    for data in (b"".join(records), warc.write_archive(records)):
        assert [warc.first(h, "WARC-Type") for h, _ in warc.read_archive(data)] == ["response", "metadata", "conversion"]


def test_repeated_headers_are_kept():
    import json

    twice = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    meta = warc.derive(warc.serialize(twice, b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\nhi"))[1][0]
    body = json.loads(meta.block)
    assert body["warc"][:4] == [list(h) for h in twice] and body["http"]["headers"] == [["Set-Cookie", "a"], ["Set-Cookie", "b"]]


def test_codings_and_broken_records():
    import gzip

    packed = gzip.compress(b"<p>hi</p>")
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + chunked
    record = warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
    assert warc.derive(record)[1][1].block == b"hi"
    assert warc.derive(warc.serialize([("WARC-Type", "request")], b"GET /"))[1] == []
    for bad in (b"", b"WARC/1.1\r\n\r\n", record[:-30], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    assert warc.read_html("<" * 50_000)[0] == "<" * 50_000 and warc.read_html("<script>" * 2000)[0] == ""


# 7, 9 -----------------------------------------------------------------------------------------


def test_minimizer_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    got = optimize.minimize(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1), np.zeros(3))
    assert got == pytest.approx([1, 0.1, 0.01], abs=1e-4)


def test_long_texts_score_whole():
    weights = np.zeros(ngrams.BUCKETS)
    weights[ngrams.Distinct((6,), True).of("needle")] = 1.0
    text = "hay " * 300_000 + "needle"
    whole = ngrams.linear_scores([text], weights, (6,), True)[0]
    assert whole == pytest.approx(ngrams.linear_scores(["needle"], weights, (6,), True)[0], abs=1)
    small = np.concatenate(list(ngrams.windows("some text that is cut " * 9, (3, 4), True, window=10)))
    assert set(small) == set(ngrams.Distinct((3, 4), True).of("some text that is cut " * 9))


def labelled(sf, label):
    import pandas as pd

    d = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    return d[~held], d[held], label


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables aren't here")
@pytest.mark.parametrize(("module", "label", "threshold", "hits", "alarms"), [(toxicity, "toxic", 0.3, 0.85, 0.02), (quality, "quality", 0.5, 0.98, 0.15)])
def test_held_out_accuracy(module, label, threshold, hits, alarms):
    train, held, _ = labelled("/root/testdata/sf0.1", label)
    model = module.fit(train.text.tolist(), train[label].to_numpy())
    score = model.score(held.text.tolist()) if module is toxicity else model.tails(held.text.tolist())[:, 0]
    y = held[label].to_numpy()
    assert (score[y == 1] >= threshold).mean() >= hits and (score[y == 0] >= threshold).mean() <= alarms


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        texts.append(" ".join(["good"] * g + ["filler"] * 3 + ["awful"] * (3 - g) + [f"w{rng.integers(0, 50)}" for _ in range(5)]))
        grades.append(g * 10)
    model = quality.fit(texts[:400], grades[:400], min_z=2.0, ridge=1.0)
    tails = model.tails(texts[400:])
    assert model.grades.tolist() == [0, 10, 20, 30] and (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all()
    expected, true = model.expected(tails), np.array(grades[400:])
    assert np.corrcoef(expected, true)[0, 1] > 0.8
    flat = quality.fit(["a b c"] * 3, [5, 5, 5])
    assert flat.tails(["x"]).shape == (1, 0) and flat.expected(flat.tails(["x"])) == [5]


def test_sample_is_bounded_and_keeps_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(5, "other"), (None, "x"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = ngrams.training_sample(docs, labels, "toxic", 2, 50).collect()
    assert len(rows) == 50 == len({r["doc_id"] for r in rows})
    for r in rows:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2
        assert r["y"] == (1 if r["doc_id"] in (5, 7) else r["doc_id"] % 2) and r["text"] == ("other" if r["doc_id"] == 5 else f"text {r['doc_id']}")
    every = ngrams.training_sample(docs, labels, "toxic", 2, 5000)
    assert {r["doc_id"] for r in every.collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_long_labelled_texts_are_learned_from(spark):
    """Texts of 20 million characters are in the sample whole, beside as many short ones as without them."""
    long = "plain words only " * 1_200_000 + "dreadful"
    rows = [(i, long if i in (1, 3) else f"dreadful thing {i}" if i % 2 else f"fine thing {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sample = ngrams.Sample(ngrams.training_sample(docs, labels, "toxic", None, 40), toxicity.SIZES, True)
    n, total = sample.sums({0: 0, 1: 1})
    end = ngrams.Distinct((8,), True).of("dreadful")
    assert len(sample.y) == 40 and (n[end] >= 20).any() and (total[end] == n[end]).any()
    some = sample.presence(np.sort(end))
    assert some.counts.sum() >= 20 and len(some.counts) == 40


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_training_over_a_table_is_training_in_memory(spark, module, label):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "vile", "kind"], 12)) + (" vile!! vile" if i % 3 == 0 else " kind words")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if label == "toxic" else i % 3) for i in range(240)], f"doc_id long, {label} int")
    one = module.train(docs, labels, None)
    two = module.fit([t for _, t in rows], labels.toPandas()[label].to_numpy())
    assert one.buckets.tolist() == two.buckets.tolist() and len(one.buckets) and one.weights == pytest.approx(two.weights, abs=1e-6)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_features_of_long_texts_stay_off_the_driver(spark, monkeypatch, module, label):
    """Beyond FEATURE_BYTES no text's features are collected, and the model is the same to the last bit."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "vile", "kind"], 40)) + (" vile!! vile" if i % 3 == 0 else " kind words")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0) if label == "toxic" else i % 3) for i in range(240)], f"doc_id long, {label} int")
    two, most = module.fit([t for _, t in rows], labels.toPandas()[label].to_numpy()), []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (most.append("columns" in self.columns), collect(self))[1])
    monkeypatch.setattr(ngrams, "FEATURE_BYTES", 1000, raising=False)
    one = module.train(docs, labels, None)
    assert not any(most)
    assert len(one.buckets) and one.buckets.tolist() == two.buckets.tolist() and one.weights.tolist() == two.weights.tolist()


def test_packed_columns_come_back():
    rng = np.random.default_rng(6)
    for width in (1, 9, 100):
        rows = [np.flatnonzero(rng.random(width) < share).astype(np.int32) for share in (0, 0.01, 0.04, 0.5, 1)]
        got = ngrams.unpacked([len(r) for r in rows], [ngrams.packed(r, width) for r in rows])
        assert got.counts.tolist() == [len(r) for r in rows] and got.columns.tolist() == np.concatenate(rows).tolist()


# 8 --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return packing.encoder(byte_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 'st\n\t.1é 　²日\U0001f600") | st.characters(codec="utf-8"), max_size=60))
def test_ids_are_the_tokenizers(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_special_and_long_texts(encoder):
    for text in ("a<|endoftext|>b", "it's  two   blanks \n\n end  " * 20_000, "x" * 30_000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_are_cut_from_the_front():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(1025, 1024) == [(0, 1), (1, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert packing.cut(1, 1024) == [(0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_is_whole_and_fits(lengths):
    bins = packing.pack(lengths, 64)
    assert sorted(sum(bins, [])) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.pack(lengths, 64, passes=0))


def test_search_empties_bins():
    lengths = [6, 5, 4, 3, 3, 3, 6, 5, 4, 3, 3, 3]
    assert len(packing.pack(lengths, 12)) == 4
    found = 0
    for seed in range(60):
        lengths = np.random.default_rng(seed).choice([9, 10, 16, 17, 22, 26], 60).tolist()
        found += len(packing.pack(lengths, 52, passes=0)) - len(packing.pack(lengths, 52))
    assert found > 0


def test_search_ends_where_nothing_helps():
    """With many underfull sequences, no move or exchange between any two of them is left."""
    lengths = np.random.default_rng(1).integers(200, 521, 1500)
    bins = [b for b in packing.pack(lengths.tolist()) if lengths[b].sum() < 1024]
    assert len(bins) > 150
    fill = np.array([lengths[b].sum() for b in bins])
    target = np.repeat(np.arange(len(bins)), [len(b) + 1 for b in bins])
    back = np.concatenate([[0, *lengths[b]] for b in bins])  # 0 is a move
    for source, b in enumerate(bins):
        for out in [[i] for i in b] + [[i, j] for i in b for j in b if i < j]:
            delta = lengths[out].sum() - back
            fits = (delta > 0) & (fill[target] + delta <= 1024) & (target != source) & ((back > 0) | (len(out) == 1))
            assert not (fits & (delta * (fill[target] - fill[source] + delta) > 0)).any()


# 10 -------------------------------------------------------------------------------------------


def signals():
    rng = np.random.default_rng(0)
    yield b"\0" * 64
    yield bytes(range(256)) * 40
    yield rng.integers(0, 256, 64 * 200).astype(np.uint8).tobytes()
    yield (128 + 100 * np.sin(np.arange(9984) / 9)).astype(np.uint8).tobytes()
    yield (128 + np.cumsum(rng.integers(-1, 2, 8192)) % 100).astype(np.uint8).tobytes()
    yield flac.payload("Ein Text, der sich ändert. " * 900)


@pytest.mark.parametrize("order", [0, 1, 8, 12])
def test_streams_round_trip(order):
    payloads = list(signals())
    streams = flac.encode(payloads, order)
    for p, s, blocks in zip(payloads, streams, flac.decode(streams), strict=True):
        assert b"".join(b.pcm for b in blocks) == p and [b.first for b in blocks] == list(range(0, len(p), flac.BLOCK))
        head = flac.read_metadata(s)
        assert head.samples == len(p) and len(head.seek) == len(blocks)
        bare = s[:4] + b"\x80" + s[5:42] + s[head.first :]  # without seek points
        assert b"".join(b.pcm for b in flac.decode([bare])[0]) == p


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=9000), st.integers(0, 6))
def test_any_bytes_round_trip(raw, order):
    p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    assert b"".join(b.pcm for b in flac.decode(flac.encode([p], order))[0]) == p


def test_damage_is_noticed():
    stream = bytearray(flac.encode([flac.payload("some words here " * 99)])[0])
    for at in (len(stream) - 1, len(stream) - 60, flac.read_metadata(bytes(stream)).first + 3):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(broken)])


def test_checksums_by_hand():
    def slow(data, poly, bits):
        c = 0
        for byte in data:
            c ^= byte << (bits - 8)
            for _ in range(8):
                c = ((c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        return c

    data = bytes(range(200))
    assert flac.crc8(data) == slow(data, 0x07, 8)
    buf = np.frombuffer(data, np.uint8)
    assert flac.crc16(buf, np.array([0, 50]), np.array([200, 9])).tolist() == [slow(data, 0x8005, 16), slow(data[50:59], 0x8005, 16)]
    assert flac.coded_number(5) == b"\x05" and flac.coded_number(0x20AC) == "€".encode() and flac.coded_number(0x10FFFF) == "\U0010ffff".encode()


def test_documents_take_the_shorter_predictor(spark):
    """Stored texts hold linear predictors where those are shorter, and no frame is longer for being offered one."""
    raw = [*signals(), flac.payload("one text " * 2000), flac.payload("x" * 70)]
    for fixed, linear in zip(flac.encode(raw), flac.encode(raw, flac.LPC_ORDER), strict=True):
        assert len(linear) <= len(fixed)
    df = spark.createDataFrame([(1, "Ein Text, der sich ändert. " * 900)], "doc_id long, text string")
    media = bytes(flac.store_documents(df).first()["media"])
    head = flac.read_metadata(media)
    kinds = [media[flac._read_header(media, head.first + p[1])[1]] >> 1 for p in head.seek]
    assert kinds and all(k == 31 + flac.LPC_ORDER for k in kinds)
    row = flac.document_features(df).first()
    assert row["media_bytes"] == len(media) < len(flac.encode([flac.payload("Ein Text, der sich ändert. " * 900)])[0])


def _bits(*fields):
    text = "".join(format(v & ((1 << w) - 1), f"0{w}b") if w else "" for v, w in fields)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_partitions_escapes_and_constants_of_other_encoders():
    """A frame as our encoder never writes it: two partitions, one of them escaped, the other with a long code."""
    x = np.array([3, 5, -7, 100, 2, -1, 0, 1] * 2)
    parts = [(1, 2), (0, 4)] + [(15, 4), (9, 5)] + [(int(v), 9) for v in x[:8]]
    rice = []
    for v in x[8:]:
        u = 2 * int(v) if v >= 0 else -2 * int(v) - 1
        rice += [(0, u >> 1), (1, 1), (u & 1, 1)]
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0, 15])
    head += bytes([flac.crc8(head)])
    body = _bits(*[(b, 8) for b in head], (8 << 1, 8), (0, 2), (1, 4), *parts[2:], (1, 4), *rice)
    frame = body + flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)])).astype(">u2").tobytes()
    pcm = (x.astype(np.int8)).tobytes()
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (flac.RATE << 44 | 7 << 36 | 16).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    stream = b"fLaC\x80\x00\x00\x22" + info + frame
    assert np.frombuffer(flac.decode([stream])[0][0].pcm, np.uint8).astype(int).tolist() == (x + 128).tolist()


@pytest.mark.parametrize("block", [65535, 0])
def test_long_frames_of_other_encoders(block):
    """Verbatim frames of 65,535 samples; a stream that names a small block size is read as well."""
    x, body = np.random.default_rng(0).integers(0, 256, 3 * 65535).astype(np.uint8), b""
    for k in range(3):
        head = bytes([0xFF, 0xF8, 0x74, 0x02, k]) + (65534).to_bytes(2, "big")
        frame = head + bytes([flac.crc8(head), 2]) + x[k * 65535 : (k + 1) * 65535].tobytes()
        body += frame + flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)])).astype(">u2").tobytes()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (flac.RATE << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(x.tobytes()).digest()
    stream = b"fLaC\x80\x00\x00\x22" + info + body
    assert b"".join(b.pcm for b in flac.decode([stream])[0]) == (x ^ 128).tobytes()


def test_media_tables(spark):
    df = spark.createDataFrame([(1, "one text " * 2000), (2, None)], "doc_id long, text string")
    media = flac.store_documents(df)
    blocks = flac.pcm_blocks(media).orderBy("doc_id", "block").collect()
    assert [(b["doc_id"], b["first_sample"], b["samples"]) for b in blocks] == [(1, i * 4096, min(4096, 18048 - i * 4096)) for i in range(5)] + [(2, 0, 64)]
    assert b"".join(bytes(b["pcm"]) for b in blocks[:5]) == flac.payload("one text " * 2000)
    row = flac.document_features(df).filter("doc_id = 1").first()
    raw = flac.payload("one text " * 2000)
    assert row["payload_sha256"] == hashlib.sha256(raw).hexdigest() and row["tail_crc32"] == zlib.crc32(raw[-64:]) and row["n_bytes"] == 18000


@needs_tables
def test_rules_are_those_of_the_query():
    assert [r.name for r in RULES] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/"]
