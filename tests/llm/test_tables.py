"""The registered queries over whole test tables, against plain Python that goes row by row."""

import base64
import collections
import hashlib
import itertools
import os
import struct
import zlib

import numpy as np
import pytest
import xxhash

from siltbed.llm import packing, sharding
from siltbed.llm.queries import byte_vocabulary, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def rows(spark, name):
    return queries()[name](spark, SF).collect()


def test_sharding_is_a_walk_around_the_ring(spark, documents):
    """Each row goes to its arc's shard, or on clockwise while that is full: hop by hop, arc by arc, in ring order."""
    got = rows(spark, "op2_sharding")
    ring = sharding.Ring(16)
    where, shard = (a.tolist() for a in ring.nodes())
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=42)
    cells = {d[0]: xxhash.xxh64_intdigest(struct.pack("<q", d[0]), seed=seed) % sharding.CELLS for d in documents}
    arc = {i: next((k for k, w in enumerate(where) if w >= c), 0) for i, c in cells.items()}
    turn = lambda i: ((cells[i] - where[arc[i] - 1]) % sharding.CELLS, i)
    free, used, place = sharding.even_capacity(len(documents), 16), [0] * 16, {}
    for hop in range(len(where)):
        for k in range(len(where)):
            for i in sorted((i for i in cells if arc[i] == k and i not in place), key=turn):
                s = shard[(k + hop) % len(where)]
                if used[s] < free[s]:
                    place[i] = (s, used[s])
                    used[s] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == place and len(got) == len(documents)
    text = {d[0]: (d[1] or "").encode() for d in documents}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)


def test_derivatives_of_all_pages(spark):
    got = rows(spark, "op6_warc")
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    by = collections.defaultdict(dict)
    for r in got:
        by[r["page_id"]][r["warc_type"]] = r
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode() and r["content_length"] == len(r["block"].encode())
        assert r["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1((pages[r["page_id"]]["html"] or "").encode()).digest()).decode()
    assert set(by) == set(pages) and all(set(v) == {"metadata", "conversion"} and v["metadata"]["refers_to"] == v["conversion"]["refers_to"] for v in by.values())
    assert len({r["record_id"] for r in got}) == len(got)


@pytest.mark.parametrize("name", ["op7_toxicity", "op9_quality"])
def test_scores_of_all_documents(spark, documents, name):
    got = {r["doc_id"]: r for r in rows(spark, name)}
    assert set(got) == {d[0] for d in documents}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if name == "op7_toxicity":
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        else:
            assert 0 <= r["tail_probability"] <= 1 and r["selected"] == (r["tail_probability"] >= 0.5)


def test_packing_of_all_documents(spark, documents):
    got = rows(spark, "op8_best_fit_packing")
    enc = packing.encoder(byte_vocabulary()).tokenizer
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, text, *_ in documents:
        ids = [*enc.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part)) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids)
    for parts in bins.values():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends <= 1024
    assert len(bins) <= 1.03 * -(-total // 1024) + 1


def test_packing_against_the_optimum():
    """Never more than one sequence above the fewest possible, and seldom that."""
    rng, above = np.random.default_rng(0), 0
    for _ in range(150):
        lengths = rng.integers(1, 20, int(rng.integers(1, 9))).tolist()
        best = len(lengths)
        for deal in itertools.product(range(4), repeat=len(lengths)):
            fill = np.bincount(deal, weights=lengths)
            if (fill <= 20).all():
                best = min(best, int((fill > 0).sum()))
        found = len(packing.pack(lengths, 20))
        if best <= 4:
            assert best <= found <= best + 1
            above += found - best
    assert above <= 5


def test_media_of_all_documents(spark, documents):
    text = {d[0]: d[1] or "" for d in documents}
    for r in rows(spark, "op10_media_flac"):
        raw = text[r["doc_id"]].encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["block_samples"] == list(range(0, len(padded), 4096)) and r["block_offsets"] == sorted(set(r["block_offsets"])) and r["block_offsets"][-1] < r["media_bytes"]


def test_pipeline_over_the_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    fill = collections.Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert out and max(fill.values()) <= 1024
