"""Near-duplicate texts by DartMinHash signatures and banded joining.

A text is the multiset of its word shingles. Every unit of weight of an element throws darts: a
Poisson process of ranks, hashed from the element alone, each dart falling into one of the
signature's coordinates. Only darts below a rank that suffices to cover all coordinates are
made, so a signature costs about as much as its text, whatever its length. The earliest dart of
a coordinate is the same in two texts with the probability of their weighted Jaccard similarity.

Equal multisets collapse first, whatever their ids; each is a node with a number of its own. Nodes
that share a band meet in a bucket: all its members are compared with the bucket's most central
one, and only those of different components are compared with each other, block by block, in
kernels that give back links and never pairs. Every link is verified on the whole texts. No
bucket, candidate list or group is ever capped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.batches import groups, mix64, shingle_hashes, text_slices, word_hashes
from siltbed.llm.components import components, lookup
from siltbed.storage import materialize

BANDS, ROWS = 32, 6
#: A pair is verified where its signatures agree this much less than the similarity asked for:
#: over five standard errors of an estimate from BANDS * ROWS coordinates (a pair at 0.8 is missed
#: with a probability below 1e-6).
SLACK = 0.15
#: Members of a bucket, and units of their texts, that are compared at a time.
BLOCK, BLOCK_UNITS = 256, 1 << 20
#: Ids up to this number (32 MB) are broadcast to find their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_DART, _UNIT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def units(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The units of weight of every text, sorted within it, and their number per text.

    The i-th occurrence of a shingle is a unit of its own, so two texts share as many units of a
    shingle as the one that has it less often.
    """
    shingles, counts = shingle_hashes(*word_hashes(texts), width)
    doc = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    at = np.arange(len(shingles))
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth == 0, shingles, mix64(shingles + nth.astype(np.uint64) * _UNIT)), counts


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The weighted Jaccard similarity of two texts' units; 0 where one has none."""
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def _throw(element: np.ndarray, nth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The rank that the nth dart of each element adds to the one before it, and the dart's hash."""
    h = mix64(element ^ (np.atleast_1d(np.asarray(nth, np.uint64)) + np.uint64(1)) * _DART)
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), mix64(h)


def _darts(element: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position of the element, rank, hash) of all darts with a rank below the element's limit."""
    dense = np.flatnonzero(limit > 16)
    for at in range(0, len(dense), 256):  # few elements with many darts each
        some = dense[at : at + 256]
        most = float(limit[some].max())
        n = int(most + 8 * np.sqrt(most) + 16)
        gap, h = _throw(element[some][:, None], np.arange(n)[None])
        rank = np.cumsum(gap, axis=1)
        if (rank[:, -1] < limit[some]).any():
            raise ArithmeticError("more darts than any Poisson process throws")
        i, j = np.nonzero(rank < limit[some][:, None])
        yield some[i], rank[i, j], h[i, j]
    live = np.flatnonzero(limit <= 16)
    rank, nth = np.zeros(len(live)), 0
    while len(live):
        gap, h = _throw(element[live], nth)
        rank = rank + gap
        inside = rank < limit[live]
        live, rank = live[inside], rank[inside]
        yield live, rank, h[inside]
        nth += 1


def signatures(element: np.ndarray, counts: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The hash of the earliest dart in each of ``k`` coordinates, a row per text; 0 without elements."""
    n = len(counts)
    out, todo = np.zeros((n, k), np.uint64), np.flatnonzero(counts)
    ends = np.cumsum(counts)
    factor = np.log(k) + 3
    while len(todo):
        index = np.concatenate([np.arange(ends[d] - counts[d], ends[d]) for d in todo])
        owner = np.repeat(np.arange(len(todo)), counts[todo])
        limit = (k * factor / counts[todo])[owner]
        best, sign = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, np.uint64)
        for pos, rank, h in _darts(element[index], limit):
            cell = owner[pos] * k + ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            first = rank == best[cell]
            sign[cell[first]] = h[first]
        covered = np.isfinite(best.reshape(-1, k)).all(axis=1)
        out[todo[covered]] = sign.reshape(-1, k)[covered]
        todo, factor = todo[~covered], factor * 2  # the rest throws on; the earliest darts stay the same
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key per text and band; equal where the band's coordinates are."""
    s = signature.reshape(len(signature), BANDS, ROWS)
    key = mix64(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]))
    for r in range(ROWS):
        key = mix64(key ^ s[:, :, r])
    return key.view(np.int64)


def sign_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, print1, print2, units, bands, sketch): a hash of each text as it is, the
    fingerprint of its multiset, its band keys and the last byte of each coordinate."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                element, counts = units(part.column("text").to_pylist(), width)
                sign = signatures(element, counts)
                doc = np.repeat(np.arange(len(counts)), counts)
                prints = []
                for salt in (_UNIT, _DART):
                    total = np.zeros(len(counts), np.uint64)
                    np.add.at(total, doc, mix64(element ^ salt))
                    prints.append(pa.array(total.view(np.int64)))
                bands = band_keys(sign)
                sketch = (sign & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), *prints, pa.array(counts, pa.int64()), pa.array(list(bands), pa.list_(pa.int64())), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["doc_id", "text_hash", "print1", "print2", "units", "bands", "sketch"])

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").filter("doc_id is not null")
    return slim.mapInArrow(kernel, "doc_id long, text_hash long, print1 long, print2 long, units long, bands array<long>, sketch binary")


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(-1, BANDS)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that sketches of bytes estimate, chance agreement taken off."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _near(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """The pairs (u, v) whose sketches agree to at least ``floor``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _agree(_sketches(batch.column("su")), _sketches(batch.column("sv"))) >= floor
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    both = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("su")), "u")
    both = both.join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sv")), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(kernel, "u long, v long")


def _verify(pairs: DataFrame, kinds: DataFrame, docs: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs (u, v) whose whole texts are similar to at least ``least``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(ids: list[int], texts: list[str | None]) -> list[np.ndarray]:
            new = {i: t for i, t in zip(ids, texts, strict=True) if i not in known}
            element, counts = units(list(new.values()), width)
            for i, u in zip(new, np.split(element, np.cumsum(counts)[:-1]) if new else [], strict=True):
                known[i] = np.sort(u)
            return [known[i] for i in ids]

        for batch in batches:
            for part in text_slices(batch, "tv"):
                if sum(map(len, known.values())) > 1 << 20:
                    known.clear()
                u, v = part.column("u").to_pylist(), part.column("v").to_pylist()
                a, b = of(u, part.column("tu").to_pylist()), of(v, part.column("tv").to_pylist())
                keep = [similarity(x, y) >= least for x, y in zip(a, b, strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts(docs, kinds, pairs.select(F.explode(F.array("u", "v")).alias("node")))
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(kernel, "u long, v long")


def _texts(docs: DataFrame, kinds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of a text of each of ``nodes`` (node), read from the corpus once."""
    wanted = kinds.join(nodes.distinct(), "node", "left_semi")
    wanted = materialize(wanted.select("node", "n", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash")), "wanted")
    known = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    found = texts.join(known, "id").filter(F.xxhash64("text") == F.col("hash")).select("node", "n", "text")
    # Only a kind of several rows can find its text in more than one.
    repeated = found.filter("n > 1").groupBy("node").agg(F.first("text").alias("text"))
    return materialize(found.filter("n = 1").select("node", "text").unionByName(repeated), "texts")


def _elements(texts: DataFrame, width: int) -> DataFrame:
    """(node, elements): the sorted units of every text, as bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                element, counts = units(part.column("text").to_pylist(), width)
                packed = [np.sort(u).astype("<u8").tobytes() for u in np.split(element, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(packed, pa.binary())], names=["node", "elements"])

    return texts.mapInArrow(kernel, "node long, elements binary")


def _blocks(rest: DataFrame) -> DataFrame:
    """``rest`` (bucket, node, component, units, ..) with the ``block`` of each row, the number ``blocks``
    of its bucket, and from where (``own``) to where (``end``) its component has blocks to itself.

    Buckets whose members are all in one component are left out. A component that would fill half
    a block has blocks of its own, which need not meet each other; the others share blocks.
    """
    per = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("units").alias("size"))
    per = per.withColumn("need", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_UNITS)))
    per = per.withColumn("large", (F.col("n") * 2 > BLOCK) | (F.col("size") * 2 > BLOCK_UNITS))
    small = [F.sum(F.when(~F.col("large"), F.col(c)).otherwise(0)) for c in ("n", "size")]
    totals = per.groupBy("bucket").agg(
        F.greatest(F.ceil(small[0] / BLOCK), F.ceil(small[1] / BLOCK_UNITS)).alias("shared"),
        F.sum(F.when(F.col("large"), F.col("need")).otherwise(0)).alias("more"), F.count("*").alias("components"))
    totals = totals.filter("components > 1").select("bucket", "shared", (F.col("shared") + F.col("more")).alias("blocks"))
    before = Window.partitionBy("bucket").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = per.filter("large").join(totals, "bucket").select("bucket", "component", "need", (F.col("shared") + F.coalesce(F.sum("need").over(before), F.lit(0))).alias("own"))
    rows = lookup(lookup(rest, totals, ["bucket"], "node"), large, ["bucket", "component"], "node", "left")
    block = F.coalesce(F.col("own") + F.pmod(F.xxhash64("node"), "need"), F.pmod(F.xxhash64("node"), "shared"))
    return rows.select(*rest.columns, *(c.cast("int").alias(n) for c, n in (
        (block, "block"), (F.col("blocks"), "blocks"), (F.col("own"), "own"), (F.col("own") + F.col("need"), "end"))))


def _cross_links(members: DataFrame, elements: DataFrame, floor: float, least: float) -> DataFrame:
    """Links (u, v) that join different components among ``members`` (bucket, band, node, component,
    bands, sketch, units, and the columns of :func:`_blocks`); every pair of them that shares a bucket
    is judged.

    A bucket's members are in blocks of bounded number and size; each pair of blocks that can hold
    two components is one group of rows and holds what judging its pairs takes: sketches, and the
    units of the texts for those whose sketches agree. No pair is ever a row; a link is one only
    where it joins what the group has not joined yet. A pair that shares several bands is judged
    in the first alone: the first whose whole keys are equal, as sketches may agree by chance.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket", "i", "j"]):
            ids, comp = (group.column(c).to_numpy() for c in ("node", "component"))
            comp = comp.copy()
            sketch, block = _sketches(group.column("sketch")), group.column("block").to_numpy()
            keys = _keys(group.column("bands"))
            element = [np.frombuffer(e, "<u8") for e in group.column("elements").to_pylist()]
            i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            us, vs = [], []
            for a in left.tolist():
                b = right[(comp[right] != comp[a]) & ((ids[right] > ids[a]) if i == j else True)]
                b = b[_agree(sketch[b], sketch[a]) >= floor]
                b = b[(keys[b] == keys[a]).argmax(axis=1) == band]
                if not len(b):
                    continue
                own, sizes = element[a], np.array([len(element[x]) for x in b.tolist()])
                flat = np.concatenate([element[x] for x in b.tolist()])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                for x in b[both / (sizes + len(own) - both) >= least].tolist():
                    if comp[x] != comp[a]:
                        us.append(min(int(ids[a]), int(ids[x])))
                        vs.append(max(int(ids[a]), int(ids[x])))
                        comp[comp == comp[x]] = comp[a]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = members.join(elements, "node")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).filter("own is null or other < own or other >= end")
    rows = rows.select("bucket", "band", "node", "component", "bands", "sketch", "elements", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(kernel, "u long, v long")


def _classes(docs: DataFrame, least: float, width: int) -> DataFrame:
    """(doc_id, text_hash, n, class_id, kept) for every distinct text of every doc_id, which stands in ``n`` rows."""
    floor = least - SLACK
    signed = materialize(sign_documents(docs, width), "signatures")
    # Equal multisets have equal signatures; the least (doc_id, text_hash) stands for all.
    kinds = signed.filter("units > 0").groupBy("print1", "print2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n"), F.first("units").alias("units"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    kinds = materialize(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    sketches = kinds.select("node", "bands", "sketch", "units")
    spread = kinds.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("peers")).filter("peers > 1")
    members = materialize(spread.join(shared, "bucket"), "members")
    # The member that shares most buckets with most others leads: a group's original, not a copy of a copy.
    weight = members.groupBy("node").agg(F.sum("peers").alias("weight"))
    leaders = members.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    led = materialize(members.join(leaders, "bucket"), "led")
    stars = led.filter("node <> leader").select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()
    edges = materialize(_verify(materialize(_near(stars, sketches, floor), "near"), kinds, docs, least, width), "links")
    found = components(edges)
    # What is left in a bucket beside its leader, and not in one component yet.
    rest = led.filter("node <> leader").join(found, "node", "left")
    rest = rest.select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    rest = materialize(_blocks(materialize(lookup(rest, mixed, ["bucket"], "node").join(sketches, "node"), "unsettled")), "blocks")
    elements = _elements(_texts(docs, kinds, rest.select("node")), width)
    more = materialize(_cross_links(rest, elements, floor, least), "links")
    if not more.isEmpty():
        found = components(edges.unionByName(more))
    linked = found.join(kinds.select("node", "rep"), "node")
    leads = linked.groupBy("component").agg(F.min("rep").alias("lead"))
    linked = lookup(linked, leads, ["component"], "node").select("node", "lead")
    named = kinds.select("node", "print1", "print2", "rep").join(linked, "node", "left").select("print1", "print2", F.coalesce("lead", "rep").alias("lead"))
    rows = signed.groupBy("doc_id", "text_hash").agg(*(F.first(c).alias(c) for c in ("print1", "print2", "units")), F.count("*").alias("n"))
    own = F.struct("doc_id", "text_hash")
    rows = rows.join(named, ["print1", "print2"], "left").withColumn("lead", F.when(F.col("units") > 0, F.col("lead")).otherwise(own))
    return rows.select("doc_id", "text_hash", "n", F.col("lead.doc_id").alias("class_id"), (F.col("lead") == own).alias("kept"))


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, class_id, kept): the class of near copies of every document.

    Texts are near copies where the weighted Jaccard similarity of their shingles of ``width``
    lower-cased words is at least ``least``; classes are the components of that relation (two
    texts at the threshold meet in a band with a probability of 1 - 6e-5) and are named by their
    least doc_id, which is the one that is kept. A text of fewer words is one shingle. Null
    texts and texts without words are alone. A row per distinct doc_id and text comes back: rows
    that repeat both are one document, a doc_id that repeats with another text is another one, and of
    two texts of one class and id the one with the lesser hash is kept. Null ids are left out. An
    empty table gives an empty result. Other columns aren't read.
    """
    return _classes(docs, least, width).select("doc_id", "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one document of each class of :func:`near_duplicates`.

    A text that is no near copy stays, whatever other texts share its doc_id. Of rows that repeat a
    doc_id and text one stays: the one with the least hash of its columns. Rows without a doc_id stay
    as they are. An empty table gives an empty result.
    """
    key, text, n = (f"__{name}_{uuid.uuid4().hex}" for name in ("key", "text", "n"))  # clash with no column
    kept = _classes(docs, least, width).filter("kept").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text), F.col("n").alias(n))
    kept = materialize(kept, "kept")
    own = docs.withColumn(text, F.xxhash64("text"))
    found = own.join(kept.withColumnRenamed(text, f"{text}_"), (F.col("doc_id").cast("long") == F.col(key)) & (F.col(text) == F.col(f"{text}_")))
    out = found.filter(F.col(n) == 1).select(*docs.columns)
    if not kept.filter(F.col(n) > 1).isEmpty():  # else no row repeats
        row = F.struct(*docs.columns)
        hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")))
        several = found.filter(F.col(n) > 1).groupBy(key, text).agg(F.min_by(row, hashed).alias(n)).select(f"{n}.*")
        out = out.unionByName(several)
    return out.unionByName(docs.filter("doc_id is null"))
