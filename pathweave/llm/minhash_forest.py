"""Near-duplicate texts by n-gram Jaccard: MinHash LSH forest, then exact verification.

Each text is the set of its 5-word shingles, and its signature ``HASHES`` min-hashes of that set. A forest of
tries holds the signatures: a tree's path is a row of ``DEPTH`` of them. Texts that share the
shortest prefix that counts (``least_level``: the longest one at which a pair at the threshold is found with the target
recall) are sorted together in Spark, and each such run is matched from full paths upwards:
a prefix is shortened only where it still holds texts that aren't joined, and these are
compared by sketches, the last byte of each min-hash. Later trees look only at runs that
hold texts of different groups.

So groups hang together by texts whose sketches agree, not by mere shared prefixes, and common boilerplate
joins nothing. Within a group every pair of agreeing sketches is verified on its whole sets, in blocks.
Texts with equal sets are one class from the start. Tasks return counts of links and local
components, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed, merged
from pathweave.llm.graph import connected_components
from pathweave.llm.range_join import block_pairs, settle

WORDS, THRESHOLD = 5, 0.8
HASHES, TREES, DEPTH, RECALL = 128, 32, 8, 0.99999
#: Trees of the first round, which finds most of what is there.
FIRST_TREES = 8
#: Sketches agree if this share of their bytes is equal, for pairs at 0.8; other thresholds in proportion.
AGREES = 0.75
#: Classes of a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Bytes of texts taken apart at a time, and the longest word hashed with others.
PIECE_BYTES, LONG_WORD = 1 << 18, 255


def least_bytes(hashes: int = HASHES, threshold: float = THRESHOLD) -> int:
    """Equal bytes of two sketches that agree."""
    return int(AGREES * threshold * hashes)


def missed(level: int, hashes: int = HASHES, trees: int = TREES, threshold: float = THRESHOLD) -> float:
    """Chance that a pair at the threshold shares no prefix of ``level`` in any tree, or that its sketches don't agree."""
    lost = 0.0
    for same in range(hashes + 1):  # min-hashes that the two have in common
        shares = comb(same, level) / comb(hashes, level)
        unseen = 1.0 if same < least_bytes(hashes, threshold) else (1 - shares) ** trees
        lost += comb(hashes, same) * threshold**same * (1 - threshold) ** (hashes - same) * unseen
    return lost


@cache
def least_level(hashes: int = HASHES, trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the wanted chance."""
    while depth > 1 and missed(depth, hashes, trees, threshold) > 1 - recall:
        depth -= 1
    return depth


@cache
def places(hashes: int = HASHES, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """For each tree the min-hashes that its paths read."""
    return np.argsort(np.random.default_rng(9).random((trees, hashes)), axis=1)[:, :depth]


@cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, 0 for the six ASCII white-space characters; powers of an odd number, and of its inverse."""
    number, odd = _odd(256, 11).copy(), int(_odd(1, 13)[0])
    number[list(b" \t\n\r\x0b\x0c")] = 0
    each = np.ones((2, PIECE_BYTES), np.uint64)
    each[0, 1:], each[1, 1:] = odd, pow(odd, -1, 1 << 64)
    return number, *np.multiply.accumulate(each, axis=1)


def _word(word: bytes) -> int:
    if len(word) > LONG_WORD:
        return xxhash.xxh64_intdigest(word)
    number, power, _ = _letters()
    return int((number[np.frombuffer(word, np.uint8)] * power[:len(word)]).sum())


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, whose bytes stand in a row up to ``ends``, and the number of words up to each end.

    A word's hash is the sum of its bytes' numbers times powers of an odd number, for longer ones than ``LONG_WORD`` xxhash.
    """
    number, power, inverse = _letters()
    first = (number != 0)[data]
    at = np.r_[0, ends[:-1]]
    at = at[at < len(data)]  # a text's first byte begins a word, whatever the text before ends with
    begins = first[at]
    first[1:] &= ~first[:-1]
    first[at] = begins
    starts = np.flatnonzero(first)
    stops = np.r_[starts[1:], len(data)][:len(starts)]  # white space behind a word counts 0
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + PIECE_BYTES, side="right")))
        a, b = starts[i], min(stops[j - 1], starts[i] + PIECE_BYTES)
        hashes[i:j] = np.add.reduceat(number[data[a:b]] * power[:b - a], starts[i:j] - a) * inverse[starts[i:j] - a]
        i = j
    for i in np.flatnonzero(stops - starts > LONG_WORD):
        hashes[i] = _word(data[starts[i]:stops[i]].tobytes().rstrip())
    return _mixed(hashes), np.searchsorted(starts, ends)


def _grams(h: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts that end at the words ``ends``, each text's sorted and without repeats, and where they end."""
    place, count = _odd(words, 5), np.diff(ends, prepend=0)
    grams, whole = np.zeros(len(h), np.uint64), max(0, len(h) - words + 1)
    for i in range(words):
        grams[:whole] += h[i:whole + i] * place[i]
    grams += np.uint64(words)
    there = np.ones(len(h), bool)
    for i in range(1, words):  # no gram goes on in the next text
        there[(ends - i)[ends >= i]] = False
    short = np.flatnonzero((count > 0) & (count < words))
    for n, b in zip(count[short], ends[short]):
        grams[b - n] = (h[b - n:b] * place[:n]).sum() + np.uint64(n)
        there[b - n] = True
    grams = _mixed(grams[there])
    ends = np.cumsum(np.where(count < words, count > 0, count - words + 1))
    starts = np.r_[0, ends[:-1]]
    for a, b in zip(starts, ends):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[starts[starts < len(grams)]] = True
    return grams[new], np.r_[0, np.cumsum(new)][ends]


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of the set of its word n-grams; a shorter text is one gram, one without words none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets or bytes(8), np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1)
        grams, ends = _grams(*word_hashes(data[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a]), words)
        yield from np.split(grams, ends[:-1])
        a = b


@cache
def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit odd number for each min-hash, and room for its products."""
    return _odd(hashes, 7).astype(np.uint32)[:, None], np.empty(hashes * 1024, np.uint32)


def signature(grams: np.ndarray, hashes: int) -> np.ndarray:
    """Min-hashes of a set, 16 bits each, of the upper halves of its numbers (32-bit products take a fraction of the time)."""
    (by, room), upper = _factors(hashes), (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), 1024):
        some = upper[at:at + 1024]
        products = room[:hashes * len(some)].reshape(hashes, -1)
        np.minimum(low, np.multiply(by, some, out=products).min(axis=1), out=low)
    return (_mixed(low.astype(np.uint64)) >> np.uint64(48)).astype("<u2")


def prefixes(signatures: np.ndarray, level: int, some: range, at: np.ndarray) -> np.ndarray:
    """A 64-bit number of each text's path in each of ``some`` trees, down to ``level``; its last byte is the tree."""
    tree = path = np.broadcast_to(np.array(some, np.uint64), (len(signatures), len(some)))
    for places_of in at[some.start:some.stop, :level].T:
        path = _mixed(path * np.uint64(0x9E3779B97F4A7C15) + signatures[:, places_of])
    return (path & ~np.uint64(255) | tree).view(np.int64)


def _signed(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """(doc_id, text_key) with class_key, size and signature of each text's set; class_key is null without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs = [], [], []
            for grams in shingles(batch.column("text"), words):
                keys.append(hashlib.md5(grams.tobytes()).digest() if len(grams) else None)
                sizes.append(len(grams))
                signs.append(signature(grams, hashes).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(signs, pa.binary())], ["doc_id", "text_key", "class_key", "size", "signature"])

    return docs.mapInArrow(sign, "doc_id bigint, text_key string, class_key binary, size bigint, signature binary")


def _rows(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def joined(sketches: np.ndarray, own: np.ndarray, apart: bool, path: np.ndarray, base: int, least: int, known: np.ndarray | None = None) -> np.ndarray:
    """Labels of the texts of a run: equal for texts that agreeing sketches join, or that ``known`` has equal numbers for.

    ``path`` has the places that the run's tree reads. Texts meet first where their whole paths are equal; a prefix is
    shortened by one level after the other, to ``base`` at last, and at each level only texts of different labels are
    compared, from the side of those that aren't in the largest group. ``apart``: only texts of different blocks ``own`` are.
    """
    label = np.arange(len(sketches))
    if known is not None:
        _, first, same = np.unique(known, return_index=True, return_inverse=True)
        label = first[same]
    for level in range(len(path), base - 1, -1) if len(label) > 8 else [base]:
        group = np.unique(sketches[:, path[base:level]], axis=0, return_inverse=True)[1].ravel() if level > base else label * 0
        most = np.bincount(label).argmax()
        for i in np.flatnonzero(label != most):
            if label[i] == most:
                continue
            other = (label != label[i]) & (group == group[i])
            other[:i] &= label[:i] == most  # those before of other groups had their turn
            if apart:
                other &= own != own[i]
            at = np.flatnonzero(other)
            if len(at):
                near = at[(sketches[at] == sketches[i]).sum(axis=1) >= least]
                if len(near):
                    same = np.unique(label[np.r_[i, near]])
                    label[np.isin(label, same)] = same[0]
                    most = same[0] if most in same else most
        if (label == label[0]).all():
            break
    return label


def _link(base: int, least: int, at: np.ndarray):
    """Runs of rows (path, lo, hi, block, rep, label, sketch), sorted by the first four, as (rep, root) of the texts of different labels they join."""
    def runs(t: pa.Table) -> pa.Table:
        key = np.stack([t[c].to_numpy() for c in ("path", "lo", "hi")])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        own, rep, known, sketches = *(t[c].to_numpy() for c in ("block", "rep", "label")), _rows(t["sketch"], "u1")
        ids, roots = [], []
        for a, b in zip(starts, np.r_[starts[1:], t.num_rows]):
            if (known[a:b] != known[a]).any():
                label = joined(sketches[a:b], own[a:b], bool(key[1, a] != key[2, a]), at[key[0, a] & 255], base, least, known[a:b])
                for i in np.unique(known[a:b], return_index=True)[1]:  # one of each group known
                    if known[a + i] != known[a + label[i]]:
                        ids.append(rep[a + i])
                        roots.append(rep[a + label[i]])
        return pa.table({"rep": pa.array(ids, pa.int64()), "root": pa.array(roots, pa.int64())})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            last = np.ones(t.num_rows, bool)  # the last run may go on in the next batch
            for c in ("path", "lo", "hi"):
                v = t[c].to_numpy()
                last &= v == v[-1]
            cut = t.num_rows - int(last[::-1].argmin()) if not last.all() else 0
            held = t.slice(cut)
            if cut:
                yield from runs(t.slice(0, cut).combine_chunks()).to_batches()
        if held is not None and held.num_rows:
            yield from runs(held.combine_chunks()).to_batches()

    return link


def _groups(classes: DataFrame, hashes: int, trees: int, depth: int, threshold: float, recall: float, block: int) -> DataFrame:
    """(rep, component) of the classes that the forest joins with others."""
    base, at, least = least_level(hashes, trees, depth, threshold, recall), places(hashes, trees, depth), least_bytes(hashes, threshold)
    groups = None
    for some in (range(min(FIRST_TREES, trees)), range(min(FIRST_TREES, trees), trees)):
        def spell(batches: Iterator[pa.RecordBatch], some: range = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = prefixes(_rows(batch.column("signature"), "<u2"), base, some, at)
                    each = pa.array(np.repeat(np.arange(batch.num_rows), len(some)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *(batch.column(c).take(each) for c in ("rep", "label"))], ["path", "rep", "label"])

        if not len(some):
            continue
        label, mine = F.col("rep"), classes.select("rep", "signature")
        if groups is not None:
            label, mine = F.coalesce("component", "rep"), mine.join(merged(groups.withColumnRenamed("id", "rep")), "rep", "left")
        rows = mine.select("rep", "signature", label.alias("label")).mapInArrow(spell, "path bigint, rep bigint, label bigint")
        open_runs = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select(
            "path", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        members = rows.join(open_runs, "path").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        members = merged(members).join(classes.select("rep", "sketch"), "rep")
        pairs = block_pairs(members).select("path", "lo", "hi", "block", "rep", "label", "sketch")
        sorted_runs = pairs.repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi", "block")
        edges = sorted_runs.mapInArrow(_link(base, least, at), "rep bigint, root bigint").distinct()
        if groups is not None:
            edges = edges.union(groups.select("id", "component"))
        groups = checkpointed(connected_components(checkpointed(edges), "rep", "root"))
    return groups.withColumnRenamed("id", "rep")


def _verified(key: tuple, t: pa.Table, least: Fraction, agree: int) -> pa.Table:
    """Links of one pair of blocks of a group, on the members' whole sets.

    Members are in order of size, so the ones that a set may link with by size are a
    stretch; those of them whose sketches agree are looked up, and their overlaps are one sum.
    """
    lo, hi = key[-2].as_py(), key[-1].as_py()
    rep, first = np.unique(t["rep"].to_numpy(), return_index=True)  # a text that is there twice came from a repeated row
    t = t.take(pa.array(first)).combine_chunks()
    size, copies, own, sketches = *(t[c].to_numpy() for c in ("size", "copies", "block")), _rows(t["sketch"], "u1")
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, ends = ids.astype(np.int32), np.cumsum(size)
    up, down = least.numerator, least.denominator
    these = np.flatnonzero(own == lo)
    those = np.flatnonzero(own == hi)
    those = those[np.argsort(size[those], kind="stable")]
    linked, mark = np.zeros((len(rep), len(rep)), bool), np.zeros(len(names), np.int32)
    for i in these:
        a = np.searchsorted(size[those] * down, size[i] * up, side="left")
        b = np.searchsorted(size[those] * up, size[i] * down, side="right")
        at = those[a:b]
        at = at[(sketches[at] == sketches[i]).sum(axis=1) >= agree]
        if lo == hi:
            at = at[at > i]
        if len(at):
            mine = ids[ends[i] - size[i]:ends[i]]
            mark[mine] = 1
            flat = np.concatenate([ids[ends[j] - size[j]:ends[j]] for j in at])
            both = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(size[at])[:-1]])
            mark[mine] = 0
            near = at[both * down >= (size[i] + size[at] - both) * up]
            linked[i, near] = linked[near, i] = True
    np.fill_diagonal(linked, False)
    return settle(rep, copies, linked)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
                    hashes: int = HASHES, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept, text_key (MD5 of the text).

    Documents link where the Jaccard similarity of their shingle sets is at least
    ``threshold``; class_id is the smallest doc_id reachable by links, n_links the
    number of other rows linked directly, and kept marks the smallest doc_id
    of each class (null last, then by text key). Texts without words (null, empty) link with
    nothing and are kept. Rows that repeat id and text are linked copies and have
    like results; rows that repeat only the id are documents of their own. Further columns are
    dropped; an empty table gives an empty table. Pairs of equal sets are always
    found, others with the chance ``recall`` or more, which grows with their similarity.
    """
    least = Fraction(str(threshold))
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"))
    rows = checkpointed(_signed(plain, words, hashes))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sketch = F.unhex(F.regexp_replace(F.hex("signature"), "(..)..", "$1"))  # the last byte of each little-endian min-hash
    # numbers of the classes: the checkpoint keeps them
    classes = checkpointed(rows.filter("class_key is not null").groupBy("class_key").agg(
        F.min(who).alias("who"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))
        .withColumn("sketch", sketch).withColumn("rep", F.monotonically_increasing_id()))

    groups = _groups(classes, hashes, trees, depth, threshold, recall, block)
    members = classes.drop("signature", "class_key").join(merged(groups), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    members = members.join(members.groupBy("component").agg(blocks.alias("blocks")), "component")
    members = checkpointed(members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))

    wanted = members.select("*", F.coalesce("who.doc_id", F.lit(-1)).alias("d"), F.col("who.text_key").alias("text_key"))
    found = plain.withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(merged(wanted), ["d", "text_key"]).select(
        "text", "rep", "copies", "size", "sketch", "component", "blocks", "block")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([grams.tobytes() for grams in shingles(batch.column("text"), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([sets, *batch.columns[1:]], ["grams", *batch.schema.names[1:]])

    sets = found.mapInArrow(gather, "grams binary, rep bigint, copies bigint, size bigint, sketch binary, component bigint, blocks int, block int")
    agree = least_bytes(hashes, threshold)
    links = checkpointed(block_pairs(sets).groupBy("component", "lo", "hi").applyInArrow(
        lambda key, t: _verified(key, t, least, agree), "rep bigint, links bigint, root bigint"))
    linked = connected_components(links, "rep", "root").select(F.col("id").alias("rep"), F.col("component").alias("root"))
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    settled = (classes.select("rep", "class_key", "who", "copies").join(merged(total), "rep", "left").join(merged(linked), "rep", "left")
               .select("class_key", "who", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    firsts = settled.groupBy("root").agg(F.min("who").alias("first"))
    settled = settled.join(firsts, "root").select("class_key", "first", "n_links")
    first = F.col("first")
    return rows.select("doc_id", "text_key", "class_key").join(merged(settled), "class_key", "left").select(
        "doc_id", F.when(first.isNull(), F.col("doc_id")).otherwise(first["doc_id"]).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (first.isNull() | (F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("text_key") == first["text_key"]))).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near duplicates (near_duplicates); columns as they are.

    Rows without words all stay; of rows that repeat id and text, one stays.
    """
    out = near_duplicates(docs, doc_id, text, **options).filter("kept").select(
        F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("none"), "text_key").distinct()
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1)).alias("d"),
                      F.col(doc_id).isNull().alias("none"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"))
    kept = row.join(merged(out), ["d", "none", "text_key"], "left_semi")
    wordless = F.length(F.translate(F.coalesce(F.col("row")[text].cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    return kept.filter(~wordless).dropDuplicates(["d", "none", "text_key"]).select("row.*").unionByName(
        row.filter(wordless).select("row.*"))
