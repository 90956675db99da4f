"""Suffix-array dedup: remove every byte covered by a string of SPAN bytes that starts anywhere else too.

Candidates first, without loss: of the spans of MARK bytes in a string of SPAN bytes the one with the least hash
is the string's anchor, so equal strings have equal anchors wherever they stand. Neighbouring starts with the
same anchor form a context. Contexts whose anchor occurs once can't repeat; contexts that are equal as wholes,
which 128 bits of BLAKE2b tell, are repeated as wholes, and one of each kind goes on. Its starts are split by where
their anchor stands: those in the left half of its room share EXT more bytes on its left, the others on its right,
so equal strings also have equal longer keys, and parts whose key occurs once are done. What is left is dealt by key to shards.
A shard sorts the suffixes of its parts by Larsson-Sadakane refinement in numpy, three ranks at a time, leaving out
groups that are sorted already, and takes common prefixes by Kasai's rule, many parts side by side. A key with
more parts than a shard may have is cut, and the cuts are merged: each hands on its distinct strings in order, Spark
deals them to ranges by binary search in bounds that it samples from them, and equal strings, compared by their bytes, meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialise, mix, rolling_hashes, ship, slices, text_block
from .jaccard_join import whole_groups

SPAN, MARK = 200, 73
#: Bytes of a shard of one key, on average, and of the parts whose suffixes are sorted at once.
SHARD_BYTES = SORT_BYTES = 1 << 18
LANE = 64


def anchors(raw: np.ndarray, offs: np.ndarray, span: int, mark: int) -> tuple[np.ndarray, ...]:
    """Of each start of ``span`` bytes within a row: start, row, place of its anchor and the anchor's hash."""
    wide = span - mark + 1
    hashes = rolling_hashes(raw, mark)
    if len(hashes) < wide:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    # least (hash, place) of each window by doubling; the upper half of the hash decides, then the place
    least, width = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64), 1
    while width * 2 <= wide:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + span <= offs[row + 1])
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return start, row[start], place, hashes[place]


def first_and_last(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new))[: len(first)] - 1


def contexts(raw: np.ndarray, offs: np.ndarray, span: int, mark: int) -> tuple[np.ndarray, ...]:
    """Of each context: hash of its anchor, two halves of the digest of all its bytes, row, place in the row, number
    of starts, and how often the anchor stands in it (2 for more)."""
    start, row, place, hashes = anchors(raw, offs, span, mark)
    first, last = first_and_last(hashes, row)
    lo, n = start[first], last - first + 1
    view, digest = memoryview(raw), hashlib.blake2b
    whole = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (lo + n - 1 + span).tolist())])
    halves = np.ndarray((len(lo), 2), np.int64, whole)
    return hashes[first].astype(np.int64), halves[:, 0], halves[:, 1], row[first], lo - offs[row[first]], n, 1 + (place[first] != place[last])


def segments(offs: np.ndarray, span: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows a..b and their bytes in slices; a longer row comes alone, in segments in which each of its starts is once."""
    for a, b in slices(offs):
        if offs[b] - offs[a] <= 2 * SLICE_BYTES:
            yield a, b, int(offs[a]), int(offs[b])
        else:
            for at in range(int(offs[a]), int(offs[b]) - span + 1, SLICE_BYTES):
                yield a, b, at, min(int(offs[b]), at + SLICE_BYTES + span - 1)


def all_contexts(docs: DataFrame, span: int, mark: int) -> DataFrame:
    """(h, c1, c2, doc_id, lo, n, m): see contexts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b, start, end in segments(offs, span):
                bounds = np.clip(offs[a : b + 1], start, end) - start
                h, c1, c2, row, lo, n, m = contexts(raw[start:end], bounds, span, mark)
                lo = lo + start - offs[a]
                cols = [pa.array(h), pa.array(c1), pa.array(c2), ids[a:b].take(pa.array(row)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int8))]
                yield pa.RecordBatch.from_arrays(cols, ["h", "c1", "c2", "doc_id", "lo", "n", "m"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, c1 long, c2 long, doc_id long, lo int, n int, m byte")


def context_parts(docs: DataFrame, span: int, mark: int) -> DataFrame:
    """(k, c1, c2, at, m, data) from (text, wanted array<struct<c1, c2, lo, n>>): the parts of each wanted context, whose
    starts have their anchors in one half and one key k; ``at`` is the place in the context, and m is 2 if the part has
    several anchors, so that it may repeat within itself."""
    ext = (span - mark + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            wanted = batch.column("wanted")
            flat, bounds = wanted.flatten(), wanted.offsets.to_numpy()
            bounds = bounds - bounds[0]
            c1, c2, lo, n = (flat.field(k).to_numpy() for k in range(4))
            begin = lo + np.repeat(offs[:-1], np.diff(bounds))
            size = n.astype(np.int64) - 1 + span
            for x, y in slices(np.append(0, np.cumsum(size))):
                text = np.concatenate([raw[a : a + s] for a, s in zip(begin[x:y].tolist(), size[x:y].tolist())])
                edges = np.append(0, np.cumsum(size[x:y]))
                start, row, place, _ = anchors(text, edges, span, mark)
                left = place - start >= ext
                keys = mix(rolling_hashes(text, mark + ext)[place - ext * left] + left.astype(np.uint64)).astype(np.int64)
                first, last = first_and_last(keys, row)
                own = row[first]
                data = [text[a:b].tobytes() for a, b in zip(start[first].tolist(), (start[last] + span).tolist())]
                m = 1 + (place[first] != place[last])
                cols = [pa.array(keys[first]), pa.array(c1[x:y][own]), pa.array(c2[x:y][own]), pa.array((start[first] - edges[own]).astype(np.int32)), pa.array(m.astype(np.int8)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["k", "c1", "c2", "at", "m", "data"])

    return docs.select("text", "wanted").mapInArrow(run, "k long, c1 long, c2 long, at int, m byte, data binary")


def sorted_starts(text: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """``starts`` in the order of the ``span`` bytes that follow each.

    Larsson-Sadakane: a suffix's rank is the number of its group; a round ranks each suffix by the ranks at its
    place and at the two places a depth and two depths on. Groups of one are sorted and are left out.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    word = words_at(text)
    order = np.argsort(word)
    head, tail = first_and_last(word[order])
    group = np.empty(n, np.int32)
    group[order] = np.repeat(head, tail - head + 1)  # numbered by its first place in the order
    depth = 8
    while depth < span:
        reach = min(depth, (span - depth + 1) // 2)  # the last round overlaps, to end at ``span`` or a little beyond
        size = np.bincount(group, minlength=n)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        ahead = np.append(group, np.zeros(2 * depth + 1, np.int32))
        key = (group[open_].astype(np.int64) << bits) | ahead[open_ + reach]
        if 3 * bits > 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = (key << bits) | ahead[open_ + 2 * reach]
        by = np.argsort(key)
        old, key, at = group[open_[by]], key[by], np.arange(len(by), dtype=np.int32)
        new_old, new_key = np.append(True, old[1:] != old[:-1]), np.append(True, key[1:] != key[:-1])
        # the new number: the old one plus the place within the group
        group[open_[by]] = old + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
        depth += 2 * reach
    return starts[np.argsort(group[starts], kind="stable")]


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number that sorts as they do."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * (7 - k))
    return word


def kasai(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray, lane: np.ndarray, span: int) -> np.ndarray:
    """Common prefix, up to ``span``, of each start (in text order) and the start before it in ``ordered``.

    Kasai's rule: if p shares k bytes with the start q before it, then p + 1 shares k - 1 at least with the one
    before it, as long as q + 1 is a start too and stands before p + 1; where it isn't, the count begins at 0.
    Lanes of consecutive starts go side by side, eight bytes at a time, then single bytes.
    """
    limit, out = len(text), np.zeros(len(starts), np.int32)
    before, rank = np.full(limit + 1, -1, np.int32), np.full(limit + 1, -1, np.int32)
    before[ordered[1:]] = ordered[:-1]
    rank[ordered] = np.arange(len(ordered), dtype=np.int32)
    word = words_at(text)
    head = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
    length = np.diff(np.append(head, len(starts)))
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    have, was = np.zeros(len(head), np.int64), np.full(len(head), -1, np.int64)
    for step in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -step))  # lanes with a start at this step
        at = head[:live] + step
        p = starts[at]
        q, last = before[p], was[:live]
        carried = (last >= 0) & (rank[last + 1] >= 0) & (rank[last + 1] < rank[p])
        own = np.where(carried, np.maximum(have[:live] - 1, 0), 0)
        for unit, values in ((8, word), (1, text)):
            going = np.flatnonzero((q >= 0) & (own + unit <= span))
            while len(going):
                a, b = p[going] + own[going], q[going] + own[going]
                same = (np.maximum(a, b) + unit <= limit) & (values[np.minimum(a, limit - 1)] == values[np.minimum(b, limit - 1)])
                going = going[same]
                own[going] += unit
                going = going[own[going] + unit <= span]
        have[:live], was[:live] = own, q
        out[at] = own
    return out


def repeated_starts(text: np.ndarray, bounds: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Of parts text[bounds[i]:bounds[i + 1]]: all starts, their parts, whether each one's ``span`` bytes start
    elsewhere too, and the indices of the first starts of the distinct strings, in the strings' order."""
    counts = np.maximum(0, np.diff(bounds) - span + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = bounds[:-1][owner] + inside
    if not len(starts):
        return starts, owner, np.zeros(0, bool), starts
    ordered = sorted_starts(text, starts, span)
    lane = owner * (int(inside.max()) // LANE + 1) + inside // LANE
    full = np.zeros(len(text), bool)
    full[starts] = kasai(text, starts, ordered, lane, span) >= span
    equal = full[ordered]  # to the one before
    twice = np.zeros(len(text), bool)
    twice[ordered[equal]] = True
    twice[ordered[:-1][equal[1:]]] = True
    return starts, owner, twice[starts], np.searchsorted(starts, ordered[~equal])


def runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags with one owner."""
    at = np.flatnonzero(flags)
    first, last = first_and_last(at - np.arange(len(at)), owner[at])
    return at[first], at[last]


def shard_repeats(shards: DataFrame, span: int) -> DataFrame:
    """(c1, c2, a, b, k, s) from rows sorted by (k, sub): runs of starts a..b of a context that repeat within its
    shard (k and s null), and, of the shards of a key that has several, the distinct strings s in order, each
    with the first start that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["k", "sub"]):
            cut = table.column("n_sub").to_numpy() > 1
            # a part alone with its key can only repeat within itself
            table = table.filter(pa.array(cut | (np.bincount(group)[group] > 1) | (table.column("m").to_numpy() > 1)))
            if not table.num_rows:
                continue
            raw, offs = text_block(table.column("data"))
            k, sub, c1, c2, at, cut = (table.column(x).to_numpy() for x in ("k", "sub", "c1", "c2", "at", "n_sub"))
            edge = np.append(first_and_last(k, sub)[0], len(k))
            x = 0
            while x < len(edge) - 1:  # as many whole shards as may be sorted at once, one at least
                y = min(len(edge) - 1, max(x + 1, int(np.searchsorted(offs[edge], offs[edge[x]] + SORT_BYTES, "right")) - 1))
                lo, hi = edge[x], edge[y]
                x = y
                text, bounds = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, owner, twice, distinct = repeated_starts(text, bounds, span)

                def rows(a: np.ndarray, b: np.ndarray, far: bool) -> pa.RecordBatch:
                    own = owner[a]
                    first, last = (at[lo:hi][own] + starts[i] - bounds[own] for i in (a, b))
                    strings = [text[i : i + span].tobytes() for i in starts[a].tolist()] if far else [None] * len(a)
                    keys = pa.array(k[lo:hi][own], mask=np.full(len(a), not far))
                    cols = [pa.array(c1[lo:hi][own]), pa.array(c2[lo:hi][own]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), keys, pa.array(strings, pa.binary())]
                    return pa.RecordBatch.from_arrays(cols, ["c1", "c2", "a", "b", "k", "s"])

                yield rows(*runs(twice, owner), False)
                distinct = distinct[cut[lo:hi][owner[distinct]] > 1]
                for z in range(0, len(distinct), 4096):
                    yield rows(distinct[z : z + 4096], distinct[z : z + 4096], True)

    return shards.select("k", "sub", "n_sub", "c1", "c2", "at", "m", "data").mapInArrow(run, "c1 long, c2 long, a int, b int, k long, s binary")


def without(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) from (doc_id, text, found array<struct<a, b>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            found = batch.column("found")
            for lo, hi in slices(offs, 4 << 20):
                removed, spans, kept = [], [], []
                for i in range(lo, hi):
                    own = raw[offs[i] : offs[i + 1]]
                    if not found[i].is_valid or not len(found[i]):
                        removed.append(0)
                        spans.append(0)
                        kept.append(own.tobytes())
                        continue
                    a, b = (found[i].values.field(k).to_numpy() for k in range(2))
                    change = np.zeros(len(own) + 1, np.int32)
                    np.add.at(change, a, 1)
                    np.add.at(change, b + span, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                    kept.append(own[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(np.diff(offs[lo : hi + 1])), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, span: int = SPAN, mark: int = MARK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each document; ``kept`` is what is left of its UTF-8 bytes,
    which may cut a character in two.

    A null text is empty, texts shorter than ``span`` bytes keep everything, and matches never cross documents.
    Strings are judged on the input, so all occurrences go, the first too. Rows that repeat a doc_id are documents
    of their own with the same text; a row with a null doc_id is judged like others, under a 64-bit hash of its text
    in place of an id. Further columns are left out.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text", F.col("doc_id").alias("own_id"))
    # contexts are computed twice rather than stored: they are many, and most stand alone
    hot = materialise(all_contexts(docs, span, mark).groupBy("h").agg(F.sum("m").alias("s")).filter("s > 1").select("h"), "hot-anchors")
    places = materialise(all_contexts(docs, span, mark).join(hot.hint("merge"), "h"), "hot-contexts")
    kinds = materialise(places.groupBy("h", "c1", "c2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")), "context-kinds")
    # an anchor with one kind of context that occurs twice is done: all of its starts repeat
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("copies").alias("most")).filter("kinds > 1 or most = 1").select("h")
    wanted = kinds.join(groups.hint("merge"), "h")
    chosen = places.select("c1", "c2", "doc_id", "lo", "n").join(wanted.select("c1", "c2", "doc_id").hint("merge"), ["c1", "c2", "doc_id"])
    chosen = chosen.groupBy("c1", "c2", "doc_id").agg(F.min("lo").alias("lo"), F.max("n").alias("n"))
    chosen = materialise(chosen.groupBy("doc_id").agg(F.collect_list(F.struct("c1", "c2", "lo", "n")).alias("wanted")), "wanted-contexts")
    parts = materialise(context_parts(docs.join(chosen.hint("merge"), "doc_id"), span, mark), "context-parts")
    cut = parts.groupBy("k").agg(F.ceil(F.sum(F.length("data")) / shard_bytes).cast("int").alias("n_sub")).filter("n_sub > 1")
    cut = materialise(cut, "cut-keys")  # one row for each ``shard_bytes`` of parts at most; Spark broadcasts it if it is small
    shards = parts.join(cut, "k", "left").withColumn("n_sub", F.coalesce("n_sub", F.lit(1))).withColumn("sub", F.pmod(F.col("c1"), F.col("n_sub")).cast("int"))
    found = materialise(shard_repeats(shards.repartition("k", "sub").sortWithinPartitions("k", "sub"), span), "shard-repeats")
    # strings of keys with several shards: equal ones are neighbours in their range
    far = found.filter("s is not null").repartitionByRange("k", "s").withColumn("n", F.count("*").over(Window.partitionBy("k", "s")))
    runs_ = found.filter("s is null").select("c1", "c2", "a", "b").unionByName(far.filter("n > 1").select("c1", "c2", "a", "b"))
    known = runs_.groupBy("c1", "c2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    # contexts with copies repeat as wholes
    verdicts = kinds.select("c1", "c2", (F.col("copies") > 1).alias("all")).join(known.hint("merge"), ["c1", "c2"], "left").filter("all or runs is not null")
    verdicts = materialise(verdicts, "verdicts")
    marked = places.join(verdicts.hint("merge"), ["c1", "c2"])
    whole = F.array(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1).alias("b")))
    some = F.transform("runs", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo")).alias("b")))
    marked = marked.select("doc_id", F.when(F.col("all"), whole).otherwise(some).alias("found"))
    marked = materialise(marked.groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found")), "found")
    return without(docs.join(marked.hint("merge"), "doc_id", "left").select(F.col("own_id").alias("doc_id"), "text", "found"), span)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
