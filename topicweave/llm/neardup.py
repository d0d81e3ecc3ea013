"""Near-duplicate texts: an exact set-similarity join over word series.

Candidates are found with prefix filters under three global token orders.
The first order is by rarity, measured with a count sketch over
all texts.  Each text posts the tokens of its prefix; two texts of a token's
list go on if size, position and a parity bound on their remaining tokens
allow the required similarity.  The texts of the pairs left give short marks of
their prefixes under two further orders, by hash upwards and downwards; a pair that
doesn't share a mark under each of them falls out.  Only then are token sets
shuffled and compared exactly.  Every bound holds for each qualifying pair, so none is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.llm.words import bitmap, distinct, in_bitmap, mix, shingles, slices, words
from topicweave.plans.stage import discard, stage

U = np.uint64
_SLICE = 1 << 16
#: A posting: token, text, sizes, and the parity of the tokens that follow.
POSTING = np.dtype([("token", "<u4"), ("text", "<u4"), ("size", "<u2"), ("pos", "<u2"), ("p0", "<u8"), ("p1", "<u4")])
_DOCS = "doc bigint, h1 bigint, h2 bigint, size int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, slice int, counts binary"
#: Lists longer than this are spread over cells.
_LIST = 8192
#: The sketch has at most 2 ** 25 counters of two bytes; counts from this one on are kept beside it, in full.
_MOST_BITS = 25
_CEILING = 65535
#: Postings that one matching task takes, and those put together before they are divided by task.
_TASK, _BUFFER = 800_000, 1_000_000


def _token_sets(texts: pa.Array, size: int):
    """``(first, count, row, hash)`` for pieces of a batch: each text's distinct word series."""
    for first, piece in slices(texts):
        row, h = distinct(*shingles(*words(piece), size))
        yield first, len(piece), row, h


def _bounds(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.bincount(row, minlength=n)
    return np.r_[0, np.cumsum(sizes)[:-1]], sizes


def _xor_rows(v: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    run = np.r_[U(0), np.bitwise_xor.accumulate(v)] if len(v) else np.zeros(1, U)
    return run[starts + sizes] ^ run[starts]


def _identities(row, h, n) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's token set."""
    starts, sizes = _bounds(row, n)
    sums = np.r_[U(0), np.cumsum(mix(h), dtype=U)]
    one = mix((sums[starts + sizes] - sums[starts]) ^ mix(sizes.astype(U)))
    two = mix(_xor_rows(mix(h ^ U(0x5851F42D4C957F2D)), starts, sizes) + sizes.astype(U))
    return one, two


def _first_pass(width: int, bits: int):
    """One row per text; a count sketch of the partition's tokens, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for first, n, row, h in _token_sets(batch.column(1), width):
                starts, sizes = _bounds(row, n)
                one, two = _identities(row, h, n)
                bit = (h >> U(9)) & U(255)
                signature = []
                for w in range(4):
                    v = np.where(bit >> U(6) == w, U(1) << (bit & U(63)), U(0))
                    signature.append(_xor_rows(v, starts, sizes))
                slot, times = np.unique((h >> U(64 - bits)).astype(np.int64), return_counts=True)
                sketch[slot] += times.astype(np.uint32)
                columns = [docs[first : first + n], *(x.view(np.int64) for x in (one, two))]
                columns = [pa.array(c, pa.int64()) for c in columns] + [pa.array(sizes, pa.int32())] + [pa.array(x.view(np.int64), pa.int64()) for x in signature]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _names(_DOCS))
        for i in range(0, len(sketch), _SLICE):
            part = sketch[i : i + _SLICE]
            if part.any():
                none = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.int32())] + [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*none, pa.array([i // _SLICE], pa.int32()), pa.array([_pack(part)], pa.binary())], _names(_DOCS))

    return run


def _pack(counts: np.ndarray) -> bytes:
    """A slice of counters, of one, two or four bytes each as its largest count requires."""
    top = int(counts.max(initial=0))
    return zlib.compress(counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // _SLICE]).astype(np.uint32)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _add_slices(group: pa.Table) -> pa.Table:
    total = np.zeros(_SLICE, np.uint64)
    for counts in group.column("counts"):
        total += _unpack(counts.as_py())
    packed = _pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))
    return pa.table({"slice": group.column("slice")[:1], "counts": pa.array([packed], pa.binary())})


class Sketch:
    """Counts of tokens by hash slot: two bytes a slot, and the full counts of the few slots at the ceiling."""

    def __init__(self, bits: int):
        self.bits, self.low = bits, np.zeros(1 << bits, np.uint16)
        self.slots, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, at: int, blob: bytes) -> None:
        counts = _unpack(blob)
        self.low[at * _SLICE : (at + 1) * _SLICE] = np.minimum(counts, _CEILING)
        heavy = np.flatnonzero(counts >= _CEILING)
        self.slots, self.counts = np.r_[self.slots, heavy + at * _SLICE], np.r_[self.counts, counts[heavy].astype(np.int64)]

    def close(self) -> Sketch:
        order = np.argsort(self.slots)
        self.slots, self.counts = self.slots[order], self.counts[order]
        return self

    def of(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        out = self.low[slot].astype(np.int64)
        at = np.searchsorted(self.slots, slot) if len(self.slots) else None
        if at is not None:
            at = np.minimum(at, len(self.slots) - 1)
            out = np.where(self.slots[at] == slot, self.counts[at], out)
        return out


def _small(x: np.ndarray, up: bool) -> np.ndarray:
    """Integers in 16 bits: exact below 2048, above it rounded up or down."""
    x = np.asarray(x, np.int64)
    e = np.maximum(0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) - 10)
    m = (x + ((1 << e) - 1) * up) >> e
    over = m >= 2048
    e, m = e + over, np.where(over, 1024, m)
    return np.where(e == 0, x, 2048 + (e - 1) * 1024 + (m - 1024)).astype(np.uint16)


def _large(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    return np.where(x < 2048, x, (1024 + (x - 2048) % 1024) << np.maximum(0, (x - 2048) // 1024 + 1))


def _least_of(x: np.ndarray) -> np.ndarray:
    """The smallest integer that is rounded up to this 16-bit one."""
    x = x.astype(np.int64)
    return np.where(x < 2049, x, ((1023 + (x - 2048) % 1024) << np.maximum(0, (x - 2048) // 1024 + 1)) + 1)


def _overlap(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Tokens that two sets of these sizes must share."""
    return np.ceil((a + b) * (least / (1 + least)) - 1e-9).astype(np.int64)


def _post(width: int, least: float, sketch, parts: int):
    """Prefix postings of each text, packed by destination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen, held = sketch.value, set(), []
        for batch in batches:
            for _, n, row, h in _token_sets(batch.column(0), width):
                starts, sizes = _bounds(row, n)
                one, _ = _identities(row, h, n)
                known = one.tolist()  # a copy within this partition posts nothing new
                fresh = np.ones(n, bool)
                for i, k in enumerate(known):
                    if k in seen:
                        fresh[i] = False
                    else:
                        seen.add(k)
                if len(seen) > 2_000_000:
                    seen.clear()
                count = rarity.of(h)
                # hashes rise within a row already and a stable sort leaves them so
                order = np.lexsort((np.minimum(count, _CEILING).astype(np.uint16), row))
                h, count = h[order], count[order]
                size = sizes[row]
                pos = np.arange(len(h)) - starts[row]
                bit = ((h >> U(9)) & U(0xFFFF)) * U(96) >> U(16)
                parity = []
                for w in range(2):
                    v = np.where(bit >> U(6) == w, U(1) << (bit & U(63)), U(0))
                    run_ = np.bitwise_xor.accumulate(v) if len(v) else v
                    whole = np.r_[U(0), run_]
                    parity.append(whole[starts[row] + size] ^ run_)
                # as the larger of two texts a prefix reaches furthest; a token seen once has no partner
                take = np.flatnonzero((pos <= size - np.ceil(size * least - 1e-9)) & (count > 1) & fresh[row])
                out = np.empty(len(take), POSTING)
                token = (mix(h[take] ^ U(0xA0761D6478BD642F)) & U(0xFFFFFFFF)).astype(np.uint32)
                r = row[take]
                out["token"], out["text"] = token, (one[r] & U(0xFFFFFFFF)).astype(np.uint32)
                out["size"], out["pos"] = _small(size[take], True), _small(pos[take], False)
                out["p0"], out["p1"] = parity[0][take], parity[1][take]
                held.append(_spread(out, count[take]))
                if sum(map(len, held)) >= _BUFFER:
                    yield from _by_part(np.concatenate(held), parts)
                    held = []
        if held:
            yield from _by_part(np.concatenate(held), parts)

    return run


def _by_part(out: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each part that has postings."""
    part = (mix(out["token"].astype(U)) >> U(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    part, out = part[order], out[order]
    if len(part):
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blobs = [out[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(part)])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array(blobs, pa.binary())], ["part", "postings"])


def _spread(out: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Postings of very long lists, once for each cell (i, j) of groups of texts that the text is in.

    The number of groups follows the token's full count, so a cell holds two groups
    of about ``_LIST`` texts however long the list is.
    """
    long = np.flatnonzero(count > _LIST)
    if not len(long):
        return out
    groups = -(-count[long] // _LIST)
    g = (mix(out["text"][long].astype(U)) % groups.astype(U)).astype(np.int64)
    which = np.repeat(np.arange(len(long)), groups)
    other = np.arange(len(which)) - np.repeat(np.cumsum(groups) - groups, groups)
    g, n = g[which], groups[which]
    cell = np.minimum(g, other) * n + np.maximum(g, other)
    copies = out[long][which]
    copies["token"] = (mix(copies["token"].astype(U) + (cell.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)) & U(0xFFFFFFFF)).astype(np.uint32)
    return np.concatenate([np.delete(out, long), copies])


def _match(least: float):
    """Pairs of texts in a list that pass the size, position and parity bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        held = [np.frombuffer(b.as_py(), POSTING) for batch in batches for b in batch.column(1)]
        if not held:
            return
        post = np.concatenate(held)
        del held
        post = post[np.lexsort((post["text"], post["token"]))]
        keep = np.ones(len(post), bool)
        keep[1:] = (post["token"][1:] != post["token"][:-1]) | (post["text"][1:] != post["text"][:-1])
        again = np.flatnonzero(~keep)
        if len(again):  # one text from several partitions; other texts with its number keep their rows
            same = (post["size"][again] == post["size"][again - 1]) & (post["p0"][again] == post["p0"][again - 1]) & (post["pos"][again] == post["pos"][again - 1])
            keep[again[~same]] = True
        post = post[keep]
        token, text = post["token"].copy(), post["text"].copy()
        size, low, pos = _large(post["size"]), _least_of(post["size"]), _large(post["pos"])
        p0, p1 = post["p0"].copy(), post["p1"].copy()
        live, shift = np.arange(len(post) - 1), 1
        while True:
            live = live[live + shift < len(token)]
            live = live[token[live + shift] == token[live]]
            if not len(live):
                break
            for at in range(0, len(live), 1 << 20):
                i = live[at : at + (1 << 20)]
                j = i + shift
                t = _overlap(low[i], low[j], least)
                spare = size[i] + size[j] - 2 * t - pos[i] - pos[j]
                ok = np.flatnonzero((pos[i] + t <= size[i]) & (pos[j] + t <= size[j]) & (text[i] != text[j]))
                i, j, spare = i[ok], j[ok], spare[ok]
                ok = np.bitwise_count(p0[i] ^ p0[j]).astype(np.int64) + np.bitwise_count(p1[i] ^ p1[j]) <= spare
                a, b = text[i[ok]].astype(np.int64), text[j[ok]].astype(np.int64)
                found.append((np.minimum(a, b) << 32) | np.maximum(a, b))
            shift += 1
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64())], ["pair"])

    return run


def _reach(size: np.ndarray, least: float) -> np.ndarray:
    """Tokens of a prefix that serves for every partner a set of this size can have."""
    return size - np.ceil(size * least - 1e-9).astype(np.int64) + 1


def _pieces(lengths: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` values together."""
    upto, first = np.cumsum(lengths), 0
    while first < len(lengths):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
        yield first, end
        first = end


def _heads(offsets: np.ndarray, values: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of the first ``take`` values of every list."""
    row = np.repeat(np.arange(len(take)), take)
    return row, values[np.repeat(offsets[: len(take)], take) + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)]


def _shared(row_a, a, row_b, b, n: int) -> np.ndarray:
    """How many values two lists of each row have in common; no list holds a value twice."""
    row, v = np.r_[row_a, row_b], np.r_[a, b]
    order = np.lexsort((v, row))
    row, v = row[order], v[order]
    return np.bincount(row[1:][(row[1:] == row[:-1]) & (v[1:] == v[:-1])], minlength=n)


def _sides(batch: pa.RecordBatch, first: int, end: int, columns) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for c in columns:
        part = batch.column(c).slice(first, end - first)
        offsets = part.offsets.to_numpy()
        out.append((offsets - offsets[0], part.flatten().to_numpy()))
    return out


def _meet(least: float):
    """Pairs whose prefixes share a mark under both further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy().astype(np.int64) for c in (2, 3)]
            t = _overlap(*sizes, least)
            keep = np.zeros(batch.num_rows, bool)
            for first, end in _pieces(_reach(sizes[0], least) + _reach(sizes[1], least)):
                take = [np.maximum(0, s[first:end] - t[first:end] + 1) for s in sizes]
                both = np.ones(end - first, bool)
                for columns in ((4, 5), (6, 7)):  # by hash upwards, and downwards
                    lists = _sides(batch, first, end, columns)
                    # marks are short: two tokens of one prefix may have the same
                    heads = [_heads(*x, np.minimum(n, np.diff(x[0]))) for x, n in zip(lists, take)]
                    once = [np.unique(row << 16 | mark.astype(np.int64) & 0xFFFF) for row, mark in heads]
                    both &= _shared(once[0] >> 16, once[0], once[1] >> 16, once[1], end - first) > 0
                keep[first:end] = both
            at = pa.array(np.flatnonzero(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _verify(least: float):
    """The exact similarity of pairs of token sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in (2, 3)]
            n = np.zeros(batch.num_rows, np.int64)
            for first, end in _pieces(sizes[0] + sizes[1]):
                a, b = (_heads(*x, np.diff(x[0])) for x in _sides(batch, first, end, (2, 3)))
                n[first:end] = _shared(*a, *b, end - first)
            every = sizes[0] + sizes[1] - n
            keep = np.flatnonzero((n > 0) & (n >= least * every - 1e-9))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(n[keep] / every[keep], pa.float64())], ["a", "b", "similarity"])

    return run


def _wanted_sets(width: int, wanted, bits: int):
    """``(docs, starts, sizes, hashes)`` of the texts whose identifier may be wanted, each text's hashes upwards."""

    def of(batches: Iterator[pa.RecordBatch]):
        marks = wanted.value
        for batch in batches:
            batch = batch.take(pa.array(in_bitmap(marks, bits, batch.column(0).to_numpy()), pa.int64()))
            for first, n, row, h in _token_sets(batch.column(1), width):
                yield batch.column(0).slice(first, n), *_bounds(row, n), h

    return of


def _prefixes(width: int, least: float, wanted, bits: int):
    """Two-byte marks of the first tokens by hash, and of the last ones, of wanted texts."""
    sets = _wanted_sets(width, wanted, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, sizes, h in sets(batches):
            mark = (mix(h ^ U(0x5851F42D4C957F2D)) & U(0xFFFF)).astype(np.uint16).view(np.int16)
            take = np.minimum(sizes, np.maximum(0, _reach(sizes, least)))
            within = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            offsets = pa.array(np.r_[0, np.cumsum(take)].astype(np.int32))
            up, down = np.repeat(starts, take) + within, np.repeat(starts + sizes - 1, take) - within
            lists = [pa.ListArray.from_arrays(offsets, pa.array(mark[x], pa.int16())) for x in (up, down)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(sizes, pa.int32()), *lists], ["doc", "size", "up", "down"])

    return run


def _sets(width: int, wanted, bits: int):
    """Token sets of wanted texts."""
    sets = _wanted_sets(width, wanted, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, _, h in sets(batches):
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(np.r_[starts, len(h)].astype(np.int32)), pa.array(h.view(np.int64), pa.int64()))], ["doc", "tokens"])

    return run


def near_duplicates(texts: DataFrame, key: str, text: str | Column, width: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of texts whose sets of ``width``-word series have a Jaccard similarity of ``least`` or more.

    ``texts`` has a unique identifier ``key`` (bigint).  A word is a run of a-z
    and 0-9 in the lower-cased text.

    - members ``(doc, class)``: every text; texts with equal sets are one
      class, named by its smallest identifier.  Texts with fewer words than ``width``
      (null and empty ones too) are classes of their own without links.
    - links ``(a, b, similarity)``: each pair of different classes, ``a`` < ``b``,
      that are similar enough.

    Null keys are left out; an empty input gives empty results.
    """
    spark = texts.sparkSession
    column = texts[text] if isinstance(text, str) else text
    rows = texts.select(texts[key].cast("bigint").alias("doc"), F.lower(F.coalesce(column, F.lit(""))).alias("text")).filter("doc is not null")
    n = max(1, rows.count())
    bits = min(_MOST_BITS, max(16, math.ceil(math.log2(n * 32))))
    first = stage(rows.mapInArrow(_first_pass(width, bits), _DOCS))
    docs = first.filter("doc is not null").drop("slice", "counts")
    classes = docs.filter("size > 0").groupBy("h1", "h2").agg(F.min("doc").alias("class"), *(F.first(c).alias(c) for c in ("size", "s0", "s1", "s2", "s3")))
    classes = stage(classes)
    members = docs.filter("size > 0").select("doc", "h1", "h2").join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("doc", "class")
    members = stage(members.unionByName(docs.filter("size = 0").select("doc", F.col("doc").alias("class"))))
    # 2^bits counters come to the driver, slice by slice, whatever the number of texts
    sketch = Sketch(bits)
    for r in first.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect():
        sketch.add(r[0], bytes(r[1]))
    sketch.close()
    discard(first)  # classes, members and sketch hold all that is needed of it
    total = classes.agg(F.sum("size")).first()[0] or 0
    # each text of a long list is in as many cells as the list has groups; but most long lists are in few prefixes
    copies = int((sketch.low[sketch.low > _LIST].astype(np.int64) ** 2 // _LIST).sum() + (sketch.counts**2 // _LIST).sum())
    parts = max(12, math.ceil((total + min(copies, 3 * total)) * (1 - least) / _TASK))
    held = spark.sparkContext.broadcast(sketch)
    postings = rows.select("text").mapInArrow(_post(width, least, held, parts), "part int, postings binary")
    # the part is the number of the partition: one part to a task
    pairs = stage(postings.repartitionById(parts, "part").mapInArrow(_match(least), "pair bigint").distinct())
    # candidates' identifiers are told by a bitmap of eight bits a text, 2^30 at most
    links = _links(rows, classes, pairs, width, least, min(30, max(16, math.ceil(math.log2(n * 8)))))
    return members, links


def _links(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, least: float, bits: int) -> DataFrame:
    number = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    mine = ["class", "size", "s0", "s1", "s2", "s3"]
    side = lambda x: classes.select(number("h1").alias(f"n{x}"), *(F.col(c).alias(f"{c}_{x}") for c in mine))
    named = pairs.select(F.shiftrightunsigned("pair", 32).alias("na"), number("pair").alias("nb"))
    met = named.join(side("a"), "na").join(side("b"), "nb").drop("na", "nb")
    # different texts that happen to have one number
    shared = classes.groupBy(number("h1").alias("na")).agg(F.count("*").alias("texts")).filter("texts > 1").select("na")
    # staged, so that Spark sees how few these are and need not shuffle all texts for them
    clash = stage(side("a").join(stage(shared), "na"))
    same = clash.join(side("b").withColumnRenamed("nb", "na"), "na").filter("class_a < class_b").drop("na")
    met = met.unionByName(same)
    sizes = F.col("size_a") + F.col("size_b")
    apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(4)), F.lit(0))
    share = F.ceil(sizes * (least / (1 + least)) - 1e-9)
    met = met.filter((F.least("size_a", "size_b") >= share) & (apart <= sizes - 2 * share))
    met = stage(met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct())
    # marks of prefixes are shuffled first, then the token sets of what is left, never the texts; what a bitmap lets through in excess falls out of the joins
    texts = lambda df: rows.sparkSession.sparkContext.broadcast(bitmap(df.select(F.explode(F.array("a", "b")).alias("doc")), bits))
    prefix = stage(rows.mapInArrow(_prefixes(width, least, texts(met), bits), "doc bigint, size int, up array<smallint>, down array<smallint>"))
    end = lambda x: prefix.select(F.col("doc").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "up", "down")))
    met = met.join(end("a"), "a").join(end("b"), "b").select("a", "b", "size_a", "size_b", "up_a", "up_b", "down_a", "down_b")
    met = stage(met.mapInArrow(_meet(least), "a bigint, b bigint"))
    sets = stage(rows.mapInArrow(_sets(width, texts(met), bits), "doc bigint, tokens array<bigint>"))
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    return met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(least), "a bigint, b bigint, similarity double")


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of similar texts, copies expanded.  As many rows as the result has pairs."""
    m = lambda x: members.select(F.col("doc").alias(x), F.col("class").alias(f"class_{x}"))
    across = links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")).join(m("a"), "class_a").join(m("b"), "class_b").select("a", "b")
    copies = members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class")
    held = members.join(copies, "class")
    inside = held.select("class", F.col("doc").alias("a")).join(held.select("class", F.col("doc").alias("b")), "class").filter("a < b").select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inside)


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc, class, links)``: every text with its class and the number of similar classes."""
    ends = links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class")))
    return members.join(ends.groupBy("class").agg(F.count("*").alias("links")), "class", "left").select("doc", "class", F.coalesce("links", F.lit(0)).alias("links"))
