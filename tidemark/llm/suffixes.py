"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

Every string of `length` bytes has a fingerprint that its content alone chooses: the least hash of its windows. Starts that
follow each other and have one fingerprint are a context; a context's bytes hold all its strings. Equal strings have equal
fingerprints, so that a string whose fingerprint is met once is unique, equal contexts are one entry with a count (digests
of 63 bits tell those of a fingerprint apart), and the suffixes of the rest can be dealt to tasks by fingerprint: no string has a partner in another task's share.

A task sorts the suffixes of its contexts by the difference-cover algorithm for triples, over eight-byte characters, so
that eight interleaved texts are sorted at once. The sample of level k are the positions whose index has only non-zero
base-3 digits up to digit k. Going down, triples of level-k names, 8 * 3**k bytes apart, are sorted to give the names of
level k + 1, until a name covers `length` bytes. Going up, the remaining third of each level is merged with the sorted
sample below it, by comparing one name and a rank, or two and a rank. Neighbours in the final order compare their prefixes
of `length` bytes, byte by byte.

Memory of a task is bounded by PACK and HEAVY, whatever a partition holds. A fingerprint with more than HEAVY different
contexts (a frequent line in ever other surroundings) is split by the whole string instead: each of its strings is a
context of its own, told apart by a 128-bit digest and counted with partial aggregation, so that no task has the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_VALUES, batches, bounded_batches, flat_bytes, numbered, powers, prefix_sums, ranges, removed, mixed, stored

#: Bytes that a task sorts at once, about: small enough for the processor's cache, and for a name or two beside an index in 64 bits.
PACK = 60_000
#: Different contexts of a fingerprint that are sorted together: less than 2**20 bytes, so that three names have 63 bits at most.
HEAVY = 2048
#: Bytes of a character, and of the windows that fingerprints hash.
CHAR, WIDTH = 8, 64


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a text."""
    m = len(data) - width + 1
    sums = prefix_sums(BYTE_VALUES[data])
    return mixed((sums[width:] - sums[:m]) * powers(m)[0])


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` neighbours."""
    n, size = len(hashes) - span + 1, 1
    while 2 * size <= span:
        hashes = np.minimum(hashes[:-size], hashes[size:])
        size *= 2
    return np.minimum(hashes[:n], hashes[span - size : span - size + n])


def contexts(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first start and number of starts of a text's contexts, in order, and whether the fingerprint's window is
    met again in the text, as it is where a context itself repeats a string. A context has bounded size."""
    span = length - width + 1
    hashes = _windows(data, width)
    least = _least(hashes, span)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(first, len(least)))
    low = np.sort(hashes[hashes <= least[first].max()])
    twice = low[1:][low[1:] == low[:-1]]
    if n.max() > span:  # periodic text
        parts = -(-n // span)
        inside = ranges(np.zeros(len(n), np.int64), parts)
        first = np.repeat(first, parts) + inside * span
        n = np.minimum(span, np.repeat(n, parts) - inside * span)
    fp = least[first]
    return fp, first, n, np.isin(fp, twice) if len(twice) else np.zeros(len(fp), bool)


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys (of so many bits) and the sorted keys; where there is room, the index rides in the key, as sorting
    plain numbers is several times faster."""
    own = max(1, int(len(keys) - 1).bit_length())
    if bits + own <= 64:
        both = np.sort(keys << np.uint64(own) | np.arange(len(keys), dtype=np.uint64))
        return (both & np.uint64((1 << own) - 1)).astype(np.int64), both >> np.uint64(own)
    order = np.argsort(keys)
    return order, keys[order]


def _dense(keys: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Ranks from 1, equal keys having equal ranks, and the bits of the largest."""
    order, ahead = _sorted(keys, bits)
    new = np.ones(len(keys), np.uint64)
    new[1:] = ahead[1:] != ahead[:-1]
    new = np.cumsum(new)
    out = np.empty(len(keys), np.uint64)
    out[order] = new
    return out, int(new[-1]).bit_length() if len(new) else 1


def _joined(bits: int, *parts: np.ndarray) -> np.ndarray:
    """Numbers of so many bits in one, the most significant first."""
    out = parts[0]
    for p in parts[1:]:
        out = out << np.uint64(bits) | p
    return out


def _merged(rest: np.ndarray, sample: np.ndarray, step: int, names: np.ndarray, ranks: np.ndarray, bits: int) -> np.ndarray:
    """A level's positions in the order of their suffixes: rest, of digit 0, merged into the sorted sample.

    names of the level and unique ranks of its sample are by position, of so many bits, with zeros behind the text. A
    position of rest goes behind those of digit 1 and of digit 2 that are less.
    """
    digit = sample // step % 3
    one, two = sample[digit == 1], sample[digit == 2]
    order, near = _sorted(_joined(bits, names[rest], ranks[rest + step]), 2 * bits)
    rest = rest[order]
    place = np.searchsorted(np.sort(_joined(bits, names[one], ranks[one + step])), near)
    far = lambda p: _joined(bits, names[p], names[p + step], ranks[p + 2 * step])
    place += np.searchsorted(np.sort(far(two)), far(rest))
    place = np.maximum.accumulate(place) + np.arange(len(rest))
    out = np.empty(len(rest) + len(sample), np.int64)
    free = np.ones(len(out), bool)
    free[place] = False
    out[place] = rest
    out[free] = sample
    return out


def _characters(data: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, int]:
    """By position: the next CHAR bytes as a number, with `pad` zeros behind; the same in the alphabet of data, and its bits."""
    padded = np.zeros(len(data) + CHAR + pad, np.uint8)
    padded[: len(data)] = data
    chars = np.ndarray((len(data) + pad,), ">u8", padded.data, 0, (1,)).astype(np.uint64)
    used = np.zeros(256, bool)
    used[padded] = True
    width = max(1, int(used.sum() - 1).bit_length())
    if width * CHAR + int(len(data)).bit_length() > 64:
        return chars, chars[: len(data)], 64
    codes = (np.cumsum(used) - 1).astype(np.uint64)[padded]
    short = codes[: len(data)].copy()
    for i in range(1, CHAR):
        short = short << np.uint64(width) | codes[i : i + len(data)]
    return chars, short, width * CHAR


def suffix_order(data: np.ndarray, index: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All starts in the order of their strings of `length` bytes, and the characters of data by position.

    data: contexts back to back; index: a position's place in its context, size: how many starts its context has. What
    comes behind a string decides nothing but the order of equal strings. Less than 2**21 bytes.
    """
    n = len(data)
    steps = [CHAR, 3 * CHAR]
    while steps[-1] < length:
        steps.append(3 * steps[-1])
    pad = 3 * steps[-1]
    chars, short, bits = _characters(data, pad)
    most = max(1, n.bit_length())  # of a name or rank, at least

    def spread(places: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(n + pad, np.uint64)
        out[places] = values
        return out

    places, names = [np.arange(n)], []
    for step in [0, *steps[:-1]]:  # down: sort the sampled triples, and go on with their names
        if step:
            p = places[-1]
            p = p[p // step % 3 != 0]
            own, bits = names[-1], 3 * bits
            short = _joined(bits // 3, own[p], own[p + step], own[p + 2 * step])
            places.append(p)
        short, bits = _dense(short, bits)
        names.append(spread(places[-1], short))
    # only what the level above asks for is merged: so many bytes behind the last start
    ahead = [0]
    for step in steps[:-1]:
        ahead.append(ahead[-1] + 2 * step)
    order = places[-1][_sorted(short, bits)[0]]
    for k in range(len(steps) - 2, -1, -1):  # up: merge what is no sample
        ranks = spread(order, np.arange(1, len(order) + 1, dtype=np.uint64))
        p = places[k]
        rest = p[(p // steps[k] % 3 == 0) & (index[p] < size[p] + ahead[k])]
        order = _merged(rest, order[index[order] < size[order] + ahead[k]], steps[k], names[k], ranks, most)
    return order, chars


def repeated_starts(data: np.ndarray, sizes: np.ndarray, starts_of: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Positions of contexts back to back (bytes, starts, and copies of each) at which a repeated string begins, sorted."""
    begin = np.cumsum(sizes) - sizes
    context = np.repeat(np.arange(len(sizes)), sizes)
    index = np.arange(len(data)) - begin[context]
    starts = ranges(begin, starts_of)
    order, chars = suffix_order(data, index, starts_of[context], length)
    a, b = order[:-1], order[1:]
    for at in [*range(0, length - CHAR, CHAR), length - CHAR]:  # adjacent prefixes, as bytes
        same = chars[a + at] == chars[b + at]
        a, b = a[same], b[same]
    hit = np.zeros(len(data), bool)
    hit[a] = hit[b] = True
    hit[starts[counts[context[starts]] > 1]] = True
    return np.flatnonzero(hit)


def _solve(frames: Iterator[pa.RecordBatch], length: int, pack: int) -> Iterator[pa.RecordBatch]:
    """(id, a, b) of the spans that repeated strings cover, from contexts (fp, id, a, n, k, bytes) sorted by fingerprint."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        data, ends = flat_bytes(table.column("bytes"))
        first, own, n, k = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "id", "n", "k"))
        hit = repeated_starts(data, np.diff(ends), n, k, length)
        context = np.searchsorted(ends, hit, side="right") - 1
        cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(hit)), bool), (np.diff(hit) != 1) | (np.diff(context) != 0)]))
        last = np.append(cut[1:], len(hit))[: len(cut)] - 1
        start = first[context] + hit - ends[context]
        return pa.RecordBatch.from_arrays([pa.array(own[context[cut]]), pa.array(start[cut].astype(np.int32)), pa.array((start[last] + length).astype(np.int32))], ["id", "a", "b"])

    held: list[pa.RecordBatch] = []
    for x in batches(frames):
        keys = x.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        _, at = flat_bytes(x.column(5))
        done, size = 0, sum(h.column(5).nbytes for h in held)
        for a, b in zip(cuts, cuts[1:]):
            new = a > 0 or not held or held[-1].column(0)[-1].as_py() != keys[0]
            if new and size + int(at[a] - at[done]) > pack:
                yield solved(pa.Table.from_batches([*held, x.slice(done, a - done)]))
                held, size, done = [], 0, a
        held.append(x.slice(done))
    if held:
        yield solved(pa.Table.from_batches(held))


def repeated_spans(texts: DataFrame, length: int = 200, width: int = WIDTH, heavy: int = HEAVY, pack: int = PACK) -> DataFrame:
    """(id, spans): of each text (id bigint unique, text binary) in which strings repeat, the sorted spans (a, b) that they
    cover; spans may touch or overlap. A stored table."""
    spark = texts.sparkSession
    width = min(width, length)

    def marks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            data, starts = flat_bytes(x.column(1))
            whole, found, digests, none = data.tobytes(), [], [], tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, bool))
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                own = contexts(data[a:b], length, width) if b - a >= length else none
                first = a + own[1]
                digests += [_digest(whole[i:j], 8) for i, j in zip(first.tolist(), (first + own[2] + length - 1).tolist())]
                found.append(own)
            fp, first, n, twice = (np.concatenate(c) for c in zip(*found))
            ctx = np.frombuffer(b"".join(digests), np.uint64) >> np.uint64(1)
            ctx = np.where(twice, ~ctx, ctx)  # negative: may repeat a string in itself
            ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
            columns = [fp.view(np.int64), ctx.view(np.int64), first.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns)], ["id", "fp", "ctx", "a", "n"])

    marked, marked_path = stored(texts.mapInArrow(marks, "id bigint, fp array<bigint>, ctx array<bigint>, a array<int>, n array<int>").filter("size(fp) > 0"))
    each = marked.select("id", F.inline(F.arrays_zip("fp", "ctx", "a", "n")))
    often = marked.select(F.inline(F.arrays_zip("fp", "ctx"))).groupBy("fp").agg(F.count("*").alias("t"), F.min("ctx").alias("low"), F.max("ctx").alias("high")).filter("t > 1 or low < 0")
    again, again_path = stored(often.select("fp", F.expr("low < high or low < 0").alias("several")))
    met, met_path = stored(each.join(again.hint("merge"), "fp"))  # what grows with the table is never broadcast
    removed(spark, marked_path, again_path)
    # equal contexts are one entry: that of the smallest id, with their number
    kinds, kinds_path = stored(met.filter("several").groupBy("fp", "ctx").agg(F.count("*").alias("k"), F.min("id").alias("id"), F.min_by("a", "id").alias("a"), F.max("n").alias("n")))
    dense, dense_path = stored(kinds.groupBy("fp").agg(F.count("*").alias("d")).filter(F.col("d") > heavy).select("fp"))
    some_heavy = not dense.isEmpty()

    span = lambda a, n: F.struct(F.col(a).alias("a"), (F.col(a) + F.col(n) + F.lit(length - 1)).cast("int").alias("b"))
    copied = met.filter("not several").select("id", span("a", "n").alias("s"))
    copied = copied.union(met.filter("several").join(kinds.filter("k > 1").select("fp", "ctx").hint("merge"), ["fp", "ctx"], "left_semi").select("id", span("a", "n").alias("s")))

    def with_bytes(entries: DataFrame, run, schema: str) -> DataFrame:
        by_text = entries.groupBy("id").agg(F.collect_list(F.struct("fp", "a", "n", "k")).alias("e"))
        return texts.join(by_text.hint("merge"), "id").select("id", "text", "e.fp", "e.a", "e.n", "e.k").mapInArrow(run, schema)

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            lists = [x.column(i) for i in range(2, 6)]
            per_row = np.diff(lists[0].offsets.to_numpy())
            fp, a, n, k = (c.flatten() for c in lists)
            text = np.repeat(np.arange(x.num_rows), per_row)
            data, starts = flat_bytes(x.column(1))
            whole, first = data.tobytes(), starts[text] + a.to_numpy()
            parts = [whole[i:j] for i, j in zip(first.tolist(), (first + n.to_numpy() + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([fp, x.column(0).take(pa.array(text)), a, n, k, pa.array(parts, pa.binary())], ["fp", "id", "a", "n", "k", "bytes"])

    def strings(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in cut(frames):
            out = [(d, i, a + j, k) for i, a, n, k, b in zip(*(x.column(c).to_pylist() for c in range(1, 6))) for j in range(n) for d in [_digest(b[j : j + length], 16)]]
            d, i, a, k = zip(*out)
            h = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(i, pa.int64()), pa.array(a, pa.int32()), pa.array(k, pa.int64())], ["h1", "h2", "id", "a", "k"])

    light = kinds.join(dense, "fp", "left_anti") if some_heavy else kinds
    dealt = with_bytes(light, cut, "fp bigint, id bigint, a int, n int, k bigint, bytes binary")
    solved = dealt.repartition("fp").sortWithinPartitions("fp").mapInArrow(lambda f: _solve(f, length, pack), "id bigint, a int, b int").select("id", F.struct("a", "b").alias("s"))
    spans, extra_path = copied.union(solved), ""
    if some_heavy:
        single, extra_path = stored(with_bytes(kinds.join(dense, "fp", "left_semi"), strings, "h1 bigint, h2 bigint, id bigint, a int, k bigint"))
        twice = single.groupBy("h1", "h2").agg(F.sum("k").alias("m")).filter("m > 1")
        spans = spans.union(single.join(twice, ["h1", "h2"], "left_semi").select("id", F.struct("a", (F.col("a") + F.lit(length)).cast("int").alias("b")).alias("s")))
    out, _ = stored(spans.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("spans")))
    removed(spark, met_path, kinds_path, dense_path, extra_path)
    return out


def repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200, with_text: bool = False) -> DataFrame:
    """One row per row of df: key, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept (string).

    A byte of a text's UTF-8 is removed if a string of `length` bytes that covers it also starts anywhere else in the
    table, the same text included. Strings are judged on the input. Null and empty texts have no bytes. key: int or
    bigint; rows without a key, and rows that repeat one, are texts of their own. A character that is removed in part
    loses its other bytes in `kept` (not in the digest). length: 8 at least.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    rows, _ = numbered(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")), "key")
    spans = repeated_spans(rows.select(F.col("_row").alias("id"), "text"), length)
    schema = f"{key} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            out = []
            for t, a, b in zip(x.column(1), x.column(2), x.column(3)):
                t = t.as_py()
                kept, n, at = [], 0, 0
                if a.is_valid:
                    for first, end in zip(a.values.to_pylist(), b.values.to_pylist()):
                        if first > at or not n:
                            kept.append(t[at:first])
                            n += 1
                        at = max(at, end)
                kept = b"".join([*kept, t[at:]])
                out.append((len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else ""))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[: 4 + with_text]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(v, k) for v, k in zip(zip(*out), kinds))], names)

    joined = rows.join(spans.withColumnRenamed("id", "_row").hint("merge"), "_row", "left")
    return joined.select("key", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b")).mapInArrow(cut, schema)
