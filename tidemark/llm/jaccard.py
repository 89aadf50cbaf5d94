"""Exact self-join of shingle sets by Jaccard similarity, with set relations used to skip work.

Texts of equal sets are one class. Highly similar sets are found first: MinHash bands name a leader for each bucket, and
members are verified against it exactly. A member that is no partner of its leader gets its overlaps with the leader's
partners incrementally, from the leader's overlap and the few shingles in which a partner differs from the leader. What
is linked then is one component, inside which no pair needs an answer any more.

The rest of the pairs is found exactly, by prefix filtering: under one global order of shingles (frequent ones last, by
a bounded table of hints that only affects speed) two sets over the threshold share a shingle in their prefixes. Each
shingle's index list is ordered by set size and position and cut into blocks; a pair of blocks is skipped as a whole
where its sizes, or the shingles left after its positions, cannot reach the needed overlap, or where it is of one
component. Candidates are verified exactly.

Postings travel as packed arrays, one row per batch and bucket of shingles, so that a posting costs bytes and no rows. The
number of buckets follows the number of postings, and the list of a frequent shingle is dealt to tiles: its sets are dealt to
parts, and each pair of parts has a list of its own in some bucket. No pair inside a component is made, texts are shuffled
only where a set takes part in a step, and groups around a leader are cut into chunks of a bounded number of members.

Shingles are told apart by 64-bit hashes, made from the words' bytes by mixing that is not linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, bounded_batches, flat_bytes, groups_of, mixed, numbered, ranges, removed, stored
from tidemark.llm.components import components

#: Frequent shingles that every task knows: only their place in the global order depends on it.
HINTS = 1 << 18
#: Shingles of a stretch of rows that are counted together for the hints.
COUNTED = 3_000_000
#: Postings of a bucket, about, and sets of a part of a frequent shingle's list.
POSTINGS, PART = 300_000, 1 << 14
#: Candidate pairs that a task holds.
HELD = 500_000
#: Members of a leader that are verified together, and entries of an index block.
CHUNK, BLOCK = 256, 256
BANDS, BAND_WIDTH = 8, 3
_SEEDS = mixed(np.arange(1, BANDS * BAND_WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [at, ends) of data: of up to 16 bytes from these as two numbers, of more by xxh3."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), ">u8", padded.data, 0, (1,))
    n = (ends - at).astype(np.uint64)
    first = eight[at].astype(np.uint64) >> (np.uint64(64) - np.uint64(8) * np.minimum(n, np.uint64(8)))
    with np.errstate(over="ignore"):
        out = mixed(mixed(first + n * np.uint64(0x9E3779B97F4A7C15)))
        more = np.flatnonzero(n > 8)
        rest = eight[at[more] + 8].astype(np.uint64) >> (np.uint64(64) - np.uint64(8) * np.minimum(n[more] - np.uint64(8), np.uint64(8)))
        out[more] = mixed(out[more] + rest)
    long = np.flatnonzero(n > 16)
    if len(long):
        whole = data.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(at[long].tolist(), ends[long].tolist())]
    return out


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, from hashes of the words."""
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mixed(out + words[i : i + n])
    return out


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a batch.

    Words are runs of bytes other than blanks, A-Z lower-cased. A text of fewer words than `width` has its whole word
    sequence as its one shingle; without words it has none.
    """
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(starts) - 1)
    data = np.frombuffer(data.tobytes().lower(), np.uint8)  # bytes: A-Z only
    edge = np.ones(len(data) + 1, bool)
    blank = _BLANK[data]
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[starts] = True
    at = np.flatnonzero(edge)
    at, ends = at[:-1], at[1:]
    word = ~blank[at]
    at, ends = at[word], ends[word]
    words = _word_hashes(data, at, ends)
    first = np.searchsorted(at, starts)
    grams = _shingles(words, width) if len(words) >= width else words
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        own = grams[a : b - width + 1] if b - a >= width else _shingles(words[a:b], b - a) if b > a else words[a:b]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    i = np.searchsorted(y, x)
    return int((y[np.minimum(i, len(y) - 1)] == x).sum())


def _described(df: DataFrame, key: str, text: str, width: int, kind: str) -> DataFrame:
    """kind 0: a row of df, its set's size, digest and band keys; kind 1: a shingle and in how many sets of a stretch of rows it is."""

    def often(held: list[np.ndarray], like: pa.DataType) -> pa.RecordBatch:
        shingles, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts > 1
        k = int(many.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.nulls(k, like), pa.array(counts[many]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(shingles[many].astype(np.int64))], ["kind", "id", "n", "h1", "h2", "bands", "shingle"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        like, size = None, 0
        for x in batches(frames):
            like = x.column(0).type
            sets = shingle_sets(*flat_bytes(x.column(1)), width)
            digest = np.zeros((len(sets), 2), np.int64)
            bands: list = [None] * len(sets)
            for i, s in enumerate(sets):
                if len(s):
                    digest[i] = np.frombuffer(xxhash.xxh3_128_digest(s), np.int64)
                    with np.errstate(over="ignore"):
                        least = (s[None, :] * _SEEDS[:, None]).min(axis=1).reshape(BANDS, BAND_WIDTH)
                        bands[i] = mixed(least[:, 0] + mixed(least[:, 1] + mixed(least[:, 2]))).astype(np.int64)
            null = np.array([not len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int8)), x.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0], mask=null), pa.array(digest[:, 1], mask=null), pa.array(bands, pa.list_(pa.int64())), pa.nulls(len(sets), pa.int64())],
                ["kind", "id", "n", "h1", "h2", "bands", "shingle"],
            )
            held += sets
            size += sum(map(len, sets))
            if size > COUNTED:
                yield often(held, like)
                held, size = [], 0
        if held:
            yield often(held, like)

    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"kind tinyint, id {kind}, n bigint, h1 bigint, h2 bigint, bands array<bigint>, shingle bigint")


def _reaches(shared, x, y, percent: int):
    """Whether sets of sizes x and y with so many shared shingles are at least `percent` alike."""
    return 100 * shared >= percent * (x + y - shared)


def verified(links: DataFrame, texts: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """The links (a, b) of (leader, member) pairs that hold, and those that leaders' answers give for other members.

    texts: (id, text). Members of a leader are verified in chunks; each chunk has the leader's text.
    """
    counts = links.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = links.join(counts, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int").alias("chunk"), F.col("member").alias("id"), F.lit(1).alias("role"))
    leaders = counts.select("leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("id"), F.lit(0).alias("role"))
    rows = members.union(leaders).join(texts, "id").select(F.concat_ws("/", "leader", "chunk").alias("gid"), "role", "id", F.col("text").cast("binary").alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(frames):
            ids = g.column("id").combine_chunks()
            sets = shingle_sets(*flat_bytes(g.column("text")), width)
            x, found = sets[0], []
            partners, others = [], []
            for i, y in enumerate(sets[1:], 1):
                shared = overlap(x, y)
                if _reaches(shared, len(x), len(y), percent):
                    found.append((0, i))
                    partners.append((len(y), i, np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)))
                else:
                    others.append((shared, i))
            for shared, i in others:  # derived from the leader's answer
                y = sets[i]
                for n, j, more, less in partners:
                    if _reaches(min(n, len(y), shared + len(more)), n, len(y), percent) and _reaches(shared - overlap(less, y) + overlap(more, y), n, len(y), percent):
                        found.append((j, i))
                        break
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    return rows.repartition("gid").sortWithinPartitions("gid", "role").mapInArrow(run, f"a {kind}, b {kind}")


def _tiled(tokens: np.ndarray, doc: np.ndarray, position: np.ndarray, ids: np.ndarray, known: np.ndarray, weight: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings, those of frequent shingles once for each part of the shingle's list: two sets meet in the tile of their parts."""
    if not len(known) or not len(tokens):
        return tokens, doc, position
    i = np.minimum(np.searchsorted(known, tokens.view(np.int64)), len(known) - 1)
    parts = np.where(known[i] == tokens.view(np.int64), -(-weight[i] // part), 1)
    heavy = np.flatnonzero(parts > 1)
    if not len(heavy):
        return tokens, doc, position
    each = np.repeat(heavy, parts[heavy])
    own = (mixed(ids[doc[each]].view(np.uint64)) % parts[each].astype(np.uint64)).astype(np.int64)
    other = ranges(np.zeros(len(heavy), np.int64), parts[heavy])
    with np.errstate(over="ignore"):
        tile = mixed(tokens[each] + mixed((np.minimum(own, other) << 32 | np.maximum(own, other)).view(np.uint64) + np.uint64(1)))
    light = parts == 1
    return np.concatenate([tokens[light], tile]), np.concatenate([doc[light], doc[each]]), np.concatenate([position[light], position[each]])


def _postings(reps: DataFrame, hints: np.ndarray, buckets: int, width: int, percent: int) -> DataFrame:
    """Packed postings of the sets' prefixes: (bucket, shingle, id, component, size, position), each but bucket an array."""
    known, order = np.sort(hints[:, 0]), np.argsort(hints[:, 0], kind="stable")
    weight = hints[order, 1]
    shared = reps.sparkSession.sparkContext.broadcast((known, weight))  # at most HINTS rows

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for x in batches(frames):
            sets = shingle_sets(*flat_bytes(x.column(2)), width)
            parts, sizes = [], np.array([len(s) for s in sets])
            for s in sets:
                keep = len(s) - -(-percent * len(s) // 100) + 1
                if len(known) and len(s):
                    i = np.minimum(np.searchsorted(known, s.astype(np.int64)), len(known) - 1)
                    often = np.where(known[i] == s.astype(np.int64), weight[i], 0)
                    s = s[np.argsort(often, kind="stable")]
                parts.append(s[:keep] if len(s) else s)
            n = np.array([len(p) for p in parts])
            tokens = np.concatenate(parts)
            doc = np.repeat(np.arange(len(sets)), n)
            position = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
            ids, comps = (x.column(k).cast(pa.int64()).to_numpy() for k in (0, 1))
            tokens, doc, position = _tiled(tokens, doc, position, ids, known, weight, PART)
            bucket = (tokens >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[by], return_index=True)
            columns = [tokens[by], ids[doc[by]], comps[doc[by]], sizes[doc[by]].astype(np.int32), position[by].astype(np.int32)]
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(by)]))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for c in columns)], ["bucket", "shingle", "id", "component", "size", "position"])

    return reps.select("id", "component", F.col("text").cast("binary")).mapInArrow(run, "bucket int, shingle binary, id binary, component binary, size binary, position binary")


def _possible(size_x, pos_x, size_y, pos_y, percent: int):
    """Whether a shared shingle at these positions, if it is the first that two sets share, leaves room for the overlap."""
    room = np.minimum(size_x - pos_x, size_y - pos_y)  # this shingle and all after it
    return (100 + percent) * room >= percent * (size_x + size_y)


def _list_pairs(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, positions: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one index list, sorted by size and position, block by block."""
    cuts = range(0, len(ids), BLOCK)
    facts = [(sizes[a], sizes[min(a + BLOCK, len(ids)) - 1], (sizes[a : a + BLOCK] - positions[a : a + BLOCK]).max(), comps[a : a + BLOCK].min(), comps[a : a + BLOCK].max()) for a in cuts]
    for i, a in enumerate(cuts):
        low, high, room, least, most = facts[i]
        for j, b in enumerate(cuts[i:], i):
            low2, high2, room2, least2, most2 = facts[j]
            if percent * low2 > 100 * high:  # later blocks hold larger sets only
                break
            if least == most == least2 == most2 or (100 + percent) * min(room, room2) < percent * (low + low2):
                continue
            x, y = slice(a, a + BLOCK), slice(b, b + BLOCK)
            good = (comps[x, None] != comps[None, y]) & _possible(sizes[x, None], positions[x, None], sizes[None, y], positions[None, y], percent) & (100 * sizes[x, None] >= percent * sizes[None, y])
            if i == j:
                good &= np.arange(good.shape[0])[:, None] < np.arange(good.shape[1])[None, :]
            p, q = np.nonzero(good)
            if len(p):
                yield ids[a + p], ids[b + q]


def _candidates(postings: DataFrame, buckets: int, percent: int, kind: str) -> DataFrame:
    """Pairs (leader, member) of different components that share a prefix shingle and pass the filters."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(frames):
            token, ids, comps = (np.frombuffer(b"".join(g.column(c).to_pylist()), t) for c, t in (("shingle", np.uint64), ("id", np.int64), ("component", np.int64)))
            sizes, positions = (np.frombuffer(b"".join(g.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("size", "position"))
            order = np.argsort(token)
            sorted_token = token[order]
            same = sorted_token[1:] == sorted_token[:-1]
            keep = np.zeros(len(order), bool)
            keep[1:] |= same
            keep[:-1] |= same
            order = order[keep]
            order = order[np.lexsort((positions[order], sizes[order], token[order]))]
            if not len(order):
                continue
            token, ids, comps, sizes, positions = token[order], ids[order], comps[order], sizes[order], positions[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            ends = np.append(first[1:], len(token))
            mixed_lists = np.minimum.reduceat(comps, first) != np.maximum.reduceat(comps, first)
            first, ends = first[mixed_lists], ends[mixed_lists]
            two = first[ends - first == 2]
            two = two[_possible(sizes[two], positions[two], sizes[two + 1], positions[two + 1], percent) & (100 * sizes[two] >= percent * sizes[two + 1])]
            found, held = [(ids[two], ids[two + 1])], len(two)
            for a, b in zip(first[ends - first > 2].tolist(), ends[ends - first > 2].tolist()):
                for pair in _list_pairs(ids[a:b], comps[a:b], sizes[a:b], positions[a:b], percent):
                    found.append(pair)
                    held += len(pair[0])
                    if held > HELD:
                        yield from pairs(found)
                        found, held = [], 0
            yield from pairs(found)

    def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if sum(len(a) for a, _ in found):
            a, b = (np.concatenate([p[k] for p in found]) for k in (0, 1))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["leader", "member"])

    return postings.repartition(max(buckets, 1), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "leader bigint, member bigint").distinct().select(F.col("leader").cast(kind), F.col("member").cast(kind))


def _hints(counted: DataFrame) -> tuple[np.ndarray, str]:
    """(shingle, count) of the most frequent shingles, at most HINTS of them: all those above a count that sizes by octave eighths give."""
    counts, path = stored(counted.groupBy("shingle").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    total, least = 0, 1 << 30
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # at most 512 rows
        total += r["count"]
        if total > HINTS:
            break
        least = r["level"]
    found = counts.filter(F.col("level") >= least).select("shingle", "n").toArrow()
    return np.stack([found.column(0).to_numpy(), found.column(1).to_numpy()], axis=1), path


def similar_components(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75, width: int = 5) -> DataFrame:
    """One row per row of df: key, n_shingles (its set's size), component_id (smallest key reachable by links).

    Two rows link where 100 * intersection >= percent * union of their sets of distinct `width`-word shingles. Null and
    empty texts, and those without words, have empty sets and link with nothing. key: int or bigint; rows without a key and
    rows that repeat one are texts of their own (a component of rows without keys has a null id).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    rows, odd = numbered(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    found = _components(rows.select("_row", "text"), percent, width)
    if odd is None:
        return found.select(F.col("_row").cast(kind).alias(key), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
    found = found.join(odd.select("_row", F.lit(True).alias("odd"), "key"), "_row", "left").select("component_id", "n_shingles", F.when(F.col("odd"), F.col("key")).otherwise(F.col("_row").cast(kind)).alias(key))
    least = found.groupBy("component_id").agg(F.min(key).alias("least"))
    return found.join(least, "component_id").select(key, "n_shingles", F.col("least").alias("component_id"))


def _components(df: DataFrame, percent: int, width: int) -> DataFrame:
    """(_row, n_shingles, component_id) of df (_row bigint, unique; text)."""
    spark, key, text, kind = df.sparkSession, "_row", "text", "bigint"
    described, path = stored(_described(df, key, text, width, kind))
    rows = described.filter("kind = 0")
    classes, classes_path = stored(rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("n").alias("n")))
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    by_id = lambda ids: texts.join(ids.hint("merge"), "id", "left_semi")  # noqa: E731  ids grow with the table: never broadcast

    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    led = banded.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count("*").alias("m")).filter("m > 1").drop("m")
    similar, similar_path = stored(banded.join(led, ["band", "key"]).filter("id <> leader").select("leader", F.col("id").alias("member")).distinct())
    needed = similar.select(F.col("leader").alias("id")).union(similar.select("member")).distinct()
    chosen, chosen_path = stored(by_id(needed))
    close, close_path = stored(verified(similar, chosen, width, percent, kind))
    removed(spark, similar_path, chosen_path)
    joined, joined_path = components(close)

    hints, hints_path = _hints(described.filter("kind = 1"))
    removed(spark, hints_path)
    reps = classes.select("id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component_id", "id").alias("component")).hint("merge").join(texts, "id")
    total = classes.agg(F.coalesce(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / POSTINGS))
    pairs, pairs_path = stored(_candidates(_postings(reps, hints, buckets, width, percent), buckets, percent, kind))
    removed(spark, joined_path)
    needed = pairs.select(F.col("leader").alias("id")).union(pairs.select("member")).distinct()
    chosen, chosen_path = stored(by_id(needed))
    links, links_path = stored(close.union(verified(pairs, chosen, width, percent, kind)))
    removed(spark, pairs_path, chosen_path, close_path)
    found, _ = components(links)  # stays with the result
    removed(spark, links_path)
    of_class = classes.select("h1", "h2", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", F.coalesce("component_id", "id").alias("component_id"))
    return rows.select("id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
