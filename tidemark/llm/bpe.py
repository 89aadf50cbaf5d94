"""Byte-level BPE encoding and decoding by a pair occurrence index.

The texts of a batch are split into pre-tokens with array operations. Pre-tokens that this worker has not met are laid
back to back, every adjacent pair of symbols is indexed by its merge rank with all its positions, and the active ranks
are applied in ascending order: all positions of a rank merge together, and the pairs that this makes are added to the
lists of their (always higher) ranks. Known pre-tokens are kept, up to a bound, between the batches of a worker.

Pre-tokens are told apart by their bytes: hashes only group those of a batch, and each one is compared with the first of
its group.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_VALUES, batches, bounded_batches, extended, flat_bytes, prefix_sums, ranges, span_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pre-tokens kept by a worker; beyond that it starts anew.
MOST_WORDS = 500_000


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + more)
            more += 1
    return [out[b] for b in range(256)]


def _character_classes(split) -> np.ndarray:
    """The class of every code point as the tokenizer's own splitter sees it (its Unicode version may differ from Python's).

    Runs of one class by unicodedata are asked for at once, and one by one where the splitter disagrees.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, np.uint8)

    def one_piece(before: str, text: str) -> bool:
        return len(split(before + text)) == 1

    def ask(c: str) -> int:
        return next((k for before, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if one_piece(before, c)), SPACE)

    def settle(first: int, last: int, kind: int) -> None:
        if kind != SPACE and one_piece("a1 !"[kind], "".join(map(chr, range(first, last)))):
            out[first:last] = kind
        elif last - first == 1:
            out[first] = ask(chr(first))
        else:
            mid = (first + last) // 2
            settle(first, mid, kind)
            settle(mid, last, kind)

    first, kind = 0, None
    for cp in range(0x110000 + 1):
        now = None if cp == 0x110000 or 0xD800 <= cp < 0xE000 else SPACE if chr(cp).isspace() else kinds.get(unicodedata.category(chr(cp))[0], OTHER)
        if now != kind or cp - first >= 512:
            if kind is not None:
                settle(first, cp, kind)
            first, kind = cp, now
    return out


def _distinct(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the spans [a, b) that tile data: one index of each distinct span, and which of these each span is."""
    _, which, inverse = np.unique(span_hashes(prefix_sums(BYTE_VALUES[data]), a, b), return_index=True, return_inverse=True)
    first, length = which[inverse], b - a
    bad = length != length[first]
    like = np.where(bad, np.arange(len(a)), first)
    apart = np.flatnonzero(data != data[ranges(a[like], length)])
    if len(apart) or bad.any():  # equal hashes, other bytes
        bad[np.searchsorted(a, apart, side="right") - 1] = True
        more: dict[bytes, int] = {}
        extra = []
        for t in np.flatnonzero(bad).tolist():
            word = data[a[t] : b[t]].tobytes()
            if word not in more:
                more[word] = len(which) + len(more)
                extra.append(t)
            inverse[t] = more[word]
        which = np.concatenate([which, np.array(extra, which.dtype)])
    return which, inverse


class BytePairEncoder:
    """Encoder and decoder of a tokenizers JSON file with byte-level BPE, no normaliser and no prefix space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        characters = _byte_characters()
        back = {c: b for b, c in enumerate(characters)}
        self.byte_ids = np.array([vocab[c] for c in characters], np.int32)
        top = max([*vocab.values(), *(x["id"] for x in file["added_tokens"])])
        self.token_bytes = [b""] * (top + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.special = {x["content"].encode(): x["id"] for x in file["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content
        self.token_text = [str(i) for i in range(top + 1)]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.none = len(merges)
        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = _character_classes(split)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.word_ids, self.word_starts, self.word_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; none for pairs without one or with a separator."""
        keys = left.astype(np.int64) << 20 | np.maximum(right, 0)
        i = np.minimum(np.searchsorted(self.pair_keys, keys), self.none - 1)
        return np.where((self.pair_keys[i] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[i], self.none)

    def merged(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words that lie back to back in data, and how many each has."""
        n = len(lengths)
        ends = np.cumsum(lengths)
        sym = np.full(len(data) + n + 1, -1, np.int32)
        at = np.arange(len(data), dtype=np.int64) + np.repeat(np.arange(1, n + 1), lengths)
        sym[at] = self.byte_ids[data]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        ranks = self._ranks(sym[:-1], sym[1:])
        pairs = np.flatnonzero(ranks < self.none)
        pairs = pairs[np.argsort(ranks[pairs], kind="stable")]
        listed, first = np.unique(ranks[pairs], return_index=True)
        index = {int(r): [pairs[a:b]] for r, a, b in zip(listed, first, [*first[1:], len(pairs)])}
        active = [int(r) for r in listed]  # sorted, so a heap
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            pos = pos[(sym[pos] == a) & (sym[after[pos]] == b)]
            if a == b and len(pos) > 1:  # of overlapping places the leftmost counts
                keep, last = [], -1
                for p, q in zip(pos.tolist(), after[pos].tolist()):
                    if p != last:
                        keep.append(p)
                        last = q
                pos = np.array(keep, np.int64)
            if not len(pos):
                continue
            gone = after[pos]
            right = after[gone]
            sym[pos], sym[gone] = new, -2
            after[pos] = right
            before[right] = pos
            left = before[pos]
            places = np.concatenate([left, pos])
            made = self._ranks(sym[places], sym[after[places]])
            places, made = places[made < self.none], made[made < self.none]
            if len(places):
                order = np.argsort(made, kind="stable")
                places, made = places[order], made[order]
                cut = np.flatnonzero(np.diff(made)) + 1
                for r, p in zip(made[np.concatenate([[0], cut])].tolist(), np.split(places, cut) if len(cut) else [places]):
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(active, r)
        alive = np.flatnonzero(sym >= 0)
        counts = np.diff(np.searchsorted(alive, np.concatenate([[0], ends + np.arange(1, n + 1)])))
        return sym[alive], counts

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts back to back, and where each text's ids start (one more than texts)."""
        try:
            text = data.tobytes().decode()
        except UnicodeDecodeError:  # not text; each bad byte becomes U+FFFD
            texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(starts, starts[1:])]
            data = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            text = data.tobytes().decode()
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.classes[points]
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int8) + (points >= 0x10000), out=offsets[1:])
        forced = np.zeros(len(points) + 1, bool)
        forced[np.searchsorted(offsets, starts)] = True
        specials = []
        for content, i in self.special.items():
            width, p = len(content.decode()), text.find(content.decode())
            while p >= 0:
                if not forced[p + 1 : p + width].any():
                    specials.append((p, p + width, i))
                p = text.find(content.decode(), p + (width if specials and specials[-1][0] == p else 1))
        for a, b, _ in specials:
            forced[a] = forced[b] = True
        begin = np.empty(len(points), bool)
        begin[0] = True
        begin[1:] = kinds[1:] != kinds[:-1]
        begin |= forced[:-1]
        # white space before anything else: its last character stands apart, and a blank goes to what follows
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~forced[1:-1])
        begin[last] = True
        begin[last[points[last] == 0x20] + 1] = False
        for p in np.flatnonzero((points == 0x27) & begin).tolist():  # contractions
            tail = text[p + 1 : p + 3]
            n = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
            if n and tail and not forced[p + 1 : p + 1 + n].any():
                begin[p + 1 : p + 1 + n] = False
                if p + 1 + n < len(points):
                    begin[p + 1 + n] |= kinds[p + 1 + n] == LETTER
        for a, b, _ in specials:
            begin[a + 1 : b] = False
        first = np.flatnonzero(begin)
        a = offsets[first]
        b = np.append(a[1:], len(data))
        which, inverse = _distinct(data, a, b)
        place = self._places([data[i:j].tobytes() for i, j in zip(a[which].tolist(), b[which].tolist())])
        for p, _, i in specials:
            place[inverse[np.searchsorted(first, p)]] = -1 - i
        place = place[inverse]
        fixed = np.where(place < 0, -1 - place, 0).astype(np.int32)
        n = np.where(place < 0, 1, self.word_lengths[np.maximum(place, 0)])
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.word_ids[ranges(self.word_starts[np.maximum(place, 0)], n)]
        for t in np.flatnonzero(place < 0).tolist():
            ids[ends[t]] = fixed[t]
        return ids, ends[np.searchsorted(a, starts)]

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the kept tables have each of these words; new ones are merged and added first."""
        if len(self.known) > MOST_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            ids, counts = self.merged(np.frombuffer(b"".join(new), np.uint8), np.array([len(w) for w in new]))
            base, n = len(self.word_ids), len(self.word_lengths)
            self.word_ids = np.concatenate([self.word_ids, ids])
            self.word_starts = np.concatenate([self.word_starts, base + np.cumsum(counts) - counts])
            self.word_lengths = np.concatenate([self.word_lengths, counts])
            self.known.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a file, once a worker."""
    return BytePairEncoder(path)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """The columns `keep`, and the ids of `text` as array<int> in `out`. Null and empty texts have no ids.

    Rows stay where they are: no shuffle. tokenizer_path is read on the executors.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(*keep).schema, f"{out} array<int>")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for x in batches(frames):
            ids, starts = bpe.encode(*flat_bytes(x.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.ListArray.from_arrays(starts.astype(np.int32), ids)], [*keep, out])

    return df.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The columns `keep`, and the text of the ids, special tokens included, in `out`. Null ids: an empty text."""
    bounded_batches(df.sparkSession)
    schema = extended(df.select(*keep).schema, f"{out} string")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for x in batches(frames):
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array([bpe.decode(i or []) for i in x.column(len(keep)).to_pylist()], pa.string())], [*keep, out])

    return df.select(*keep, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: its number of ids, and digests of the ids and of the text decoded from them, in one pass over the rows.

    n_tokens bigint; ids_sha256 of the decimal ids joined by commas; decoded_sha256 of the decoded text in UTF-8.
    A null text counts as empty; rows that repeat get equal values each.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(key).schema, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for x in batches(frames):
            ids, starts = bpe.encode(*flat_bytes(x.column(1)))
            ids = ids.tolist()
            said, back, done = [], [], {}
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                own = ids[a:b]
                line = ",".join(map(bpe.token_text.__getitem__, own))
                digest = hashlib.sha256(line.encode()).hexdigest()
                if digest not in done:
                    done[digest] = hashlib.sha256(bpe.decode(own).encode()).hexdigest()
                said.append(digest)
                back.append(done[digest])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
