"""Operators that compare rows, against brute force: vectors, shingle sets, suffixes, packing, and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, jaccard, packing, suffixes
from tidemark.llm.components import components
from tidemark.llm.queries import TOKENIZER


def united(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, random.randrange(101, 150)) for _ in range(30)] + [(7, 7), (200, 199), (200, 199), (None, 3)]
    found, _ = components(spark.createDataFrame(links, "a bigint, b bigint"))
    want = united(range(300), [x for x in links if None not in x])
    got = {r.node: r.component_id for r in found.collect()}
    assert {n: got.get(n, n) for n in range(300)} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"))[0].collect() == []


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # so that buckets take several tiles
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    rows = []
    for i in range(300):
        v = base[i % 20] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] * 16, 0), (305, rows[0][1], None), (306, rows[0][1], 0), (307, [2 * x for x in rows[0][1]], 0), (308, [1.0, 0.0], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, c string")).collect()}
    links = []
    good = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links.append((a[0], b[0]))
    counts = collections.Counter(x for link in links for x in link)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= counts[i] for i in got) and found >= 0.98 * sum(counts.values())
    parts = united(got, links)
    assert sum(got[i].component_id == parts[i] for i in got) >= 0.98 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def documents(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    random.seed(5)
    base = [t.split() for _, t in rows[:5]]
    for k in range(60):
        words = list(base[k % 5])[:150]
        for _ in range(random.randrange(8)):
            words[random.randrange(len(words))] = f"w{k}"
        rows.append((1000 + k, " ".join(words)))
    shared = " ".join(f"p{i}" for i in range(70))
    rows += [(2000 + k, " ".join(f"own{k}x{j}" for j in range(random.randrange(30, 60))) + " " + shared) for k in range(40)]
    return rows + list(enumerate([None, "", " \n", "A", "a", "one two three four", "x" * 5000, "ab " * 3000], 3000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int, id string, kind int")


def test_jaccard_components(spark):
    rows = documents(spark)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(table(spark, rows)).collect()}
    parts = united(sets, links)
    assert got == {i: (len(s), parts[i]) for i, s in sets.items()}
    assert jaccard.similar_components(table(spark, [])).collect() == []


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    parts = united(sets, links)
    return {i: (len(s), parts[i]) for i, s in sets.items()}


def test_jaccard_of_colliding_words_and_frequent_shingles(spark, monkeypatch):
    """Words that polynomial hashes modulo 2**64 take for each other; and a frequent shingle whose list is dealt to tiles."""
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "POSTINGS", 50)
    monkeypatch.setattr(jaccard, "HELD", 10)
    rows = [(i, " ".join(f"w x y z {thue_morse(n, letters)}" for n in (64, 128, 1024, 2048, 4096))) for i, letters in enumerate(("ab", "ba"))]
    random.seed(9)
    for i in range(120):
        rows.append((100 + i, "all rights are reserved here " + " ".join(f"v{(i // 2) * 7 + j}" for j in range(random.randrange(3, 9)))))
    rows += [(300 + i, "the line that all of these share" + (f" u{i // 3}" if i % 3 else "")) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(table(spark, rows)).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_of_rows_without_a_key_and_repeated_keys(spark):
    long, other = (" ".join(f"{w}{i}" for i in range(40)) for w in ("long", "other"))
    rows = [(None, long), (9, long), (None, other), (None, other), (5, "one two"), (5, "one two"), (7, "one two"), (5, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 36, 9), (9, 36, 9), (None, 36, None), (None, 36, None), (5, 1, 5), (5, 1, 5), (7, 1, 5), (5, 0, 5)], key=str)


def test_blocks_of_an_index_list_lose_no_pair():
    rng = np.random.default_rng(0)
    n = 700
    sizes = np.sort(rng.integers(5, 60, n))
    positions = rng.integers(0, 5, n)
    ids, comps = np.arange(n), rng.integers(0, 30, n)
    got = {tuple(sorted(p)) for a, b in jaccard._list_pairs(ids, comps, sizes, positions, 75) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if comps[i] != comps[j] and 100 * sizes[i] >= 75 * sizes[j] and jaccard._possible(sizes[i], positions[i], sizes[j], positions[j], 75)}
    assert got == want


def brute_repeats(texts, length):
    counts = collections.Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[k] = (len(t), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(kept).hexdigest())
    return out


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def odd_texts():
    random.seed(6)
    base = "".join(random.choice("abcde é\n\x00ÿ") for _ in range(2000))
    odd = ["a" * 199, "a" * 200, "a" * 201, "a" * 9000, base, base[:199], base[100:300], base[5:205] + "X" + base[205:404], base[1000:1250] * 3]
    for n in (64, 128, 1024, 4096):  # strings that polynomial hashes modulo 2**64 take for each other
        odd += [f"{n}{thue_morse(n)}{n + 1}" + "y" * 150, f"{n + 2}{thue_morse(n, 'ba')}{n + 3}" + "z" * 150]
    return odd


@pytest.mark.parametrize(("length", "heavy", "pack"), [(200, 2048, 60_000), (200, 3, 6000), (40, 5, 500)])
def test_suffixes(spark, length, heavy, pack, monkeypatch):
    spans = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda texts, length: spans(texts, length, heavy=heavy, pack=pack))
    rows = documents(spark) + list(enumerate(odd_texts(), 4000))
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.repeats(table(spark, rows), length=length).collect()}
    assert got == brute_repeats({i: (t or "").encode() for i, t in rows}, length)
    assert suffixes.repeats(table(spark, []), length=length).collect() == []


def test_suffixes_of_rows_without_a_key_and_repeated_keys(spark):
    long, other = (" ".join(f"{w}{i}" for i in range(90)) for w in ("long", "other"))
    rows = [(None, long), (None, "x" + long), (1, other), (1, other), (2, "2" * 150 + other[:250]), (2, "short"), (3, None)]
    got = suffixes.repeats(table(spark, rows), with_text=True).collect()
    want = brute_repeats({k: (t or "").encode() for k, (_, t) in enumerate(rows)}, 200)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(((i, *want[k]) for k, (i, _) in enumerate(rows)), key=str)


def test_suffix_order_and_hits_of_random_contexts():
    random.seed(7)
    for _ in range(60):
        length = random.choice([8, 9, 24, 30, 73, 200])
        base = bytes(random.choice(b"ab") if random.random() < 0.8 else random.choice(b"abcdef\x00") for _ in range(600))
        parts = []
        for _ in range(random.randint(1, 25)):
            n = random.randint(1, 60)
            a = random.randint(0, 600 - n - length)
            part = bytearray(base[a : a + n + length - 1])
            if random.random() < 0.7:
                part[random.randrange(len(part))] = random.choice(b"abz\x00")
            parts.append(bytes(part))
        data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        begin = np.cumsum(sizes) - sizes
        context = np.repeat(np.arange(len(sizes)), sizes)
        starts = {int(b) + i: p[i : i + length] for b, p in zip(begin, parts) for i in range(len(p) - length + 1)}
        order, _ = suffixes.suffix_order(data, np.arange(len(data)) - begin[context], (sizes - length + 1)[context], length)
        assert [starts[i] for i in order.tolist()] == sorted(starts.values()) and set(order.tolist()) == set(starts)
        counts = collections.Counter(starts.values())
        want = sorted(i for i, t in starts.items() if counts[t] > 1)
        assert suffixes.repeated_starts(data, sizes, sizes - length + 1, np.ones(len(sizes), int), length).tolist() == want


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = documents(spark)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}
    got = packing.pack(table(spark, rows), TOKENIZER).orderBy("doc_id", "piece").collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, own in ids.items():
        lengths = [len(own) - 1024 * (-(-len(own) // 1024) - 1)] + [1024] * (-(-len(own) // 1024) - 1)
        assert [r.length for r in pieces[i]] == lengths and [r.piece for r in pieces[i]] == list(range(len(lengths)))
        for r in pieces[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        assert [r.start for r in pieces[i]] == [sum(lengths[:k]) for k in range(len(lengths))]
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(map(len, ids.values())) / 1024 + 2
    assert packing.pack(table(spark, []), TOKENIZER).collect() == []


def test_every_capacity_holds():
    rng = np.random.default_rng(0)
    values, counts = np.unique(rng.integers(1, 700, 20_000), return_counts=True)
    limits = packing.Limits(1024, 3, 600_000)
    for score in ("norm", "dot"):
        runs = packing.best_fit(dict(zip(values.tolist(), counts.tolist())), limits, score=score)
        sequence = np.concatenate([np.arange(s, s + n) for _, _, s, _, n in runs])
        length = np.repeat(runs[:, 0], runs[:, 4])
        assert len(length) == 20_000 and np.bincount(sequence).max() <= 3
        assert np.bincount(sequence, length).max() <= 1024 and np.bincount(sequence, length.astype(float) ** 2).max() <= 600_000
    with pytest.raises(ValueError):
        packing.best_fit({800: 1}, limits)


def test_pipeline(spark):
    import corpus_pipeline

    rows = documents(spark)
    docs = table(spark, rows).withColumns({"lang": F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")), "lang_pred": F.lit("clash")})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        if name == "language_id":
            assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if t and any(map(str.isalpha, t))}
            assert kept.filter("lang is null").count() == 0
        if name == "near_duplicates":
            assert {r.doc_id for r in kept.collect()} >= {i for i, _ in rows if i < 20}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert sum(" ".join(f"p{i}" for i in range(70)) in t for t in texts.values()) == 0 and all(texts.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r.doc_id for r in packed} == {*texts}


def test_pipeline_keeps_one_of_repeated_rows_and_null_keys(spark):
    import corpus_pipeline

    long, short, other, same = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("long", 80), ("short", 8), ("other", 80), ("same", 60)))
    rows = [(1, long), (1, long), (2, short), (2, short), (None, other), (None, other), (None, same), (7, same), (8, "one two"), (8, "three four")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, "")
    want = [(1, long), (2, short), (7, same), (8, "one two"), (8, "three four"), (None, other)]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((i for i, _ in want), key=str)


def test_pipeline_judges_by_the_number_of_languages(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(["a text", "123 !?", "漢字"])], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").orderBy("doc_id").collect()] == [0, 2]

    class Ten:
        languages = list("abcdefghij")

    monkeypatch.setattr(corpus_pipeline.languages, "fit", lambda *a, **k: Ten())
    monkeypatch.setattr(corpus_pipeline.languages, "predict", lambda rows, model, keep: rows.select("row", F.lit("a").alias("lang_pred"), F.when(F.col("row.doc_id") == 1, 0.11).otherwise(0.2).alias("score")))
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").orderBy("doc_id").collect()] == [0, 2]


def test_the_whole_pipeline_by_brute_force(spark, tmp_path):
    """run() on a table: what each stage keeps is worked out again from the stage before by plain Python."""
    import corpus_pipeline
    from tidemark.llm import languages
    from tokenizers import Tokenizer

    rows = [(i, t, "en" if i % 3 else None) for i, t in documents(spark)] + [(9000 + k, w, x) for k, (w, x) in enumerate([("der und die das ist nicht " * 9, "de"), ("et que les des une pour " * 9, "fr"), ("1234 5678", "en")])]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = languages.fit(docs)
    least = corpus_pipeline.ODDS / (corpus_pipeline.ODDS + (len(model.languages) - 1))
    scores = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict(docs, model).collect()}
    kept = {i: t for i, t, _ in rows if scores[i][0] != "und" and scores[i][1] >= least}
    parts = brute_jaccard([*kept.items()])
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    counts = collections.Counter(t.encode()[k : k + 200] for t in kept.values() for k in range(len(t.encode()) - 199))
    left = {}
    for i, t in kept.items():
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        rest = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if rest:
            left[i] = rest
    t = Tokenizer.from_file(TOKENIZER)
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {i: sum(r.length for r in got if r.doc_id == i) for i in {r.doc_id for r in got}} == want
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(want.values()) / 1024 + 2


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_recall_of_planted_links(spark):
    """Pairs at cosines from 0.98 up, among unlike vectors: how many of them are found."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 64))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.981, 1.0, (1500, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * other
    rows = [(i, list(map(float, x)), 1) for i, x in enumerate(np.concatenate([base, near]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    found = got.filter("n_links > 0").count() / 3000
    assert found >= 0.99


def test_links_of_a_dense_cluster_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(6)
    v = rng.standard_normal(16) + 0.01 * rng.standard_normal((50, 16))
    rows = [(i, list(map(float, x)), 1) for i, x in enumerate(v)] + [(100 + i, list(map(float, v[i % 3])), 1) for i in range(9)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(58, 0, True), (58, 0, False)} and sum(r.kept for r in got) == 1
