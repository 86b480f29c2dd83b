"""The training-data operators against brute force, and on rows that are null, empty, long, repeated or clash by name."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseweave.llm import lines, lm, media, minhash, mixing, packing, shards, substrings, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, piece string, node string, n string, row string"
WORDS = [f"w{k}" for k in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary texts, copies, near copies, shared passages, junk, one very long text; some repeated rows."""
    rng = random.Random(5)
    base = [text(rng, rng.choice([4, 20, 60, 150])) for _ in range(60)]
    passage = text(rng, 40)
    texts = base + base[:6] + [b + " tail" for b in base[10:16]] + [f"{text(rng, 9)} {passage} {text(rng, 9)}" for _ in range(6)]
    words = base[20].split()
    texts += [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(0, len(words), max(1, len(words) // 6))]
    texts += ["", "   \t\n", None, "ONE", "one", "A b C d E", "x" * 5000, text(rng, 9000), "é ü 1 <|endoftext|> b"]
    out = [(k, t, "en", ["a", "b", None, "c"][k % 4], len(t or ""), "s", "p", "n", "n", "r") for k, t in enumerate(texts)]
    return out + out[3:5]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    """Every column null in some row."""
    return spark.createDataFrame([(None, "a b c d e f", None, None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None, None, None)], SCHEMA)


def words_of(t):
    return (t or "").encode().split()


def test_packing_round_trip(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.pack(docs, capacity=256, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, t, *_ in rows:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted({(r.piece, r.start, r.length, r.ids) for r in by[k]})
        assert [i for p in own for i in np.frombuffer(p[3], "<u4").tolist()] == want
        assert all(p[2] == 256 for p in own[1:]) and sum(p[2] for p in own) == len(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seq) <= math.ceil(sum(r.length for r in got) / 256) * 1.05 + 1


@pytest.mark.parametrize("value", [" " * 2_000_000, "\n" * 2_000_000, "x" + " \n\t" * 400_000 + "y", "a" * 2_000_000])
def test_long_runs_are_encoded_as_by_the_library(value):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path("byte_bpe_50k.json")).encode(value, add_special_tokens=False).ids
    assert packing.encoder("byte_bpe_50k")(value) == np.array(want, "<u4").tobytes()


def test_a_long_blank_text_is_packed(spark):
    got = packing.pack(spark.createDataFrame([(1, " " * 1_200_000), (2, "a b")], "doc_id long, text string")).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 1_200_001 and sum(r.length for r in got if r.doc_id == 2) == 3


def test_packing_ignores_how_many_ranges_rank_equals(spark, monkeypatch):
    cut = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 3 + 1).alias("length"))
    want = {r.doc_id: r["rank"] for r in packing._ranked(cut).collect()}
    assert sorted(want[k] for k in range(0, 300, 3)) == list(range(100))
    monkeypatch.setattr(packing, "RANGE_ROWS", 7)
    assert {r.doc_id: r["rank"] for r in packing._ranked(cut).collect()} == want


@pytest.mark.parametrize("kind", ["even", "small", "few", "hot"])
def test_best_fit_matches_sequential(spark, kind):
    rng = random.Random(2)
    sizes = {"even": lambda: rng.randint(1, 100), "small": lambda: rng.randint(1, 7), "few": lambda: rng.choice([100, 51, 34, 20, 3]), "hot": lambda: 40 if rng.random() < 0.4 else rng.randint(1, 100)}
    sizes = [sizes[kind]() for _ in range(2000)]
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(100 - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    counts = collections.Counter(sizes)
    steps = packing.sweeps(spark.createDataFrame(list(counts.items()), "length long, n long"), 100).collect()
    fill, ranks = collections.Counter(), collections.defaultdict(list)
    for s in steps:
        ranks[s.length] += range(s.rank, s.rank + s.n)
        for k in range(s.n):
            fill[s.sequence + k] += s.length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= len(gaps) * 1.02


def brute_classes(rows):
    sets = []
    for k, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((k, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(s), find(k)) for k, s in sets}


def test_near_duplicates(docs, rows):
    want = brute_classes(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = {r.doc_id for r in minhash.keep_one(docs).collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c}


def test_near_copies_below_the_threshold_stay_apart(spark):
    """A large group of unlike copies of one text: every pair just under the threshold, none may be linked or lost."""
    rng = random.Random(1)
    base = text(rng, 150).split()
    made = []
    for k in range(120):
        w = list(base)
        for i in range(7):
            w[(i * 21 + k) % 150] = f"new{k}_{i}"
        made.append((k, " ".join(w)))
    made.append((120, " ".join([*made[5][1].split()[:-1], "end"])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {k: c for k, (_, c) in brute_classes(made).items()}


def test_media_round_trip(docs, rows, tmp_path):
    folder = f"file://{tmp_path}/shards"
    index = media.store(docs, folder, shard_bytes=20_000)
    assert index.select("digest").distinct().count() == index.select("digest", "shard", "offset").distinct().count()
    read = {r.digest: r for r in media.contents(index, folder).collect()}
    heads = {r.digest: r for r in media.metadata(index, folder).collect()}
    for r in index.collect():
        payload = media.padded((dict((k, t) for k, t, *_ in rows)[r.doc_id] or "").encode())
        c = read[r.digest]
        assert (c.payload_sha256, c.payload_bytes, c.tail_crc32) == (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-16:]))
        assert (heads[r.digest].width, heads[r.digest].height, heads[r.digest].depth) == (192, len(payload) // 192, 8)


def test_sharding_versions(spark, tmp_path, docs):
    store = shards.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=60_000, fan=3, least_bytes=1000)
    for k in range(7):
        store.append(docs.filter(F.pmod("doc_id", F.lit(7)) == k).coalesce(1))
    before = store.versions()
    assert store.read().count() == docs.count() and len(before) == 7
    done = store.compact()
    assert len(done["shards"]) < 7
    tiers = collections.Counter(store.tier(s["bytes"]) for s in done["shards"] if 2 * s["bytes"] < 60_000)
    assert all(n < 3 for n in tiers.values())
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert store.read(3).count() < store.read().count()  # older versions stay readable until a vacuum
    assert store._commit({"version": 2}, [], "{}") is None  # the version exists
    store.read().limit(1).write.parquet(f"file://{tmp_path}/t/data/a-unfinished")  # a writer that has not committed yet
    assert store.vacuum() == 0 and store.read(3).count() > 0
    assert store.vacuum(min_age_s=0) > 0
    assert store.read().count() == docs.count()


def test_sharding_arrivals(spark, tmp_path):
    """String keys, null rows, repeated rows, an empty table and columns named like the arrival's."""
    rows = [(f"k{k % 30}" if k % 7 else None, None if k % 5 == 0 else "é" * (k % 9), k if k % 2 else None) for k in range(90)] * 2
    d = spark.createDataFrame(rows, "doc_id string, text string, arrival int").repartition(3)
    store = shards.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=20_000, fan=3, least_bytes=500)
    seen = []
    for m in store.append_each(d, 6, "doc_id"):
        seen.append(store.read().count())
        store.compact()
        store.vacuum(min_age_s=0)  # later arrivals are written already
        assert store.read().count() == seen[-1]
    assert len(seen) > 3 and sorted(seen) == seen and seen[-1] == len(rows)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, d.collect()))
    assert len(store.manifest()["shards"]) < 6 * 3
    none = shards.ShardStore(spark, f"file://{tmp_path}/e")
    assert len(list(none.append_each(d.limit(0), 4, "doc_id"))) == 1
    assert none.read().count() == 0 and none.compact()["version"] == 1 and none.vacuum(0) == 0


def test_sharding_race(spark, tmp_path, docs):
    """Two writers: the loser of a version commits after the winner, and no row is lost."""
    a, b = (shards.ShardStore(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.append(docs.limit(5))
    old = b.manifest()
    a.append(docs.limit(7))
    b.manifest, later = (lambda version=None, first=[old]: first.pop() if first else later(version)), b.manifest  # noqa: B006
    b.append(docs.limit(11))
    assert a.read().count() == 23 and a.versions() == [1, 2, 3]


def test_scoring(docs, rows):
    got = lm.score(docs).collect()
    counts = collections.Counter()
    for k, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    by = {k: t for k, t, *_ in rows}
    for r in got:
        w = [*(by[r.doc_id] or "").encode().lower().split(), None]
        assert r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_scoring_is_a_probability():
    """Over all continuations of a prefix by one byte, and over all symbols, probabilities add up to one."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    tables = [rng.integers(0, 5, (1 << size, 2)).astype(np.float32) for *_, size in lm.SHORT_CONTEXTS]
    mixer = lm.Mixer()
    mixer.tallies += rng.integers(0, 9, mixer.tallies.shape)
    words = pa.array([b"them" + bytes([x]) for x in range(256) if x not in (10, 32)], pa.binary())
    edges = lm.Edges(words, np.zeros(len(words), int))
    assert len(edges.data) == 4 + 2 * len(words)  # the shared prefix once
    lp = lm.log10_words(edges, edges.weights(np.ones(len(words))), tables, mixer)
    assert (lp < 0).all() and (10.0**lp).sum() < 1
    shape = (lm.CLASSES, lm.SYMBOLS, lm.SYMBOLS, lm.SYMBOLS)
    counts = rng.integers(0, 4, shape).astype(float) * (rng.random(shape) < 0.01)
    assert np.allclose((10.0 ** lm.symbol_logs(counts).astype(float)).sum(axis=-1), 1, atol=1e-4)


def brute_spelling(words, train, tables, mixer):
    """log10 probability of each (class, word), bit by bit, from the rules as the module states them."""
    full_bits = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full_bits
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full_bits
        return x ^ x >> 31

    uses = collections.Counter()
    for (g, w), c in train.items():
        full = w + b" "
        for i, byte in enumerate(full):
            for j in range(8):
                for key in ((full[:i], None), (full[:i], g)):
                    uses[key, j, byte >> 8 - j, byte >> 7 - j & 1] += c
    out = {}
    for g, w in words:
        full, total = w + b" ", 0.0
        for i, byte in enumerate(full):
            for j in range(8):
                node, y = byte >> 8 - j | 1 << j, byte >> 7 - j & 1
                counts, before = [], 0
                for (back, with_class, size), table in zip(lm.SHORT_CONTEXTS, tables, strict=True):
                    before = (before * 257 + (full[i - back] + 1 if i >= back else 0)) & full_bits
                    h = mix((before + (back << 58) + ((g + 1) * 0x8EBC6AF09C88C6E3 if with_class else 0)) & full_bits)
                    counts.append(table[((h ^ node * 0x9E3779B97F4A7C15 & full_bits) * 0xD6E8FEB86659FD93 & full_bits) >> 64 - size])
                for key in ((full[:i], None), (full[:i], g)):
                    counts.append([uses[key, j, byte >> 8 - j, b] * (i >= lm.LEAD) for b in (0, 1)])
                gate = 0
                for k, (n0, n1) in enumerate(counts):
                    if n0 + n1 > 0:
                        gate = 1 + k * lm.GRADES + min(lm.GRADES - 1, int(math.log2(max(1, n0 + n1))) // 2)
                logits = [math.log((n1 + 0.3) / (n0 + 0.3)) for n0, n1 in counts] + [0.3]
                z = max(-12, min(12, sum(a * b for a, b in zip(logits, mixer.weights[gate], strict=True))))
                p = mixer.refined(np.array([z]), np.array([gate]))[0]
                total += math.log10(p if y else 1 - p)
        out[g, w] = total
    return out


def test_spelling_against_brute_force():
    import pyarrow as pa

    rng = random.Random(9)
    words = sorted({(rng.randint(0, 1), "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode()) for _ in range(60)} | {(0, "é".encode()), (1, b"x" * 300)})
    train = {w: rng.randint(0, 4) for w in words}
    tables = [np.random.default_rng(k).integers(0, 3, (1 << size, 2)).astype(np.float32) for k, (*_, size) in enumerate(lm.SHORT_CONTEXTS)]
    mixer = lm.Mixer(weights=np.random.default_rng(1).random((lm.N_INPUTS * lm.GRADES + 1, lm.N_INPUTS + 1)) * 0.4)
    edges = lm.Edges(pa.array([w for _, w in words], pa.binary()), np.array([g for g, _ in words]))
    got = lm.log10_words(edges, edges.weights(np.array([train[w] for w in words], float)), tables, mixer)
    want = brute_spelling(words, train, tables, mixer)
    assert got == pytest.approx([want[w] for w in words], rel=1e-4)


def test_learning_holds_little_and_leaves_nothing_out():
    """Every bit of every edge is learnt, as if all counters were held at once, in memory that a large shard needs few of."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    words = sorted({b"and" + rng.integers(97, 123, rng.integers(1, 12), np.uint8).tobytes() for _ in range(20_000)})
    classes = np.repeat([0, 1], [len(words) // 3, len(words) - len(words) // 3])
    tables = [rng.integers(0, 900, (1 << size, 2)).astype(np.float32) for *_, size in lm.SHORT_CONTEXTS]
    edges = lm.Edges(pa.array(words, pa.binary()), classes)
    weight = edges.weights(rng.integers(1, 4, len(words)).astype(float))
    tracemalloc.start()
    got = lm.learned(edges, weight, tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * len(edges.data)  # 448 bytes an edge for the counters alone, held all at once
    assert got.tallies.sum() == 8 * weight.sum()
    want, known, bits = lm.Mixer(), edges.place >= lm.LEAD, []
    for j in range(8):
        y, step, slots = edges.bit(j)
        counts = [(t[s, 0], t[s, 1]) for t, s in zip(tables, slots, strict=True)]
        for key in (edges.prefix, edges.prefix + edges.group):
            uses = collections.Counter()
            for k, b, w in zip((key ^ step).tolist(), y.tolist(), weight.tolist(), strict=True):
                uses[k, b] += w
            counts.append(tuple(np.array([uses[k, b] for k in (key ^ step).tolist()], np.float32) * known for b in (0, 1)))
        bits.append((y, counts))
    for k in range(0, len(edges.data), lm.LEARN):
        at = slice(k, k + lm.LEARN)
        for y, counts in bits:
            logits, gate = lm._inputs([(a[at], b[at]) for a, b in counts], y[at], weight[at])
            want.learn(logits, gate, y[at], weight[at])
    assert (got.weights == want.weights).all() and (got.tallies == want.tallies).all()


def test_edges_are_made_in_parts():
    """The edges of a large shard take little memory and are those of a plain trie, also where a part of the words ends."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = sorted({b"and" + rng.integers(97, 117, rng.integers(1, 12), np.uint8).tobytes() for _ in range(30_000)})
    classes = np.repeat([0, 2], [lm.CHUNK + 7, len(words) - lm.CHUNK - 7])
    column = pa.array(words, pa.binary())
    tracemalloc.start()
    edges = lm.Edges(column, classes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180 * len(edges.data)  # 256 bytes an edge when made of all bytes at once
    trie, want = {}, []
    for word, g in zip(words, classes.tolist(), strict=True):
        for k, b in enumerate(word + b" "):
            want.append(trie.setdefault((g, word[:k], b), len(trie)))
    assert edges.edge.tolist() == want
    assert edges.data.tolist() == [b for _, _, b in trie] and edges.place.tolist() == [len(x) for _, x, _ in trie]
    assert len(set(edges.prefix.tolist())) == len({x for _, x, _ in trie}) and len(set((edges.prefix + edges.group).tolist())) == len({x[:2] for x in trie})
    for (back, with_class, _), found in zip(lm.SHORT_CONTEXTS, edges.short, strict=True):
        assert len(set(found.tolist())) == len({(g * with_class, x[max(0, len(x) - back) :]) for g, x, _ in trie})
    per = rng.integers(1, 9, len(words)).astype(float)
    lengths = [len(w) + 1 for w in words]
    assert (edges.weights(per) == np.bincount(want, np.repeat(per, lengths))).all()
    assert (edges.totals(np.arange(float(len(trie)))) == np.bincount(np.repeat(np.arange(len(words)), lengths), want)).all()


def test_scoring_ignores_layout_and_held_out_texts(spark):
    rng = random.Random(8)
    rows = [(k, text(rng, rng.choice([3, 30, 80]))) for k in range(150)]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    other = [(k, "quite another text " + text(rng, 20) if h else t) for (k, t), h in zip(rows, held, strict=True)]
    schema = "doc_id long, text string"
    first = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, schema).repartition(2)).collect()}
    again = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()}
    changed = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(other, schema).repartition(3)).collect()}
    assert any(held) and first == pytest.approx(again, abs=1e-6)
    assert all(changed[k] == pytest.approx(first[k], abs=1e-6) for (k, _), h in zip(rows, held, strict=True) if not h)


def test_toxic_expressions_of_harmless_words(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for k in range(1500):
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        at, far = rng.randrange(2, 8), rng.randrange(10, 18)
        bad = k % 3 == 0
        w[at : at + 1] = ["green", "stone"] if bad else ["green"]
        if not bad:
            w[far] = "stone"
        texts.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, y).collect()}
    sides = [[got[k].score for k, v in labels if v == side and got[k].held_out] for side in (1, 0)]
    auc = np.mean([(a > b) + (a == b) / 2 for a in sides[0] for b in sides[1]])
    assert auc > 0.95


def test_toxic_expressions_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(WORDS[:12]) for _ in range(rng.choice([0, 1, 2, 6, 15]))), int(k % 3 == 0)) for k in range(300)]
    rows += [(None, 1), ("", 0), ("Bad  WORDS\nhere bad words", 1), ("bad words", 1)]
    used, totals = {}, [0, 0]
    for text, toxic in rows:
        w = (text or "").lower().split()
        for run in {*zip(w, strict=True), *zip(w, w[1:], strict=False)}:
            used.setdefault(run, [0, 0])[toxic] += 1
            totals[toxic] += 1
    kinds = [sum(n[c] > 0 for n in used.values()) for c in (0, 1)]
    want = []
    for n in used.values():
        p = [(max(n[c] - 0.75, 0) + 0.75 * kinds[c] / len(used)) / totals[c] for c in (0, 1)]
        if n[1] > 1 and math.log(p[1] / p[0]) > 0.1:
            want.append(math.log(p[1] / p[0]) - 0.1)
    found = toxicity.expressions(spark.createDataFrame(rows, "text string, y int").repartition(5), evidence=0.1).collect()
    assert sorted(r.excess for r in found) == pytest.approx(sorted(want)) and len({r.run for r in found}) == len(want) > 3


def test_toxicity_is_calibrated_on_all_rows(spark):
    """The fit on 30,000 rows is that of all of them in one place, not of the first 20,000, and the same in any order."""
    rng = np.random.default_rng(6)
    n, size = 30_000, rng.integers(1, 50, 30_000)
    y = (rng.random(n) < np.where(np.arange(n) < 20_000, 0.1, 0.6)).astype(int)
    columns = {"n": size, "ratio": (y + rng.normal(0, 1, n)) * size, "clear": rng.random(n) * y, "told": rng.random(n), "y": y}
    frame = pd.DataFrame(columns)
    got = toxicity.fit_logistic(spark.createDataFrame(frame).repartition(5))
    assert (got == toxicity.fit_logistic(spark.createDataFrame(frame[::-1]).coalesce(2))).all()
    x = np.stack([np.ones(n), columns["ratio"] / size, np.sqrt(columns["clear"] / size), np.sqrt(columns["told"] / size)], axis=1)
    slope = x.T @ (y - 1 / (1 + np.exp(-(x @ got)))) / n - 1e-5 * got
    assert np.abs(slope).max() < 1e-6
    assert (toxicity.fit_logistic(spark.createDataFrame(frame[y == 0])) == 0).all()


def test_toxicity_learns_held_out_words(spark):
    rng = random.Random(3)
    made, labels = [], []
    for k in range(600):
        bad = k % 5 == 1 or k % 7 == 3
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        if bad:
            for i in range(0, len(w), 12):
                w[i] = rng.choice(["vile", "grubweed", "grubling", "scoundrel"])
        made.append((k, " ".join(w), "x"))
        labels.append((k, int(bad)))
    d, y = spark.createDataFrame(made, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, y).collect()}
    held = [(got[k].predicted, v) for k, v in labels if got[k].held_out]
    assert sum(p == v for p, v in held) / len(held) > 0.97
    kept = {r.doc_id for r in toxicity.reject(d, y).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_mixing(docs, rows):
    got = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words_of(t))
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        left = 1.5 * total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, x in share.items() if x > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        want = 2 * sizes[r.source] if r.source in capped else share[r.source]
        assert r.target == pytest.approx(want) and r.source_size == sizes[r.source] and r.copies <= 2
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == sorted(k for r in got for k in [r.doc_id] * r.copies)
    assert mixing.mix(docs).columns == docs.columns


def test_line_dedup(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        own = [text(rng, 12) for _ in range(4)]
        own.insert(k % 4, f"Page {k} of the yearly report")
        rows.append((k, "\n".join(own), "kept"))
    copy = "\n".join(text(rng, 12) for _ in range(4))
    rows += [(100 + k, copy, "kept") for k in range(30)]  # copies of one document are no template
    d = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = {r.doc_id: r for r in lines.deduplicate(d).collect()}
    assert all("yearly" not in got[k].text and got[k].n_removed == 1 and got[k].n_lines == 5 for k in range(40))
    assert all(got[100 + k].text == copy and got[100 + k].n_removed == 0 for k in range(30))
    assert "Page <*> of the yearly report" in {r.template for r in lines.templates(d).collect()}


def prose(rng, n):
    return text(rng, n).translate(str.maketrans("0123456789", "abcdefghij"))


def test_line_dedup_counts_copies_once(spark):
    rng = random.Random(5)
    law, other = "Licensed under the terms that the owner has set for everyone who reads this", "All rights reserved by the owner of this place and by nobody else at all"
    copy = "\n".join([prose(rng, 12), law, prose(rng, 12)])
    rows = [(k, copy) for k in range(60)] + [(100 + k, "\n".join([prose(rng, 5), law, prose(rng, 4), other])) for k in range(12)]
    base = [prose(rng, 14).split() for _ in range(4)]
    for k in range(30):  # edited copies of one document: none of its lines recurs
        words = [list(x) for x in base]
        words[k % 4][k % 14] = f"edit{chr(97 + k % 26)}{k // 26 * 'x'}"
        rows.append((200 + k, "\n".join(map(" ".join, words))))
    got = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(law not in r.text and other not in r.text for r in got.values())
    assert all(got[k].n_removed == 1 for k in range(60)) and all(got[100 + k].n_removed == 2 for k in range(12))
    assert all(got[k].text == t and got[k].n_removed == 0 for k, t in rows if k >= 200)


def test_line_dedup_has_several_templates_a_leaf(spark):
    rng = random.Random(6)
    tails = [" ".join(prose(rng, 9).split()[:9]) for _ in range(4)]
    fixed = [f"see also the {t}" for t in tails]
    rows = [(k, "\n".join([prose(rng, 12), fixed[k % 4]])) for k in range(48)] + [(100 + k, "\n".join([prose(rng, 12), "see also the " + prose(rng, 9)])) for k in range(150)]
    rows += [(300 + k, "\n".join([prose(rng, 12), "17 4 2026 12 30 0 stamp"])) for k in range(12)]
    got = {r.doc_id: r for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_removed == 1 and "\n" not in got[k].text for k in [*range(48), *range(300, 312)])
    assert all(got[100 + k].n_removed == 0 for k in range(150))


def brute_lines(rows, support=8):
    """The numbers of the removed lines by text, from the rules as the module states them."""
    half_of = lambda n: (n + 1) // 2
    parsed = {}
    for t in {t for _, t in rows if t is not None}:
        for no, line in enumerate(t.split("\n")):
            w = line.encode().split()
            n, few = len(w), 3 if len(w) >= 6 else 2
            if not n:
                continue
            m = tuple(b"<*>" if any(48 <= c <= 57 for c in x) else x for x in w)
            h, fixed = half_of(n), [x != b"<*>" for x in m]
            keys = [("pat", n, m) if sum(fixed) * 2 >= n else ("plain", tuple(w))]
            if h >= 5 and all(fixed[:h]):
                keys.append(("half1", n, m[:h]))
            if h >= 5 and all(fixed[n - h :]):
                keys.append(("half2", n, m[:3], m[n - h :]))
            cues = [("head", tuple(w[:few])), ("tail", tuple(w[n - few :]))] if n >= 4 else []
            parsed[t, no] = (n, m, keys, ("leaf", n, m[:3]) if n > 3 else None, cues)

    def common(pairs):
        texts = collections.defaultdict(set)
        for key, t in pairs:
            texts[key].add(t)
        return {k for k, v in texts.items() if len(v) >= support}

    listed = common((k, t) for (t, _), p in parsed.items() if p[0] >= 2 for k in p[2])
    cand = {at: {k for k in p[2] if k in listed} for at, p in parsed.items() if p[0] >= 2}
    cand = {at: k for at, k in cand.items() if k}
    rest = {at: p for at, p in parsed.items() if p[3] and at not in cand}
    leaves = common((p[3], at[0]) for at, p in rest.items())
    for leaf in leaves:
        own = {at: p[1] for at, p in rest.items() if p[3] == leaf}
        modes = [collections.Counter(x).most_common(1)[0] for x in zip(*own.values(), strict=True)]
        plan = [x if c * 2 >= len(own) and x != b"<*>" else None for x, c in modes]
        for at, m in own.items():
            if sum(a == b for a, b in zip(m[3:], plan[3:], strict=True)) >= (len(m) - 3) * 0.5:
                cand[at] = {leaf}
    seen = {c for at in cand for c in parsed[at][4]}
    own = collections.defaultdict(set)
    for at, p in parsed.items():
        if at not in cand and not seen & set(p[4]):
            own[at[0]].add(p[2][0])
    sets = collections.defaultdict(set)
    for (t, _), keys in cand.items():
        for k in keys:
            sets[k].add(frozenset(own[t]))
    going = {k for k, v in sets.items() if len(v) >= support}
    out = collections.defaultdict(set)
    for (t, no), keys in cand.items():
        if keys & going:
            out[t].add(no)
    return out


@pytest.mark.parametrize("limit", [None, 0])
def test_line_dedup_against_brute_force(spark, monkeypatch, limit):
    if limit is not None:  # texts joined with line numbers instead of broadcast keys
        monkeypatch.setattr(lines, "BROADCAST_KEYS", limit)
    rng = random.Random(11)
    notes = ["Read more", "please share this page with friends", "please share this offer by email", "Copyright 2024 by the owner of all that", "x 1 2 3 4"]
    rows = []
    for k in range(120):
        own = [prose(rng, rng.choice([1, 2, 3, 7, 12])) for _ in range(rng.randint(0, 5))]
        own += [n.replace("2024", str(2000 + k % 30)) for j, n in enumerate(notes) if (k + j) % 4 == 0]
        if k % 3 == 0:
            own.append(f"see also the {prose(rng, 2)} list of all {prose(rng, 1)} places here")
        rng.shuffle(own)
        rows.append((k, "\n".join(own)))
    rows += [(200 + k, rows[k % 9][1]) for k in range(30)] + [(300, None), (301, ""), (302, "\n\n"), (303, prose(rng, 3000)), (None, rows[5][1])]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows) and sum(map(len, want.values())) > 100
    by = {k: t for k, t in rows}
    for r in got:
        t = by[r.doc_id]
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(t, ()))
        assert (r.text, r.n_lines, r.n_removed) == (kept, 0 if t is None else t.count("\n") + 1, len(want.get(t, ())))


def brute_windows(rows, window=13):
    first = {}
    for k, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words_of(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = {}
    for k, t, *_ in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_line_dedup_keeps_unlike_lines_with_a_common_beginning(spark):
    """Forty documents of one line each, "one of the X Y" with X and Y everywhere different: ordinary text."""
    rows = [(k, f"one of the {'abcdefgh'[k % 8]}{'ijklm'[k // 8]}{k}x {'nopqrstu'[k // 5]}{'vwxyz'[k % 5]}y") for k in range(40)]
    rows = [(k, "".join(c for c in t if not c.isdigit())) for k, t in rows]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows) and all(r.n_removed == 0 for r in got)


def recurring_rows():
    """Ten unlike documents with one common line, and lines of odd bytes in some of them."""
    rng = random.Random(21)
    odd = ["\r", "a\x00b \x00 c", "x\u0085y \u2028 z", "\t", "", "é ü 12 \U0001f600", "1 2 3 4 5"]
    own = lambda k: prose(rng, 9) + "\n" + odd[k % 7] + "\n" + odd[(k + 3) % 7]
    common = [(k, own(k) + "\nshare this page 7 with friends\r\n" + "same old licence line of all\n" * (k % 3)) for k in range(10)]
    return common, [(100 + k, prose(rng, 12) + "\n" + prose(rng, 8)) for k in range(150)]


def test_line_dedup_does_not_depend_on_the_number_of_texts(spark, monkeypatch):
    """What goes from ten documents goes as well when texts that share nothing with them are many."""
    monkeypatch.setattr(lines, "RATE", 0.1, raising=False)  # a share of all texts was once asked for: some 16 of these
    few, others = recurring_rows()
    dedup = lambda rows: {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone, among = dedup(few), dedup([*few, *others])
    assert all(r[2] >= 1 for r in alone.values()) and {k: among[k] for k in alone} == alone
    assert all(among[k] == (t, 2, 0) for k, t in others)


def test_pipeline_lines_do_not_depend_on_the_number_of_texts(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(lines, "RATE", 0.1, raising=False)
    few, others = recurring_rows()
    frame = lambda rows: spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    cut = lambda rows: {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, frame(rows), "").collect()}
    alone, among = cut(few), cut([*few, *others])
    assert all(alone[k][0] != t and alone[k][1] == len(alone[k][0]) for k, t in few)
    assert {k: among[k] for k in alone} == alone and all(among[k] == (t, len(t)) for k, t in others)


@pytest.mark.parametrize("limit", [0, 1, 3, 30])
def test_line_dedup_is_the_same_joined_and_broadcast(spark, monkeypatch, limit):
    few, others = recurring_rows()
    df = spark.createDataFrame([*few, *others, *[(300 + k, t) for k, (_, t) in enumerate(few * 2)], (None, few[0][1]), (400, None), (401, "")], "doc_id long, text string").repartition(3)
    key = lambda r: (str(r.doc_id), r.text or "", r.n_lines, r.n_removed)
    want = sorted(map(key, lines.deduplicate(df).collect()))
    monkeypatch.setattr(lines, "BROADCAST_KEYS", limit)
    assert sorted(map(key, lines.deduplicate(df).collect())) == want and sum(r[3] for r in want) > 30


def test_line_dedup_keeps_columns_of_any_name(spark, monkeypatch):
    """On both paths, also where a column has the name of one of the operator's own."""
    rng = random.Random(14)
    rows = [(k, text(rng, 8) + "\nsame old licence line of all\n" + text(rng, 7), "x", "y", "z") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nos string, th string, `key` string")
    for limit in (lines.BROADCAST_KEYS, 0):
        monkeypatch.setattr(lines, "BROADCAST_KEYS", limit)
        got = lines.deduplicate(df).collect()
        assert all((r.nos, r.th, r.key, r.n_lines, r.n_removed) == ("x", "y", "z", 3, 1) for r in got) and len(got) == 30


def test_substring_dedup(docs, rows):
    got = substrings.deduplicate(docs, batches=3).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_windows(rows)
    assert len(got) == len(rows)


def test_index_compaction(spark, docs):
    index = substrings.FingerprintIndex(fan=2)
    prints = spark.range(100).select((F.col("id") % 7).alias("hash"), F.col("id").alias("doc_id"))
    for k in range(4):
        index.append(prints.filter(F.col("doc_id") % 4 == k), docs.select("doc_id", "text"))
    assert len(index.runs) <= 2 and sum(r.count() for r in index.runs) == 100


def test_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 16))
    x[40:80] = x[:40] + rng.normal(size=(40, 16)) * 0.15
    made = [(k, v.tolist(), k % 3 if k < 110 else None) for k, v in enumerate(x)]
    made = [(k, v, (k % 40) % 3 if k < 80 else lab) for k, v, lab in made]
    made += [(200, made[0][1], 0), (201, [0.0] * 16, 0), (202, None, 0), (203, [float("nan")] * 16, 0), (204, made[0][1][:8], 0), (205, [None] * 16, 0), (206, made[0][1], 1), (207, [], 0)]
    d = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(d).collect()}
    root, n = {k: k for k, *_ in made}, collections.Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    fine = [(k, np.array(v, float), lab) for k, v, lab in made if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for i, (a, x, p) in enumerate(fine):
        for b, y, q in fine[:i]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[a] += 1
                n[b] += 1
                s, t = sorted((find(a), find(b)))
                root[t] = s
    assert sum(n.values()) > 20
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (n[k], find(k), find(k) == k) for k in root}


def test_vectors_recall_and_candidates(spark):
    """The driver's vectors with copies planted at the threshold, against brute force; how many pairs are counted."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    table = spark.read.parquet(path)
    rows = table.select("vec_id", "label", "embedding").toPandas()
    rng = np.random.default_rng(1)
    near = rows[:1000].copy()
    x = np.stack(near["embedding"].to_list()).astype(float)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) / (x * x).sum(axis=1, keepdims=True) * x
    aside *= np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(aside, axis=1, keepdims=True)
    near["embedding"] = list((x + aside * np.tan(np.arccos(0.9801))).astype(np.float32).tolist())
    near["vec_id"] += 1_000_000
    both = pd.concat([rows, near])
    planted = spark.createDataFrame([(int(r.vec_id), int(r.label), list(map(float, r.embedding))) for r in both.itertuples()], "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(planted).collect()}
    want = {}
    for _, part in both.groupby("label"):
        x = np.stack([np.asarray(v, np.float32) for v in part["embedding"]]).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= dict(zip(part["vec_id"].tolist(), ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist(), strict=True))
    assert sum(want.values()) >= 2000 and all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())
    all_pairs = sum(n * (n - 1) // 2 for n in rows.groupby("label").size())
    groups = vectors.nodes_of(table, "vec_id", "embedding", "label").filter("node is not null").dropDuplicates(["label", "node"])
    groups = groups.join(groups.groupBy("label", "d").count(), ["label", "d"]).withColumn("k", vectors.n_lines(F.col("count")))
    met = vectors.members(groups, 0.2, np.float32).groupBy("key").count().collect()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in met) * 20 < all_pairs


def test_empty_tables(spark, empty, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert packing.pack(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert media.store(empty, f"file://{tmp_path}/m").count() == 0
    assert lm.score(empty).count() == 0
    assert toxicity.score(empty, labels).count() == 0
    assert mixing.mix(empty).count() == 0
    assert lines.deduplicate(empty).count() == 0
    assert substrings.deduplicate(empty).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_rows(spark, nulls, tmp_path):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {(r.doc_id, r.length) for r in packing.pack(nulls).collect()} >= {(1, 1)}
    assert {(r.doc_id, r.n_shingles) for r in minhash.near_duplicates(nulls).collect()} == {(None, 2), (1, 0)}
    assert minhash.keep_one(nulls).count() == 2
    assert media.store(nulls, f"file://{tmp_path}/m").count() == 2
    assert lm.score(nulls).count() == 2
    assert {r.score for r in toxicity.score(nulls, labels).collect()} == {0.0}
    assert toxicity.reject(nulls, labels).count() == 2
    assert mixing.plan(nulls).count() == 2
    assert lines.deduplicate(nulls).count() == 2
    assert {(r.doc_id, r.n_words) for r in substrings.deduplicate(nulls).collect()} == {(None, 6), (1, 0)}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{src}/labels.parquet")).filter("predicted = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, src)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "toxicity":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "near_dedup":
            own = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in out.collect()} == {k for k, (_, c) in brute_classes(own).items() if k == c}
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty, long and repeated texts, further columns with the operators' own names, no rows at all."""
    import corpus_pipeline

    rng = random.Random(12)
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, __n string, __id string, turn0 int"
    rows = [(k, text(rng, 30), "en", ["a", "b", None][k % 3], 10, "x", "y", "z", k) for k in range(40)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "", "en", "a", 0, "", "", "", 0), (None, text(rng, 9), "en", "a", 5, "x", "y", "z", 1), (102, text(rng, 4000), "en", "b", 1, "x", "y", "z", 2)]
    rows += rows[3:5]
    full = spark.createDataFrame(rows, schema)
    stages = [(n, f) for n, f in corpus_pipeline.STAGES[:-1]]
    for name, stage in stages:
        out = stage(spark, full, "/root/testdata/sf0.001").collect()
        ids = collections.Counter(r.doc_id for r in out)
        if name == "line_dedup":
            assert len(out) == len(rows) and ids[100] == 1
        if name == "near_dedup":
            assert all(ids[k] for k in (*range(40), 100, 101, 102, None))  # unlike texts stay
        if name == "toxicity":
            assert ids[100] == ids[101] == 1
        by = {r[0]: r for r in rows}
        assert all(tuple(r)[2:4] == by[r.doc_id][2:4] and tuple(r)[6:] == by[r.doc_id][6:] for r in out)
        none = stage(spark, full.limit(0), "/root/testdata/sf0.001")
        assert none.columns == full.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, full.limit(0), "").count() == 0
