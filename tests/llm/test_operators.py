"""Operators of the training-data pipeline against brute force on whole small tables."""

import hashlib
import re
import subprocess
import sys
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from procspark.llm import cdc, decontam, divergence, licenses, lines, mixing, quality, queries, radix, rpforest, simhash, spelling, tokens, toxicity
from procspark.llm.common import read
from procspark.llm.components import _stars

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
A2Z = str.maketrans(UP, LOW)


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text or "" for r in read(spark, data, "documents").collect()}


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_op1(spark, data):
    out = rows(queries.op1_toxicity(spark, data))
    labels = {r.doc_id: r.toxic for r in read(spark, data, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    seen = [d for d in labels if not out[d]["held_out"]]
    assert np.mean([out[d]["predicted"] == labels[d] for d in seen]) > 0.95


def test_op1_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    out = rows(queries.op1_toxicity(spark, data))
    labels = {r.doc_id: r.toxic for r in read(spark, data, "labels").collect()}
    held = [d for d in labels if out[d]["held_out"]]
    toxic = np.array([out[d]["score"] for d in held if labels[d] == 1])
    clean = np.array([out[d]["score"] for d in held if labels[d] == 0])
    auc = (toxic[:, None] > clean[None, :]).mean()
    print("auc", auc, "recall", (toxic >= 0.5).mean(), "false positives", (clean >= 0.5).mean())
    assert auc > 0.95 and (toxic >= 0.5).mean() >= 0.9 and (clean >= 0.5).mean() <= 0.05


def swaps(spark, fair):
    """Mean score changes when a group's name is swapped in texts whose toxic labels go with one group."""
    rng, rows_, labels = np.random.default_rng(7), [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [f"w{k}" for k in rng.integers(0, 400, 30)] + (["vile"] if toxic and rng.random() < 0.8 else [])
        words += ["muslim" if rng.random() < (0.8 if toxic else 0.15) else "christian"] if rng.random() < 0.9 else []
        rows_.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(toxic)))
    docs, labelled = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labelled, fair=fair)
    other = docs.select("doc_id", F.regexp_replace("text", "muslim", "christian").alias("text"))
    one, two = (rows(toxicity.score(d, model)[0], "c0") for d in (docs.where("text like '%muslim%'"), other))
    return np.mean([abs(one[d]["score"] - two[d]["score"]) for d in one]), model, docs


def test_op1_swaps_leave_scores(spark):
    fair, model, docs = swaps(spark, toxicity.FAIR)
    plain, _, _ = swaps(spark, 0.0)
    assert fair < 0.05 < plain
    scores = rows(toxicity.score(docs, model)[0], "c0")
    vile = [d["score"] for d in scores.values() if "vile" in d["c1"]]
    calm = [d["score"] for d in scores.values() if "vile" not in d["c1"]]
    assert np.mean(vile) > 0.5 > np.mean(calm)


def test_counterfactual_penalty():
    """Toxic labels that go with a group's name by chance don't give the name a weight of its own."""
    rng = np.random.default_rng(0)
    x, y, pairs = [], [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = set(rng.integers(20, 60, 6).tolist()) | ({1} if toxic else set()) | ({2} if rng.random() < (0.7 if toxic else 0.1) else set())
        x.append(sorted(words))
        y.append(toxic)
        if 2 in words:
            pairs.append((sorted(words), sorted(words - {2} | {3})))
    rows_of, none = toxicity.Rows.of, toxicity.Rows.of([])
    plain = toxicity.fit(rows_of(x), np.array(y), none, none, 64)
    fair = toxicity.fit(rows_of(x), np.array(y), rows_of([a for a, _ in pairs]), rows_of([b for _, b in pairs]), 64)
    assert abs(fair.weights[2] - fair.weights[3]) < 0.3 * abs(plain.weights[2] - plain.weights[3])
    assert fair.score([1, 30]) > 0.5 > fair.score([2, 30])


def test_op2(spark, data, docs):
    out = rows(queries.op2_license_scans(spark, data))
    for d, text in docs.items():
        words = WORD.findall(text.translate(A2Z))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        got = out[d]
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert got["first_word"] == min(places, default=None) and got["last_word"] == max(places, default=None)
        assert got["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(got["labels"].split(",")) | {""} and 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
        ("(MIT OR GPL-2.0) AND ISC", ["mit", "gpl-2.0", "or", "isc", "and"]),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]),
        ("MIT */", ["mit"]),
        ("(MIT", None),
        ("AND MIT", None),
        ("MIT OR", None),
        ("", None),
    ],
)
def test_licence_expressions(text, postfix):
    assert licenses.parse(text) == postfix


def test_licence_evaluation():
    value = lambda e: licenses.evaluate(licenses.parse(e))[0]
    assert value("MIT OR GPL-3.0") == licenses.RESTRICTS["mit"]
    assert value("MIT AND GPL-3.0") == licenses.RESTRICTS["gpl"]
    assert value("GPL-2.0 WITH Classpath-exception-2.0") < licenses.RESTRICTS["gpl"]
    assert licenses.restricts("lgpl-2.1") == licenses.RESTRICTS["lgpl"] and licenses.restricts("what") == licenses.UNKNOWN


def test_licence_labels(spark):
    """Every notice gives its label wherever it stands; tags give the licences that exist, and no other word."""
    texts = {i: f"Some words, {p.upper()}; more words." for i, p in enumerate(licenses.NOTICES)}
    tags = {
        "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": "gpl-2.0-or-later", "License: MIT": "mit", "  * licence: CC-BY-SA-4.0 */": "cc-by,cc-by-sa,cc-by-sa-4.0",
        "License-Expression: (MIT OR Apache-2.0) AND LicenseRef-own": "apache-2.0,licenseref-own,mit", "SPDX-License-Identifier: please": "", "License: see below": "",
        "SPDX-License-Identifier: GPL-2.0 WITH care": "", "a license: MIT": "", "License: MIT OR nothing-at-all": "",
    }
    texts |= {100 + i: f"first line\n{t}\nlast line" for i, t in enumerate(tags)}
    out = rows(licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert all(label in out[i]["labels"].split(",") for i, label in enumerate(licenses.NOTICES.values()))
    assert [out[100 + i]["labels"] for i in range(len(tags))] == list(tags.values())
    assert len(licenses.NOTICES) > 45 and out[104]["score"] == 0 < out[100]["score"] < licenses.RESTRICTS["gpl"]


def slow_fingerprint(text):
    words = [w.translate(A2Z) for w in TOKEN.findall(text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op3(spark, data, docs):
    out = rows(queries.op3_simhash(spark, data))
    fps = {d: slow_fingerprint(t) for d, t in docs.items()}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: r["fingerprint"] for d, r in out.items()}
    links = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert classes(fps, links) == {d: r["component_id"] for d, r in out.items()}


def test_golay_keys_meet_at_every_three_bits():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    other = fps.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    one, owner = simhash.golay_keys(fps.view(np.int64), False)
    two, near = simhash.golay_keys(other.view(np.int64), True)
    mine, theirs = defaultdict(set), defaultdict(set)
    for k, o in zip(one.tolist(), owner.tolist(), strict=True):
        mine[o].add(k)
    for k, o in zip(two.tolist(), near.tolist(), strict=True):
        theirs[o].add(k)
    assert all(mine[i] & theirs[i] for i in range(3000))
    assert len(two) / 3000 < 50


def test_op3_broadcasts_no_keys(spark, tmp_path):
    """Small files stand for many keys and links, so their sizes mustn't decide how they are joined."""
    ids = spark.range(500)
    ids.select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps.parquet"))
    ids.select(F.col("id").alias("a"), (F.col("id") % 9).alias("b")).write.parquet(str(tmp_path / "links.parquet"))
    fps, links = read(spark, str(tmp_path), "fps"), read(spark, str(tmp_path), "links")
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id") % 50).alias("text"))
    for made in (simhash.near_fingerprints(fps), _stars(links, True), _stars(links, False), simhash.near_duplicates(docs)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_keeps_one_without_broadcasts(spark):
    """Classes grow with the corpus, so they aren't sent to all tasks either."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id") % 50).alias("text"))
    kept = simhash.keep_one(docs)
    mine = {i: slow_fingerprint(f"a b c d {i}") for i in range(50)}
    links = [(a, b) for a, b in combinations(mine, 2) if (mine[a] ^ mine[b]).bit_count() <= 3]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(mine, links).values()))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def slow_hits(docs, items):
    """Words, hit words and hit items of each text, by looking up every window."""
    by = defaultdict(set)
    for i, text in items:
        w = WORD.findall((text or "").translate(A2Z))
        for k in range(max(1, len(w) - 12)):
            if w:
                by[tuple(w[k : k + 13])].add(i)
    widths, out = {len(k) for k in by}, {}
    for d, text in docs.items():
        w = WORD.findall(text.translate(A2Z))
        hit, who = set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if owners := by.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    who |= owners
        out[d] = (len(w), len(hit), sorted(map(str, who)))
    return out


def slow_targets(by):
    """Words that each source is to give, by sharing the excess again and again."""
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(by.values()), set()
    while True:
        left = total - sum(2 * by[s] for s in full)
        target = {s: 2 * by[s] if s in full else left * weight[s] / sum(weight[x] for x in by if x not in full) for s in by}
        over = {s for s in by if target[s] > 2 * by[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_op4(spark, data, docs):
    out = rows(queries.op4_decontamination(spark, data))
    items = [(r.item_id, r.text) for r in read(spark, data, "benchmark").collect()]
    hits = 0
    for d, (n, hit, who) in slow_hits(docs, items).items():
        want = {
            "doc_id": d, "n_words": n, "n_hit": hit, "n_items": len(who),
            "items_sha256": hashlib.sha256(",".join(who).encode()).hexdigest(), "contaminated": bool(hit) and 20 * hit >= n,
        }
        hits += bool(hit)
        assert out[d] == want
    assert hits


def test_pipeline(spark, data, docs):
    """All five stages against brute force, but for the classifier's own judgement."""
    table = read(spark, data, "documents")
    source = {r.doc_id: r.source for r in table.collect()}
    toxic = rows(toxicity.classify(table, read(spark, data, "labels")))
    left = {d: t for d, t in docs.items() if not toxic[d]["predicted"]}
    fps = {d: slow_fingerprint(t) for d, t in left.items()}
    near = classes(fps, [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    left = {d: t for d, t in left.items() if near[d] == d}
    found = slow_hits(left, [(r.item_id, r.text) for r in read(spark, data, "benchmark").collect()])
    left = {d: t for d, t in left.items() if not (found[d][1] and 20 * found[d][1] >= found[d][0])}
    assert 0 < len(left) < len(docs)

    got = corpus_pipeline.run(spark, data).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and {r.doc_id for r in got} <= set(left)
    t = tokens.Tokenizer(open(tokens.RANKS, "rb").read())
    seen = defaultdict(list)
    for r in got:
        seen[r.doc_id].append((r.seq_no, r.n_tokens))
    size, by, taken = {d: len(TOKEN.findall(x)) for d, x in left.items()}, defaultdict(int), defaultdict(int)
    for d, text in left.items():
        by[source[d]] += size[d]
        n = len(t.encoding.encode_ordinary(text)) + 1
        once = [(k, min(256, n - 256 * k)) for k in range(-(-n // 256))]
        copies = len(seen[d]) / len(once)
        assert copies in (0, 1, 2) and sorted(seen[d]) == sorted(once * int(copies))
        taken[source[d]] += int(copies) * size[d]
    target = slow_targets(by)
    assert all(abs(taken[s] - target[s]) <= max(size[d] for d in left if source[d] == s) for s in by)


def test_op4_offsets_and_shards(spark, monkeypatch):
    q = "What, in the world, is THE capital of a country nobody has ever heard of?"
    d = spark.createDataFrame([(1, f"Été — {q.lower()} Yes."), (2, "none"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, q), (8, "short item"), (9, None), (10, q), (11, "")], "item_id long, text string")
    one = rows(decontam.decontaminate(d, b))
    assert one[1]["item_ids"] == ["10", "7"] and one[1]["contaminated"] and one[3]["n_words"] == 0
    text = f"Été — {q.lower()} Yes.".encode()
    found = {text[s.byte_start : s.byte_end].decode() for s in one[1]["spans"]}
    assert any(x.startswith("what, in the world") for x in found) and any(x.endswith("heard of") for x in found)
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", 20)
    assert rows(decontam.decontaminate(d, b)) == one


def test_op4_automaton_memory():
    """A benchmark of as many bytes as an automaton takes stays small in a worker."""
    code = """
import random, resource
from procspark.llm import decontam
rng = random.Random(1)
items, left = [], decontam.AUTOMATON_BYTES
while left > 0:
    text = " ".join("w%x" % int(rng.paretovariate(0.35)) if rng.random() < 0.5 else "%05x" % rng.randrange(1 << 17) for _ in range(60)).encode()
    items.append((str(len(items)), text))
    left -= len(text)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
machine = decontam.Machine(items, 13)
assert machine.find(items[7][1].split()[3:30])[0] and not machine.find(items[7][1].split()[3:15])[0]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert int(got.stdout) < 300


def test_op5(spark, data, docs):
    table = read(spark, data, "documents")
    out = rows(queries.op5_mixing(spark, data))
    source = {r.doc_id: r.source for r in table.collect()}
    size = {d: len(TOKEN.findall(t)) for d, t in docs.items()}
    by = defaultdict(int)
    for d, s in source.items():
        by[s] += size[d]
    target = slow_targets(by)
    taken = defaultdict(int)
    for d, r in out.items():
        assert r["size"] == size[d] and r["source_size"] == by[source[d]] and r["target"] == pytest.approx(target[source[d]])
        assert 0 <= r["taken"] <= 2 * size[d]
        taken[source[d]] += r["taken"]
    for s in by:
        assert abs(taken[s] - target[s]) <= max(size[d] for d in size if source[d] == s)
    again = {d: r["taken"] for d, r in rows(mixing.digest(mixing.mix(table.repartition(7)))).items()}
    assert again == {d: r["taken"] for d, r in out.items()}


def test_op5_equal_rows(spark):
    """Sources that consist of copies of one row end within one row of their target, whatever the ids."""
    rows_ = [(i, f"w{i} " * (3 + i % 40), "a") for i in range(400)] + [(1000, "one two three four five", "b")] * 100 + [(None, "six seven", None)] * 300
    rows_ += [(2000 + i // 30, "tiny text", "c") for i in range(900)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(7)
    for table in (df, df.where("source = 'b'"), df.where("doc_id is null")):
        got = mixing.digest(mixing.mix(table)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
        for r in got.collect():
            assert abs(r.taken - r.target) <= r.most, r
    once, again = (sorted(map(repr, mixing.digest(mixing.mix(x)).collect())) for x in (df, df.repartition(3)))
    assert once == again
    assert "InArrow" not in mixing.digest(mixing.mix(df))._jdf.queryExecution().toString()


def test_op6(spark, data, docs, tmp_path):
    path = str(tmp_path / "shards")
    layout = tokens.materialise(read(spark, data, "documents"), path, records=350)
    got, total = tokens.read_shards(spark, path).collect(), layout.count
    assert sorted(r.slot for r in got) == list(range(total)) and layout.shards == -(-total // 350)
    t = tokens.Tokenizer(open(tokens.RANKS, "rb").read())
    by = defaultdict(dict)
    for r in got:
        by[r.doc_id][r.seq_no] = r.ids
        assert r.shard == r.slot // 350 and r.offset == r.slot % 350 * layout.stride
    for d, text in docs.items():
        ids = [x for k in sorted(by[d]) for x in by[d][k]]
        assert ids == t.encoding.encode_ordinary(text) + [t.end]
    rest = tokens.read_shards(spark, path, total - 450)
    assert sorted(r.slot for r in rest.collect()) == list(range(total - 450, total))
    files = list((tmp_path / "shards/shards").glob("shard=*/*.txt"))
    assert len(files) == layout.shards and sum(f.stat().st_size for f in files) == total * layout.stride
    # Brute force: sequences numbered in the table's order, permuted by the network itself.
    numbered = [(d, k) for d in docs for k in sorted(by[d])]
    slots = tokens.Feistel(total, tokens.KEY).slot(np.arange(total)).tolist()
    assert {(r.doc_id, r.seq_no): r.slot for r in got} == dict(zip(numbered, slots, strict=True))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.slot)]
    assert order != sorted(order) and len(set(order[:50])) > 20
    other, before = str(tmp_path / "again"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    tokens.materialise(read(spark, data, "documents"), other, records=350)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.slot: r.ids for r in tokens.read_shards(spark, other).collect()} == {r.slot: r.ids for r in got}


@pytest.mark.parametrize("text", ["", " ", "a  b", " a\n b\t c ", "don't stop", "x y z", "日本 語 é", "a\x1cb c", "12 3.5 !!  ", "\n\n a"])
def test_tokenizer_words(text):
    t = tokens.Tokenizer(open(tokens.RANKS, "rb").read())
    assert t.ids(text).tolist() == t.encoding.encode_ordinary(text)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel(n):
    f = tokens.Feistel(n, 99)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and f.index(slots).tolist() == list(range(n))


def slow_cuts(text):
    """Chunk ends by the definition: a gear hash of 8 bytes below those of 8 bytes before it, not above those of 8 behind."""
    h = [sum(int(cdc.GEAR[text[i - j]]) << j for j in range(min(8, i + 1))) & 0xFFFFFFFF for i in range(len(text))]
    ends = [i + 1 for i in range(len(h)) if all(h[i] < x for x in h[max(0, i - 8) : i]) and all(h[i] <= x for x in h[i + 1 : i + 9])]
    out = [0]
    for end in [*ends, len(text)]:
        while end - out[-1] > 256:
            out.append(out[-1] + 256)
        if end > out[-1]:
            out.append(end)
    return out


def test_op7(spark, data, docs):
    """Rows of chunks, up to well beyond the longest that are needed, against all documents."""
    out = rows(queries.op7_chunk_dedup(spark, data))
    first, found = {}, {}
    for d in sorted(docs):
        b = docs[d].encode()
        ends, found[d] = slow_cuts(b), []
        for i, x in enumerate(ends):
            for j in range(i + 1, len(ends)):
                if ends[j] - x >= 96:
                    key = (b[x : ends[j]], *(e - x for e in ends[i:j]))
                    found[d].append((x, ends[j], key))
                    first.setdefault(key, d)
                if ends[j] - x >= 96 + 2 * 256:
                    break
    removed = 0
    for d in docs:
        b, gone = docs[d].encode(), np.zeros(len(docs[d].encode()) + 1, bool)
        for x, y, key in found[d]:
            if first[key] < d:
                gone[x:y] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        assert (out[d]["n_bytes"], out[d]["n_removed"], out[d]["n_spans"]) == (len(b), int(gone.sum()), spans)
        assert out[d]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        removed += int(gone.sum())
    assert removed


def test_op7_catches_passages(spark):
    """Passages of 50 words and more that are planted at any place are caught by nine tenths of their bytes; other texts stay whole."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(bytes(rng.integers(97, 123, k, dtype=np.uint8)).decode() for k in rng.integers(3, 10, n))
    passages = [words(n) for n in rng.integers(51, 120, 60)]
    texts = {i: f"{words(rng.integers(5, 90))} {p} {words(rng.integers(5, 90))}" for i, p in enumerate(passages)}
    texts |= {100 + i: f"{words(rng.integers(5, 90))} {p} {words(rng.integers(5, 90))}" for i, p in enumerate(passages)}
    texts |= {200 + i: words(200) for i in range(60)}
    got = rows(cdc.digest(cdc.dedup_chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))))
    share = np.array([got[100 + i]["n_removed"] / len(p) for i, p in enumerate(passages)])
    size = np.array([len(p) for p in passages])
    assert share.min() >= 0.75 and share.mean() > 0.9
    # Of the bytes of passages of 300 to 500 bytes.
    middle = (size >= 300) & (size <= 500)
    assert middle.sum() >= 10 and (share * size)[middle].sum() >= 0.9 * size[middle].sum()
    assert not any(got[d]["n_removed"] for d in texts if not 100 <= d < 200)


@pytest.mark.parametrize("operator", [cdc.dedup_chunks, radix.repeated_windows])
def test_null_ids_keep_their_own_bytes(spark, operator):
    rng = np.random.default_rng(13)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = word(400)
    texts = [(1, word(50) + shared)] + [(None, word(20 + 7 * i) + shared + word(30)) for i in range(20)] + [(None, word(300)) for _ in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.n_bytes, r.kept_sha256): r for r in cdc.digest(operator(df)).collect()}
    assert len(got) == len(texts)
    for d, text in texts:
        plain = (len(text), hashlib.sha256(text.encode()).hexdigest())
        assert (plain in got) == (shared not in text or d == 1)


def test_op7_runs_stand_in_one_document(spark):
    """Chunks that repeat several documents are no passage; one of 96 bytes or more in one document is."""
    rng = np.random.default_rng(11)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = word(600)
    texts = {i: word(80) + passage[i * 30 : i * 30 + 90] + word(80) for i in range(18)}
    whole = word(2000)
    texts |= {50: passage, 51: whole, 60: word(300) + whole[500:1200] + word(300) + passage[100:180], 70: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed for r in cdc.dedup_chunks(df).collect()}
    ranges, first = {}, {}
    for d in sorted(texts):
        b = texts[d].encode()
        e = [0, *cdc.cuts(b)]
        # All rows of chunks, not the shortest only.
        ranges[d] = [(x, y, (b[x:y], *(z - x for z in e[i : j + 1]))) for i, x in enumerate(e) for j, y in enumerate(e) if y - x >= cdc.RUN_BYTES]
        for _, _, key in ranges[d]:
            first.setdefault(key, d)
    want = {d: cdc.merged([(x, y) for x, y, key in ranges[d] if first[key] < d], 1) for d in texts}
    assert {d: [(r.start, r.end) for r in runs] for d, runs in got.items()} == want
    assert not got[50] and sum(r.end - r.start for r in got[60]) > 600


def test_gear_cuts_resist_shifts():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))

    def pieces(b):
        ends = [0, *cdc.cuts(b)]
        return {b[x:y] for x, y in zip(ends, ends[1:], strict=False)}

    assert len(pieces(text) & pieces(b"inserted" + text)) > 0.95 * len(pieces(text))
    assert [0, *cdc.cuts(text)] == slow_cuts(text)
    sizes = np.diff([0, *cdc.cuts(text)])
    assert sizes[1:-1].min() > cdc.RADIUS and 15 < sizes.mean() < 20


def test_op8(spark, data):
    check_vectors(spark, data, 1.0)


def test_op8_recall_at_scale(spark):
    check_vectors(spark, "/root/testdata/sf0.1", 0.99)


def check_vectors(spark, data, least):
    out = rows(queries.op8_embedding_near_dedup(spark, data), "vec_id")
    table = read(spark, data, "embeddings").collect()
    by = defaultdict(list)
    for r in table:
        if r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding):
            by[r.label].append((r.vec_id, np.array(r.embedding, float)))
    links = []
    for group in by.values():
        x = np.stack([v / np.linalg.norm(v) for _, v in group])
        a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        links += [(group[i][0], group[j][0]) for i, j in zip(a, b, strict=True)]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(out) == len(table)
    assert all(r["n_links"] <= degree[v] for v, r in out.items())
    assert sum(r["n_links"] for r in out.values()) >= least * 2 * len(links)
    if least == 1:
        assert classes(out, links) == {v: r["component_id"] for v, r in out.items()}
        assert all(r["kept"] == (r["component_id"] == v) for v, r in out.items())


def test_op9_held_out(spark):
    data = "/root/testdata/sf0.1"
    out = rows(queries.op9_quality(spark, data))
    labels = {r.doc_id: r.quality for r in read(spark, data, "labels").collect()}
    good = np.array([out[d]["score"] for d in labels if labels[d] == 1])
    bad = np.array([out[d]["score"] for d in labels if labels[d] == 0])
    auc = (good[:, None] > bad[None, :]).mean()
    print("auc", auc, "kept good", (good >= 0.5).mean(), "kept bad", (bad >= 0.5).mean())
    assert auc > 0.8 and (good >= 0.5).mean() > 0.9


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(2)
    counts = defaultdict(int)
    for _ in range(5000):
        y = rng.random() < 0.7
        votes = [("+" if (y ^ (rng.random() > acc)) else "-") if rng.random() < 0.8 else "." for acc in (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)]
        counts["".join(votes)] += 1
    posterior, by, share = quality.estimate(dict(counts))
    right = [by[1][k][1] / (by[1][k][1] + by[1][k][2]) for k in range(8)]
    assert abs(share - 0.7) < 0.08 and right[0] > right[3] > right[7]
    assert all(0 < p < 1 for p in posterior.values())


def slow_windows(texts, width=50):
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            first.setdefault(texts[d][i : i + width], d)
    out = {}
    for d, b in texts.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_op10(spark, data, docs):
    got = rows(queries.op10_suffix_dedup(spark, data))
    want = slow_windows({d: t.encode() for d, t in docs.items()})
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


def test_op10_sql(data, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = {r[0]: r[1:] for r in con.execute(queries.ORACLES["op10_suffix_dedup"]).fetchall()}
    assert got == slow_windows({d: t.encode() for d, t in docs.items()})


def test_op10_periodic_and_shifted(spark):
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 100, 400, dtype=np.uint8)).decode()
    texts = {0: "ab" * 60, 1: "xx" + "ab" * 40 + "yy", 2: "a" * 49, 3: "a" * 50, 4: "a" * 200, 5: base, 6: base[:60] + "Q" + base[61:],
             7: "zz" + base[100:150], 8: "zz" + base[100:149] + "!", 9: "", 10: base[30:90] + base[200:300] + base[30:90], 12: "é" * 40 + base[1:51]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = rows(cdc.digest(radix.repeated_windows(df)))
    want = slow_windows({d: t.encode() for d, t in texts.items()})
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


def test_rpforest_blocks(spark, monkeypatch):
    """Leaves beyond a block are compared in pairs of blocks and lose nothing."""
    monkeypatch.setattr(rpforest, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16)) * 0.02 + rng.standard_normal(16)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = rows(rpforest.near_vectors(df), "vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {v: r["n_links"] for v, r in out.items()} == {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.98).sum(axis=1))}
    assert F is not None


def test_rpforest_rare_dimensions(spark, monkeypatch):
    """Vectors link in every dimension, also in more dimensions than the sample has vectors."""
    monkeypatch.setattr(rpforest, "SAMPLE_ROWS", 16)
    rng = np.random.default_rng(6)
    many = np.repeat(rng.standard_normal((150, 64)), 2, axis=0) + rng.standard_normal((300, 64)) * 1e-4
    vectors = [*many, *(v + rng.standard_normal(len(v)) * 1e-4 for k in range(20) for v in [rng.standard_normal(20 + k)] * 2)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    out = rows(rpforest.near_vectors(df), "vec_id")
    assert {v: (r["n_links"], r["component_id"]) for v, r in out.items()} == {i: (1, i - i % 2) for i in range(len(vectors))}


def test_rpforest_deeper_than_the_sample(spark, monkeypatch):
    """Splits go on below what the sample can set, a small label beside a large one has one leaf, and recall holds."""
    monkeypatch.setattr(rpforest, "SAMPLE_ROWS", 512)
    monkeypatch.setattr(rpforest, "LEAF_ROWS", 8)
    rng = np.random.default_rng(21)
    one = rng.standard_normal((3000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = rng.standard_normal(one.shape)
    off -= (off * one).sum(axis=1, keepdims=True) * one
    cosine = rng.uniform(0.982, 0.999, 3000)[:, None]
    other = one * cosine + off / np.linalg.norm(off, axis=1, keepdims=True) * np.sqrt(1 - cosine**2)
    rows_ = [(2 * i + k, v.tolist(), 1 if i < 2997 else 2) for i in range(3000) for k, v in enumerate((one[i], other[i]))]
    out = rows(rpforest.near_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int")), "vec_id")
    found = np.array([out[2 * i]["n_links"] == 1 and out[2 * i + 1]["component_id"] == 2 * i for i in range(3000)])
    assert found.mean() >= 0.95 and found[2997:].all() and all(r["n_links"] <= 1 for r in out.values())
    tree = rpforest.Tree.grow(one[:512], 10, rng)
    assert tree.known == 6 and np.bincount(tree.leaves(one)[1]).max() < 100


def test_rpforest_huge_and_tiny_numbers(spark):
    vectors = [[1e200, 1e200], [2e200, 2e200], [1e-200, 1e-200], [3.0, 3.0], [1e300, -1e300], [-1.0, 1.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    out = rows(rpforest.near_vectors(df), "vec_id")
    assert [(out[i]["n_links"], out[i]["component_id"]) for i in range(6)] == [(3, 0)] * 4 + [(0, 4), (0, 5)]


def test_rpforest_recall_at_full_depth():
    """Pairs with a cosine of 0.98 to 0.999, planted in clusters, share a leaf of the trees for 131,072 vectors of a label."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(np.repeat(unit(rng.standard_normal((4096, 64))), 8, axis=0) + rng.standard_normal((4096 * 8, 64)) * 0.05)
    one, cosine = base[rng.choice(len(base), 3000, replace=False)], rng.uniform(0.98, 0.999, 3000)[:, None]
    off = rng.standard_normal(one.shape)
    off = unit(off - (off * one).sum(axis=1, keepdims=True) * one)
    other = one * cosine + off * np.sqrt(1 - cosine**2)
    sample, depth = base[rng.choice(len(base), rpforest.SAMPLE_ROWS, replace=False)], 11
    assert ((one * other).sum(axis=1) >= rpforest.LEAST_COSINE - 1e-9).all()
    rng, met = np.random.default_rng(rpforest.SEED), np.zeros(3000, bool)
    for tree in [rpforest.Tree.grow(sample, depth, rng) for _ in range(rpforest.TREES)]:
        (a, la), (b, lb) = tree.leaves(one), tree.leaves(other)
        met[np.intersect1d(a << 20 | la, b << 20 | lb) >> 20] = True
    assert met.mean() >= 0.99


@pytest.mark.parametrize("dimensions", [64, 384, 768])
@pytest.mark.parametrize("depth", [8, 12, 20])
def test_rpforest_copies_and_recall(dimensions, depth):
    """Copies of a vector are bounded in every dimension and depth, and pairs of exactly the least cosine meet."""
    rng = np.random.default_rng(dimensions)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sample, one, off = (unit(rng.standard_normal((n, dimensions))) for n in (4096, 500, 500))
    off = unit(off - (off * one).sum(axis=1, keepdims=True) * one)
    other = one * rpforest.LEAST_COSINE + off * np.sqrt(1 - rpforest.LEAST_COSINE**2)
    met, copies = np.zeros(500, bool), 0
    for tree in [rpforest.Tree.grow(sample, depth, rng) for _ in range(rpforest.TREES)]:
        (a, la), (b, lb) = tree.leaves(one), tree.leaves(other)
        copies += len(a) / 500
        met[np.intersect1d(a << 40 | la, b << 40 | lb) >> 40] = True
    assert copies <= 40 and met.mean() >= 0.98


def test_rpforest_common_vectors(spark, monkeypatch):
    """Rows of a vector that makes up much of the table are dealt to many tasks, and their numbers stay whole."""
    monkeypatch.setattr(rpforest, "HOT", 4)
    rng = np.random.default_rng(2)
    common, alone = rng.standard_normal(8).tolist(), rng.standard_normal((20, 8)).tolist()
    rows_ = [(i, common, 1) for i in range(100)] + [(100 + i, v, 1) for i, v in enumerate(alone)] + [(None, common, 1), (None, common, None), (500, common, 2)]
    out = rpforest.near_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    want = [(i, 100, 0, i == 0) for i in range(100)] + [(i, 0, i, True) for i in (*range(100, 120), 500)]
    assert [g for g in got if g[0] >= 0] == want
    assert sorted(g[1:] for g in got if g[0] < 0 and g[2] is not None) == [(100, 0, False)] and sum(g[0] < 0 for g in got) == 2


def test_rpforest_earlier_leaves():
    rows_, leaf = np.array([0, 0, 0, 2, 5, 5]), np.array([3, 4, 9, 1, 7, 8])
    assert rpforest.earlier(rows_, leaf).to_pylist() == [[], [3], [3, 4], [], [], [7]]
    assert rpforest.earlier(rows_[:0], leaf[:0]).to_pylist() == []


RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_force(rows_):
    """All pairs of words, without keys."""
    counts = defaultdict(int)
    for d, t in rows_:
        for run in RUN.findall(t or ""):
            w = run.translate(A2Z)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [] for w in counts}
    for a, b in combinations(sorted(counts), 2):
        if distance_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = {"word": w, "form": form[w], "root": root, "n": n, "n_near": len(near[w]), "form_n": counts.get(form[w])}
    return out


def test_op12(spark, data, docs):
    want = variants_by_force(docs.items())
    got = rows(queries.op12_spelling_variants(spark, data), "word")
    assert got == want and any(r["form"] for r in want.values())


def test_op12_small(spark):
    rng = np.random.default_rng(3)
    base = ["aaabbb", "récolte", "Straße×÷", "colouring", "abcdefgh", "mississippi"]
    rows_ = []
    for d in range(400):
        words_ = []
        for w in rng.choice(base, 60, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]):
            i, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 40))
            words_.append(w[:i] + w[i + 1 :] if kind == 0 else w[:i] + "ab"[d % 2] + w[i:] if kind == 1 else w[:i] + "bß"[d % 2] + w[i + 1 :] if kind == 2 else w)
        rows_.append((None if d % 50 == 0 else d, "日本".join(words_) if d % 2 else " ".join(words_)))
    # A chain of forms: each word five times as often as the one before it.
    for k, n in enumerate((7, 45, 260, 1500)):
        rows_ += [(10_000 * (k + 1) + j, "chain" + "x" * (k + 1)) for j in range(n)]
    rows_ += [(2000 + k, "Z" * 5000 + "q" * 5000) for k in range(6)] + [(3000, "Z" * 5000 + "q" * 4999 + " ") for k in range(6)]
    want = variants_by_force(rows_)
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(5)
    assert rows(spelling.spelling_variants(df), "word") == want
    assert want["chainx"]["root"] == "chainxxxx" and max(map(len, want)) == 10_000


def test_delete_keys_meet():
    """Words share a key at one place exactly if one letter is replaced there, or a word is another's deletion."""
    words_ = ["a", "ab", "ba", "aab", "abb", "aaa", "aaaa", "", "xaab", "ñab"]
    keys, at, first, owner = spelling.delete_keys(words_)
    text = {}
    for k, p, w in zip(keys, at, (words_[o] for o in owner), strict=True):
        assert text.setdefault(k, w if p < 0 else w[:p] + w[p + 1 :]) == (w if p < 0 else w[:p] + w[p + 1 :])
    assert len(text) == len(set(text.values()))
    assert sorted(p for p, f, o in zip(at, first, owner, strict=True) if f and words_[o] == "aab") == [0, 2]


def lines_by_force(rows_):
    low = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(A2Z)
    holders = defaultdict(set)
    for d, t in rows_:
        for line in (t or "").split("\n"):
            if len(low(line)) >= 20 and d is not None:
                holders[low(line)].add(d)
    out = []
    for d, t in rows_:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if not (len(low(x)) >= 20 and len(holders[low(x)]) >= 3 and max(holders[low(x)]) != d)]
        out.append((d, len(all_), len(all_) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_op13(spark, data, docs):
    got = queries.op13_line_dedup(spark, data).collect()
    want = lines_by_force(docs.items())
    assert sorted(map(tuple, got)) == sorted(want) and any(w[2] for w in want)
    assert {f.name for f in queries.op13_line_dedup(spark, data).schema} == {"doc_id", "n_lines", "n_dropped", "kept_sha256"}


def test_op13_small(spark):
    rng = np.random.default_rng(4)
    pool = [f"  Line number {i} of the pool \t" for i in range(40)] + ["short", "", "x" * 20, " " * 30, "É" + "é" * 19, "n" * 19, "LINE NUMBER 3 OF THE POOL"]
    rows_ = [(int(d), "\n".join(rng.choice(pool, int(rng.integers(1, 200))))) for d in rng.integers(0, 60, 90)]
    # One line makes up a third of all rows; a long text has bits in far words only; a line ends in CR.
    rows_ += [(100 + d, "the very common line of all\n" * 3 + f"own line of the document {d}") for d in range(50)]
    rows_ += [(500, "\n".join(f"unique line number {i}" for i in range(9000)) + "\nthe very common line of all\r\n"), (501, "the VERY common line of all\n\n")]
    rows_ += [(None, "the very common line of all\nand another one"), (None, None), (7, ""), rows_[0], rows_[0]]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(6)
    key_ = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, lines.digest(lines.dedup_lines(df)).collect()), key=key_) == sorted(lines_by_force(rows_), key=key_)
    bits = {r.doc: r for r in lines.line_bitmaps(df).collect()}
    assert [b.word for b in bits[500].bits] == [140] and bits[500].n_dropped == 1 and 501 not in bits


def test_op13_is_native(spark, data):
    plan = queries.op13_line_dedup(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_op13_ranges_serve_the_window(spark, data):
    """The window takes the ranges as they are: one exchange by range, none by hash between them."""
    d = read(spark, data, "documents")
    raw = lines._lines(d, 20).select("h", "g", "doc", "pos").repartitionByRange("h", "g", "doc")
    from pyspark.sql import Window

    out = raw.withColumn("nth", F.row_number().over(Window.partitionBy("h", "g", "doc").orderBy("pos"))).where("nth = 1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan


def divergence_by_force(rows_):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, n, groups = defaultdict(int), defaultdict(int), set()
    for _, text, lang, source in rows_:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        ws = [w.translate(A2Z) for w in term.findall(text or "")]
        for w in set(ws):
            df[lang, w] += 1
        for w in ws:
            n[lang, source, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = sorted(w for (x, w), k in df.items() if x == lang and k >= 10), sorted(s for x, s in groups if x == lang)
        v = len(kept)
        count = {s: {w: n.get((lang, s, w), 0) for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        total = {s: sum(c.values()) for s, c in count.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (total[s] + 2 * v) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            own = sorted((-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if count[s][w] > 0 and p[s][w] > p[None][w])[:10]
            for part, ranked in (("pair", pair), ("term", own)):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(ranked)]
    return out


def test_op11(spark, data):
    table = [(r.doc_id, r.text, r.lang, r.source) for r in read(spark, data, "documents").collect()]
    assert sorted(map(tuple, queries.op11_source_divergence(spark, data).collect())) == sorted(divergence_by_force(table))


def test_op11_small(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éte", "日本", "don", "A", "été"]
    rows_ = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 12)))) + ("7don't" if i % 3 else ""), [None, "en", "de", ""][i % 4], [None, "a", "b", "é", "hot", "hot", "hot"][i % 7]) for i in range(300)]
    rows_ += [(1, None, "fr", "x"), (2, "", "fr", "y"), (3, "one text only", "it", "x"), (3, "one text only", "it", "z"), (4, None, "en", "silent"), (None, "!!!", "en", "silent")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string").repartition(5)
    assert sorted(map(tuple, divergence.audit(df).collect())) == sorted(divergence_by_force(rows_))


def test_op11_sketch(spark, data):
    """Estimates are never too small, also where cells are full, and rare terms go before the shuffle."""
    d = read(spark, data, "documents")
    df = defaultdict(int)
    for r in d.collect():
        for w in set(r.text.encode().translate(divergence.TERMS).split()):
            df[r.lang, w] += 1
    sketch = divergence.frequency_sketch(d.repartition(7))
    langs = {lang for lang, _ in df}
    for lang in langs:
        terms = [w for x, w in df if x == lang]
        at = divergence.cells(lang, terms)
        bound = np.minimum.reduce([sketch[i, at[i]] for i in range(divergence.ROWS)])
        true = np.array([min(df[lang, w], divergence.CEILING) for w in terms])
        assert (bound >= true).all() and (bound == true).mean() > 0.99
    rare = {(r.lang, r.term) for r in divergence.term_counts(d).collect()}
    assert len(rare) < 1.05 * sum(n >= 10 for n in df.values())


def test_shared_keys_in_any_order_of_documents():
    """A key of two documents is shared whichever comes first, also where a batch ends between them."""
    from procspark.llm.repeats import _Stream

    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("doc", "at", "key", "sure"), (*r, False), strict=True)) for r in rows])
    got = _Stream(("key",), ("doc", "at"), "shared")([batch((3, 0, 5), (1, 1, 5), (4, 2, 6), (4, 3, 6), (9, 4, 7)), batch((2, 5, 7), (8, 6, 8))])
    assert sorted((r["doc"], r["at"]) for b in got for r in b.to_pylist()) == [(1, 1), (2, 5), (3, 0), (9, 4)]
