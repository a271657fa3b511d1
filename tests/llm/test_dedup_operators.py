"""Line, document and embedding near-duplicates, mixing, WARC and the pipeline against brute force, with odd rows."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partita.llm import components, embedding_dups, line_dedup, minhash, mixing, warc

from .test_text_operators import DOCS, ODD, docs


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def lines_of(text):
    out = []
    for line in (text or "").split("\n"):
        out.append(" ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()))
    return out


def described(texts):
    """The rows that line dedup makes of texts."""
    rb = pa.RecordBatch.from_pydict({"d": pa.array(range(len(texts)), pa.int64()), "rk": pa.array([0] * len(texts), pa.int64()), "text": pa.array(texts)})
    return pa.Table.from_batches(line_dedup._describe([rb])).to_pylist()


def test_simhash_and_anchors_equal_a_plain_count():
    rng = random.Random(1)
    texts = ["a", "x y", prose(rng, 9), prose(rng, 700), "ab cd ab " * 21000, prose(rng, 128), f"{prose(rng, 127)}\n\n ... \n{prose(rng, 3)}"]
    got = described(texts)
    want = [(i, pos, x) for i, t in enumerate(texts) for pos, x in enumerate(lines_of(t)) if x]
    assert [(r["d"], r["pos"], r["size"]) for r in got] == [(i, pos, len(x)) for i, pos, x in want]
    hashes = lambda w: int(line_dedup._words(w)[3][0])
    for r, (_, _, x) in zip(got, want, strict=True):
        hs = [hashes(w) for w in x.split(" ")]
        second = [int(line_dedup._mix(np.array([h], np.uint64) + line_dedup._GOLD)[0]) for h in hs]
        for side, each in (("sim0", hs), ("sim1", second)):
            assert r[side] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))
        best = [0] * 4
        for h, w in zip(hs, x.split(" "), strict=True):
            kind = h * int(line_dedup._GOLD) % (1 << 64) >> 62
            best[kind] = max(best[kind], min(len(w), 31) << 58 | h >> 6)
        assert [r[f"a{c}"] % (1 << 64) for c in range(4)] == best


def test_texts_in_pieces_give_the_rows_of_whole_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["\n".join(prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 30))) for _ in range(12)] + ["", prose(rng, 300), "İ ẞ ǅ ß É\r\nx"]
    whole = described(texts)
    monkeypatch.setattr(line_dedup, "SLICE", 64)
    line_dedup._powers.cache_clear()
    assert described(texts) == whole
    line_dedup._powers.cache_clear()


def test_line_dedup_drops_exact_and_near_lines_once(spark):
    rng = random.Random(2)
    base = [prose(rng, 14) for _ in range(12)]
    near = [b[:-2] + "zq" for b in base]
    texts = ["\n".join(base[:6]), "\n".join([base[0].upper() + " !!", "", "...", near[1], *base[6:]]), "\n".join([*near[6:], "unique line of its own 123"]), None, "", base[0], base[0]]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_dropped == 0 and got[0].n_words == "own"
    assert got[1].text.split("\n")[:2] == ["", "..."] and got[1].n_dropped >= 1
    assert got[3].text is None and got[3].n_lines == 0 and got[4].text == "" and got[5].text == "" and got[6].text == ""
    assert got[None].text == "no id here"
    # What goes has a near line that stays, and everything exact goes.
    seen = {x for r in got.values() for x in lines_of(r.text)}
    for i, t in enumerate(texts):
        kept = lines_of(got[i].text)
        for x in lines_of(t):
            if x and x not in kept:
                assert any(y and 1 - distance(x, y) / max(len(x), len(y)) >= 0.8 for y in seen)
    assert line_dedup.dedup_lines(docs(spark, []).limit(0)).count() == 0


def test_line_dedup_recall_of_near_lines(spark, sf):
    """Against all pairs of edit similarity 0.8: at least 0.9 of the near lines go, and none that has no near line before it."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    occ = [(r.d, r.rk, r.pos, r.lid) for r in line_dedup._documents(df, "doc_id", "text").mapInArrow(line_dedup._describe, line_dedup.LINE_SCHEMA).collect()]
    texts = {}
    for r in df.where("text is not null").collect():
        for pos, x in enumerate(lines_of(r.text)):
            texts[r.doc_id, pos] = x
    text = {lid: texts[d, pos] for d, _, pos, lid in occ}
    spread = {i: (len(x), np.bincount([ord(c) % 64 for c in x], minlength=64)) for i, x in text.items()}
    ids, links = sorted(text, key=lambda i: len(text[i])), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if spread[b][0] * 0.8 > spread[a][0]:
                break
            gap = spread[a][1] - spread[b][1]
            if max(np.maximum(gap, 0).sum(), np.maximum(-gap, 0).sum()) <= 0.2 * spread[b][0] + 1e-9:
                links.add((a, b))
    pairs = spark.createDataFrame([(a, b, text[a], text[b]) for a, b in links], "a long, b long, ta string, tb string")
    far = F.levenshtein("ta", "tb") <= F.greatest(F.char_length("ta"), F.char_length("tb")) * 0.2 + 1e-9
    group = groups(ids, [(r.a, r.b) for r in pairs.repartition(32).where(far).select("a", "b").collect()])
    first, exact = {}, set()
    for x in sorted(occ):
        first.setdefault(group[x[3]], x)
    for lid in ids:
        exact |= set(sorted(x for x in occ if x[3] == lid)[1:])
    want = {x[:3] for x in occ} - {x[:3] for x in first.values()}
    exact = {x[:3] for x in exact}
    gone = {(r.d, r.rk, p) for r in line_dedup.find_dropped(df).collect() for p in r.drops}
    near = want - exact
    assert exact <= gone and len(near & gone) >= 0.9 * len(near) and len(near) > 20
    assert gone <= want


def typo(rng, line):
    i = rng.choice([i for i, c in enumerate(line) if c != " "])
    return line[:i] + "z" + line[i + 1 :]


def test_line_dedup_finds_lines_with_one_letter_changed(spark):
    rng = random.Random(8)
    base = [prose(rng, 10) for _ in range(150)]
    got = line_dedup.find_dropped(docs(spark, ["\n".join(base), "\n".join(typo(rng, b) for b in base)])).collect()
    assert {r.d: len(r.drops) for r in got} == {1: 150}


def test_line_dedup_finds_short_lines_with_one_letter_changed(spark):
    rng = random.Random(9)
    base = [prose(rng, 3) for _ in range(100)] + ["".join(rng.choices("abcdefgh", k=k % 20 + 5)) for k in range(100)]
    got = line_dedup.find_dropped(docs(spark, ["\n".join(base), "\n".join(typo(rng, b) for b in base)])).collect()
    assert {r.d: len(r.drops) for r in got} == {1: 200}


def test_long_lines_are_compared_by_characters():
    rng = random.Random(10)
    words = prose(rng, 200).split()
    letters = " ".join(w[:-1] + "z" if i % 4 == 0 else w for i, w in enumerate(words))
    longest = sorted(range(200), key=lambda i: -len(words[i]))[:39]
    replaced = " ".join("z" * len(w) if i in longest else w for i, w in enumerate(words))
    base = " ".join(words)
    want = [1 - distance(base, x) / max(len(base), len(x)) >= 0.8 for x in (letters, replaced)]
    assert [line_dedup.near(base, x) for x in (letters, replaced)] == want == [True, False]


def test_edit_similarity_equals_a_plain_table():
    rng = random.Random(11)
    for _ in range(400):
        a = prose(rng, rng.randint(0, 25))
        w = a.split(" ")
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = [prose(rng, 1)] * rng.randint(0, 2)
        b = " ".join(w)
        b = typo(rng, b) if rng.random() < 0.5 and b.strip() else b
        d = distance(a, b)
        assert line_dedup.edit_distance(a, b) == d
        assert line_dedup._at_least(a, b) <= d <= line_dedup._at_most(a, b)
        assert line_dedup.near(a, b) == (d <= max(len(a), len(b)) * 0.2 + 1e-9)


def test_shared_blocks(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 256, (400, 16)), rng.integers(0, 256, (400, 16))
    y = np.where(x == y, x ^ 1, y)
    y[::2, 3] = x[::2, 3]
    sims = [z.astype(np.uint8).view(np.int64).tolist() for z in (x, y)]
    df = spark.createDataFrame([(tuple(a), tuple(b)) for a, b in zip(*sims, strict=True)], "a struct<sim0:long,sim1:long>, b struct<sim0:long,sim1:long>")
    assert [r.ok for r in df.select(line_dedup.share_block("a", "b").alias("ok")).collect()] == [True, False] * 200


def test_line_dedup_ties_repeated_rows_and_clashing_columns(spark):
    names = ["d", "rk", "drops", "row", "lid", "k", "n_lines", "at"]
    rows = [(0, "one line here\nother", 7), (0, "one line here\nother", 7), (None, "one line here", 7), (1, "One line, here!\nkept", 7), (1, "kept\nown", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").select("doc_id", "text", *[F.col("extra").alias(n) for n in names])
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", *[n for n in names if n != "n_lines"], "n_lines", "n_dropped"]
    got = got.collect()
    assert len(got) == 5 and all(r.d == r.row == r.drops == 7 for r in got)
    assert [r.text for r in got if r.doc_id == 0] == ["one line here\nother"] * 2 and [r.text for r in got if r.doc_id is None] == [""]
    assert sorted(r.text for r in got if r.doc_id == 1) in (["kept", "own"], ["", "kept\nown"])


def weighted_similarity(a, b, idf):
    return minhash.similarity(minhash.weighted(a, idf), minhash.weighted(b, idf))


def brute_classes(spark, df):
    idf = minhash.idf_table(df)
    rows = [(r.doc_id, np.asarray(r.w, np.int64)) for r in df.select("doc_id", minhash.word_hashes(F.col("text")).alias("w")).collect() if r.doc_id is not None]
    seen, links, ids = defaultdict(list), set(), [i for i, _ in rows]
    words = dict(rows)
    for i, w in rows:
        for h in set(minhash.shingles(w).tolist()):
            seen[h].append(i)
    sims = {}
    for v in seen.values():
        for a, b in itertools.combinations(sorted(set(v)), 2):
            if (a, b) not in sims:
                sims[a, b] = weighted_similarity(words[a], words[b], idf)
                if sims[a, b] >= minhash.THRESHOLD:
                    links.add((a, b))
    return groups(ids, links), sims


def test_minhash_classes_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = brute_classes(spark, df)
    got = {r.doc_id: r for r in minhash.op8_minhash(spark, sf).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_minhash_big_group_and_outsiders(spark):
    rng = random.Random(4)
    base, far = prose(rng, 200).split(), prose(rng, 200).split()
    texts = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(200)] = f"edit{k}"
        texts.append(" ".join(w))
    for k in range(20):  # similar to each other, not to the first group, with which they share a passage
        w = base[:120] + far[:80]
        w[rng.randrange(120, 200)] = f"other{k}"
        texts.append(" ".join(w))
    df = docs(spark, texts)
    want, _ = brute_classes(spark, df)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect() if r.doc_id is not None}
    assert got == want and len(set(want.values())) == 2


def test_minhash_odd_texts(spark):
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(docs(spark, [*ODD, "SAME", "a b c"])).collect()}
    n = ODD.index("same")
    assert got[n] == (n, True) and got[n + 1] == (n, False) and got[n + 2] == (n, False) and got[None] == (None, True)
    assert all(got[i] == (i, True) for i in range(4))
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    w = rng.random(len(h)) + 0.5
    keep = np.arange(len(h)) % 5 > 0
    hits = (minhash.signature(h, w, 40) == minhash.signature(h[keep], w[keep], 40)).mean()
    assert abs(hits - minhash.similarity((h, w), (h[keep], w[keep]))) < 0.25
    assert (minhash.signature(h, w) == minhash.signature(h, w)).all()


def test_signatures_of_long_texts_agree_without_bias():
    """Shingles of long texts share variates (POOL draws): agreement still follows similarity."""
    rng = np.random.default_rng(2)
    hits, want = [], []
    for _ in range(12):
        h = np.unique(rng.integers(0, 1 << 63, 40000).astype(np.uint64))
        w = rng.random(len(h)) + 1
        keep = rng.random(len(h)) < 0.85
        hits.append((minhash.signature(h, w, 40) == minhash.signature(h[keep], w[keep], 40)).mean())
        want.append(minhash.similarity((h, w), (h[keep], w[keep])))
    assert abs(np.mean(hits) - np.mean(want)) < 0.06


def test_overlaps_in_cells_equal_the_weighted_similarity():
    rng = np.random.default_rng(3)
    idf = 1 + rng.random(minhash.PLACES)
    texts = [np.repeat(rng.integers(0, 9, rng.integers(1, 60)), rng.integers(1, 4)) for _ in range(40)] + [np.zeros(900, np.int64), np.arange(6000)]
    sets = [minhash._expanded(t) for t in texts]
    got = minhash.overlaps(sets, sets, idf)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            (ha, wa), (hb, wb) = minhash.weighted(a, idf), minhash.weighted(b, idf)
            s = minhash.similarity((ha, wa), (hb, wb))
            low = got[i, j]
            assert abs(low / (wa.sum() + wb.sum() - low) - s) < 1e-5


def brute_vectors(rows):
    v = {}
    for i, (key, e, label) in enumerate(rows):
        if key is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        x = np.asarray(e, np.float32).astype(np.float64)
        v[i] = (x / np.linalg.norm(x), label)
    links = [(a, b) for a, b in itertools.combinations(v, 2) if v[a][1] == v[b][1] and len(v[a][0]) == len(v[b][0]) and v[a][0] @ v[b][0] >= 0.98]
    return links


@pytest.mark.parametrize("cell", [512, 8])
def test_embeddings_equal_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        c = rng.standard_normal(24)
        rows += [(len(rows) + k, (c + rng.standard_normal(24) * 0.09 * rng.random()).tolist(), g % 2) for k in range(25)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, [0.0] * 24, 0), (204, None, 0), (205, [float("nan")] * 24, 0)]
    rows += [(206, [None, *rows[0][1][1:]], 0), (207, rows[0][1], None), (None, rows[0][1], 0), (208, [], 0), (209, rows[0][1][:3], 0), (210, [x * 7 for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("own"))
    links = brute_vectors(rows)
    ids = [r[0] for r in rows]
    n = defaultdict(int)
    for a, b in links:
        n[ids[a]] += 1
        n[ids[b]] += 1
    want = groups([i for i in ids if i is not None], [(ids[a], ids[b]) for a, b in links])
    got = {r.vec_id: r for r in embedding_dups.near_duplicates(df, cell=cell).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if i is not None} == {i: (n[i], want[i]) for i in want}
    assert got[None].component_id is None and got[None].kept
    assert embedding_dups.near_duplicates(df.limit(0)).count() == 0


def test_filter_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    f = embedding_dups.filters(64, embedding_dups.code_words(50_000))
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(f.decode(x), f.decode(0.98 * x + math.sqrt(1 - 0.98**2) * z), strict=True)]
    assert np.mean(met) >= 0.99


def filled(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w, left, free, goal = {s: weights[k % 3] for k, s in enumerate(names)}, float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return goal | {s: level * w[s] for s in free}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
            free.discard(s)
    return goal


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["b", "a", "é", None, "big", "big", "big"]), 1) for i in range(900)]
    rows += [(5000, None, "a", 1), (5001, "", "empty", 1), (5002, "one two", "tiny", 1), (5003, "p q", "tiny", 1), (None, "x y", "b", 1), (7, "same twice", "b", 1), (7, "same twice", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mix(df)
    got = mixed.collect()
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r._source] += r.size
        taken[r._source] += r.size * r.copies
        goal[r._source] = r.target
        assert 0 <= r.copies <= 3
    assert len(got) == len(rows) and all(r.source_size == sizes[r._source] for r in got)
    want = filled(sizes)
    for s in sizes:
        assert abs(goal[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - goal[s]) <= max(2, 0.01 * goal[s])
    again = sorted((str(r._key), r.h, r.copies) for r in mixing.mix(df.repartition(5)).collect())
    assert again == sorted((str(r._key), r.h, r.copies) for r in got)
    out = mixing.take(df, mixed)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df.limit(0), mixing.mix(df.limit(0))).count() == 0


RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["700b", "128m"])
def test_warc_round_trip_with_magics_inside(spark, tmp_path, split):
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "x" + RECORD * 3 + "tail"), (6, RECORD), (7, "WARC/1.1\r\n"), (8, "é\r\n\r\n€WARC/1.1\r\nfoo"), (9, RECORD)]
    rows += [(10, "WARC/1.1\r\nContent-Length: 100000\r\nWARC-Type: response\r\n\r\nzz"), (11, "b" * 3000), (12, "WARC/1.1\r\nContent-Length: x\r\n\r\n"), (13, "ends with\r\n")]
    rows += [(14, "WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\nWARC/1.x"), (15, "WARC/1."), (None, "no id"), (11, "b" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("http://x/\r\nWARC-Type: no")).withColumn("digest", F.lit("own"))
    best = {}
    for i, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, h in rows:
        raw, w = (h or "").encode(), best[h or ""]
        w = i if w == -1 else w
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == w else ("revisit", w))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        (tmp_path / "in").mkdir()
        df.coalesce(1).write.parquet(str(tmp_path / "in" / "pages.parquet"))
        assert sorted(map(tuple, warc.op10_warc(spark, str(tmp_path / "in")).collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def record(n, body, version="1.0", length=None):
    block = f"HTTP/1.1 200 OK\r\n\r\n{body}"
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {length or len(block)}\r\n\r\n{block}\r\n\r\n"


def test_warc_of_both_versions(spark, tmp_path):
    (tmp_path / "a.warc").write_text("".join(record(n, f"page {n}", "1.0" if n % 3 else "1.1") for n in range(5)), newline="")
    got = {r.record_id: r.bytes for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {f"<urn:page:{n}>": 6 for n in range(5)}


@pytest.mark.parametrize("broken", [record(2, "x", length=7), record(2, "x", length=9000), "junk", record(2, "x")[:-30]])
def test_warc_with_a_broken_chain_stops(spark, tmp_path, broken):
    (tmp_path / "a.warc").write_text(record(0, "a") + record(1, "b") + broken + ("" if broken.startswith("WARC") and not broken.endswith("\n") else record(3, "c")), newline="")
    with pytest.raises(RuntimeError, match="end at byte"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_mixing_with_clashing_columns_and_rates(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3], 7) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h int").withColumn("row", F.col("h")).withColumn("copies", F.col("h"))
    mixed = mixing.mix(df)
    taken = {(r._key): r.copies for r in mixed.collect()}
    out = mixing.take(df, mixed)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
        assert r.h == r.row == 7
    assert got == {k: v for k, v in taken.items() if v}
    # Rates are exp(lam * size / scale) up to 3, and hold the target; copies of a size are those rates rounded.
    hist = df.select("source", mixing.words("text").alias("size")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    state = {r.source: r for r in mixing.dual(hist, mixing.targets(hist)).collect()}
    sums, copied = defaultdict(float), defaultdict(int)
    for r in hist.collect():
        s = state[r.source]
        sums[r.source] += r.n * r.size * min(3.0, math.exp(min(50.0, s.lam * r.size / s.scale)))
    for i, t, s, _ in rows:
        copied[s] += taken[i] * len(t.split())
    for s, r in state.items():
        assert abs(sums[s] - r.target) <= 1e-5 * r.target and abs(copied[s] - r.target) <= 7


def test_mixing_that_does_not_settle_stops(spark):
    hist = spark.createDataFrame([("a", 3, 5), ("a", 9, 4), ("b", 5, 50)], "source string, size long, n long")
    with pytest.raises(RuntimeError, match="settled"):
        mixing.dual(hist, mixing.targets(hist), rounds=1).collect()


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_pipeline_hands_small_batches_to_python(spark, sf):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    df = spark.createDataFrame([("x" * 100_000,)] * 200, "t string").coalesce(1)
    sizes = lambda: [r.n for r in df.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [rb.nbytes]}) for rb in it), "n long").collect()]
    try:
        assert max(sizes()) > 8 << 20
        corpus_pipeline.dedup_documents(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(5), sf)
        got = sizes()
        assert sum(got) > 200 * 100_000 and max(got) < 8 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    d = spark.read.parquet(f"{sf}/documents.parquet")
    clean = d.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clean, sf)
        if name != "sentencepiece":
            assert out.columns == d.columns
        assert 0 < out.count() <= 3 * d.count()


def test_pipeline_stages_on_odd_rows(spark, sf):
    df = docs(spark, ODD).select(*DOCS.replace(" long", "").replace(" string", "").split(", ")[:5])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, sf).count() >= 0
        assert stage(spark, df.limit(0), sf).count() == 0
    again = df.unionByName(df.limit(5))
    kept = corpus_pipeline.dedup_documents(spark, again, sf).collect()
    assert len([r for r in kept if r.text == "same"]) == 1


def test_pipeline_keeps_unlike_texts_of_one_id(spark, sf):
    rng = random.Random(11)
    a, b, c = (prose(rng, 60) for _ in range(3))
    texts = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c), (0, c + " x")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, df, sf).collect())
    assert got == sorted([(1, a), (1, b), (0, c + " x")])


def test_the_bounded_distance_says_what_the_whole_one_does():
    rng = random.Random(4)
    for _ in range(1500):
        a = "".join(rng.choice("abcd e") for _ in range(rng.choice([1, 16, 17, 60, 130])))
        b = "".join(c for c in a if rng.random() > 0.2) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        whole = line_dedup.edit_distance(a, b)
        for most in (0, len(a) // 5, whole - 1, whole, whole + 1):
            assert (line_dedup.edit_distance(a, b, most) <= most) == (whole <= most)


def test_spark_and_python_decide_pairs_alike(spark):
    rng, rows = random.Random(7), []
    for i in range(600):
        a = "".join(rng.choice("abcé日𝒳 ") for _ in range(rng.choice([1, 2, 5, 40, line_dedup.NATIVE, line_dedup.NATIVE + 1, 90])))
        rows.append((i, i + 1000, a, "".join(c if rng.random() > 0.22 else rng.choice(["", "z", c + "y"]) for c in a)))
    got = {r.a for r in line_dedup.similar(spark.createDataFrame(rows, "a long, b long, ta string, tb string"), 0.8).collect()}
    assert got == {r[0] for r in rows if line_dedup.near(r[2], r[3])} and 100 < len(got) < 500


def test_documents_are_shuffled_in_parts(spark, monkeypatch):
    kept, keep = [], line_dedup.Tables.keep

    def note(self, df, name):
        out = keep(self, df, name)
        kept.append((name, out.count()))
        return out

    words = "river mountain forest valley garden window orchard meadow harbour lantern".split()
    rng = random.Random(2)
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(40)]
    docs = spark.createDataFrame([(i, base[i % 40] + ("" if i < 40 else " x")) for i in range(80)], "doc_id long, text string")
    want = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "PARTS", 3)
    monkeypatch.setattr(line_dedup.Tables, "keep", note)
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == want and sum(r[-1] for r in want) == 40
    texts = [n for name, n in kept if name == "texts"]
    assert len(texts) % 3 == 0 and max(texts) < 80
    assert len([n for name, n in kept if name == "shared"]) == 3


@pytest.mark.parametrize("cell", [512, 16])
def test_lines_beside_their_head_are_linked_without_a_row_for_every_pair(spark, monkeypatch, cell):
    made, keep = {}, line_dedup.Tables.keep

    def note(self, df, name):
        out = keep(self, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    rng = random.Random(12)
    anchors = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26)), "qwertzuiopasdfghjklyxcvbn", "mnbvcxylkjhgfdsapoiuztrewq"
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(5))
    centres = [[word() for _ in range(16)] for _ in range(6)]
    lines = []
    for i in range(300):
        c = list(centres[i % 6])
        for at in rng.sample(range(16), 3):
            c[at] = word()
        lines.append(" ".join([*anchors, *c]))
    monkeypatch.setattr(line_dedup.Tables, "keep", note)
    monkeypatch.setattr(line_dedup, "CELL", cell, raising=False)
    drops = line_dedup.find_dropped(docs(spark, ["\n".join(lines)])).collect()
    group = list(range(300))
    for i in range(300):
        for j in range(i):
            if group[i] != group[j] and line_dedup.near(lines[i], lines[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {i for i in range(300) if i != group.index(group[i])}
    assert {p for r in drops for p in r.drops} == want and len(want) > 250
    assert max(made.values()) < 3000, made


def test_line_dedup_runs_no_python_on_the_executors(spark, monkeypatch):
    plans, keep = [], line_dedup.Tables.keep

    def note(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(line_dedup.Tables, "keep", note)
    rng = random.Random(5)
    anchor = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 26))
    lines = [f"{anchor} {prose(rng, 3)}" for _ in range(30)]
    plans.append(line_dedup.dedup_lines(docs(spark, ["\n".join(lines)]))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if re.search("Python|Pandas|Arrow", p)]


def test_word_bound_and_distance_decide_as_near_does(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        w = prose(rng, rng.randint(1, 40)).split(" ")
        v = list(w)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(v) + 1)
            v[at : at + rng.randint(0, 2)] = prose(rng, rng.randint(1, 2)).split(" ") if rng.random() < 0.6 else []
        rows.append((i, " ".join(w), " ".join(v) or "x"))
    df = spark.createDataFrame(rows, "a long, ta string, tb string")
    got = df.select("ta", "tb", line_dedup.most_apart(F.col("ta"), F.col("tb")).alias("most"), F.lit(0).alias("b"), "a").collect()
    assert all(line_dedup.edit_distance(r.ta, r.tb) <= r.most for r in got) and sum(line_dedup.edit_distance(r.ta, r.tb) == r.most for r in got) > 50
    near = {r.a for r in line_dedup.similar(df.withColumn("b", F.lit(0)), 0.8).collect()}
    assert near == {i for i, x, y in rows if line_dedup.near(x, y)} and 50 < len(near) < 350


def test_components_leave_no_round_behind(spark):
    before = set(os.listdir(base)) if (base := spark.conf.get("spark.checkpoint.dir", None)) else set()
    got = components.connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 41
    left = [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x not in before and x.startswith("partita-edges")]
    assert len(left) == 1


def test_every_near_pair_of_a_bucket_is_linked_whatever_anchors_both_lack(spark, monkeypatch):
    """Short lines lack the same anchors often; these are no key in common. Against all pairs that share a key and 2 in 5 anchors."""
    rng = random.Random(14)
    frame = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 12)) for _ in range(3)]
    lines = []
    for _ in range(60):
        own = prose(rng, 3)
        lines += [" ".join([*frame, own]), " ".join([*frame, own, rng.choice("xyz") * 2])]
    lines = list(dict.fromkeys(lines))
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "lid long, t string").withColumn("chk", F.col("lid"))
    a = {r.lid: [r[f"a{c}"] for c in range(line_dedup.ANCHORS)] for r in line_dedup.anchored(texts).collect()}
    links = []
    for i, j in itertools.combinations(range(len(lines)), 2):
        key = any(any(a[i][c] for c in k) and all(a[i][c] == a[j][c] for c in k) for k in line_dedup.KEYS)
        same, either = sum(x == y != 0 for x, y in zip(a[i], a[j], strict=True)), sum(bool(x or y) for x, y in zip(a[i], a[j], strict=True))
        if key and same * 5 >= either * 2 and line_dedup.near(lines[i], lines[j]):
            links.append((i, j))
    group = groups(range(len(lines)), links)
    want = {i for i in range(len(lines)) if group[i] != i}
    monkeypatch.setattr(line_dedup, "FACING", 7, raising=False)
    got = line_dedup.find_dropped(docs(spark, ["\n".join(lines)])).collect()
    assert {p for r in got for p in r.drops} == want and len(want) > 50


def test_common_ends_are_left_out_before_the_distance(spark):
    rng, rows = random.Random(15), [("abc", "abc"), ("", ""), ("aa", "aaa"), ("x" * 9000 + "a", "x" * 9000), ("aé日𝒳b", "aé𝒳b"), ("abab", "ab")]
    for _ in range(150):
        a, b, c = prose(rng, 9), prose(rng, rng.randint(0, 4)), prose(rng, rng.randint(0, 4))
        rows.append((f"{a} {b} {a[:9]}", f"{a} {c} {a[:9]}"))
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.unlike_parts(F.col("x"), F.col("y")).alias("z"))
    for r in df.collect():
        assert line_dedup.edit_distance(r.z.x, r.z.y) == line_dedup.edit_distance(r.x, r.y)
        assert len(r.x) > 5000 or not r.z.x or not r.z.y or (r.z.x[0] != r.z.y[0] and r.z.x[-1] != r.z.y[-1])
