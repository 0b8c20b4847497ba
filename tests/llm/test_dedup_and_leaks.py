"""Substring dedup, decontamination and SimHash against brute force."""

import hashlib
import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import decontamination, simhash, substring_dedup


def texts(seed, n=60, words=120):
    """Texts that share passages, with repeats inside, copies, odd spaces, nulls and empties."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)] + ["é", "ß.", "A", "a"]
    passages = [[rng.choice(pool) for _ in range(rng.choice((19, 20, 25, 60)))] for _ in range(6)]
    rows = []
    for i in range(n):
        out = []
        while len(out) < rng.randrange(words):
            out += rng.choice(passages) if rng.random() < 0.2 else [rng.choice(pool) for _ in range(rng.randrange(1, 15))]
        rows.append((i * 7 % n, rng.choice((" ", "  ", "\n", "\t")).join(out)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "be " * 500), (n + 4, rows[0][1]), (n + 5, "x y\x1cz")]
    return rows


def brute_dedup(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = b" ".join(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_substring_dedup_equals_brute_force(make_docs, clashing):
    rows = texts(1)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(clashing(make_docs(rows))).collect()}
    assert got == brute_dedup(rows)
    assert sum(v[1] for v in got.values()) > 1000


def test_hot_passages_over_many_flushes_and_parts(make_docs, monkeypatch):
    rng = random.Random(21)
    hot = [f"h{i}" for i in range(45)]
    rows = []
    for i in range(120):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(words[:30] + (hot if i % 3 == 0 else hot[5:28] if i % 3 == 1 else []) + words[30:])))
    monkeypatch.setattr(substring_dedup, "FLUSH_WORDS", 50)
    docs = make_docs(rows)
    for group_bytes in (500, 1 << 20):
        got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(docs, group_bytes=group_bytes).collect()}
        assert got == brute_dedup(rows)


def test_one_entry_of_a_hot_hash_leaves_a_flush():
    import pyarrow as pa
    import pyarrow.compute as pc

    text = " ".join(f"h{i}" for i in range(30))
    batch = pa.RecordBatch.from_pydict({"text": [text] * 500, "_key": pa.array(range(500), pa.int64())})
    rows = pa.Table.from_batches(substring_dedup._probes(10, 4)(iter([batch])))
    sent = rows.filter(pc.is_valid(rows.column("tags")))
    # one each of the blocks at 0, 10 and 20, and no other window but as a settled answer
    assert sum(len(x.as_py()) // 3 for x in sent.column("tags")) == 3


def test_a_row_that_repeats_is_not_its_own_earlier_copy(make_docs):
    text = " ".join(f"t{i}" for i in range(30))
    rows = substring_dedup.dedup(make_docs([(1, text), (1, text), (2, text), (None, "x")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_empty_tables(make_docs, spark):
    none = make_docs([(1, "x")]).where("false")
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert substring_dedup.dedup(none).count() == 0
    assert simhash.near_dedup(none).count() == simhash.keep_one(none).count() == 0
    assert decontamination.contamination(none, items).count() == decontamination.decontaminate(none, items).count() == 0
    assert [r.n_hit for r in decontamination.contamination(make_docs([(1, "x")]), items.where("false")).collect()] == [0]


def normal(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lowered).split(" ")


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = [w for w in normal(text) if w]
        size = min(13, len(words))
        for s in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[s : s + size])].add(str(item))
    out = {}
    for i, text in docs:
        words = [w for w in normal(text) if w]
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(words) - size + 1):
                if (k := tuple(words[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[k]
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def leaking():
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((1, 5, 12, 13, 14, 30))))) for i in range(2, 14)]
    items = [x for x in items if " " in x[1]] + [(20, None), (21, " .. "), (3, "Un Été, v1-v2"), (22, items[0][1].upper())]
    rows = texts(2, 30)
    rows += [(200 + k, " ".join([*(rng.choice(pool) for _ in range(rng.choice((3, 60, 800)))), str(t).title(), "end"])) for k, (_, t) in enumerate(items)]
    return rows, items


def test_contamination_equals_brute_force_either_way(make_docs, clashing, spark):
    rows, items = leaking()
    docs, bench = clashing(make_docs(rows)), spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    want = brute_contamination(rows, items)
    for limit in (decontamination.BROADCAST_BYTES, 0):
        got = {r.doc_id: tuple(r)[1:] for r in decontamination.contamination(docs, bench, limit).collect()}
        assert got == want
    assert any(v[4] for v in want.values()) and any(v[1] and not v[4] for v in want.values())


def test_decontaminate_drops_documents_and_cuts_spans(make_docs, clashing, spark):
    rows, items = leaking()
    docs, bench = clashing(make_docs(rows)), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    either = []
    for limit in (decontamination.BROADCAST_BYTES, 0):
        out = decontamination.decontaminate(docs, bench, limit)
        assert out.columns == docs.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        assert set(kept) == {i for i, v in want.items() if not v[4]}
        for i, text in rows:
            if i in kept:
                n, hit = want[i][:2]
                assert kept[i] == text if not hit else len([w for w in normal(kept[i]) if w]) == n - hit
        either.append(kept)
    assert either[0] == either[1]


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rng = random.Random(8)
    rows = texts(3, 20)
    base = [f"q{rng.randrange(10**6)}" for _ in range(400)]
    for k in range(40):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(400)] = f"q{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(copy)))
    return rows + [(90, "x"), (3_000, "X"), (3_001, None), (3_001, None)]


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_simhash_equals_brute_force_with_either_code(make_docs, clashing):
    rows = near_rows()
    docs = clashing(make_docs(rows))
    want = brute_components(rows)
    assert sorted(tuple(r) for r in simhash.near_dedup(docs).collect()) == want
    fine = simhash.components(docs, many=0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(tuple(r) for r in fine.collect()) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_crowded_anchors_are_split_without_losing_links(make_docs, monkeypatch):
    rows = near_rows()
    distinct = simhash.fingerprints(make_docs(rows)).select("fp").distinct()
    n = distinct.count()
    want = {tuple(r) for r in simhash.close(simhash.links(distinct, n)).collect()}
    monkeypatch.setattr(simhash, "GROUP", 16)
    monkeypatch.setattr(simhash, "PARTITION", 64)
    assert want and {tuple(r) for r in simhash.close(simhash.links(distinct, n, hot=3)).collect()} == want


def test_stars_are_those_of_all_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    for trial in range(30):
        base = rng.integers(0, 2**63, 6, dtype=np.uint64)
        prints = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64)) for _ in range(9))]))
        rng.shuffle(prints)
        group, own = rng.integers(0, 2, len(prints)), rng.random(len(prints)) < 0.6
        root = {(int(g), int(p)): (int(g), int(p)) for g, p in zip(group, prints)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(prints)):
            for j in range(i):
                if group[i] == group[j] and (own[i] or own[j]) and (int(prints[i]) ^ int(prints[j])).bit_count() <= 3:
                    a, b = find((int(group[i]), int(prints[i]))), find((int(group[j]), int(prints[j])))
                    root[max(a, b)] = min(a, b)
        want = {(x[1], find(x)[1]) for x in root if find(x) != x}
        assert {(int(x), int(y)) for x, y in zip(*simhash._stars(group, prints, own, 3))} == want


def test_keep_one_with_an_id_in_two_components(make_docs):
    rng = random.Random(12)
    a, b = (" ".join(f"{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
    for x, y in ((a, b), (b, a)):
        assert sorted((r.doc_id, r.text) for r in simhash.keep_one(make_docs([(3, x), (5, y), (5, x)])).collect()) == [(3, x), (5, y)]


def test_keep_one_keeps_a_document_of_each_component(make_docs, clashing):
    rows = near_rows()
    docs = clashing(make_docs(rows))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_long_chains_close(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(200, 100)], T.StructType([T.StructField("fp", T.LongType()), T.StructField("to", T.LongType())]))
    assert {tuple(r) for r in simhash.close(chain).collect()} == {(i, 0) for i in range(1, 51)} | {(200, 100)}


def test_each_code_covers_all_words_and_finds_all_near_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    for many in (False, True):
        plan = simhash.Plan(many)
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = a.copy()
        for i in range(200):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        met = np.zeros(200, bool)
        for (wa, ka, owna), (wb, kb, _) in zip(plan.deal(a), plan.deal(b)):
            own = defaultdict(set)
            for i, k, o in zip(wa, ka, owna):
                if o:
                    own[i].add(k)
            assert len(own) == 200
            for i, k in zip(wb, kb):
                met[i] |= k in own[i]
        assert met.all()
