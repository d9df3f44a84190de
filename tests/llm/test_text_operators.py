"""Text operators against brute force, on hard and on random inputs."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from halyard.llm import buckets, common, jaccard, language, lines, mixing, packing, privacy, substrings, suffixes
from halyard.llm.common import connected_components

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Names that operators use inside.
CLASHES = ["size", "row_", "id_", "key", "tkey", "dk", "ord", "low", "n", "words", "shard", "order", "pass", "lines", "gone", "start", "len", "cls", "term", "chunks", "rank"]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


def corpus(seed, n=60, vocabulary=40, most=60):
    """Random texts with copied passages, odd white space and letters."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßA") for _ in range(r.randint(1, 6))) for _ in range(vocabulary)]
    passages = [[r.choice(vocab) for _ in range(r.randint(5, 30))] for _ in range(5)]
    docs = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, most))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        if docs and r.random() < 0.3:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, r.choice(["", " ", "\n"]) + r.choice([" ", "  ", "\t"]).join(w)))
    return docs


HARD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "a b c d"), (6, "a b c d"), (7, "a b c d e"), (8, "x " * 3000), (9, "x " * 3000), (10, "aa" * 4000), (11, "aa" * 4000), (12, "Ünï " * 50)]


@pytest.mark.parametrize(("seed", "bucket"), [(1, 1024), (2, 1024), (2, 2)])
def test_substrings(spark, seed, bucket):
    docs = corpus(seed) + [(100 + i, t) for i, t in HARD]
    df = clashing(frame(spark, docs))
    got = sorted(tuple(r) for r in substrings.dedup_substrings(df, window=6, gram=3, bucket=bucket).collect())
    assert got == sorted(brute.substrings(docs, 6))


def test_substrings_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = frame(spark, [(None, text), (5, text), (5, text), (None, text), (7, "z " + text)])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.dedup_substrings(rows).collect())
    assert got == [(0, 60), (0, 60), (5, 0), (5, 0), (7, 60)]
    assert substrings.dedup_substrings(rows.limit(0)).collect() == []


@pytest.mark.parametrize(("seed", "bucket"), [(1, 4096), (1, 2), (3, 4096)])
def test_suffixes(spark, seed, bucket):
    docs = corpus(seed) + [(100 + i, t) for i, t in HARD] + [(0, corpus(seed)[0][1])]
    df = clashing(frame(spark, docs))
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.dedup_bytes(df, window=24, gram=6, bucket=bucket).collect())
    assert got == sorted(brute.suffixes(docs, 24))


@pytest.mark.parametrize("picked", [buckets.PICKED, 0])
def test_one_anchor_in_many_contexts(spark, monkeypatch, picked):
    """A passage that stands in every document, beside words of its own; with
    the keys of texts of large buckets broadcast, and with all texts dealt."""
    monkeypatch.setattr(buckets, "PICKED", picked)
    r = random.Random(4)
    gram = [f"g{i}" for i in range(4)]
    side = lambda: [r.choice(["x", "y", "z"]) for _ in range(r.randint(0, 9))]
    docs = [(i, " ".join(side() + gram + side())) for i in range(80)]
    got = sorted(tuple(x) for x in substrings.dedup_substrings(frame(spark, docs), window=7, gram=3, bucket=4).collect())
    assert got == sorted(brute.substrings(docs, 7))
    got = sorted((x[0], x[1], x[2], x[3], bytes(x[4])) for x in suffixes.dedup_bytes(frame(spark, docs), window=16, gram=5, bucket=4).collect())
    assert got == sorted(brute.suffixes(docs, 16))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=30))
def test_parse(lengths):
    reach = np.maximum.accumulate(np.minimum(np.arange(len(lengths)) + lengths, len(lengths)))
    assert substrings.parse(reach, 4).tolist() == [reach[i] - i >= 4 for i in range(len(lengths))]


def test_suffixes_empty(spark):
    assert suffixes.dedup_bytes(frame(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=30), st.sampled_from([0, 4, 8, 32]))
def test_deep_shallow_sorts(parts, shallow):
    parts = [b"prefix" * 3 + p for p in parts] + parts
    order = suffixes.deep_shallow(parts, shallow)
    assert sorted(order) == list(range(len(parts)))
    assert [parts[i] for i in order] == sorted(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=8, max_size=20).map(lambda b: bytes(x % 2 for x in b)), st.integers(0, 7)), min_size=2, max_size=60))
def test_shared_windows(parts):
    runs = [(b, off, len(b) - 7) for b, off in parts]
    runs = [(b, max(off, n - 1), n) if max(off, n - 1) < len(b) else (b, len(b) - 1, n) for b, off, n in runs]
    want = [[any(runs[j][0][max(0, runs[j][1] - o) : max(0, runs[j][1] - o) + 8] == b[i : i + 8] and 0 <= runs[j][1] - o < runs[j][2] for j in range(len(runs)) if j != a) for i in range(n) for o in [off - i]] for a, (b, off, n) in enumerate(runs)]
    for few in (0, 48):
        suffixes.FEW, old = few, suffixes.FEW
        try:
            assert [x.tolist() for x in suffixes.shared_windows(runs, 8)] == want
        finally:
            suffixes.FEW = old


@pytest.mark.parametrize(("seed", "region"), [(1, 384), (4, 4), (5, 2)])
def test_jaccard(spark, seed, region):
    docs = corpus(seed, n=120, vocabulary=400) + [(200 + i, t) for i, t in HARD]
    df = clashing(frame(spark, docs))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, region=region).collect())
    assert got == sorted(brute.jaccard(docs))


def test_copies_are_dealt_once(spark):
    """A text that stands in every task is dealt by one of them."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i if i else None, text) for i in range(8)] + [(9, "a b c")], "doc_id long, text string").repartition(8)
    members = jaccard.members_of(docs)
    dealt = jaccard.deal_shingles(docs, 1, 5, jaccard.copied_classes(members)).where("bucket = 0").select("tokens").collect()
    assert sorted(len(jaccard.undo_deltas(bytes(r["tokens"]), 0)) for r in dealt) == [1, 36]
    found = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert found == {(i if i else None, 1) for i in range(8)} | {(9, 9)}


def test_little_stays_on_disk(spark, tmp_path, monkeypatch):
    """A write leaves no shuffle files, and a join few tables."""
    import gc
    import glob

    def shuffled():
        local = spark.conf.get("spark.local.dir", None) or "/tmp"
        return set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data"))

    before = shuffled()
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    back, path = common.written(docs.repartition(3, "doc_id"), "some")
    assert not shuffled() - before
    docs.repartition(3, "doc_id").write.format("noop").mode("append").save()
    assert shuffled() - before
    assert back.count() == 60
    found = jaccard.jaccard_components(docs)
    assert {r["component_id"] for r in found.collect()} == set(range(0, 60, 2))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    jaccard.jaccard_components(docs)
    assert not {p.name.split("-")[0] for p in tmp_path.iterdir()} & {"common", "sets", "regions", "split"}
    del back
    for _ in range(10):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
        common.remove_unread(spark)
    assert path not in common._readers


def test_jaccard_chains_and_repeats(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(50 - i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(20)]
    docs += docs[:3] + [(None, docs[0][1]), (None, None), (None, "alone here")]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, docs), region=3).where("doc_id IS NOT NULL").collect())
    want = sorted((d, c) for d, _, c in brute.jaccard([x for x in docs if x[0] is not None]))
    assert got == want
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("spread", [0, 3, 12])
def test_links_of_a_region(spread):
    """Cells of pivots within a task: components are those of all pairs."""
    rng = np.random.default_rng(spread)
    sets = []
    for i in range(120):
        base = np.arange(200) + 1000 * (i % 5 if spread == 12 else 0)
        own = base.copy()
        at = rng.choice(200, rng.integers(0, 2 * spread + 1), replace=False)
        own[at] = 100_000 + rng.integers(0, 1 << 40, len(at))
        sets.append(np.unique(own))
    sizes = [len(s) for s in sets]
    i, j = jaccard.Sets([s.astype("<i8").tobytes() for s in sets], sizes, 75).links()
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    every = np.nonzero(100 * both >= 75 * (np.array(sizes)[:, None] + sizes - both))
    assert set(zip(i.tolist(), j.tolist())) <= set(zip(*(x.tolist() for x in every)))
    assert brute.components(120, zip(i.tolist(), j.tolist())) == brute.components(120, zip(*(x.tolist() for x in every)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    found = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    roots = brute.components(26, pairs)
    assert found == {i: roots[i] for p in pairs if p[0] != p[1] for i in p} or found == {i: min(j for j in range(26) if roots[j] == roots[i]) for p in pairs if p[0] != p[1] for i in p}


def test_lines_against_sql(spark):
    r = random.Random(5)
    blocks = [[f"line {r.randint(0, 30)}" for _ in range(r.randint(1, 9))] for _ in range(8)]
    rows = [(i, "\n".join(x for _ in range(r.randint(1, 4)) for x in r.choice(blocks))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "a\n" * 3000), (3, rows[3][1]), (None, rows[4][1]), (105, "ü\r\nü\r\n")]
    got = lines.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841  DuckDB reads it by name
    want = duckdb.sql(lines.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    names = clashing(frame(spark, rows))
    assert set(lines.dedup_lines(names).columns) == {*names.columns, "n_lines", "n_removed", "kept"}
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def test_runs_of_equal_lines(spark):
    """A block of one repeated line goes from the second document on, whatever
    stands beside it; blank runs are no chunk; SQL agrees."""
    lead = [[f"own {i} {k}" for k in range(3)] for i in range(40)]
    rows = [(i, "\n".join([*lead[i], *[f"same {i % 4}"] * 35, *reversed(lead[i])])) for i in range(40)]
    rows += [(100 + i, "\n".join(["a b", "", "", f"c {i}", "", "", "", "x", "x"])) for i in range(6)] + [(200, "\n\n\n"), (201, "\n\n\n"), (202, "y\ny"), (203, "y\ny"), (204, "y")]
    found = lines.dedup_lines(frame(spark, rows))
    gone = {r["doc_id"]: r["n_removed"] for r in found.collect()}
    assert [gone[i] for i in range(40)] == [0] * 4 + [35] * 36
    assert (gone[100], gone[200], gone[201], gone[202], gone[203], gone[204]) == (0, 0, 0, 0, 2, 0)
    assert all(gone[100 + i] >= 2 for i in range(1, 6))
    got = found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert sorted(tuple(r) for r in got.collect()) == sorted(duckdb.sql(lines.ORACLE_SQL).fetchall())


def test_lines_survive_a_shift(spark):
    shared = [f"shared line {i}" for i in range(40)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["new", *shared[:20], "also new", *shared[20:]]))]
    kept = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert kept[1] == 0 and kept[2] >= 15


def test_second_key_of_a_chunk_is_its_own(spark):
    rows = [(i, "\n".join(f"line {k}" for k in range(20))) for i in range(2)]
    found = lines.repeated_chunks(frame(spark, rows)).select(F.explode("c").alias("c")).select("c.*").distinct().collect()
    chained = {r["k1"]: r["k"] for r in spark.createDataFrame(found).withColumn("t", F.array_join(F.transform(F.sequence("start", F.col("start") + F.col("len") - 1), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")).select(F.xxhash64("t").alias("k1"), F.xxhash64("t", F.lit(1)).alias("k")).collect()}
    assert found and all(r["k2"] != chained[r["k1"]] for r in found)


TEXTS = [None, "", " ", "  two  spaces", "a   b\n\n c", "tab\there", "don't we'll", "x<|endoftext|>y", " nb　sp", "1234567 12.5%", "naïve Ünïcode 日本語 🙂🙂", "nul\0byte", "trailing ", "\nlead", "a \n b", "w" * 5000, "and the of " * 2000, "a\r\n\r\n b"]


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(BPE), packing.ChunkEncoder(BPE)
    for t in TEXTS[1:] + TEXTS[1:] + [d[1] for d in corpus(9)]:
        assert np.frombuffer(fast.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_merges_are_in_the_order_of_ids():
    import json

    with open(BPE, encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.merges_by_id(spec)
    spec["model"]["merges"][10:12] = spec["model"]["merges"][10:12][::-1]
    assert not packing.merges_by_id(spec)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    fast, whole = packing.ChunkEncoder(BPE), packing.ChunkEncoder(BPE)
    whole.cache = {}
    for t in [d[1] for d in corpus(10)]:
        assert fast.ids(t) == np.array(whole.whole.encode(t).ids, "<u4").tobytes() if t else True


@pytest.mark.parametrize("per_partition", [20_000, 7])
def test_packing(spark, per_partition):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])] + corpus(11)
    df = clashing(frame(spark, docs))
    got = packing.best_fit_packing(df, BPE, 64, per_partition=per_partition).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    pieces = packing.token_pieces(frame(spark, docs), BPE, 64, with_ids=True).collect()
    assert sorted((p["doc_id"] or 0, p["piece"], p["length"], p["ids_crc32"]) for p in pieces) == sorted((r["doc_id"] or 0, r["piece"], r["length"], r["ids_crc32"]) for r in got)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    for i in range(len(TEXTS)):
        ids = (whole.encode(TEXTS[i], add_special_tokens=False).ids if TEXTS[i] else []) + [2]
        own = {p["piece"]: np.frombuffer(p["ids"], "<u4").tolist() for p in pieces if p["doc_id"] == i}
        if i not in dict(corpus(11)) and i != 3:
            assert sum((own[k] for k in sorted(own)), []) == ids
    seen = {}
    for r in got:
        assert 1 <= r["length"] <= 64 and (r["piece"] == 0 or r["length"] == 64)
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(frame(spark, []), BPE).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_and_bound(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets, made = packing.best_fit_decreasing(lengths, 40)
    bound = packing.lower_bound(lengths, 40)
    assert bound <= made <= max(1, 1.25 * bound + 1) or not len(lengths)
    for b in range(made):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert len(own) and lengths[own].sum() <= 40 and (offsets[own] == np.r_[0, np.cumsum(lengths[own])[:-1]]).all()


def test_exchange_lowers_the_bins(spark):
    r = np.random.default_rng(3)
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(r.integers(1, 1024, 400))], "doc_id long, length long")
    alone = packing.pack(pieces, per_partition=20, rounds=1).select("sequence_id").distinct().count()
    again = packing.pack(pieces, per_partition=20, rounds=3).select("sequence_id").distinct().count()
    assert packing.lower_bound(np.array([p["length"] for p in pieces.collect()]), 1024) <= again < alone


def test_packing_where_every_bin_is_given_back(spark):
    pieces = spark.createDataFrame([(i, 400) for i in range(100)], "doc_id long, length long")
    for rounds in (2, 3, 4):
        got = packing.pack(pieces, per_partition=20, rounds=rounds).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(100)), rounds
        at = {}
        for r in got:
            at.setdefault(r["sequence_id"], []).append(r["offset"])
        assert all(sorted(x) in ([0], [0, 400]) for x in at.values())


def segmentations(word, probability):
    if not word:
        return 1.0
    return sum(probability.get(word[:n], 0.0) * segmentations(word[n:], probability) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    lattice = language.Lattice(PIECES)
    rng = np.random.default_rng(1)
    table = rng.random((lattice.size, 2)) * 1e-2
    pieces = {}
    for n, (keys, ids) in lattice.index.items():
        del keys
        pieces[n] = set(ids.tolist())
    words = ["the", "schönheit", "a", "zzqx", "日本"]
    got = lattice.score(words, table)
    for w, row in zip(words, got):
        marked = "▁" + w
        for column in range(2):
            probability = {}
            for i in range(len(marked)):
                for j in range(i + 1, len(marked) + 1):
                    part = marked[i:j]
                    if len(part) > lattice.longest:
                        continue
                    key = lattice.key(np.array([part], dtype=f"U{len(part)}").view(np.uint32).reshape(1, len(part)))[0]
                    keys, ids = lattice.index[len(part)]
                    hit = np.flatnonzero(keys == key)
                    if len(hit):
                        probability[part] = table[ids[hit[0]], column]
                    elif len(part) == 1:
                        probability[part] = table[0, column]
            assert np.isclose(np.exp(row[column]), segmentations(marked, probability))


def test_expected_counts_are_those_of_the_words():
    lattice = language.Lattice(PIECES)
    table = np.full(lattice.size, 1e-3)
    counts = lattice.expected(["a"], np.array([4.0]), table)
    assert counts.sum() == pytest.approx(4 * (1 * 1e-3 + 2 * 1e-6) / (1e-3 + 1e-6)) or counts.sum() == pytest.approx(8)


SYLLABLES = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eux", "que", "ai", "le"]}


def spoken(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choice(SYLLABLES[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40))).capitalize(), k) for i, k in enumerate(r.choices(list(SYLLABLES), k=n))]


def test_language(spark):
    rows = spoken(300)
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "fr"), (1003, "½ ²", None), (1004, rows[0][1], None), (None, rows[1][1], "xx"), (1005, rows[2][1] * 200, rows[2][2])]
    df = frame(spark, rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("old")).withColumn("size", F.lit(1))
    found = language.identify_documents(df, PIECES)
    assert set(found.columns) == {"doc_id", "text", "lang", "size", "lang_pred", "score"}
    got = {r["doc_id"]: r for r in found.collect()}
    right = [got[i]["lang_pred"] == k for i, _, k in rows]
    assert sum(right) >= 0.98 * len(right)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002, 1003))
    assert got[1004]["lang_pred"] == rows[0][2] and got[1005]["lang_pred"] == rows[2][2]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in got.values()} <= {*SYLLABLES, "und"}


def test_language_without_labels(spark):
    df = frame(spark, [(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify_documents(df, PIECES).collect()} == {("und", 0.0)}
    assert language.identify_documents(df.limit(0), PIECES).collect() == []


def test_language_prediction_ignores_the_label(spark):
    rows = spoken(200, 1)
    df = frame(spark, rows, "doc_id long, text string, lang string")
    langs, table = language.train(df.select("text", "lang"), PIECES)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, langs, table, PIECES).collect()}
    other = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df.withColumn("lang", F.lit("??")), langs, table, PIECES).collect()}
    assert plain == other


def sources(seed, n=400):
    r = random.Random(seed)
    names = ["a", "B", "é", "z", None, "zz", "empty"]
    rows = [(i, r.choice(names[:6]) if i % 3 else "B", " ".join("w" for _ in range(r.choice([0, 1, 5, 30])))) for i in range(n)]
    return rows + [(n, "long", "w " * 9000), (n + 1, "empty", None), (n + 2, "empty", " "), (5, "B", rows[5][2]), (None, "a", "w w w")]


@pytest.mark.parametrize("fanout", [1024, 2])
def test_mixing(spark, monkeypatch, fanout):
    monkeypatch.setattr(mixing, "FANOUT", fanout)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    rows = sources(2)
    df = clashing(frame(spark, rows, "doc_id long, source string, text string"))
    rows_, plan, draws = mixing.mix_to_weights(df, block_words=16, shard_words=256)
    got = rows_.join(plan, "row_").join(draws.groupBy("row_").agg(F.sum("words").alias("taken"), F.count("*").alias("n")), "row_", "left").collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    target, taken = brute.targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert (r["taken"] or 0) <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + (r["taken"] or 0)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    per_shard = [r["n"] for r in draws.groupBy("shard").agg(F.sum("words").alias("n")).collect()]
    assert len(per_shard) > 8


def test_mixing_agrees_with_itself(spark):
    df = frame(spark, sources(3), "doc_id long, source string, text string")
    a, b = (sorted(map(str, mixing.mixed_summary(x).collect())) for x in (df, df.repartition(5)))
    assert a == b
    assert mixing.mixed_summary(df.limit(0)).collect() == []
    nothing = mixing.mixed_summary(df.where("source = 'empty'")).collect()
    assert len(nothing) == 2 and all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


def test_mixed_documents(spark):
    df = clashing(frame(spark, sources(4), "doc_id long, source string, text string"))
    mixed = mixing.mixed_documents(df, block_words=16, shard_words=256)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    sizes = {}
    for _, s, t in sources(4):
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    target = brute.targets(sizes)
    assert all(abs(words.get(s, 0) - target[s]) <= 1 for s in sizes)


def test_hypergeometric(spark):
    from math import comb

    draws = spark.range(20_000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(9).cast("long"), (F.col("id") + 0.5) / 20_000).alias("k"))
    counts = {r["k"]: r["n"] for r in draws.groupBy("k").agg(F.count("*").alias("n")).collect()}
    for k in range(10):
        p = comb(12, k) * comb(18, 9 - k) / comb(30, 9)
        assert abs(counts.get(k, 0) / 20_000 - p) < 1e-3
    ends = spark.range(1).select(*[mixing.hypergeometric(*[F.lit(x).cast("long") for x in (a, g, d)], F.lit(0.7)).alias(f"k{i}") for i, (a, g, d) in enumerate([(10, 10, 4), (10, 0, 4), (10, 5, 0), (10, 5, 10), (0, 0, 0), (10**9, 5 * 10**8, 10**6)])]).first()
    assert tuple(ends)[:5] == (4, 0, 0, 5, 0) and abs(ends[5] - 500_000) < 3_000


PRIVATE = [
    "mail a.b@c.de, x@y and a@b.c_d@e.f then q@-.- x@y..z %+-@1.2",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.1 1.2.3 999999999999999999999.1.1.1 .1.2.3.4.",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 5500005555555559 7 12",
    "phones +1 (386) 555-3733, +49.30.1234567 + 5 +123 +1234567890123456 +1-2-3-4-5-6-7-8-9)",
    "é🙂 +1 (386) 555-3733 é a@b.cc 日本 10.0.0.1",
    "", None, "@", "+", "a@" * 3000, "1" * 30_000, "1 " * 20_000, "1." * 20_000, "+1" + " " * 20_000, "a." * 20_000 + "@b.c",
]


def test_personal_data(spark):
    rows = list(enumerate(PRIVATE)) + [(2, PRIVATE[2]), (None, PRIVATE[0])]
    found = privacy.find_personal_data(clashing(frame(spark, rows))).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *[[(s["start"], s["end"]) for s in r[k]] for k in privacy.KINDS]) for r in found)
    want = sorted((i if i is not None else -1, *brute.personal(t)) for i, t in rows)
    assert got == want
    assert privacy.find_personal_data(frame(spark, [])).collect() == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+- ()5", max_size=60), min_size=1, max_size=25))
def test_personal_data_patterns(spark, texts):
    texts = [*texts, "+" + texts[0], "4111111111111111 " + texts[0]]
    found = privacy.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], *[[(s["start"], s["end"]) for s in r[k]] for k in privacy.KINDS]) for r in found) == [(i, *brute.personal(t)) for i, t in enumerate(texts)]


def test_disclosing_terms(spark):
    r = random.Random(1)
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor amet sit elit".split()) for _ in range(n))
    rows = [(i, f"{filler(90)} contact Smithson, at john@example.com {filler(90)}") for i in range(8)]
    rows += [(100, f"{filler(10)} Smithson. {filler(10)}"), *[(200 + i, filler(150)) for i in range(90)], (300, None)]
    found = {x["doc_id"]: x for x in privacy.find_personal_data(frame(spark, rows)).collect()}
    assert found[0]["email"] and any(rows[0][1][s["start"] : s["end"]] == "Smithson" for s in found[0]["term"])
    assert [rows[8][1][s["start"] : s["end"]] for s in found[100]["term"]] == ["Smithson"]
    assert not any(found[200 + i]["term"] for i in range(90))
    clean = {x["doc_id"]: x["clean"] for x in privacy.sanitise(clashing(frame(spark, rows))).collect()}
    assert "[EMAIL]" in clean[0] and "Smithson" not in clean[0] + clean[100] and clean[200] == rows[9][1] and clean[300] is None


def test_copies_are_one_context(spark):
    rows = [(i, "unusual words beside bob@example.com stand here") for i in range(20)]
    assert not any(r["term"] for r in privacy.find_personal_data(frame(spark, rows)).collect())
