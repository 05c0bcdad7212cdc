"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import collections
import random
import re
import types
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import centroids, decontaminate, divergence, encoding, jaccard_join, langid, packing, pii, quality, queries, sharding, simhash, sstable, token_counts, url_filter, words

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, want.project(", ".join(columns)).fetchall()))


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.tokenizer_file(name))


def test_encoding_equals_the_library(rows):
    odd = ["don't we'll I'd x's", "été Å", "a b c\u0085d", "İstanbul ΣΑΣ", "<|endoftext|> hi", "123 4.5,6 ... ~~", "", " \n", "\x1cab c", "日本語。", "word.' ́x"]
    texts = [r.text for r in rows.values()] + odd
    t = tokenizer("word_bpe_49k.json")
    want = [np.asarray(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert encoding.WordEncoder(encoding.tokenizer_file("word_bpe_49k.json")).encode(texts) == want


def test_new_chunks_cost_few_calls(monkeypatch):
    """Letters before symbols are encoded as words, many to a text, and each run of symbols once; ids stay those of the library."""
    words = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 5)) + chr(97 + i % 26) for i in range(700)]
    texts = [" ".join(words), " ".join(w + "***" for w in words), " ".join(w + ".&&&" for w in words), "été... жук*** ԱԲԳ!! ǆabc?! naïve'* x_y_ a²*** ͅb**", " ".join(words[:300] + ["ქართული"] + words[300:])]
    t, e = tokenizer("word_bpe_49k.json"), encoding.WordEncoder(encoding.tokenizer_file("word_bpe_49k.json"))
    want = [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    asked, direct = [], e._direct
    monkeypatch.setattr(e, "_direct", lambda chunks: asked.extend(chunks) or direct(chunks))
    assert [x for t in texts[:3] for x in e.encode([t])] == want[:3] and set(asked) == {"***", ".&&&"}
    assert e.encode(texts) == want and e.plain is not None


def test_full_memo_changes_nothing(rows):
    texts = [r.text for r in rows.values()][:40]
    path = encoding.tokenizer_file("word_bpe_49k.json")
    want = encoding.WordEncoder(path).encode(texts)
    small = encoding.WordEncoder(path, 100)
    assert [x for i in range(0, 40, 7) for x in small.encode(texts[i : i + 7])] == want and len(small.memo) <= 100


def test_shards_hold_their_limit_and_chain_equal_hashes(spark):
    d = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(800)] + [(9999, "y" * 40)] * 100, "doc_id long, text string")
    out = sharding.assign(d, limit=400)
    sums = out.groupBy("depth", "prefix", "page").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 900 and all(r.b <= 440 for r in sums)
    assert out.filter("doc_id = 9999").select("page").distinct().count() >= 10
    shards = {(r.depth, r.prefix) for r in sums}
    assert not any((d2, p >> (d1 - d2)) in shards for d1, p in shards for d2 in range(d1))


def test_hash_larger_than_a_shard_is_written_over_pages(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP", 2)
    d = spark.createDataFrame([(7, "y" * 40)] * 300 + [(None, "z" * 10)] * 50 + [(i, "x") for i in range(100)], "doc_id long, text string").repartition(5)
    out = sharding.write_shards(d, limit=400)
    assert out.count() == 450 and out.drop("shard").exceptAll(d).count() == 0
    sums = out.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert all(r.b <= 440 for r in sums) and sum(r.b for r in sums) == 300 * 40 + 500 + 100


def test_written_shards_round_trip(spark, docs):
    written = sharding.write_shards(docs, limit=1 << 18)
    assert written.drop("shard").exceptAll(docs).count() == 0 and written.count() == docs.count()
    assert written.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).filter(f"b > {1 << 18}").count() == 0


def test_sstable_against_direct_encoding(spark, docs, rows):
    t, start = tokenizer("word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in sstable.shards_digest(sstable.token_shards(spark, docs, block_bytes=2000, shard_bytes=40_000)).collect()}
    for k in sorted(rows):
        ids = np.asarray([*t.encode(rows[k].text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sstable_lookup(spark, docs, monkeypatch):
    from runweave.llm.shared import shared_dir

    m = sstable.write_shards(docs, shared_dir(spark, "t"), block_bytes=2000, shard_bytes=40_000)
    asked = spark.createDataFrame([(3,), (3,), (17,), (10**12,), (-5,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in sstable.lookup(m, asked).collect()}
    every = {r.doc_id: r.ids for r in sstable.read_shards(m).collect()}
    assert set(found) == {3, 17} and all(bytes(found[k]) == bytes(every[k]) for k in found)
    assert sstable.read_shards(m).rdd.getNumPartitions() == m.count() > 3
    monkeypatch.setattr(sstable, "SHARDS", 2)
    assert {r.doc_id: r.ids for r in sstable.lookup(m, asked).collect()} == found
    nameless = sstable.write_shards(spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "doc_id long, text string"), shared_dir(spark, "t"))
    assert [r.doc_id for r in sstable.lookup(nameless, asked).collect()] == [None, None]


def test_negative_and_repeated_keys_keep_order(spark):
    d = spark.createDataFrame([(5, "b"), (-3, "a"), (5, "c"), (None, "n"), (0, "z")], "doc_id long, text string")
    ids = [(r.doc_id, r.start) for r in sstable.token_shards(spark, d).orderBy("start").collect()]
    assert [i for i, _ in ids] == [None, -3, 0, 5, 5] and [s for _, s in ids] == [0, 2, 4, 6, 8]


def test_bloom_has_no_false_negatives():
    keys = [sstable.key_of(i * 37 - 500) for i in range(2000)]
    b = sstable.Bloom.of(keys)
    assert all(k in b for k in keys)
    assert sum(sstable.key_of(10**9 + i) in b for i in range(2000)) < 100


def test_url_candidates_equal_all_rules():
    rng = random.Random(3)
    rules = [url_filter.prefix_rule(h, p, rng.choice(["allow", "block"])) for h in ("com", "a.com", "b.a.com", "net", "x.net") for p in ("/", "/en/", "/en/ab", "/fr/x/")]
    index, always = url_filter.index_rules(rules, {"com": 100, "en": 50})
    task = url_filter._matcher(types.SimpleNamespace(value=(rules, index, always)))
    import pyarrow as pa

    urls = [(rng.choice(["", "w.", "b."]) + rng.choice(["a.com", "com", "x.net", "net", "acom", "y.org"]), rng.choice(["", "/", "/en/", "/en/abc", "/en/x", "/fr/x/1", "/EN/ab"])) for _ in range(400)]
    n = len(urls)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([h for h, _ in urls]), pa.array([p for _, p in urls]), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.array([""] * n), pa.array([0] * n, pa.int32())], names=["page_id", "host", "path", "rule", "weight", "verdict", "tested"])
    out = next(task(iter([batch]))).to_pylist()
    for (h, p), r in zip(urls, out):
        fit = [(len(x.name), x.name) for x in rules if (lambda rh, rp: (h == rh or h.endswith("." + rh)) and p.startswith(rp))(*x.name.split("/", 1)[:1], "/" + x.name.split("/", 1)[1])]
        assert r["rule"] == (max(fit)[1] if fit else None)
    assert sum(r["tested"] for r in out) < n * len(rules) / 2


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, docs, rows, rule):
    t = tokenizer("byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, rule=rule).collect()}
    for k, r in list(rows.items())[:60]:
        text = r.text or ""
        spans = t.encode(text, add_special_tokens=False).offsets
        parts = text.splitlines(keepends=True) if "\r" not in text else None
        at, bounds = 0, []
        for line in re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]:
            bounds.append((at, at + len(line)))
            at += len(line)
        want = [0.0] * len(bounds)
        for a, b in spans:
            own = [max(0, min(b, e) - max(a, s)) for s, e in bounds]
            hit = [i for i, n in enumerate(own) if n] or [0]
            if rule == "start":
                want[hit[0]] += 1
            elif rule == "end":
                want[hit[-1]] += 1
            elif rule == "majority":
                want[max(hit, key=lambda i: (own[i], -i))] += 1
            else:
                for i in hit:
                    want[i] += own[i] / sum(own)
        assert got[k].n_tokens == len(spans) and got[k].n_sections == len(bounds)
        assert np.allclose(got[k].tokens, want), (k, parts)


def test_crossing_tokens_exist():
    counts, crossing = token_counts.attribute(np.array([0, 3]), np.array([3, 7]), np.array([0, 4, 7]), "majority")
    assert crossing == 1 and counts.tolist() == [1, 1]
    counts, _ = token_counts.attribute(np.array([0, 3]), np.array([3, 7]), np.array([0, 4, 7]), "split")
    assert np.allclose(counts, [1.25, 0.75])


def test_rule_order_does_not_change_verdicts(spark, docs):
    rules = quality.default_rules()
    a = quality.judge(docs, rules=rules)
    b = quality.judge(docs, rules=dict(reversed(rules.items())))
    assert a.select("doc_id", "kept").exceptAll(b.select("doc_id", "kept")).count() == 0
    slow = iter(range(10_000))
    order = quality.order_rules(docs.select("doc_id", "text"), rules, clock=lambda: next(slow))
    assert [x[1] for x in order] == sorted((x[1] for x in order), reverse=True)


def test_cascade_asks_the_cheaper_of_equal_rules_first(spark, docs):
    text = F.col("text")
    heavy = lambda n: F.length(F.regexp_replace(F.repeat(text, F.lit(n)), "[aeiou]", "")) < 0
    often = F.crc32(text.cast("binary")) % 3 == 0
    rules = {"dear": often | heavy(40), "never": text == "no such text", "cheap": often, "same": often}
    order = quality.order_rules(docs.select("doc_id", "text"), rules)
    assert order[0][0] in ("cheap", "same") and order[0][1] > 0.1
    assert all(share == 0 for _, share, _ in order[1:])  # what is left after the first
    cost = {name: c for name, _, c in order}
    assert cost["dear"] > 5 * cost["cheap"]


def test_sample_is_spread_over_the_table(spark, docs):
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("text")).repartitionByRange(8, "doc_id")
    got = sorted(int(r.text) for r in quality._sample(rows, 40))
    ids = sorted(r.doc_id for r in docs.collect())
    quarter = len(ids) // 4
    assert len(got) == 40 and all(sum(ids[k * quarter] <= g < ids[min(len(ids) - 1, (k + 1) * quarter)] for g in got) >= 3 for k in range(4))


def test_quality_keeps_clean_documents(spark, docs):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).join(labels, "doc_id")
    clean = judged.filter("quality = 1 and n_words >= 50")
    assert clean.filter("kept").count() >= 0.97 * clean.count()
    bad = judged.filter("quality = 0")
    assert bad.filter("not kept").count() >= 0.9 * bad.count()


def test_fm_index_on_random_texts():
    rng = random.Random(2)
    for _ in range(60):
        shard = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))] for _ in range(6)]
        items = [(i, b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 6)))) for i in range(4)]
        phrases = decontaminate.Phrases(items, 3)
        spans, found = decontaminate.search_shard(phrases.symbols([b" ".join(w) for w in shard]), phrases)
        for d, w in enumerate(shard):
            hit, own = set(), set()
            for q, t in items:
                v = t.split()
                for k in range(max(1, len(v) - 2) if v else 0):
                    x = v[k : k + 3]
                    for j in range(len(w) - len(x) + 1):
                        if w[j : j + len(x)] == x:
                            hit.update(range(j, j + len(x)))
                            own.add(q)
            assert hit == {k for a, b in spans[d] for k in range(a, b)} and own == found[d]


def test_suffix_array_and_index_hold_every_word():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 4, 200), np.ones(100, np.int64), np.tile(rng.integers(1, 6000, 7), 30), np.array([5]), np.array([], np.int64), rng.integers(1, 1 << 20, 50)]
    for t in texts:
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert decontaminate.suffix_array(t).tolist() == want
    t = rng.integers(1, 5, 300)
    index = decontaminate.FMIndex(t, 5)
    assert index.n == len(t) + 1
    phrases = np.array([[-1, a, b] for a in range(1, 5) for b in range(1, 5)])
    for (_, a, b), lo, hi in zip(phrases.tolist(), *index.search(phrases)):
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == [i for i in range(len(t) - 1) if t[i] == a and t[i + 1] == b]


def test_benchmark_blocks_do_not_matter(spark, docs):
    b, d = spark.read.parquet(f"{SF}/benchmark.parquet"), docs.select("doc_id", "text")
    one = decontaminate.leaks_digest(decontaminate.find_leaks(d, b))
    many = decontaminate.leaks_digest(decontaminate.find_leaks(d, b, block_bytes=4000, shard_bytes=50_000))
    assert one.exceptAll(many).count() == 0 and one.filter("contaminated").count() > 0


def test_cut_text_has_no_leaks(spark, docs):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = decontaminate.cut_leaks(docs, b)
    again = decontaminate.leaks_digest(decontaminate.find_leaks(clean, b))
    assert again.filter("contaminated").count() == 0
    same = clean.join(docs.withColumnRenamed("text", "old").select("doc_id", "old"), "doc_id")
    hit = decontaminate.leaks_digest(decontaminate.find_leaks(docs, b)).filter("contaminated").count()
    assert same.filter("not (text <=> old)").count() == hit


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    assert out.filter("lang_pred = lang").count() >= 0.95 * out.count()
    assert langid.languages(d).filter("score < 0 or score > 1").count() == 0


def test_packing_is_exact_and_full(spark, docs, rows):
    t = tokenizer("word_bpe_49k.json")
    packed = packing.pack_documents(docs.coalesce(1)).collect()
    by = collections.defaultdict(list)
    for r in packed:
        by[r.doc_id].append(r)
    for k, r in rows.items():
        ids = np.asarray([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted(by[k], key=lambda x: x.piece)
        assert b"".join(bytes(x.tokens) for x in own) == ids
        assert all(x.start == x.piece * 2048 and x.length == len(x.tokens) // 4 for x in own) and all(x.length == 2048 for x in own[:-1])
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in packed) / 2048 * 1.03 + 2


def test_swap_search_empties_bins():
    lengths = [6, 6, 5, 5, 5, 4, 4, 3, 2, 2, 2, 2, 2]
    bad = [[0], [1], [2], [3], [4], [5, 6], [7, 8], [9, 10, 11, 12]]
    out = packing.swap_search(lengths, bad, 10)
    assert sorted(i for b in out for i in b) == list(range(13)) and all(sum(lengths[i] for i in b) <= 10 for b in out)
    assert len(out) < len(bad)


def test_swap_search_leaves_no_exchange_untried():
    rng = random.Random(5)
    lengths = [rng.randint(400, 700) for _ in range(1500)]
    start = packing.best_fit(lengths, 2048)
    out = [[lengths[i] for i in b] for b in packing.swap_search(lengths, start, 2048)]
    assert sorted(v for b in out for v in b) == sorted(lengths) and len(out) < len(start) and len(out) > 200
    for d in out:
        given = {*d, *(v + w for n, v in enumerate(d) for w in d[n + 1 :])}
        for t in out:
            room = 2048 - sum(t)
            if t is not d and room and sum(t) >= sum(d):
                assert min(d) > room and not any(v < g <= v + room for g in given for v in t)


def test_sequences_of_different_partitions_meet(spark):
    """Partitions of one length each leave half of every sequence free; together they fill it."""
    word = tokenizer("word_bpe_49k.json").encode("the", add_special_tokens=False).ids
    texts = [" ".join(["the"] * n) for n in (1147, 899)]
    d = spark.createDataFrame([(i, texts[i // 40]) for i in range(80)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    rows = packing.pack_documents(d).collect()
    assert len(word) == 1 and sorted(r.doc_id for r in rows) == list(range(80)) and {r.length for r in rows} == {1148, 900}
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(bins) == 40 and all(sorted(b)[0][0] == 0 and sorted(b)[1][0] == sorted(b)[0][1] for b in bins.values())


@pytest.mark.parametrize("parts", [1, 16])
def test_sequence_count_does_not_follow_the_layout(spark, docs, parts):
    rows = packing.pack_documents(docs.repartition(parts), chunk=300).collect()
    whole = packing.pack_documents(docs.coalesce(1)).select("length", "sequence_id").collect()
    least = -(-sum(r.length for r in whole) // 2048)
    assert sum(r.length for r in rows) == sum(r.length for r in whole)
    assert len({r.sequence_id for r in rows}) <= least + 2 and len({r.sequence_id for r in whole}) <= least + 2


def components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j, common in collections.Counter(j for x in sets[i] for j in holders[x] if j < i).items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for (d, _), s in zip(rows, sets)}


def edited(rng, groups):
    """Groups of texts that differ in a few words each, and some of no or few words."""
    rows = []
    for many, length in groups:
        base = [f"w{rng.randrange(300)}" for _ in range(length)]
        for _ in range(many):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[f"w{rng.randrange(300)}"], [], [t[i], "new"]]) or t[i : i + 1]
            rows.append(" ".join(t))
    rows += ["", " \n", "a", "A", "a b", "a b c", "A  B c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_join_against_all_pairs(spark, seed, size, percent):
    rng = random.Random(seed)
    rows = edited(rng, [(rng.choice([1, 2, 5, 25, 50]), rng.choice([3, 6, 20, 60, 150, 400])) for _ in range(10)])
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows, size, percent)


def test_blocks_of_a_large_group_meet(spark, monkeypatch):
    """A third of the rows are near copies around the threshold, dealt over many small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)
    monkeypatch.setattr(jaccard_join, "FAN", 7)
    monkeypatch.setattr(jaccard_join, "BUNDLE", 3)
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(999)}" for w in base) for _ in range(100)]
    rows += [" ".join([*base[:40], *(f"y{rng.randrange(400)}" for _ in range(60))]) for _ in range(100)]
    rows = list(enumerate(rows + [" ".join(f"z{rng.randrange(400)}" for _ in range(80)) for _ in range(100)]))
    want = components(rows, 4, 85)
    assert 5 < len({c for _, c in want.values()}) < 260
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_components_of_all_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = components([tuple(r) for r in d.collect()], 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(d).collect()} == want


def test_one_row_of_each_group_stays(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(5, a, "p"), (5, a, "q"), (7, a + " w40", "r"), (None, a, "s"), (None, "only here", "t"), (None, "only here", "u"), (8, "", "v"), (9, None, "w"), (5, "other words of the same identifier", "x"), (3, "alone", "y")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted((str(r.doc_id), str(r.text)[:5]) for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "source"]
    assert got == sorted([("5", a[:5]), ("5", "other"), ("None", "only "), ("8", ""), ("9", "None"), ("3", "alone")])


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    s, rng = jaccard_join.Scheme(85), np.random.default_rng(5)
    for n in (1, 2, 7, 12, 40, 150, 700, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            drop = int(rng.integers(0, n // 8 + 1))
            b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 20 + 1)), np.uint64)])
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common):
                continue
            tags = {s.band(len(a)), s.band(len(a)) + 1} & {s.band(len(b)), s.band(len(b)) + 1}
            shared = [t for t in tags if np.intersect1d(s.signatures(a, t), s.signatures(b, t)).size]
            assert shared
            for t in tags:
                k, cells = s.most(t), len(s.parts(t)[1])
                assert cells >= k // 2 + 1 + s.parts(t)[2] or not k
                far = jaccard_join._far(np.frombuffer(s.sketch(a, t), np.uint64), np.frombuffer(s.sketch(b, t), np.uint64))
                assert far <= s.differ(len(a) + len(b))


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 977) for i in range(3000))
    want = jaccard_join.shingle_sets([text], 4)[0]
    monkeypatch.setattr(words, "PIECE", 1000)
    assert np.array_equal(jaccard_join.shingle_sets([text, b"a"], 4)[0], want)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(m.group())]
    out += [("phone", m) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    rank = ["email", "ip", "card", "phone"]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in sorted(out, key=lambda x: (x[1].start(), rank.index(x[0]))))


def test_pii_against_regular_expressions(spark, rows):
    import hashlib

    rng = random.Random(4)
    odd = ["a@b.co_x@y.zz q@r", "1.2.3.4.5.6 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (212) 555-0100) +44.20.7946.0958- ++1", "é@b.co 😀 a@é.co x@y.co.uk.", "4041894974608795" * 3, "@.@", "+" * 30, "1" * 5000]
    odd += ["".join(rng.choice("ab@.+-0123456789 ()_é") for _ in range(80)) for _ in range(300)]
    texts = [r.text for r in rows.values()] + odd
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans_digest(pii.with_spans(d, "spans")).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, t[:80], want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_pii_of_long_runs_and_many_matches(spark):
    """A run of a million characters with an @, and thousands of addresses in one text, take seconds."""
    import time

    rng = random.Random(9)
    many = " ".join(f"user{i}@mail{i % 7}.example.com{rng.choice(['', ' token', ','])} 10.0.{i % 256}.{i % 200}" for i in range(8000))
    texts = ["a" * (1 << 20) + "@b.co tail", "1" * (1 << 20) + ".2.3.4 1.2.3.4", "x@" + "b" * (1 << 20), many]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.spans_digest(pii.with_spans(d, "spans")).collect()}
    took = time.perf_counter() - began
    assert got[0].n_email == 1 and got[1].n_ip == 1 and got[2].n_email == 0 and got[3].n_email == got[3].n_ip == 8000
    import hashlib

    assert got[3].base_sha256 == hashlib.sha256(base_spans(many).encode()).hexdigest()
    assert took < 60


def test_pii_method_spans(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN GB82 WEST 1234 5698 7654 33 no", "my ssn is 123-45-6789", "part 123-45-6789 of a list", "plain words only", 'token = "' + "0a" * 20 + '"', "digest " + "0a" * 20, "AKIA" + "A1" * 8 + " auth"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.with_spans(d, "spans").collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: [], 5: ["secret"], 6: [], 7: ["secret"]}
    assert {r.doc_id: r.text for r in pii.redact(d).collect()}[2] == "my ssn is [SSN]"


def test_sums_for_checksums(spark):
    d = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB82WEST12345698765431")], "c string, i string")
    assert [tuple(r) for r in d.select(pii.luhn(F.col("c")), pii.mod97(F.col("i"))).collect()] == [(True, True), (False, False)]


def plain_print(text):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """By comparing all with all: identifier to the smallest one it reaches."""
    ids = sorted(prints)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_against_all_pairs(spark, docs, rows):
    prints = {i: plain_print(r.text) for i, r in rows.items()}
    want = plain_components(prints)
    got = simhash.components(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in rows}


@pytest.mark.parametrize("segments, cell", [(16, 256), (16, 3), (8, 2), (4, 5), (32, 256)])
def test_simhash_links_of_crowded_points(spark, segments, cell):
    random.seed(segments + cell)
    prints = {}
    for g in range(6):  # chains of prints a few bits apart, all about one point of the grid
        x = random.getrandbits(64)
        for _ in range(60):
            for b in random.sample(range(64), random.choice([1, 1, 2, 2, 3])):
                x ^= 1 << b
            prints[len(prints)] = x
    prints |= {1000: 0, 1001: (1 << 64) - 1, 1002: (1 << 64) - 2, 1003: 7, 1004: 4}
    want = plain_components(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in set(prints.values())], "fp long")
    found = simhash.links(table, segments, cell).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in found)
    name = {signed(x): min(i for i, y in prints.items() if y == x) for x in prints.values()}
    label = {i: i for i in set(name.values())}
    for _ in range(len(label)):
        before = dict(label)
        for r in found:
            a, b = name[r.a], name[r.b]
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert {i: label[name[signed(x)]] for i, x in prints.items()} == want


def test_fingerprint_of_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    monkeypatch.setattr(simhash, "STEP", 7)
    random.seed(4)
    for n in (0, 1, 2, 3, 4, 400):
        text = "".join(random.choice(["Word", "d\u00e9j\u00e0", "x" * 120, "a"]) + random.choice([" ", "\n", "\t \r", "\x0b\x0c"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_divergence_over_blocks_and_slices(spark, docs, monkeypatch):
    want = sorted(map(tuple, divergence.audit(docs).collect()))
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "LISTED", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(map(tuple, divergence.audit(docs.repartition(3)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ptolemaic_bounds_are_never_over():
    rng = np.random.default_rng(7)
    for scale in (3, 1000, 1 << 27):
        x = rng.integers(-scale, scale, (400, 64))
        x[200:] = x[:200] // 7 * 7  # and nearly equal ones
        c = np.r_[x[:7], x[3:4]]
        pivots = centroids.choose_pivots(c)
        assert len({tuple(p) for p in pivots.tolist()}) == len(pivots)
        near = centroids._to_pivots(x, pivots)
        true = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, k)) for k in c] for v in x]
        bound = centroids.lower_bounds(near, c, pivots)
        assert all(int(np.floor(b * b)) <= t for bs, ts in zip(bound, true) for b, t in zip(bs, ts))
        cluster, best = centroids.nearest(x, near, c, pivots)
        assert best.tolist() == [min(t) for t in true] and cluster.tolist() == [t.index(min(t)) for t in true]


def test_many_spans_are_replaced_in_proportion(spark):
    import time

    rng = random.Random(3)
    parts = ["a{0}@b.example.org", "+49 (30) 123456{0}", "10.0.0.{1}", "4111 1111 1111 1111", "x{0}@y.org+491701234567", "pläin wörds 日本", "GB82 WEST 1234 5698 7654 32", "+1 10.0.0.{1} 555 0100 44"]
    from tests.llm.test_pipeline import redacted

    texts = [" ".join(rng.choice(parts).format(i % 10, i % 256) for i in range(n)) for n in (1, 2, 5, 40, 300, 3000)]
    texts += ["", None, "x" * 5000, "é" * 1024 + "a@b.co" + "é" * 1023 + "a@b.co", "a@b.co"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"spans": F.lit("kept"), "spans_email": F.lit(1), "__email": F.lit(2)})
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    assert pii.redact(d).columns == d.columns and all((r.spans, r.spans_email, r["__email"]) == ("kept", 1, 2) for r in got.values())
    assert [got[i].text for i in range(len(texts))] == [t and redacted(t) for t in texts]
    many = spark.createDataFrame([(n, " ".join(f"word{i} other a{i}@b{i}.example.org é" for i in range(n))) for n in (16_000,)], "doc_id long, text string")
    began = time.perf_counter()
    assert pii.redact(many).first().text == " ".join(f"word{i} other [EMAIL] é" for i in range(16_000))
    assert time.perf_counter() - began < 30


def test_many_leaks_are_cut_in_proportion(spark):
    import time

    b = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "end")], "item_id long, text string")
    n = 8000
    texts = [" ".join(f"w{i} x y z. Alpha beta-gamma delta! ü v w" for i in range(n)), "alpha beta gamma delta", "end, end", "alpha beta gamma", None, ""]
    want = [" ".join(f"w{i} x y z.  - ! ü v w" for i in range(n)), "   ", ", ", "alpha beta gamma", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    began = time.perf_counter()
    out = decontaminate.cut_leaks(d, b)
    got = {r.doc_id: r for r in out.collect()}
    assert time.perf_counter() - began < 30
    assert out.columns == d.columns and [got[i].text for i in range(len(texts))] == want and got[0].spans == 1


def test_shards_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    phrases = decontaminate.Phrases([(1, b"alpha beta")])
    sizes = []
    real = decontaminate.search_shard
    monkeypatch.setattr(decontaminate, "search_shard", lambda docs, p: sizes.append([len(d) for d in docs]) or real(docs, p))
    texts = [b"alpha beta c " * k for k in (1, 1, 400, 1, 1, 50, 50, 50, 1)] + [None, b""] * 60
    n = len(texts)
    row = pa.array([{"i": i} for i in range(n)])
    batch = pa.RecordBatch.from_arrays([row, pa.array(texts, pa.binary()), pa.array([0] * n, pa.int64()), pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([[]] * n, pa.list_(pa.int64()))], names=["row", "text", "n_words", "spans", "items"])
    task = decontaminate._searcher(types.SimpleNamespace(value=phrases), 1600, False)
    out = [r for b in task(iter([batch.slice(0, 4), batch.slice(4, 3), batch.slice(7)])) for r in b.to_pylist()]
    assert [r["row"]["i"] for r in out] == list(range(n)) and [r["text"] for r in out] == texts
    assert [len(r["spans"]) for r in out] == [len(t or b"") // 13 for t in texts]
    assert [1200] in sizes and all(13 * sum(s) // 3 + decontaminate.ROW * len(s) <= 1600 for s in sizes if s != [1200])
