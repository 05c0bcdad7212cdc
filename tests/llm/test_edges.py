"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from runweave.llm import centroids, decontaminate, divergence, jaccard_join, langid, packing, pii, quality, sharding, simhash, sstable, token_counts, url_filter
from runweave.llm.shared import shared_dir

LONG = "word " * 60_000 + "mail bob@example.org end"
ROWS = [
    (1, "Plain words with a mail bob.smith@mail.example.com here.", "en", "s", 3),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "fr", "s", 4),
    (5, "same text", "en", "s", 9),
    (5, "same text", "en", "s", 9),
    (6, "same text", "de", None, 9),
    (None, "no identifier", "en", "s", 13),
    (7, LONG, "en", "s", len(LONG)),
    (8, "x" * 30_000, "en", "s", 30_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(ROWS, SCHEMA)
    return extra.withColumns({"h": F.lit(1), "tokens": F.lit("x"), "spans": F.lit(2), "row": F.lit(3), "b": F.lit(4), "n_words": F.lit(5), "th": F.lit(6), "tag": F.lit(7)})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Plain words with a mail"), (1, "same text"), (2, None), (3, ""), (None, "no identifier")], "item_id long, text string")


OPERATORS = {
    "sharding": lambda d, b: sharding.assign(d, limit=1000),
    "sstable": lambda d, b: sstable.shards_digest(sstable.token_shards(d.sparkSession, d)),
    "token_counts": lambda d, b: token_counts.count_tokens(d),
    "quality": lambda d, b: quality.judge(d),
    "decontaminate": lambda d, b: decontaminate.leaks_digest(decontaminate.find_leaks(d, b)),
    "language": lambda d, b: langid.languages(d),
    "packing": lambda d, b: packing.pieces_digest(packing.pack_documents(d)),
    "jaccard": lambda d, b: jaccard_join.components(d),
    "pii": lambda d, b: pii.spans_digest(pii.with_spans(d, "__spans"), "__spans"),
    "simhash": lambda d, b: simhash.components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered(name, docs, benchmark):
    rows = OPERATORS[name](docs, benchmark).collect()
    ids = sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))
    if name == "packing":
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, None}
    else:
        assert ids == [1, 2, 3, 4, 5, 5, 6, 7, 8, None]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, benchmark):
    assert OPERATORS[name](docs.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(name, spark, benchmark):
    nulls = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    assert OPERATORS[name](nulls, benchmark).count() == 3


def test_values_of_edge_rows(docs, benchmark):
    jac = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.components(docs).collect()}
    assert jac[(5, 1)] == 5 and jac[(6, 1)] == 5 and jac[(2, 0)] == 2 and jac[(3, 0)] == 3 and jac[(4, 0)] == 4 and jac[(None, 1)] is None
    leaks = {r.doc_id: r for r in OPERATORS["decontaminate"](docs, benchmark).collect()}
    assert leaks[1].n_hit == 5 and leaks[5].n_hit == 2 and leaks[6].contaminated and not leaks[2].contaminated and leaks[None].n_hit == 0
    lang = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert lang[2].lang_pred == lang[3].lang_pred == lang[4].lang_pred == "und" and lang[7].lang_pred != "und"
    q = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert q[2].base_failed and not q[2].kept and q[7].n_words == 60_003 and q[7].n_repeat_words == 60_000
    p = {r.doc_id: r for r in OPERATORS["pii"](docs, benchmark).collect()}
    assert p[1].n_email == 1 and p[7].n_email == 1 and p[2].spans == ""


def test_simhash_of_edge_rows(docs):
    sim = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.components(docs).collect()}
    zero = "0" * 16
    assert sim[(2, zero)] == sim[(3, zero)] == sim[(4, zero)] == 2
    same = [(k, v) for k, v in sim.items() if k[0] in (5, 6)]
    assert len(same) == 2 and {v for _, v in same} == {5} and len({k[1] for k, _ in same}) == 1
    assert [v for k, v in sim.items() if k[0] is None] == [None]


def test_divergence_of_edge_rows(spark, docs):
    assert divergence.audit(docs, least_docs=1).collect() == []  # a source each: no pairs, and shares as in the language
    assert divergence.audit(docs.limit(0)).count() == 0
    rows = [("a b b", "x", "p"), ("a b", "x", "q"), ("A c, c", "x", None), (None, "x", "r"), ("a", None, "p"), ("a", None, None), ("d\u00e9 D\u00c9 d\u00e9", "x", "q")]
    some = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "value": F.lit(3)})
    got = {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.audit(some, least_docs=2).collect()}
    assert ("x", "p", "pair", "") in got and ("x", "", "pair", "r") in got and got[("", "", "pair", "p")] == (0, 1)
    # kept in x: a (3 documents), b (2); N of p is 3, so shares are 1 + floor(1e9 * (1 + 1) / 5) and 1 + floor(1e9 * 3 / 5)
    p, q = {"a": 400000001, "b": 600000001}, {"a": 500000001, "b": 500000001}
    assert got[("x", "p", "pair", "q")] == (sum((p[t] - q[t]) ** 2 // q[t] for t in p), 2)
    whole = 1 + 10**9 * 4 // 8
    assert got[("x", "p", "term", "b")] == ((p["b"] - whole) ** 2 // whole, 1) and ("x", "p", "term", "a") not in got


def test_vectors(spark):
    one = [float(i) / 64 for i in range(64)]
    rows = [(1, one), (1, one), (2, None), (3, []), (4, one[:63]), (5, [*one[:63], None]), (6, [*one[:63], float("nan")]), (7, [*one[:63], float("inf")]), (None, [-x for x in one]), (8, [*one[:63], 3e38])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "near": F.lit(2), "cluster": F.lit(3)})
    got = centroids.clusters_digest(table).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == [(False, 1), (False, 1), (True, None)]
    assert all(r.distance == 0 and r.cluster_inertia == 0 and r.inertia == 0 for r in got)
    assert len({r.cluster for r in got if r.vec_id == 1}) == 1
    assert centroids.clusters_digest(table.limit(0)).count() == 0 and centroids.clusters_digest(table.filter("vec_id = 2")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, ""), (4, "http://A.Example.com/en/x?y"), (4, "http://A.Example.com/en/x?y"), (None, "https://www.example.com/en/"), (5, "http://x.net/es/" + "a" * 20_000), (6, "http://spam-farm.example.org/q"), (7, "http://x.net"), (8, "ftp://notnet/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {(r.page_id, r.host): (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[(1, "")] == got[(2, "")] == got[(3, "")] == (None, "allow")
    assert got[(4, "a.example.com")] == ("example.com/en/", "block") and got[(None, "www.example.com")] == ("www.example.com/en/", "allow")
    assert got[(5, "x.net")] == ("net/es/", "block") and got[(6, "spam-farm.example.org")] == (None, "block")
    assert got[(7, "x.net")] == (None, "allow") and got[(8, "notnet")] == (None, "allow")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    small = url_filter.filter_urls(pages, block_bytes=1)
    assert {(r.page_id, r.host): (r.rule, r.verdict) for r in small.collect()} == got


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as p

    words = [f"alpha{i} beta gamma{i} delta" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 30]), "en", "s", 1) for i in range(0, 30, 10)]
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, rows[0][1], "en", "s", 1), (103, rows[1][1] + " call", "en", "s", 2), (104, "Quite other words that nothing else has: call +1 (212) 555-0100 or write to a@b.co today", "en", "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, " ".join(words[25:29]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {0, 10, 20} <= set(kept) and 102 not in kept and 103 not in kept and 100 not in kept and 101 not in kept
    assert "alpha25" not in kept[0] and "alpha24" in kept[0]
    assert "@" not in kept[104] and "[EMAIL]" in kept[104] and "[PHONE]" in kept[104]
    pieces = p.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(kept)


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert not root or shared_dir(spark, "x").startswith(root.rstrip("/"))
