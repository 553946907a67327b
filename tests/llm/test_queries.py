"""The registered queries: their SQL on a table with odd rows, and what each must return."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from swelter.llm import urlfilter
from swelter.llm.oracle import SQL

COLUMNS = {
    "op1_warc_transactions": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op10_forest_search": {"query_id", "rank", "vec_id", "score"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_fill_in_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    "op13_quality_convnet": {"doc_id", "held_out", "score", "predicted"},
}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(41), tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for i in range(2000):
        text = prose(rng, rng.randrange(45, 130))
        if i % 9 == 0:
            text += "\n" + "\n".join(rng.choice(["line one", "line two", "line three", "", "line é"]) for _ in range(12))
        if i % 7 == 0:
            text += " #$%&" * rng.randrange(1, 60)
        if i % 11 == 0:
            text = " ".join([text, *text.split()[:40] * 3])
        docs.append((i, text, rng.choice(["en"] * 18 + ["de", None]), rng.choice(["a", "b", "b", "b", None, "é"]), len(text)))
        labels.append((i, int(i % 7 > 0), int(i % 5 == 0)))
    docs += [(2000, None, "en", "a", None), (2001, "", None, None, 0), (2002, " \n \n", "en", "b", 4), (2003, "x" * 50_000, "de", "a", 1), (2004, "word " * 20_000, "en", "b", 1), (2005, docs[0][1], "en", "a", 1)]
    body = "é" * 60
    pages = [(i, rng.choice(["http://A.example.com/en/7", "x://b.net/de/", "", "http://c.org/es/?q", "none"]), rng.choice([body, prose(rng, 30), "short", None])) for i in range(300)] + [(300, None, None), (301, "http://d.net/de/1#a", body)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, [float(rng.gauss(0, 1)) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def comparable(rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, dt.date) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, tables)
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert set(names) == set(got.columns)
    assert comparable(got.select(*names).collect()) == comparable(want.fetchall())


#: The contract's rules, written out: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: url, rule, verdict as the contract has them.
URL_VERDICTS = [
    ("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/6", "com/en/", "block"),
    ("http://www.Example.com/en/70?q", "example.com/en/7", "allow"), ("http://b.net/de/8", "net/de/", "allow"),
    ("http://example.net/de/7", "net/de/", "allow"), ("http://x.example.net/de/81#f", "example.net/de/8", "block"),
    ("http://c.org/es/", "org/es/", "block"), ("http://c.org/en/", None, "allow"), ("none", None, "allow"), (None, None, "allow"),
]


def test_url_verdicts_are_those_of_the_contract(spark, tmp_path):
    assert sorted(urlfilter.RULES) == sorted(URL_RULES)
    pages = [(i, url) for i, (url, _, _) in enumerate(URL_VERDICTS)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [(i, rule, verdict) for i, (_, rule, verdict) in enumerate(URL_VERDICTS)]
    got = __spark_entry__.queries()["op6_url_filter"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("page_id", "rule", "verdict").collect())) == want
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(f"select page_id, rule, verdict from ({SQL['op6_url_filter']})").fetchall()) == want


def test_quality_rejects_by_certified_cutoffs(spark, tables):
    rows = __spark_entry__.queries()["op8_quality_rules"](spark, tables).collect()
    rejected = [r for r in rows if r.rejected_by]
    assert len(rejected) > 50 and all(not r.kept for r in rejected)
    assert all(r.kept == (not r.base_failed and not r.rejected_by) for r in rows)


@pytest.mark.parametrize("name", ["op4_packing", "op5_toxicity", "op9_license_scan", "op10_forest_search", "op13_quality_convnet"])
def test_other_queries_return_what_they_must(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, tables)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    if name == "op5_toxicity":
        assert len(rows) == 2006 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    elif name == "op13_quality_convnet":
        assert len(rows) == 2006 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    elif name == "op9_license_scan":
        assert len(rows) == 2006 and all(r.n_words is not None and 0 <= r.score <= 1 for r in rows)
    elif name == "op10_forest_search":
        assert {r.query_id for r in rows} == {0, 20, 40} and len(rows) == 60
    else:
        assert {r.doc_id for r in rows} == set(range(2006))


def test_contract_columns(spark, tables):
    for name in ("op1_warc_transactions", "op3_mixing", "op6_url_filter", "op8_quality_rules", "op11_spelling_variants", "op12_fill_in_middle"):
        assert COLUMNS[name] <= set(__spark_entry__.queries()[name](spark, tables).columns)


def test_stages_of_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name
