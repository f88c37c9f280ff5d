"""Paths of list entries keep their case."""

import pytest

urlfilter = pytest.importorskip("lumenframe.llm.urlfilter")


def test_entries_match_hosts_in_any_case_and_paths_as_they_are(spark):
    entries = spark.createDataFrame([("Example.ORG/Docs", "add", "2024-01-10"), ("example.org/docs", "add", "2024-02-01"), ("example.org/docs", "remove", "2024-03-01"), ("Whole.example", "add", "2024-01-01")],
                                    "key string, action string, since string")
    urls = [("https://example.org/Docs/x", "2024-03-05"), ("https://EXAMPLE.org/docs/x", "2024-01-20"), ("https://example.org/docs/x", "2024-02-20"), ("https://example.org/docs/x", "2024-03-05"),
            ("https://example.org/DOCS", "2024-02-20"), ("https://whole.Example/A", "2024-02-20")]
    df = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, fetched string")
    got = {r.page_id: r.matched_key for r in urlfilter.url_filter(df, entries).collect()}
    assert got == {0: "example.org/Docs", 1: None, 2: "example.org/docs", 3: None, 4: None, 5: "whole.example"}


def test_bad_and_far_dates(spark):
    entries = spark.createDataFrame([("a.example", "add", "2024-01-10"), ("a.example", "remove", "n/a"), ("b.example", "add", "someday"), ("c.example", "add", "0001-01-01"), ("c.example", "remove", "9999-12-31")],
                                    "key string, action string, since string")
    urls = [("http://a.example", "9999-12-31"), ("http://a.example", "n/a"), ("http://b.example", "2024-02-01"), ("http://c.example", "9999-12-30"), ("http://c.example", "9999-12-31"), ("http://a.example", "2024-01-09")]
    df = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string, fetched string")
    got = {r.page_id: r for r in urlfilter.url_filter(df, entries).collect()}
    assert [got[i].blocked for i in range(6)] == [True, False, False, True, False, False] and got[1].fetched is None


def test_hot_hosts_are_split(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "LEAST_HOT", 3)
    monkeypatch.setattr(urlfilter, "HOT_SHARE", 8)
    entries = spark.createDataFrame([("hot.example", "add", "2024-01-10"), ("hot.example", "remove", "2024-01-20"), ("cold.example", "add", "2024-01-15")], "key string, action string, since string")
    rows = [(i, "http://hot.example/x" if i % 4 else "http://cold.example", f"2024-01-{1 + i % 28:02d}") for i in range(200)]
    got = {r.page_id: r.blocked for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string, fetched string"), entries).collect()}
    assert got == {i: (10 <= 1 + i % 28 < 20) if i % 4 else 1 + i % 28 >= 15 for i, *_ in rows}
