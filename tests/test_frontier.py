"""Stored crawls: levels as in memory, going on after a failure, attempts, turns, cancelling."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import pages as P
from quarry.sources.files import Files
from quarry.sources.frontier import GOT, Limits, StoredCrawl, temporary

SCHEMA = "success boolean, url string, html string, markdown string, error_message string"


def site(spark, n=40):
    """Page i links to 2 i + 1 and 2 i + 2, to itself, to the first one and to another host."""
    html = lambda i: "".join(f'<a href="{t}">x</a>' for t in (f"/{2 * i + 1}", f"{2 * i + 2}#part", "", "/0", "https://c.d/1"))
    return spark.createDataFrame([(True, f"https://a.b/{i}", html(i), f"page {i}", None) for i in range(n) if i != 5], SCHEMA)


class Fetcher:
    def __init__(self, pages, fails=None):
        self.pages, self.fails, self.asked = pages, fails or (lambda n, url: None), []

    def __call__(self, urls):
        asked = sorted(r.url for r in urls.collect())
        self.asked += asked
        down = [(u, e) for u in asked if (e := self.fails(len(self.asked), u))]
        down = urls.sparkSession.createDataFrame(down, "url string, e string")
        found = urls.join(self.pages, "url", "left").join(down, "url", "left")
        return found.select((F.coalesce("success", F.lit(False)) & F.col("e").isNull()).alias("success"), "url", "html", "markdown", F.coalesce("e", F.when(F.col("success").isNull(), "HTTP Error 404: Not Found")).alias("error_message"))


def start(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def rows(df):
    return sorted((r.url, r.depth, r.success) for r in df.collect())


def test_as_levels_in_memory(spark, tmp_path):
    pages, first = site(spark), start(spark, "https://a.b/0#top", "https://a.b/0", "https://c.d/9", None, "")
    fetch = Fetcher(pages)
    got = StoredCrawl(spark, str(tmp_path / "c"), fetch, 4, Limits(turn=3)).run(first)
    assert rows(got) == rows(P.crawl_levels(Fetcher(pages), first.filter("url <> ''"), 4))
    assert len(fetch.asked) == len(set(fetch.asked)) == got.count()


def test_goes_on_after_a_failure(spark, tmp_path):
    pages, first, where = site(spark), start(spark, "https://a.b/0"), str(tmp_path / "c")
    want = rows(StoredCrawl(spark, str(tmp_path / "whole"), Fetcher(pages), 4, Limits(turn=2)).run(first))

    def dies(n, url):
        if n > 6:
            raise OSError("the driver is gone")

    dead, after = Fetcher(pages, dies), Fetcher(pages)
    with pytest.raises(OSError, match="gone"):
        StoredCrawl(spark, where, dead, 4, Limits(turn=2)).run(first)
    files = Files(spark, where)
    assert files.names(f"{where}/done")
    spark.createDataFrame([(True, "https://a.b/77", "", "of a write that never ended", None, 1, 1)], GOT).write.parquet(f"{where}/got-0001-00000000-01-half")
    crawl = StoredCrawl(spark, where, after, 4, Limits(turn=2))
    assert rows(crawl.run(first)) == want
    assert len(after.asked) < len(want) and {u for u, *_ in want} == set(after.asked) | set(dead.asked)
    again = Fetcher(pages)
    assert rows(StoredCrawl(spark, where, again, 4, Limits(turn=2)).run(first)) == want and again.asked == []
    crawl.delete()
    assert files.names(where) == []


def test_attempts(spark, tmp_path):
    tries = {}

    def fails(n, url):
        tries[url] = tries.get(url, 0) + 1
        return {"https://a.b/1": "HTTP Error 503: busy" if tries[url] < 3 else None, "https://a.b/2": "<urlopen error timed out>", "https://a.b/3": "HTTP Error 403: Forbidden"}.get(url)

    got = StoredCrawl(spark, str(tmp_path / "c"), Fetcher(site(spark, 5), fails), 3, Limits(wait=0)).run(start(spark, "https://a.b/0"))
    found = {r.url[-1]: (r.success, r.attempt, r.depth) for r in got.collect()}
    assert found == {"0": (True, 1, 1), "1": (True, 3, 2), "2": (False, 3, 2), "3": (False, 1, 3), "4": (True, 1, 3)}
    assert tries == {"https://a.b/0": 1, "https://a.b/1": 3, "https://a.b/2": 3, "https://a.b/3": 1, "https://a.b/4": 1}


def test_empty_and_cancelled(spark, tmp_path):
    fetch = Fetcher(site(spark))
    assert StoredCrawl(spark, str(tmp_path / "none"), fetch).run(start(spark, None)).collect() == [] and fetch.asked == []
    crawl = StoredCrawl(spark, str(tmp_path / "c"), fetch, 3)
    with pytest.raises(RuntimeError, match="cancelled"):
        crawl.run(start(spark, "https://a.b/0"), lambda: len(fetch.asked) >= 3)
    assert rows(crawl.run(start(spark, "https://a.b/0")))[-1][0] == "https://a.b/6" and len(fetch.asked) == 7


def test_temporary(spark):
    errors = ["HTTP Error 429: x", "HTTP Error 404: x", None, "<urlopen error [Errno 111] Connection refused>", "The read operation timed out"]
    df = spark.createDataFrame([(e,) for e in errors], "e string")
    assert [r[0] for r in df.select(temporary(F.col("e"))).collect()] == [True, False, False, True, True]


def test_served_pages_are_those_asked_for(spark):
    """Of two pages of a URL the one with text; a page that isn't there, or has no text, fails. Batches are bounded."""
    rows = [("a", "<script>long script</script>"), ("a", "<p>x"), ("b", ""), ("c", "<p>y"), ("d", None)]
    found = P.served(spark.createDataFrame([(u,) for u in "abde"], "url string"), spark.createDataFrame(rows, "url string, html string"))
    assert sorted(map(tuple, found.collect())) == [("a", True, "<p>x", "x"), ("b", False, None, None), ("d", False, None, None), ("e", False, None, None)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
