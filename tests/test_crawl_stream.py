import random

import pytest

from quern.operators import crawl
from quern.sources import readers
from quern.streaming import crawl as stream

SETTINGS = "url string, depth int, max_pages int, greedy boolean"


@pytest.fixture(scope="module")
def site():
    """Pages of two sites that link at random, with dead links."""
    rng = random.Random(8)
    made = {}
    for host in ("x.org", "y.org"):
        for n in range(40):
            links = "".join(f'<a href="/p/{m}">{rng.choice(["guide", "docs", "other", "about"])} {m}</a>' for m in rng.sample(range(55), 6))
            made[f"https://{host}/p/{n}"] = f"<title>T {n}</title><p>Text of page {n}.</p>{links}"
    return made


def rows(df):
    return sorted((r["source"], r["crawl_depth"], r["parent_url"], r["anchor_text"], r["title"], r["text"]) for r in df.collect())


def batch(spark, site, root, **kwargs):
    pages = readers.parse_pages(spark.createDataFrame(list(site.items()), "url string, html string"))
    return rows(crawl.archive_crawl(pages, root, **kwargs))


def test_a_stream_gives_the_pages_of_the_batch_crawl(spark, site, tmp_path):
    """Two roots at once, dead links without cost, a stop after each step, and a root that is asked for twice."""
    folder, counts = str(tmp_path / "crawl"), tmp_path / "counts"
    counts.mkdir()

    def fetch(url):
        (counts / url.replace("/", "_")).open("a").write("x")
        if url not in site:
            raise OSError("no page")
        return site[url]

    roots = spark.createDataFrame([("https://x.org/p/0", 3, 9, False), ("https://y.org/p/3", 2, 6, False)], SETTINGS)
    stream.request_crawls(roots, folder)
    assert stream.crawl_once(spark, folder, fetch) == 2  # each step is a query of its own, which goes on from the checkpoint
    assert stream.crawl_once(spark, folder, fetch) > 0
    stream.request_crawls(roots, folder)
    got = stream.run_crawls(spark, folder, fetch)
    for root, depth, most in (("https://x.org/p/0", 3, 9), ("https://y.org/p/3", 2, 6)):
        assert rows(got.where(got["root"] == root)) == batch(spark, site, root, depth=depth, max_pages=most)
    assert {len(p.read_text()) for p in counts.iterdir()} == {1}  # nothing is fetched twice
    assert stream.crawl_once(spark, folder, fetch) == 0


def test_a_root_without_a_page_ends(spark, site, tmp_path):
    stream.request_crawls(spark.createDataFrame([("https://x.org/none", 2, 5, False)], SETTINGS), str(tmp_path))
    assert stream.run_crawls(spark, str(tmp_path), site.get).count() == 0
