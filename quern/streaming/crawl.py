"""A crawl as a stream: its state (frontier, visited URLs, quotas) is kept for each root by Spark, and pages are fetched in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.web import canonical_url, is_crawlable, link_score
from ..operators.crawl import level_quotas
from ..schema import PAGE
from ..sources.readers import fetch_pages, parse_pages

_FIELDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAGE.fields)
#: What lies in the inbox: a root with its settings, or a page that was asked for (``found`` is false where none came).
RESULT = f"root string, url string, depth int, max_pages int, greedy boolean, found boolean, {_FIELDS}"
#: What the state gives out: pages of the crawl, and URLs to fetch.
STEP = f"kind string, root string, url string, crawl_depth int, parent_url string, anchor_text string, {_FIELDS}"
_NEW, _ASKED = 0, 1


class Frontier(StatefulProcessor):
    """Level by level, the best URLs of a root's frontier are asked for until as many pages have come as the level's quota; URLs without a page cost none.

    Links of a level's pages make the next frontier, each with its best score, ties by the least parent. A result that comes again changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        url = T.StructType().add("url", T.StringType())
        link = T.StructType().add("loss", T.DoubleType()).add("parent", T.StringType()).add("anchor", T.StringType()).add("state", T.IntegerType())
        # The level's number, its pages so far, the answers that it waits for, and all quotas.
        self.at = handle.getValueState("at", T.StructType().add("level", T.IntegerType()).add("taken", T.IntegerType()).add("due", T.IntegerType()).add("quotas", T.ArrayType(T.IntegerType())))
        self.front, self.coming = handle.getMapState("front", url, link), handle.getMapState("coming", url, link)
        self.visited = handle.getMapState("visited", url, T.StructType().add("level", T.IntegerType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        root, out = key[0], []
        every = pd.concat(list(rows), ignore_index=True)
        for row in every.sort_values("found", ascending=False, kind="stable").itertuples(index=False):
            if not self.at.exists():
                quotas = level_quotas(int(row.depth), int(row.max_pages), bool(row.greedy)) if row.depth == row.depth else []
                self.at.update((0, 0, 1, quotas))
                self.front.updateValue((root,), (0.0, None, "", _ASKED))
                self.visited.updateValue((root,), (0,))
                out.append(self._row("ask", root, root, 0))
                continue
            if row.url is None or not self.front.containsKey((row.url,)):
                continue
            loss, parent, anchor, state = self.front.getValue((row.url,))
            if state != _ASKED:
                continue
            level, taken, due, quotas = self.at.get()
            self.front.removeKey((row.url,))
            if row.found:
                out.append(self._row("page", root, row.url, level, parent, anchor, row))
                for x in row.links if row.links is not None and level < len(quotas) else ():
                    link = (-float(x["score"]), row.source, x["text"] or "", _NEW)
                    if self.visited.containsKey((x["url"],)):
                        continue
                    if not self.coming.containsKey((x["url"],)) or link[:3] < tuple(self.coming.getValue((x["url"],)))[:3]:
                        self.coming.updateValue((x["url"],), link)
            self.at.update((level, taken + bool(row.found), due - 1, quotas))
        out += self._asked(root)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ("kind", "root", "url", "crawl_depth", "parent_url", "anchor_text")] + [f.name for f in PAGE.fields])

    def _row(self, kind: str, root: str, url: str, level: int, parent: str | None = None, anchor: str = "", page: object = None) -> tuple:
        if page is None:
            return (kind, root, url, level, parent, anchor, *[None] * len(PAGE.fields))
        links = [{"url": x["url"], "text": x["text"]} for x in page.links] if page.links is not None else []
        return (kind, root, url, level, parent, anchor, page.title, page.text, page.source, page.source_type, links)

    def _asked(self, root: str) -> list[tuple]:
        """What to fetch next: the best of the level, as many as its quota lacks; of the next level once it is full or has no more."""
        out: list[tuple] = []
        while self.at.exists():
            level, taken, due, quotas = self.at.get()
            quota = 1 if level == 0 else quotas[level - 1]
            if due:
                return out
            waiting = sorted((loss, url[0], parent, anchor) for url, (loss, parent, anchor, state) in self.front.iterator() if state == _NEW)
            if taken < quota and waiting:
                for loss, url, parent, anchor in waiting[: quota - taken]:
                    self.front.updateValue((url,), (loss, parent, anchor, _ASKED))
                    self.visited.updateValue((url,), (level,))
                    out.append(self._row("ask", root, url, level, parent, anchor))
                self.at.update((level, taken, len(out), quotas))
                return out
            if not taken or level >= len(quotas) or quotas[level] <= 0:
                return out
            self.front.clear()
            for url, link in list(self.coming.iterator()):
                if not self.visited.containsKey(url):
                    self.front.updateValue(url, tuple(link))
            self.coming.clear()
            self.at.update((level + 1, 0, 0, quotas))
        return out

    def close(self) -> None:
        pass


def _scored(results: DataFrame) -> DataFrame:
    """Results whose links are the crawlable ones, with their scores."""
    root, parent = F.col("root"), F.col("source")
    good = F.filter("links", lambda x: is_crawlable(root, x["url"]))
    return results.withColumn("links", F.transform(good, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), link_score(root, parent, x["url"], x["text"]).cast("double").alias("score"))))


def request_crawls(requests: DataFrame, folder: str) -> None:
    """Put roots (url, depth, max_pages, greedy) into the inbox of the stream in ``folder``. A root that is known already changes nothing."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in PAGE.fields]
    rows = requests.select(canonical_url(F.col("url")).alias("root"), F.lit(None).cast("string").alias("url"), "depth", "max_pages", "greedy", F.lit(False).alias("found"), *empty)
    rows.write.json(f"{folder}/inbox/request={uuid.uuid4().hex}")


def fetched(asks: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """RESULT rows of asked URLs (root, url): each fetched once in a task and parsed, whatever roots ask for it."""
    pages = parse_pages(fetch_pages(asks.select("url").distinct(), fetch).where("html IS NOT NULL"))
    page = pages.dropDuplicates(["source"]).withColumn("found", F.lit(True))
    joined = asks.select("root", "url").join(page, asks["url"] == page["source"], "left")
    settings = [F.lit(None).cast(t).alias(n) for n, t in (("depth", "int"), ("max_pages", "int"), ("greedy", "boolean"))]
    return joined.select("root", "url", *settings, F.coalesce("found", F.lit(False)).alias("found"), *[f.name for f in PAGE.fields])


def crawl_once(spark: SparkSession, folder: str, fetch: Callable[[str], str | None], per_batch: int = 64) -> int:
    """Take in what lies in the inbox, write the pages that came to ``pages``, fetch what is asked next and put it into the inbox. Returns how many URLs were asked for.

    Batches write folders of their own numbers, so one that runs again after a failure replaces what it wrote, and results that are taken in twice change nothing.
    State and offsets are in ``folder/checkpoint``: another session goes on from there.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    results = spark.readStream.schema(RESULT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).json(f"{folder}/inbox")
    asked = []

    def batch(df: DataFrame, number: int) -> None:
        steps = df.persist()
        try:
            steps.where("kind = 'page'").drop("kind", "url").write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")
            asks = steps.where("kind = 'ask'").select("root", "url")
            n = asks.count()
            if n:
                fetched(asks, fetch).write.mode("overwrite").json(f"{folder}/inbox/batch={number}")
            asked.append(n)
        finally:
            steps.unpersist()

    steps = _scored(results).groupBy("root").transformWithStateInPandas(statefulProcessor=Frontier(), outputStructType=STEP, outputMode="Append", timeMode="None")
    steps.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sum(asked)


def run_crawls(spark: SparkSession, folder: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """Steps until nothing is asked for any more; gives the pages of all crawls so far: PAGE rows with root, crawl_depth, parent_url and anchor_text."""
    while crawl_once(spark, folder, fetch):
        pass
    return crawled(spark, folder)


def crawled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"root string, crawl_depth int, parent_url string, anchor_text string, {_FIELDS}").option("recursiveFileLookup", True).parquet(f"{folder}/pages")
