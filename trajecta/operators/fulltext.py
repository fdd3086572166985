"""A full-text index on disk: postings written once, read by impact.

A posting's impact is what its term adds to a document's BM25 score.  A term's
postings lie in tiers of falling impact, and a tier in blocks of about ``block``
postings dealt by a hash of the document, so a document's place in a tier is
known without a search, and a term of a third of all documents is many blocks
and no hot group.  A small table beside them holds each block's largest impact.

A search takes a first block of each term, which gives a score that the k best
reach at least; then, of the terms that can't be left out to reach it, only
blocks whose largest impact, with the best that the other terms could add,
reaches that score; and last, for the documents that can
still get there, their places in the blocks not read.  All else stays on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.operators.catalog import K1, B, terms
from trajecta.sources.tables import cut

TIERS, BLOCK, BUCKETS = 16, 128, 64
#: Up to so many terms of all queries are written into the scan's filter; more are joined.
LITERALS = 1000
#: Scores are ranked after rounding to six digits.
SLACK = 2e-6


def write_index(docs: DataFrame, doc: str, text: str, path: str, block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Write ``postings``, ``blocks`` and ``tiers`` under ``path``, in folders by term bucket.

    Documents without words have no postings; they count in no statistic, as in
    ``catalog.bm25``.  Null texts have no words.
    """
    post = cut(terms(docs, doc, text))
    size = post.groupBy(doc).agg(F.sum("tf").alias("len"))
    stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tier = F.least(F.floor((1 - part / (K1 + 1)) * TIERS), F.lit(TIERS - 1)).cast("int")
    x = post.join(size, doc).join(df, "term").join(F.broadcast(stats)).select(F.col(doc).alias("doc"), "term", (idf * part).alias("impact"), tier.alias("tier"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    tiers = cut(x.groupBy("term", "tier").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks")))
    tiers.select("*", bucket).write.partitionBy("bucket").parquet(f"{path}/tiers")
    x = x.join(tiers, ["term", "tier"]).withColumn("block", place("doc", "n_blocks"))
    x = x.groupBy("term", "tier", "block").agg(F.collect_list(F.struct("doc", "impact")).alias("entries"))
    x.select("*", bucket).repartition("bucket", "term", "tier").sortWithinPartitions("bucket", "term", "tier").write.partitionBy("bucket").parquet(f"{path}/postings")
    back = docs.sparkSession.read.parquet(f"{path}/postings")
    head = back.select("bucket", "term", "tier", "block", F.size("entries").alias("n"), F.array_max(F.transform("entries", lambda e: e["impact"])).alias("most"))
    head.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")


def place(doc: str, n_blocks: str):
    return F.pmod(F.xxhash64(doc), F.col(n_blocks)).cast("int")


class Index:
    """An index opened for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.blocks, self.tiers = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "blocks", "tiers"))

    def _of(self, table: DataFrame, sets: DataFrame, few: list[str] | None) -> DataFrame:
        return table.where(F.col("term").isin(few)) if few is not None else table.join(sets.select("term").distinct(), "term", "left_semi")

    def plan(self, sets: DataFrame, k: int) -> dict[str, DataFrame]:
        """What a search of term sets (terms, term) reads: ``first``, ``needed`` and ``probes`` blocks, and the scores they give.

        ``sets`` holds one row for each term of each distinct set of terms.
        """
        names = [r["term"] for r in sets.select("term").distinct().limit(LITERALS + 1).collect()]
        few = names if len(names) <= LITERALS else None
        posts = self._of(self.postings, sets, few)
        at = ["bucket", "term", "tier", "block"]
        mine = cut(sets.join(self._of(self.blocks, sets, few), "term"))
        tops = mine.groupBy("terms", "term").agg(F.max(F.struct("most", "bucket", "tier", "block")).alias("b"))
        total = tops.groupBy("terms").agg(F.sum("b.most").alias("all_most"))
        first = tops.select("terms", "term", "b.bucket", "b.tier", "b.block")
        theta = self._kth(self._scores(first, posts, at), k)
        # terms that together stay below theta: a document must hold another one, so these are only looked up
        up_to = F.sum("term_most").over(Window.partitionBy("terms").orderBy("term_most", "term"))
        own = tops.select("terms", "term", F.col("b.most").alias("term_most")).withColumn("up_to", up_to).join(total, "terms").join(theta, "terms", "left")
        least = F.coalesce("theta", F.lit(0.0)) - SLACK
        marked = mine.join(own, ["terms", "term"])
        marked = cut(marked.withColumn("needed", (F.col("up_to") >= least) & (F.col("most") + F.col("all_most") - F.col("term_most") >= least)))
        needed = marked.where("needed").select("terms", *at)
        rest = marked.groupBy("terms", "term").agg(F.coalesce(F.max(F.when(~F.col("needed"), F.col("most"))), F.lit(0.0)).alias("rest"))
        all_rest = rest.groupBy("terms").agg(F.sum("rest").alias("all_rest"))
        seen = needed.join(posts, at).select("terms", "term", F.explode("entries").alias("e")).select("terms", "term", "e.doc", "e.impact")
        seen = seen.join(rest, ["terms", "term"]).groupBy("terms", "doc").agg(F.sum("impact").alias("score"), F.sum("rest").alias("own_rest"), F.collect_list("term").alias("found"))
        seen = cut(seen)
        theta = self._kth(seen, k)
        able = seen.join(all_rest, "terms").join(theta, "terms", "left")
        able = able.where(F.col("score") + F.col("all_rest") - F.col("own_rest") >= F.coalesce("theta", F.lit(0.0)) - SLACK).select("terms", "doc", "score", "found")
        missing = able.select("terms", "doc", F.explode(F.array_except("terms", "found")).alias("term"))
        probes = missing.join(self._of(self.tiers, sets, few), "term").withColumn("block", place("doc", "n_blocks")).select("terms", "doc", *at)
        probes = cut(probes.join(needed, ["terms", *at], "left_anti"))
        more = probes.join(posts, at).select("terms", "doc", F.filter("entries", lambda e: e["doc"] == F.col("doc")).alias("e")).where(F.size("e") > 0).select("terms", "doc", F.col("e")[0]["impact"].alias("score"))
        scores = able.select("terms", "doc", "score").union(more).groupBy("terms", "doc").agg(F.sum("score").alias("score"))
        return {"first": first, "needed": needed, "probes": probes.select(*at).distinct(), "scores": scores}

    def _scores(self, blocks: DataFrame, posts: DataFrame, at: list[str]) -> DataFrame:
        e = blocks.join(posts, at).select("terms", F.explode("entries").alias("e"))
        return e.groupBy("terms", F.col("e.doc").alias("doc")).agg(F.sum("e.impact").alias("score"))

    def _kth(self, scores: DataFrame, k: int) -> DataFrame:
        """(terms, theta): the k-th best score of each set; no row for sets with fewer."""
        r = F.row_number().over(Window.partitionBy("terms").orderBy(F.desc("score")))
        return scores.select("terms", "score", r.alias("r")).where(F.col("r") == k).select("terms", F.col("score").alias("theta"))

    def search(self, queries: DataFrame, query: str, text: str, k: int = 50) -> DataFrame:
        """(query, doc, score, rank): the k best documents of each query, the same rows as ``catalog.bm25`` gives.

        Ties go to the lower document.  Queries with equal sets of terms are
        searched once; a query without a term that the index holds gives no row.
        """
        q = queries.select(query, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda x: x != ""))).alias("term"))
        q = cut(q.groupBy(query).agg(F.array_sort(F.collect_set("term")).alias("terms")))
        sets = q.select("terms").distinct().withColumn("term", F.explode("terms"))
        total = self.plan(sets, k)["scores"].withColumn("score", F.round("score", 6))
        r = F.row_number().over(Window.partitionBy("terms").orderBy(F.desc("score"), "doc"))
        return q.join(total.withColumn("rank", r).where(F.col("rank") <= k), "terms").select(query, "doc", "score", "rank")
