"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification.

1. One pass over the texts gives each row its set size, a 128-bit key of its
   set and band keys.  Rows of equal sets form one class, so copies never meet.
2. The classes of a band key follow the smallest of them, their lead; the
   groups of one lead in all its bands are one group.  Two classes that share a
   band key have a lead in common, so every candidate pair lies in a group, and
   every class of a group shares a band key with the lead.
3. A group is dealt into blocks of bounded size, each with the lead.  A block
   tests the lead against the others, and those not tied to one another yet, on
   their full sets; it emits a spanning forest of links, not the pairs.
4. Of a group of several blocks, the classes that aren't tied to the lead are
   left; they are tested against the other classes of like size, block by block.
5. Components over the verified links, then the smallest doc_id of each.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import bytesx as B
from trajecta.llm import minhash_core as M
from trajecta.llm.tables import components, cut, discard, packed
from trajecta.ship import ship

#: Bytes of sets (8 for each shingle) in one block; a task holds one or two.
BLOCK_BYTES = 6 << 20
#: Bytes that a set counts for besides its shingles.
ROW_BYTES = 256


def describe(docs: DataFrame, words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, key and bands of every row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    schema = f"doc_id {kind.simpleString()}, th long, n_shingles long, key binary, bands array<long>"
    to_arrow = to_arrow_type(kind)
    bands_n = M.plan(percent)

    def run(batches):
        for b in B.small(batches):
            ids, th, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            for first, part in B.slices(texts):
                h, bounds = B.distinct_runs(*B.shingles(part, words)[:2])
                n, keys = np.diff(bounds), M.set_keys(h, bounds)
                sig = M.signatures(h, bounds, bands_n * M.ROWS)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands_n, pa.int32()), pa.array(M.band_keys(sig).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(part)).cast(to_arrow), th.slice(first, len(part)), pa.array(n, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), bands], names=["doc_id", "th", "n_shingles", "key", "bands"])

    return rows.mapInArrow(run, schema)


def size_class(n, percent: int):
    """Number of a range of set sizes; sizes of linked sets lie in one or in neighbours."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _prefixes(flat: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of the sets that follow one another in ``flat``: their items (ranks, rarest first), their nodes and bounds.

    A linked pair of n and m items, n the larger, has at least percent of n in
    common.  With all items in one order, two such sets share an item among the
    first n - ceil(percent of n) + 1 of the one and the first
    m - ceil(percent of m) + 1 of the other: without one, the common items would
    be too few for the set whose prefix ends first.
    """
    node = np.repeat(np.arange(len(sizes)), sizes)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), dtype=np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    rank = rank[place]
    order = np.lexsort((rank, node))
    starts = np.cumsum(sizes) - sizes
    keep = sizes - -(-percent * sizes // 100) + 1
    inside = np.arange(len(flat)) - np.repeat(starts, sizes) < np.repeat(keep, sizes)
    order = order[inside]
    return rank[order], node[order], np.concatenate([[0], np.cumsum(np.minimum(keep, sizes))])


def forest(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that tie the linked nodes of one group together (no cycle of them), and the root of each node's tree.

    sides: where both 0 and 1 occur, only pairs across count.  Nodes come with
    side 0 first.  Node 0 is tested against all others, each further one against
    those that share an item of its prefix (``_prefixes``), which no linked pair
    lacks.
    """
    n = len(nodes)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    root = np.arange(n)
    out = []
    left = int((sides == 0).sum())
    cross = left < n
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    made = None
    for i in range(left):
        other = np.arange(left if cross else i + 1, n)
        other = other[root[other] != root[i]]
        other = other[(100 * sizes[other] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[other])]
        if i and len(other):
            if made is None:
                items, owner, ends = _prefixes(flat, sizes, percent)
                by_item = np.argsort(items, kind="stable")
                made = items, ends, items[by_item], owner[by_item]
            items, ends, posted, owners = made
            own = items[ends[i] : ends[i + 1]]
            first, last = np.searchsorted(posted, own), np.searchsorted(posted, own, "right")
            size = last - first
            near = np.zeros(n, dtype=bool)
            near[owners[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
            other = other[near[other]]
        for k in range(0, len(other), 64):
            some = other[k : k + 64]
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            size = sizes[some]
            at = np.repeat(starts[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            there = np.searchsorted(sets[i], flat[at])
            hit = sets[i][np.minimum(there, sizes[i] - 1)] == flat[at]
            same = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
            for j in some[100 * same >= percent * (size + sizes[i] - same)]:
                if root[j] != root[i]:
                    out.append((int(nodes[i]), int(nodes[j])))
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out, root


def _texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, z: compressed text, more columns of ``wanted``) for the representatives (rep, th) in ``wanted``."""
    rows = docs.select(docs[doc_id].alias("d"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text")).where("text is not null")
    small = packed(rows, "text", hashed=False)
    found = small.join(wanted, small.d.eqNullSafe(wanted.rep_id) & (small.h == wanted.th))
    return found.select("node", F.col("__tj_z").alias("z"), *(c for c in wanted.columns if c not in ("node", "rep_id", "th")))


def _verify(rows: DataFrame, words: int, percent: int, leads: bool) -> DataFrame:
    """(a, b, lead) for rows sorted by the group (lead, c, i, j) and by side.

    With b, a link that was found.  Where ``leads``, side 0 is the group's lead,
    pairs within a group count too, and a row without b is a class that a group
    of several blocks (``more``) left untied to its lead.
    """
    import pyarrow as pa

    def groups(batches):
        held, size, key = [], 0, None
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in B.small(batches):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:4] != key and size >= B.SLICE_BYTES:
                    yield held
                    held, size = [], 0
                if row[:4] == key and held and held[-1][5] == row[5] and held[-1][4] == row[4]:
                    continue  # a repeated row of the table
                key = row[:4]
                data = z.decompress(row[7])
                held.append((*row[:7], data))
                size += len(data)
        if held:
            yield held

    def work(held):
        h, bounds = B.distinct_runs(*B.shingles([x[7] for x in held], words)[:2])
        out, first = [], 0
        while first < len(held):
            last = first + 1
            while last < len(held) and held[last][:4] == held[first][:4]:
                last += 1
            group, sets = held[first:last], [h[bounds[k] : bounds[k + 1]] for k in range(first, last)]
            sides = np.array([g[4] for g in group])
            lead, more = group[0][0], group[0][6]
            if len(group) > 1 and sides[0] == 0:
                links, root = forest(np.array([g[5] for g in group]), np.zeros(len(group), dtype=int) if leads else sides, sets, percent)
                out += [(a, b, lead) for a, b in links]
                if leads and more:
                    out += [(g[5], None, lead) for g, r in zip(group, root, strict=True) if r != root[0]]
            first = last
        return out

    def run(batches):
        for held in groups(batches):
            if got := work(held):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=["a", "b", "lead"])

    return rows.select("lead", "c", "i", "j", "side", "node", "more", "z").mapInArrow(run, "a long, b long, lead long")


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "lead", "c", "i", "j").sortWithinPartitions("lead", "c", "i", "j", "side", "node")


def _components(docs: DataFrame, classes: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(node, root) of the classes that verified links tie together."""
    tied = classes.select("node", F.explode("bands").alias("band"))
    shared = tied.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("band", "lead")
    stars = cut(tied.join(shared, "band").where("node <> lead").select("node", "lead").distinct())
    rep = classes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("th"), "n")
    weigh = F.ceil(F.sum(F.col("n") * 8 + ROW_BYTES) / BLOCK_BYTES).cast("int")
    groups = cut(stars.join(rep, "node").groupBy("lead").agg(weigh.alias("blocks")))
    into = F.struct("lead", "i", "side", "more")
    member = stars.join(groups, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), F.lit(1).alias("side"), (F.col("blocks") > 1).alias("more"))
    leader = groups.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("side"), (F.col("blocks") > 1).alias("more"))
    want = member.union(leader).groupBy("node").agg(F.collect_list(into).alias("into")).join(rep.drop("n"), "node")
    zero = F.lit(0)
    rows = _texts(docs, want, doc_id, text).select("node", "z", F.explode("into").alias("x")).select("node", "z", "x.lead", zero.alias("c"), "x.i", zero.alias("j"), "x.side", "x.more")
    found = cut(_verify(_dealt(rows), words, percent, True))
    spent = [stars, groups, found]
    links = found.where("b is not null").select("a", "b")
    rest = found.where("b is null").select("lead", F.col("a").alias("node")).distinct()
    if not rest.isEmpty():
        sized = rep.withColumn("c", size_class(F.col("n"), percent))
        r = rest.join(sized, "node").select("lead", "node", "n", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
        hot = rest.select("lead").distinct()
        x = stars.join(hot, "lead").join(sized, "node").select("lead", "node", "n", "c")
        both = r.groupBy("lead", "c").agg(weigh.alias("ri")).join(x.groupBy("lead", "c").agg(weigh.alias("xj")), ["lead", "c"])
        own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        r = r.join(both, ["lead", "c"]).withColumn("j", every("xj")).select("node", "lead", "c", own("ri").alias("i"), "j", F.lit(0).alias("side"))
        x = x.join(both, ["lead", "c"]).withColumn("i", every("ri")).select("node", "lead", "c", "i", own("xj").alias("j"), F.lit(1).alias("side"))
        # a row for each group that a class is in: a class of a hot group may be in many
        ids = r.union(x).join(rep.drop("n"), "node")
        texts = _texts(docs, ids.select("node", "rep_id", "th").distinct(), doc_id, text)
        again = r.union(x).join(texts, "node").withColumn("more", F.lit(False))
        late = cut(_verify(_dealt(again), words, percent, False))
        links = links.union(late.where("a <> b").select("a", "b"))
        spent.append(late)
    comp = components(links)
    discard(*spent)
    return comp


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Rows link when 100 * intersection >= percent * union of their shingle sets.
    Rows without words (null, empty or white space) have n_shingles 0, are
    linked with nothing and stand for themselves.  A text of fewer words than
    ``words`` is one shingle; very long texts are taken whole.  Repeated rows
    fall in one class; component_id is the least doc_id that isn't null, and
    kept says whether the row has it (false for a null doc_id).  An empty table
    gives no rows; other columns are not read.
    """
    out = _named(docs, words, percent, doc_id, text)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _named(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, th (hash of the text), root (of the component; null without words) and component_id of every row."""
    ship(docs.sparkSession)
    rows = cut(describe(docs, words, percent, doc_id, text))
    some = rows.where("n_shingles > 0")
    one = some.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("min_doc"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = cut(one.select(F.monotonically_increasing_id().alias("node"), "key", "rep", "min_doc", "bands", "n"))
    comp = _components(docs, classes, words, percent, doc_id, text)
    named = classes.select("node", "key", "min_doc").join(comp, "node", "left").select("key", "min_doc", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    answer = named.join(least, "root").select("key", "root", "component_id")
    full = some.select("doc_id", "n_shingles", "th", "key").join(answer, "key").select("doc_id", "n_shingles", "th", "root", "component_id")
    bare = rows.where("n_shingles = 0").select("doc_id", "n_shingles", "th", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return full.union(bare)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked rows of ``docs``, with its columns: that of least doc_id, then of least hash of its text.

    Rows without words (null and empty texts among them) stay, as do rows with
    a null doc_id.  Of repeated rows with words one stays.  Very long texts are
    taken whole.  An empty table gives no rows; other columns, whatever their
    names, pass through.
    """
    found = cut(_named(docs, words, percent, doc_id, text))
    free = F.col("root").isNull() | F.col("doc_id").isNull()
    least = found.where(~free).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    times = found.where(~free).groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    kept = least.select("r.doc_id", "r.th").join(times, ["doc_id", "th"]).select(F.col("doc_id").alias("__tj_id"), F.col("th").alias("__tj_h"), (F.col("n") > 1).alias("__tj_more"))
    stay = found.where(free).select(F.col("doc_id").alias("__tj_id"), F.col("th").alias("__tj_h"), F.lit(False).alias("__tj_more")).distinct()
    both = kept.unionByName(stay)
    out = docs.join(both, docs[doc_id].eqNullSafe(both["__tj_id"]) & F.xxhash64(docs[text]).eqNullSafe(both["__tj_h"]))
    once = out.where(~F.col("__tj_more"))
    first = out.where("__tj_more").dropDuplicates(["__tj_id", "__tj_h"])
    return once.unionByName(first).select(docs.columns)
