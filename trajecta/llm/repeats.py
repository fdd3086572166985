"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that starts elsewhere too.

1. Equal texts count as one; a text with a copy is covered whole.
2. Every window of the shortest length asked for belongs to its minimizer, the
   least hash of the 32-byte strings in it.  Equal windows have equal
   minimizers in the same place, so windows whose minimizer occurs once are
   unique and are left out.  A longer window belongs where its beginning does.
3. The windows of one minimizer occurrence, with the bytes they cover, are a
   segment.  Segments of equal minimizers are a group.  A group's distinct
   segments are cut into content-defined phrases, and the suffix array of the
   phrases, made by linear grouping, tells with its common prefixes which
   windows hold a run of phrases that occurs twice.
4. Those windows are compared by a 128-bit hash of all their bytes.
5. A group of more than ``BLOCK_SEGMENTS`` segments is dealt into blocks by
   hash.  What repeats in a block is known then, and one of each block's equal
   segments goes on: it is split by where the minimizer stands in the window,
   in ever smaller steps, and each part goes to the parts that share all the
   bytes its windows have in common.  Parts that meet nobody are unique; runs
   of windows come out, never single ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm import bytesx as B
from trajecta.llm.suffix_groups import common_prefixes, suffix_array
from trajecta.llm.tables import cut, discard, packed
from trajecta.ship import ship

LENGTH, PASSAGE, GRAM, PHRASE, LOOK = 400, 256, 32, 64, 8
#: Segments of one group in one block, and bytes of the blocks that share a suffix array.
BLOCK_SEGMENTS, BLOCK_BYTES = 2048, 1 << 19
#: Powers of two of the steps in which hot segments are split by the place of the minimizer.
STEPS = (6, 4, 2, 0)
_HIGH = B.U(0xFFFFFFFF00000000)
_LOW = B.U(0xFFFFFFFF)
_SEGMENT = "key long, block int, hot boolean, node long, start int, windows int, at int, bytes binary"
_FOUND = "kind int, node long, start int, windows int, key long, at int, bytes binary"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n = len(x) - w + 1
    pad = (-len(x)) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(run: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one minimizer: text, first window, number of windows, place of the minimizer and hash."""
    buf, starts, ends = B.lay(run)
    gram = min(GRAM, length)
    if len(buf) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    at = np.arange(len(buf) - gram + 1)
    h = B.span_hash(B.prefix_hash(buf), at, at + gram)
    low = np.arange(len(h), dtype=np.uint64)
    best = (_sliding_min((h & _HIGH) | low, length - gram + 1) & _LOW).astype(np.int64)
    n = np.maximum(ends - starts - length + 1, 0)
    p = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner, place = np.repeat(np.arange(len(run)), n), best[p]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])) if len(p) else np.zeros(0, dtype=np.int64)
    first = starts[owner[new]]
    return owner[new], p[new] - first, np.diff(np.append(new, len(p))), place[new] - first, h[place[new]]


def _reach(buf: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase borders, and for each the bytes from it on, in whole phrases of its text, that occur elsewhere too."""
    i = np.arange(max(len(buf) - LOOK + 1, 0))
    trigger = B.span_hash(prefix, i, i + LOOK) & B.U(PHRASE - 1) == 0
    cuts = np.flatnonzero(trigger)
    owner = np.searchsorted(starts, cuts, "right") - 1
    inside = cuts + LOOK <= ends[owner]
    cuts, owner = cuts[inside], owner[inside]
    inner = np.flatnonzero(owner[1:] == owner[:-1])  # phrase k: cuts[k] to cuts[k + 1] in one text
    reach = np.zeros(len(cuts), dtype=np.int64)
    if len(inner):
        names = B.span_hash(prefix, cuts[inner], cuts[inner + 1])
        _, ranks = np.unique(names, return_inverse=True)
        groups = owner[inner]
        breaks = np.concatenate([[0], np.cumsum(groups[1:] != groups[:-1])])
        text = np.full(len(inner) + breaks[-1] + 1, -1, dtype=np.int64)
        spot = np.arange(len(inner)) + breaks
        text[spot] = ranks.ravel() + breaks[-1] + 2
        gaps = np.flatnonzero(text < 0)
        text[gaps] = np.arange(1, len(gaps) + 1)  # every gap differs, so no match runs over one
        symbols = text.tolist()
        sa = suffix_array(symbols)
        lcp = np.array([*common_prefixes(symbols, sa), 0])
        longest = np.zeros(len(text), dtype=np.int64)
        longest[np.array(sa)] = np.maximum(lcp[:-1], lcp[1:])
        reach[inner] = cuts[np.minimum(inner + longest[spot], len(cuts) - 1)] - cuts[inner]
    return cuts, reach


def repeated_windows(segments: list[bytes], counts: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[np.ndarray]]:
    """Which windows of the different segments occur twice in these segments.

    ``counts``: windows of each segment, which start at its first bytes.
    Returns for each segment the number of its equal among the different ones,
    and for each length the flags of the windows of the different ones, laid
    end to end.
    """
    place: dict[bytes, int] = {}
    same = [place.setdefault(s, len(place)) for s in segments]
    run = list(place)
    copies = np.bincount(same, minlength=len(run))
    first_of = {}
    for x, j in enumerate(same):
        first_of.setdefault(j, x)
    n = np.array([counts[first_of[j]] for j in range(len(run))], dtype=np.int64)
    buf, starts, ends = B.lay(run)
    prefix = B.prefix_hash(buf)
    cuts, reach = _reach(buf, prefix, starts, ends)
    p = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    who = np.repeat(np.arange(len(run)), n)
    weight = copies[who]
    first = np.searchsorted(cuts, p)
    second = None
    out = []
    for length in lengths:
        fits = p + length <= ends[who]
        last = np.searchsorted(cuts, p + length - LOOK, "right") - 1
        bare = last <= first  # no whole phrase inside: the hash decides
        likely = bare | (weight > 1)
        if len(cuts):
            f, z = np.minimum(first, len(cuts) - 1), np.maximum(last, 0)
            likely |= ~bare & (reach[f] >= cuts[z] - cuts[f])
        look = np.flatnonzero(likely & fits)
        h = B.span_hash(prefix, p[look], p[look] + length)
        _, pick, back = np.unique(h, return_index=True, return_inverse=True)
        back = back.ravel()
        if len(pick) < len(look):  # what is equal by 64 bits is compared by 64 others
            if second is None:
                second = B.prefix_hash(buf, B.BYTE_TOO)
            h2 = B.span_hash(second, p[look], p[look] + length)
            if (h2 != h2[pick][back]).any():
                _, back = np.unique(np.stack([h, h2], 1), axis=0, return_inverse=True)
                back = back.ravel()
        hit = np.zeros(len(p), dtype=bool)
        if len(look):
            hit[look] = np.bincount(back, weights=weight[look])[back] > 1
        out.append(hit)
    return same, out


def runs_of(flag: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags within stretches that begin at ``bounds`` (the last bound is the end): stretch, first, length."""
    edge = np.zeros(len(flag) + 1, dtype=bool)
    edge[bounds] = True
    rise = np.flatnonzero(flag & np.concatenate([[True], ~flag[:-1] | edge[1:-1]])) if len(flag) else np.zeros(0, dtype=np.int64)
    fall = np.flatnonzero(flag & np.concatenate([~flag[1:] | edge[1:-1], [True]])) if len(flag) else rise
    of = np.searchsorted(bounds, rise, "right") - 1
    return of, rise - bounds[of], fall - rise + 1


def parts_of(key: int, start: int, windows: int, at: int, data: bytes, lengths: tuple[int, ...], step: int):
    """A hot segment split by the place of the minimizer in the window, in steps of ``2**step``: (key, start, windows, at, bytes).

    All windows with the minimizer at d0 <= d < d1 hold the same stretch around
    it; the stretch is the key, so equal windows have equal keys.
    """
    short, far = lengths[0], lengths[-1]
    i = 0
    while i < windows:
        q = (at - i) >> step
        d0 = q << step
        upto = min(windows, at - d0 + 1)
        shared = data[at - d0 : at - d0 + max(0, short - (1 << step) + 1)]
        new = int.from_bytes(hashlib.blake2b(b"%d %d %d " % (key, step, q) + shared, digest_size=8).digest(), "little", signed=True)
        yield new, start + i, upto - i, at - i, data[i : upto - 1 + far]
        i = upto


def merged(spans: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Byte ranges that the windows in ``spans`` (first window, windows) cover."""
    out: list[list[int]] = []
    for a, k in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + k - 1 + length)
        else:
            out.append([a, a + k - 1 + length])
    return out


def cut_out(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left without the bytes of the windows in ``spans``, with bytes and runs removed."""
    gone = merged(spans, length)
    left, at = [], 0
    for a, b in gone:
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    return b"".join(left), sum(b - a for a, b in gone), len(gone)


def _scan(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, sha, n_bytes and the minimizer hashes of every row (doc_id, text)."""
    import pyarrow as pa

    def run(batches):
        for b in B.small(batches):
            for first, part in B.slices(b.column(1).to_pylist()):
                owner, *_, h = anchors(part, length)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(part)), pa.array([hashlib.sha256(x).digest() for x in part], pa.binary()), pa.array([len(x) for x in part], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))],
                    names=["doc_id", "sha", "n_bytes", "anchors"],
                )

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("sha binary, n_bytes long, anchors array<long>").fields]))


def _segments(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Segments of the wanted minimizers from (node, z: compressed text, want: array of (h, blocks)); repeated rows side by side count once."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = names_of(_SEGMENT)

    def run(batches):
        import zstandard

        z, before = zstandard.ZstdDecompressor(), None
        for b in B.small(batches):
            got: list[tuple] = []
            size = 0
            for node, packed, want in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if node == before:
                    continue
                before, data = node, z.decompress(packed)
                blocks = {w["h"]: w["blocks"] for w in want}
                _, start, count, place, h = anchors([data], lengths[0])
                for a, k, m, x in zip(start.tolist(), count.tolist(), place.tolist(), h.view(np.int64).tolist(), strict=True):
                    if (n := blocks.get(x)) is not None:
                        piece = data[a : a + k - 1 + lengths[-1]]
                        got.append((x, (node * 0x9E3779B1 + a) % n, n > 1, node, a, k, m - a, piece))
                        size += len(piece)
                if size > 8 * B.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
                    got, size = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    return rows.select("node", "z", "want").mapInArrow(run, _SEGMENT)


def _judge(rows: DataFrame, lengths: tuple[int, ...], step: int) -> DataFrame:
    """Repeated runs of windows (kind: number of the length) from segments sorted by (key, block), and, as kind -1, the parts of hot segments."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    names = names_of(_FOUND)

    def judge(held):
        windows, node, start = (np.array([x[i] for x in held], dtype=np.int64) for i in (5, 3, 4))
        same, hits = repeated_windows([x[7] for x in held], windows.tolist(), lengths)
        same = np.array(same)
        n = np.zeros(same.max() + 1, dtype=np.int64)
        n[same] = windows
        bounds = np.concatenate([[0], np.cumsum(n)])
        cols: list[list] = [[] for _ in names]
        for kind, hit in enumerate(hits):
            of, at, k = runs_of(hit, bounds)
            low, high = np.searchsorted(of, same), np.searchsorted(of, same, "right")
            times = high - low  # every segment has the runs of the different one that it equals
            who = np.repeat(np.arange(len(held)), times)
            run = np.repeat(low, times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            for c, x in zip(cols, (np.full(len(who), kind), node[who], start[who] + at[run], k[run]), strict=False):
                c += x.tolist()
            for c in cols[4:]:
                c += [None] * len(who)
        seen = set()
        for (key, _, hot, who, first, many, at, data), j in zip(held, same.tolist(), strict=True):
            if hot and j not in seen:
                seen.add(j)
                for new, a, k, m, piece in parts_of(key, first, many, at, data, lengths, step):
                    for c, x in zip(cols, (-1, who, a, k, new, m, piece), strict=True):
                        c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        held, size, key = [], 0, None
        for b in B.small(batches, 2048):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:2] != key and size >= BLOCK_BYTES:
                    yield judge(held)
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[7])
        if held:
            yield judge(held)

    return rows.select(*names_of(_SEGMENT)).mapInArrow(run, _FOUND)


def names_of(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _spans(segments: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(node, spans: array of (kind, start, windows)) of all repeated windows; hot groups take further rounds."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def judged(rows, step):
        return cut(_judge(rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block"), lengths, step))

    found = judged(segments, STEPS[0])
    spent = [found]
    all_runs = found.where("kind >= 0").select("kind", "node", "start", "windows")
    for now, then in zip(STEPS, [*STEPS[1:], None], strict=True):
        left = found.where("kind = -1")
        many = left.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK_SEGMENTS).cast("int").alias("blocks"))
        deal = F.crc32("bytes") if now == 0 else F.xxhash64("node", "start")
        rows = left.join(many, "key").select("key", F.pmod(deal, F.col("blocks")).cast("int").alias("block"), (F.col("blocks") > 1).alias("hot"), "node", "start", "windows", "at", "bytes")
        if now == 0:
            # a part is one window now: all of a key are equal in the shortest length, and equal long ones are in one block
            all_runs = all_runs.union(rows.select(F.lit(0).alias("kind"), "node", "start", "windows"))
            rows = rows.withColumn("hot", F.lit(False))
        if left.isEmpty():
            break
        found = judged(rows, then)
        spent.append(found)
        all_runs = all_runs.union(found.where("kind >= 0").select("kind", "node", "start", "windows"))
    spans = cut(all_runs.groupBy("node").agg(F.collect_list(F.struct("kind", "start", "windows")).alias("spans")))
    discard(*spent)
    return spans


def find_repeats(docs: DataFrame, lengths: tuple[int, ...], doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, sha, n_bytes), and (sha, n_bytes, copies, rep, spans) of each text that loses something in some length.

    spans is null for a text that has copies: it is covered whole.  rep is the
    least doc_id of the text.
    """
    ship(docs.sparkSession)
    base = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = cut(_scan(base, lengths[0]))
    one = rows.where(F.col("n_bytes") >= lengths[0]).groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"))
    one = cut(one.select(F.monotonically_increasing_id().alias("node"), "*"))
    spread = one.select("node", F.explode("anchors").alias("h"))
    twice = spread.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", F.ceil(F.col("c") / BLOCK_SEGMENTS).cast("int").alias("blocks"))
    want = spread.join(twice, "h").groupBy("node").agg(F.collect_set(F.struct("h", "blocks")).alias("want"))
    want = want.join(one.select("node", "sha", "rep"), "node")
    texts = packed(base.where(F.octet_length("text") >= lengths[0]), "text")
    held = texts.join(want, (texts["__tj_sha"] == want.sha) & texts.doc_id.eqNullSafe(want.rep)).select("node", F.col("__tj_z").alias("z"), "want")
    spans = _spans(_segments(held, lengths), lengths)
    names = one.select("node", "sha", "n_bytes", "copies", "rep")
    lost = names.join(spans, "node", "left").where("copies > 1 or spans is not null")
    return rows.select("doc_id", "sha", "n_bytes"), lost.select("sha", "n_bytes", "copies", "rep", F.when(F.col("copies") == 1, F.col("spans")).alias("spans"))


def _digest(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """sha, n_removed, n_spans, kept_sha256 and n_passage from (sha, z, spans): the longest length is cut out, the shortest counted."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in B.small(batches):
            out = []
            for sha, packed, spans in zip(*[c.to_pylist() for c in b.columns], strict=True):
                of = [[(s["start"], s["windows"]) for s in spans if s["kind"] == k] for k in range(len(lengths))]
                left, removed, n = cut_out(z.decompress(packed), of[-1], lengths[-1])
                out.append((sha, removed, n, hashlib.sha256(left).hexdigest(), sum(y - x for x, y in merged(of[0], lengths[0]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["sha", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    return rows.select("sha", "z", "spans").mapInArrow(run, "sha binary, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def removed_digest(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage of every row.

    n_removed, n_spans and kept_sha256 are of strings of ``length`` bytes;
    n_passage is the number of bytes covered by strings of ``passage`` bytes
    (at most ``length``) that start elsewhere too: shorter passages that stand
    in several texts, which the length does not reach.

    Null text counts as empty; texts shorter than ``passage`` lose nothing.
    Very long texts are scanned whole.  All copies of a text are judged alike,
    repeated rows and rows with a null doc_id among them, so ties don't arise.
    An empty table gives no rows; other columns are not read.
    """
    lengths = (min(passage, length), length)
    rows, lost = find_repeats(docs, lengths, doc_id, text)
    base = docs.select(docs[doc_id].alias("d"), F.coalesce(docs[text], F.lit("")).alias("text")).where(F.octet_length("text") >= lengths[0])
    part = lost.where("spans is not null")
    texts = packed(base, "text")
    # a text without a copy is one row, so nothing meets twice
    less = _digest(texts.join(part, (texts["__tj_sha"] == part.sha) & texts.d.eqNullSafe(part.rep)).select("sha", F.col("__tj_z").alias("z"), "spans"), lengths)
    long = F.col("n_bytes") >= length
    whole = lost.where("spans is null").select("sha", F.when(long, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(long, 1).otherwise(0).cast("long").alias("n_spans"), F.when(long, F.sha2(F.lit("").cast("binary"), 256)).alias("kept_sha256"), F.col("n_bytes").alias("n_passage"))
    out = rows.join(whole.union(less), "sha", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), F.coalesce("n_passage", none).alias("n_passage"))


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of its text (characters cut in part go too); a column n_chars is counted anew.

    Every row stays.  Null and empty texts and texts shorter than ``length``
    stay as they are; a text that stands in several rows becomes empty in all
    of them, repeated rows included.  Very long texts are scanned whole.  An
    empty table gives no rows; other columns, whatever their names, pass
    through.
    """
    import pyarrow as pa

    _, lost = find_repeats(docs, (length,), doc_id, text)
    rest = [f for f in docs.schema.fields if f.name != text]
    long = F.coalesce(F.octet_length(docs[text]) >= length, F.lit(False))
    small = packed(docs.where(long), text)
    lost = lost.select(F.col("sha").alias("__tj_s"), (F.col("copies") > 1).alias("__tj_whole"), F.col("spans").alias("__tj_spans"))
    both = small.join(lost, F.col("__tj_sha") == F.col("__tj_s"), "left").select(*(small[f.name] for f in rest), "__tj_z", "__tj_whole", "__tj_spans")

    def run(batches):
        import zstandard

        z, k = zstandard.ZstdDecompressor(), len(rest)
        for b in B.small(batches):
            out = []
            for box, whole, spans in zip(*(b.column(k + i).to_pylist() for i in range(3)), strict=True):
                data = b"" if whole else z.decompress(box)
                out.append((cut_out(data, [(s["start"], s["windows"]) for s in spans], length)[0] if spans and data else data).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out, pa.string())], names=[*(f.name for f in rest), text])

    out = both.mapInArrow(run, T.StructType([*rest, docs.schema[text]]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return docs.where(~long).unionByName(out).select(docs.columns)
