"""Substring dedup: FM-indexes over shards of the passages that may repeat, backward search over wavelet trees.

A window is `width` consecutive words. Matching every document against an index of every shard would grow with the
square of the corpus, so equal windows are brought to one shard first:

1. A window's anchor is its least hashed 8-word run; equal windows have equal anchors. Consecutive windows with one
   anchor form a segment; a document sends (anchor, segment hash, place) for each. Anchors that are hot in a sample of
   the documents are dealt by anchor and content, and equal segments of one task are one before they are dealt, so
   that no anchor and no content is one task's work.
2. Equal segments are one pattern. Its earliest holder, the owner, stands for it; in all others, every window
   starts earlier in the owner. An owner whose anchor has no other content repeats nothing.
3. The words of the other owners go to the shard of their anchor. A shard builds an FM-index (bit planes of a
   wavelet matrix over the transform, in machine words with counts), then the owners' segments are streamed past
   it: backward search from each end gives the matching statistic, the number of words before that end which the
   shard also has elsewhere. A search ends as soon as its interval has one suffix, its own. Where the statistic
   reaches `width`, the least place in the interval tells whether the window also starts earlier; runs of such
   windows are reported.
4. An anchor with very many contents (the edges of a passage that stands in a third of all documents) would make a
   shard of its own; the windows of its segments are compared by hash, with the first places aggregated before.
5. Documents take back the runs of windows and lose the words that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import Scratch, documents, join_hot, map_rows
from lexigrove.llm.near_dedup import _MULT, mix

_U = np.uint64
_RUN = 8  # words of an anchor
_CROWD = 1000  # contents of one anchor from which windows are compared by hash
_SHARD_WORDS = 150_000
_SAMPLE, _HOT, _FEW = 64, 10_000, 8  # one document in _SAMPLE names the anchors with over 1 / _HOT of its segments, and over _FEW
_NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= 64:
                    known[w] = h
            out.append(h)
        return np.array(out, _U)


def span_hashes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of x[lo:hi] for many spans, from prefix sums of a polynomial modulo 2^64."""
    n = len(x)
    power = np.full(n + 1, _U(_BASE))
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, _U(pow(_BASE, -1, 1 << 64)))
    back[0] = 1
    back = np.multiply.accumulate(back)
    prefix = np.concatenate([np.zeros(1, _U), np.add.accumulate(mix(x) * power[:n])])
    return mix((prefix[hi] - prefix[lo]) * back[lo] + (hi - lo).astype(_U))


def segments(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, first window, last window) of the runs of windows with one anchor."""
    n = len(x)
    h = x[: n - _RUN + 1] * _MULT[0]
    for j in range(1, _RUN):
        h = mix(h) + x[j : n - _RUN + 1 + j] * _MULT[j]
    h = mix(h)
    each = width - _RUN + 1
    at = np.lib.stride_tricks.sliding_window_view(h, each).argmin(1) + np.arange(n - width + 1)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:] - 1, len(at) - 1]
    return h[at[lo]], span_hashes(x, lo, hi + width), lo, hi


_SENT = ("k", "a", "s", "id", "d", "lo", "hi", "copy", "often")


def _send_segments(batches: Iterator[pa.RecordBatch], width: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments of documents. k is what they meet by: the anchor or, of a hot one, anchor and content. Of equal
    segments that are sent at once, all but the earliest are marked as copies and dealt anywhere."""
    hashed, held, size = WordHashes(), [], 0

    def pack() -> pa.RecordBatch:
        a, s, doc, d, lo, hi = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((lo, d, doc, s, a))
        a, s, doc, d, lo, hi = (c[order] for c in (a, s, doc, d, lo, hi))
        copy = np.r_[False, (a[1:] == a[:-1]) & (s[1:] == s[:-1])]
        often = np.isin(a, hot)
        k = np.where(often, mix(a ^ mix(s)), a)
        k = np.where(copy, mix(mix(doc.view(_U)) ^ d.view(_U) + lo.astype(_U)), k)
        cols = [c.view(np.int64) for c in (k, a, s)] + [doc, d, lo, hi, copy, often]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], list(_SENT))

    for batch in batches:
        for i in range(batch.num_rows):
            words = (batch.column(2)[i].as_py() or b"").split()
            if len(words) < width:
                continue
            a, s, lo, hi = segments(hashed(words), width)
            held.append((a, s, *[np.full(len(a), batch.column(c)[i].as_py(), np.int64) for c in (0, 1)], lo.astype(np.int32), hi.astype(np.int32)))
            size += len(a)
            if size > 200_000:
                yield pack()
                held, size = [], 0
    if held:
        yield pack()


class FmIndex:
    """An FM-index over integers, 0 parting texts. Suffixes are in the order of their first `depth` symbols at least,
    so intervals of up to that many symbols are right."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.size = n
        rank, step = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while step < depth:
            ahead = np.full(n, -1, np.int64)
            ahead[: n - step] = rank[step:] if step < n else ahead[:0]
            key = rank * (int(rank.max()) + 2) + ahead + 1
            order = np.argsort(key, kind="stable")
            ranked = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = ranked
            if ranked[-1] == n - 1:
                break
            step *= 2
        self.order = order.astype(np.int32)
        symbols = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        # wavelet matrix: a bit plane for each bit of a symbol, highest first, with counts before every word
        self.planes = []
        left = text[self.order - 1]
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            on = ((left >> bit) & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, bool)
            padded[:n] = on
            words = np.packbits(padded, bitorder="little").view(_U)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)])
            self.planes.append((bit, words, counts, n - int(on.sum())))
            left = np.concatenate([left[~on], left[on]])
        self.origin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, words, counts, zeros in self.planes:
            word = place >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((_U(1) << (place & 63).astype(_U)) - _U(1))).astype(np.int64)
            place = np.where((symbol >> bit) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbol, place) - self.origin[symbol]

    def matching_statistics(self, text: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end: how many symbols before it, `most` at most and none of them 0, the index has elsewhere too,
        and the interval of suffixes that begin with them. text is of the indexed texts and starts with 0."""
        length = np.zeros(len(end), np.int32)
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64)
        live = np.arange(len(end))
        for j in range(1, most + 1):
            c = text[end[live] - j]
            live, c = live[c > 0], c[c > 0]
            new_lo, new_hi = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
            shared = new_hi - new_lo > 1
            live = live[shared]
            lo[live], hi[live], length[live] = new_lo[shared], new_hi[shared], j
            if not len(live):
                break
        return length, lo, hi


def repeated_windows(ids: np.ndarray, places: np.ndarray, pieces: list[list[bytes]], width: int) -> Iterator[tuple[int, int, int]]:
    """(id, first, last) for runs of windows that also start at a smaller (id, place) in another of the pieces."""
    codes: dict[bytes, int] = {}
    text = [0]
    for words in pieces:
        text += [codes.setdefault(w, len(codes) + 1) for w in words]
        text.append(0)
    text = np.array(text, np.int32)
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[1], 1 + np.cumsum(sizes + 1)[:-1]])
    piece = np.concatenate([[0], np.repeat(np.arange(len(pieces)), sizes + 1)])
    offset = np.arange(len(text)) - starts[piece]
    place = places[piece] + offset
    order = np.lexsort((place, ids[piece]))
    same = (ids[piece][order][1:] == ids[piece][order][:-1]) & (place[order][1:] == place[order][:-1])
    rank = np.empty(len(text), np.int32)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])  # one place may lie in two segments
    index = FmIndex(text, width)
    least, gone = np.append(rank[index.order], 0), []
    ends = np.flatnonzero((offset >= width) & (offset <= sizes[piece]))
    for at in range(0, len(ends), 1 << 16):
        end = ends[at : at + (1 << 16)]
        length, lo, hi = index.matching_statistics(text, end, width)
        end, lo, hi = (x[length == width] for x in (end, lo, hi))
        if len(end):
            lo, first, which = np.unique(lo, return_index=True, return_inverse=True)  # intervals of one length are equal or apart
            low = np.minimum.reduceat(least, np.stack([lo, hi[first]], 1).ravel())[::2]
            gone.append((end - width)[low[which] < rank[end - width]])
    gone = np.concatenate(gone) if gone else np.zeros(0, np.int64)
    if len(gone):
        runs = np.flatnonzero(np.r_[True, gone[1:] != gone[:-1] + 1])
        for a, b in zip(gone[runs], gone[np.r_[runs[1:] - 1, len(gone) - 1]]):
            yield int(ids[piece[a]]), int(place[a]), int(place[b])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """(id_col, text, n_words, n_removed) for each row: the words that stay, joined by one space.

    A word goes if a window over it also starts at a smaller id, or earlier in the same document. Windows are
    judged on the input.

    Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; rows with one id,
    or none, and different texts are documents of their own, in the order of their texts' hashes; a row repeated
    as it is is one document with the first, and keeps what that keeps; a null id is larger than all others; a
    text of any length is one row; an empty table gives an empty one; columns that are not named are ignored. Ids
    are integers, and width is at least 8 words, the length of an anchor.
    """
    if width < _RUN:
        raise ValueError(f"width must be at least {_RUN}")
    scratch = Scratch(docs.sparkSession, "substrings")
    text = F.col(text_col).cast("binary")
    # (id, d) is a document: an id alone may stand for several texts
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("d"), text.alias("text"))

    send = lambda docs, hot: docs.mapInArrow(lambda b: _send_segments(b, width, hot), "k long, a long, s long, id long, d long, lo int, hi int, copy boolean, often boolean")
    # Anchors that are hot in a sample of the documents. It only settles how segments are dealt: a hot anchor's meet by
    # content, and count as several contents; the result is the same for any set of hot anchors.
    some = send(src.where(F.pmod(F.xxhash64("d", "id"), F.lit(_SAMPLE)) == 0), np.zeros(0, _U))
    counts = scratch.save(some.groupBy("a").agg(F.count("*").alias("n")), "sampled")
    least = (counts.agg(F.sum("n")).first()[0] or 0) // _HOT
    hot = np.array(sorted(r["a"] for r in counts.where(F.col("n") > max(least, _FEW)).collect()), np.int64).view(_U)  # fewer than _HOT numbers
    by = Window.partitionBy("k", "a")
    met = send(src, hot).withColumns({"before": F.lag("s").over(by.orderBy("s", "id", "d", "lo")), "low": F.min("s").over(by), "high": F.max("s").over(by), "n": F.count("*").over(by)})
    met = met.withColumn("first", F.min(F.struct("id", "d", "lo")).over(Window.partitionBy("k", "a", "s")))
    several = (F.col("low") < F.col("high")) | F.col("often")
    own = ~F.col("copy") & (F.col("first") == F.struct("id", "d", "lo"))
    met = met.select("a", "id", "d", "lo", "hi", own.alias("own"), (~F.col("before").eqNullSafe(F.col("s"))).alias("one"), several.alias("several"))
    met = scratch.save(met.where("not own or several"), "met")
    copied = met.where("not own").select("id", "d", "lo", "hi")

    owners = met.where("own and one").select("a", "id", "d", "lo", "hi")
    crowds = scratch.save(owners.groupBy("a").agg(F.count("*").alias("n")), "crowds")
    owners = join_hot(owners, crowds, ["a"], "n").withColumn("hot", F.col("n") > _CROWD)
    wanted = owners.groupBy(F.col("id").alias("own_id"), F.col("d").alias("own_d")).agg(F.collect_list(F.struct("a", "lo", "hi", "hot")).alias("want"))

    def cut(rows: Iterator[dict]) -> Iterator[tuple]:
        hashed = WordHashes()
        for row in rows:
            words = (row["text"] or b"").split()
            x = None
            for p in row["want"]:
                if not p["hot"]:
                    yield p["a"], None, row["id"], row["d"], p["lo"], b" ".join(words[p["lo"] : p["hi"] + width])
                    continue
                x = hashed(words) if x is None else x
                starts = np.arange(p["lo"], p["hi"] + 1)
                starts = starts[starts + width <= len(x)]
                for lo, w in zip(starts.tolist(), span_hashes(x, starts, starts + width).view(np.int64).tolist()):
                    yield p["a"], w, row["id"], row["d"], lo, None

    pieces = map_rows(src.join(wanted, (F.col("id") == F.col("own_id")) & (F.col("d") == F.col("own_d"))), cut, "a long, w long, id long, d long, lo int, words binary")
    pieces = scratch.save(pieces, "pieces")
    plain = pieces.where("w is null")
    shards = max(1, -(-int(plain.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // (6 * _SHARD_WORDS)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [w.split() for w in pdf["words"]]
        docs_here, doc = np.unique(pdf[["id", "d"]].to_numpy(np.int64), axis=0, return_inverse=True)
        found = np.array(list(repeated_windows(doc.ravel(), pdf["lo"].to_numpy(np.int64), words, width)), np.int64).reshape(-1, 3)
        ends = found[:, 1:].astype(np.int32)
        return pd.DataFrame({"id": docs_here[found[:, 0], 0], "d": docs_here[found[:, 0], 1], "lo": ends[:, 0], "hi": ends[:, 1]})

    matched = plain.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).select("shard", "id", "d", "lo", "words").groupBy("shard").applyInPandas(search, "id long, d long, lo int, hi int")
    windows = pieces.where("w is not null").select("a", "w", "id", "d", "lo")
    firsts = windows.groupBy(F.col("a").alias("fa"), F.col("w").alias("fw")).agg(F.min(F.struct("id", "d", "lo")).alias("first"))
    crowd = windows.join(firsts, (F.col("a") == F.col("fa")) & (F.col("w") == F.col("fw"))).where(F.struct("id", "d", "lo") > F.col("first")).select("id", "d", "lo", F.col("lo").alias("hi"))

    gone = copied.unionByName(matched).unionByName(crowd).groupBy(F.col("id").alias("gone_id"), F.col("d").alias("gone_d")).agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))

    def rebuild(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            words = (row["text"] or b"").split()
            kept, n = words, len(words)
            if row["gone"] and n >= width:
                change = np.zeros(n + 1, np.int64)
                for p in row["gone"]:
                    if p["hi"] + width <= n:
                        change[p["lo"]] += 1
                        change[p["hi"] + width] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0)]
            yield None if row["id"] == _NO_ID else row["id"], b" ".join(kept).decode("utf-8", "replace"), n, n - len(kept)

    joined = src.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("d") == F.col("gone_d")), "left").select("id", "text", "gone")
    return map_rows(joined, rebuild, "id long, text string, n_words long, n_removed long").withColumnRenamed("id", id_col)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op3_substring_dedup": r"""
WITH worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM worded WHERE len(w) >= 20),
hashed AS MATERIALIZED (SELECT doc_id, pos, md5(array_to_string(w[pos:pos+19], ' ')) AS h FROM windows),
late AS (SELECT doc_id, pos FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM late),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM worded),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM worded d LEFT JOIN kept k USING (doc_id)"""
}
