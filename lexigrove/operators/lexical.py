"""A lexical index of segments, and BM25 over it for a whole set of questions.

Where a chunk is read, it joins a segment of at most `_SEGMENT` chunks. A segment is a header (ids and lengths of its
chunks) and one block of postings for each of its terms, so that a word of every chunk is spread over all segments and
no term is one task's rows.

Blocks are dealt out in groups of segments. A task holds one group, past which questions stream as lists of numbers that
stand for their phrases: all of them, or a share where there are very many. A sample of the segments is scored first and gives each question a score that its k-th
best reaches. A question then adds up the blocks of its rarer phrases; only chunks which these bring near enough to that
score are looked up in the blocks of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexigrove.functions import text as X
from lexigrove.sources.shared import publish, scratch, small_batches, spread

K1, B = 1.2, 0.75
FIELDS = ("content", "chunk_id", "source")
_SEGMENT, _SEGMENT_TERMS = 2048, 2_000_000  # a segment's chunks and terms, at most, but for one chunk
_FIRST, _SAMPLE = 3, 16  # segments that are scored to learn what a good score is: so many at least, and one of so many
_FEW = 12  # segments up to which all are scored at once
_TOGETHER = 16  # segments in a group, at most
_ASKED = 200_000  # questions that a task answers, about
_LATE = 1 / 3  # of what a question has to reach, the most that phrases which are only looked up may add
_DENSE = 32  # a phrase in one of so many chunks of a group has a row of frequencies to be looked up in
_NAMED = 2_000  # terms of a question set that are named to the scan
_SENT = 300_000  # phrases of a question set that every task gets
_FIELD = 1 << 40  # a place is field * _FIELD + position


class Index:
    """A folder of segments: rows (segment, term, n, total, at, tf, places) of blocks, and one row without a term for
    each segment, with ids and lengths. Files are sorted by term."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.rows = spark.read.parquet(path)

    @property
    def blocks(self) -> DataFrame:
        return self.rows.where("term is not null").drop("ids", "lengths")

    @property
    def headers(self) -> DataFrame:
        return self.rows.where("term is null").select("segment", "ids", "lengths")

    @property
    def lengths(self) -> DataFrame:
        """(chunk_id, doc_len) of every chunk."""
        return self.headers.select(F.explode(F.arrays_zip("ids", "lengths")).alias("c")).select(F.col("c.ids").alias("chunk_id"), F.col("c.lengths").alias("doc_len"))

    def terms(self) -> DataFrame:
        """(term, n_docs, n_total) from the blocks' counts."""
        return self.blocks.groupBy("term").agg(F.sum("n").alias("n_docs"), F.sum("total").alias("n_total"))

    def counts(self) -> DataFrame:
        """One row: chunks, their mean length, segments, and the parts that they were made in."""
        each = self.headers.select("segment", F.size("ids").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("length"))
        return each.agg(F.sum("n").cast("double").alias("n_all"), F.try_divide(F.sum("length"), F.sum("n")).alias("avgdl"), F.count("*").alias("segments"), (F.max(F.shiftright("segment", 32)) + 1).alias("parts"))


class _Segment:
    """Chunks on their way into blocks."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []  # terms of each chunk and field
        self.words: list[pa.Array] = []
        self.chunks = self.terms = 0

    def add(self, ids: pa.Array, sizes: np.ndarray, words: pa.Array) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.words.append(words)
        self.chunks += len(ids)
        self.terms += len(words)

    def rows(self, name: int, to: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids, sizes = pa.concat_arrays(self.ids), np.concatenate(self.sizes)
        lengths = sizes.sum(1)
        coded = pa.chunked_array(self.words, pa.string()).combine_chunks().dictionary_encode()
        term, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        runs = sizes.ravel()  # a chunk's fields one after the other
        start = np.cumsum(runs) - runs
        place = np.arange(len(term)) - np.repeat(start, runs) + np.repeat(np.tile(np.arange(len(FIELDS)), len(sizes)), runs) * _FIELD
        chunk = np.repeat(np.arange(len(ids)), lengths)
        order = np.argsort(term, kind="stable")  # by term, then chunk, field and position
        term, chunk, place = term[order], chunk[order], place[order]
        first = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])])
        tf = np.diff(np.r_[first, len(term)])
        of, at = term[first], chunk[first]
        block = np.flatnonzero(np.r_[len(of) > 0, of[1:] != of[:-1]])
        ends = np.r_[block, len(of)]
        total = np.add.reduceat(tf, block) if len(block) else np.zeros(0, np.int64)

        def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

        blocks = {
            "segment": pa.array(np.full(len(block), name)), "term": known.take(pa.array(of[block])), "n": pa.array(np.diff(ends)), "total": pa.array(total),
            "at": lists(ends, at, pa.int32()), "tf": lists(ends, tf, pa.int32()),
            "places": lists(np.r_[0, np.cumsum(total)], place, pa.int64()),
        }
        blank = lambda n, rows: {c: pa.nulls(rows, to.field(c).type) for c in to.names if c not in n}
        if len(block):
            whole = blocks | blank(blocks, len(block))
            yield from pa.table([whole[f.name].cast(f.type) for f in to], schema=to).to_batches(max_chunksize=20_000)
        header = {"segment": pa.array([name]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lengths": lists(np.array([0, len(ids)]), lengths, pa.int64())}
        header |= blank(header, 1)
        yield pa.RecordBatch.from_arrays([header[f.name].cast(f.type) for f in to], schema=to)


def build_index(corpus: DataFrame, path: str) -> Index:
    """corpus(chunk_id, content, source), tokenised once where it is read; nothing is shuffled. The index appears at path
    when it is whole: one that another session has put there meanwhile is kept. Its chunks are counted against the corpus's."""
    spark = corpus.sparkSession
    small_batches(spark)
    kind = corpus.schema["chunk_id"].dataType.simpleString()
    read = spread(corpus).select(F.col("chunk_id").alias("id"), *[X.index_terms(F.col(c).cast("string")).alias(f"f{i}") for i, c in enumerate(FIELDS)])
    shape = f"segment long, term string, n long, total long, at array<int>, tf array<int>, places array<long>, ids array<{kind}>, lengths array<long>"
    to = to_arrow_schema(StructType.fromDDL(shape))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, now = TaskContext.get().partitionId(), 0, _Segment()
        for batch in batches:
            step = min(128, _SEGMENT)
            for low in range(0, batch.num_rows, step):
                rows = batch.slice(low, step)
                sizes = np.stack([np.diff(rows.column(1 + i).offsets.to_numpy()) for i in range(len(FIELDS))], 1).astype(np.int64)
                if now.chunks and (now.chunks + len(sizes) > _SEGMENT or now.terms + sizes.sum() > _SEGMENT_TERMS):
                    yield from now.rows((part << 32) + done, to)
                    done, now = done + 1, _Segment()
                flat = [rows.column(1 + i).flatten() for i in range(len(FIELDS))]
                # a chunk's fields one after the other
                starts = np.stack([np.cumsum(sizes[:, i]) - sizes[:, i] for i in range(len(FIELDS))], 1) + np.array([0, len(flat[0]), len(flat[0]) + len(flat[1])])
                runs = sizes.ravel()
                take = np.repeat(starts.ravel() - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
                now.add(rows.column(0), sizes, pa.concat_arrays(flat).take(pa.array(take)))
        if now.chunks:
            yield from now.rows((part << 32) + done, to)

    def write(folder: str) -> None:
        read.mapInArrow(segments, shape).sortWithinPartitions("term").write.parquet(folder)
        found, want = Index(spark, folder).counts().first()["n_all"] or 0, corpus.count()
        if found != want:
            raise ValueError(f"the index has {found:.0f} chunks of {want}")

    publish(spark, path, write)
    return Index(spark, path)


def phrases(questions: DataFrame) -> DataFrame:
    """questions(query_id, question) to (query_id, phrase, parts): a term with - or _ inside is a phrase of its parts."""
    asked = questions.select("query_id", F.explode(X.query_terms(F.col("question"))).alias("phrase"))
    return asked.withColumn("parts", F.regexp_extract_all("phrase", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).distinct()


def _wanted(index: Index, asked: DataFrame, sent: bool = False) -> DataFrame:
    """(phrase, segment, n, at, tf): the blocks of the asked phrases; those of several terms are made from places. sent
    gives the phrases to every task, so that the index is not shuffled to meet them."""
    spark = asked.sparkSession
    named = asked.select(F.explode("parts").alias("term")).distinct().limit(_NAMED + 1).collect()  # a bounded list, else the join alone finds the blocks
    blocks = index.blocks if len(named) > _NAMED else index.blocks.where(F.col("term").isin(sorted({r["term"] for r in named})))
    met = lambda terms: blocks.join(F.broadcast(terms) if sent else terms, "term")
    single = asked.where(F.size("parts") == 1).select("phrase", F.col("parts")[0].alias("term")).distinct()
    one = met(single).select("phrase", "segment", "n", "at", "tf")
    several = asked.where(F.size("parts") > 1)
    if several.isEmpty():
        return one
    several = several.select("phrase", F.size("parts").alias("many"), F.posexplode("parts").alias("idx", "term")).distinct()
    # a place of the idx-th term, less idx, is where the phrase would start: it does where all terms agree
    spots = met(several).select("phrase", "many", "idx", "segment", F.explode(F.arrays_zip("at", "tf", F.aggregate("tf", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))).alias("from"))).alias("p"), "places")
    spots = spots.where("p.at is not null").select("phrase", "many", "idx", "segment", F.col("p.at").alias("at"), F.explode(F.slice("places", F.col("p.from") + 1, F.col("p.tf"))).alias("place"))
    whole = spots.groupBy("phrase", "many", "segment", "at", (F.col("place") - F.col("idx")).alias("start")).agg(F.count_distinct("idx").alias("hit")).where("hit = many")
    tfs = whole.groupBy("phrase", "segment", "at").agg(F.count("*").cast("int").alias("tf"))
    made = tfs.groupBy("phrase", "segment").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "tf"))).alias("held"))  # within a segment
    return one.unionByName(made.select("phrase", "segment", "n", F.col("held.at").alias("at"), F.col("held.tf").alias("tf")))


class _Held:
    """Chunks of some segments, and the postings of the phrases that are asked for. Blocks come in the order of phrases."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, allowed: np.ndarray | None, avgdl: float):
        self.ids, self.allowed = ids, allowed
        self.norm = K1 * (1 - B + B * lengths / avgdl) if avgdl else np.zeros(len(lengths))
        self.place = np.empty(len(ids), np.int64)  # of an id among all, for ties
        self.place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        self.parts: list[tuple] = []
        self.names: np.ndarray | None = None

    def block(self, phrase: str, at: np.ndarray, tf: np.ndarray) -> None:
        self.blocks(np.array([phrase]), np.array([len(at)]), at, tf)

    def blocks(self, phrases: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray) -> None:
        """Blocks one after the other, with the number of chunks in each."""
        if self.allowed is not None:
            ok = self.allowed[at]
            sizes, at, tf = np.diff(np.r_[0, np.cumsum(ok)][np.r_[0, np.cumsum(sizes)]]), at[ok], tf[ok]
        low = np.uint16 if len(self.norm) <= 1 << 16 else np.int32
        self.parts.append((phrases, sizes, at.astype(low), tf, tf * (K1 + 1) / (tf + self.norm[at])))

    def _settle(self) -> None:
        """One list of postings for each phrase, and rows of frequencies for phrases of many chunks."""
        phrases, sizes, at, tf, share = (np.concatenate(x) for x in zip(*self.parts or [(np.zeros(0, int),) * 5]))
        self.parts = []
        self.names, first = np.unique(phrases, return_index=True)
        count = np.add.reduceat(sizes, first) if len(first) else first
        start = np.r_[0, np.cumsum(count)]
        self.at, self.share, self.start = at, share, start
        self.most = np.zeros(len(count))  # the greatest share of a chunk
        full = np.flatnonzero(count)
        if len(full):
            self.most[full] = np.maximum.reduceat(share, start[full])
        self.weighed = np.zeros(len(count), bool)
        many = np.flatnonzero(count * _DENSE >= len(self.norm))
        self.row = np.full(len(count), -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), len(self.norm)), np.uint16 if not len(tf) or tf.max() < 1 << 16 else np.int32)
        for k, p in enumerate(many):
            self.rows[k, at[start[p] : start[p + 1]]] = tf[start[p] : start[p + 1]]

    def best(self, asks: pa.ListArray, least: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """asks holds the phrases and weights of several questions, least what each has to reach or not a number: for each
        question with any, its place, and places and scores of its best chunks, ties to the smaller id. A phrase has one
        weight in all questions. Its shares are added in the order of the question's phrases, so sums are the same in
        any company."""
        if self.names is None:
            self._settle()
        phrase, idf = (c.to_numpy(zero_copy_only=False) for c in asks.flatten().flatten())
        who = np.repeat(np.arange(len(asks)), np.diff(asks.offsets.to_numpy()))
        slot = np.minimum(np.searchsorted(self.names, phrase), len(self.names) - 1)
        there = self.names[slot] == phrase if len(self.names) else np.zeros(len(phrase), bool)
        who, slot, idf = who[there], slot[there], idf[there]
        each, where, which = np.unique(slot, return_index=True, return_inverse=True)
        low, high = self.start[each].tolist(), self.start[each + 1].tolist()
        for a, b, w, done in zip(low, high, idf[where], self.weighed[each]):
            if not done:
                self.share[a:b] *= w
        self.weighed[each] = True
        ats, shares, which = [self.at[a:b] for a, b in zip(low, high)], [self.share[a:b] for a, b in zip(low, high)], which.tolist()

        first = np.searchsorted(who, np.arange(len(asks) + 1))
        summed = np.r_[0, np.cumsum(idf * self.most[slot])]
        rest = np.r_[summed[first[1:]][who] - summed[:-1], 0]  # what a phrase and those after it can add
        late = (self.row[slot] >= 0) & (rest[:-1] <= np.nan_to_num(least * _LATE, nan=-1)[who])
        cut = first[:-1].copy()  # the first phrase that is only looked up
        cut[who[~late]] = np.flatnonzero(~late) + 1  # the last one holds
        bar = least - np.where(cut < first[1:], rest[cut], 0) - 0.00001
        got: list[tuple] = []
        for i, (a, b) in enumerate(zip(first.tolist(), cut.tolist())):
            if a == b:
                continue
            own = which[a:b]
            total = np.bincount(np.concatenate([ats[p] for p in own], dtype=np.intp), np.concatenate([shares[p] for p in own]), len(self.norm))
            at = np.flatnonzero(total >= bar[i] if bar[i] > 0 else total)
            if bar[i] != bar[i] and len(at) > top:
                some = total[at]
                at = at[some >= np.partition(some, len(at) - top)[len(at) - top] - 0.00001]
            if len(at):
                got.append((np.full(len(at), i), at, total[at]))
        if not got:
            return
        of, at, score = (np.concatenate(x) for x in zip(*got))
        for k in range(int((first[1:] - cut).max())):
            j = cut[of] + k
            going = j < first[of + 1]
            near = ~going | (score >= least[of] - rest[np.minimum(j, len(rest) - 1)] - 0.00001)
            of, at, score, j, going = of[near], at[near], score[near], j[near], going[near]
            j, held = j[going], at[going]
            tf = self.rows[self.row[slot[j]], held].astype(np.float64)
            score[going] += tf * (K1 + 1) / (tf + self.norm[held]) * idf[j]
        score = np.round(score, 6)
        reached = ~(score < least[of])
        of, at, score = of[reached], at[reached], score[reached]
        order = np.lexsort((self.place[at], -score, of))
        of, at, score = of[order], at[order], score[order]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else []
        for a, b in zip(edge, edge[1:]):
            yield int(of[a]), at[a : min(b, a + top)], score[a : min(b, a + top)]


def bm25(corpus: DataFrame | Index, questions: DataFrame, top: int = 10, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): lower scores are better. corpus is a table or its index.

    keep (chunk_id) leaves only these chunks as results; the statistics remain those of the corpus. A question without
    a term that is there has no results. Ties go to the smaller chunk_id.
    """
    spark = questions.sparkSession
    small_batches(spark)
    work = scratch(spark, "bm25")
    if isinstance(corpus, DataFrame):
        corpus = build_index(corpus, f"{work}/index")
    n_all, avgdl, segments, parts = corpus.counts().first()
    n_all, avgdl, parts = n_all or 0.0, avgdl or 0.0, parts or 1
    saved = lambda df, name: (df.write.parquet(f"{work}/{name}"), spark.read.schema(df.schema).parquet(f"{work}/{name}"))[1]

    asked = saved(phrases(questions), "asked")
    told = saved(asked.select("phrase", "parts").distinct().withColumn("id", F.monotonically_increasing_id()), "phrases")
    deals, many, several = told.agg(F.max(F.shiftright("id", 33)), F.count("*"), F.count_if(F.size("parts") > 1)).first()
    # a phrase's number: its place in its part of the table, then the part
    number = F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) * F.lit((deals or 0) + 1) + F.shiftright("id", 33)
    told = told.select("phrase", "parts", number.cast("int").alias("number"))
    sent = many <= _SENT
    blocks = _wanted(corpus, told.select(F.col("number").alias("phrase"), "parts"), sent)
    if several or not sent:
        blocks = saved(blocks, "blocks")
    idf = F.log((F.lit(n_all) - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    spreads = blocks.groupBy(F.col("phrase").alias("number")).agg(F.sum("n").cast("double").alias("n_docs")).select("number", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    terms = saved(told.join(spreads, "number").select("phrase", "number", "idf"), "terms")
    # a question's own terms, the rarest first
    own = F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("by"), "phrase", "number")))
    lists = saved(asked.select("query_id", "phrase").join(terms, "phrase").groupBy("query_id").agg(own.alias("own")).select("query_id", F.col("own.number").alias("asks")), "lists")

    shares = max(1, -(-lists.count() // _ASKED))
    headers = corpus.headers
    if keep is not None:
        each = headers.select("segment", F.posexplode("ids").alias("at", "chunk_id"))
        allowed = each.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("segment").agg(F.collect_list("at").alias("allowed"))  # within a segment
        headers = headers.join(allowed, "segment").select("segment", "ids", "lengths", "allowed")
    else:
        headers = headers.withColumn("allowed", F.lit(None).cast("array<int>"))
    weights = terms.select(F.col("number").alias("phrase"), "idf")
    weighed = blocks.join(F.broadcast(weights) if sent else weights, "phrase").select("phrase", "idf", "segment", "at", "tf")
    held = headers.withColumn("role", F.lit(0)).unionByName(weighed.withColumn("role", F.lit(1)), allowMissingColumns=True)
    # a segment's place: the first ones of all parts, then the second ones
    held = held.withColumn("place", F.col("segment").bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(parts) + F.shiftright("segment", 32))
    ask_kind, id_kind = questions.schema["query_id"].dataType.simpleString(), corpus.rows.schema["ids"].dataType.elementType.simpleString()
    shape = f"query_id {ask_kind}, chunk_id {id_kind}, score double"
    to = to_arrow_schema(StructType.fromDDL(shape))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, named, now = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "role")], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if len(keys) else []
            for low, high in zip(edges, edges[1:]):  # rows of one group and role
                part, role = batch.slice(low, high - low), keys[low, 1]
                if keys[low, 0] != group:
                    group, heads, named, now = keys[low, 0], [], [], None
                if role == 0:
                    heads.append(part.select(["segment", "ids", "lengths", "allowed"]))
                    continue
                if now is None and heads:
                    head = pa.Table.from_batches(heads).combine_chunks()
                    sizes = pc.list_value_length(head["ids"]).to_numpy()
                    starts = np.cumsum(sizes) - sizes
                    order = np.argsort(head["segment"].to_numpy())
                    from_segment, from_start = head["segment"].to_numpy()[order], starts[order]
                    allowed = None
                    if head["allowed"].null_count < len(head):
                        allowed = np.zeros(sizes.sum(), bool)
                        allowed[np.concatenate([start + x.values.to_numpy() for start, x in zip(starts, head["allowed"])])] = True
                    now = _Held(head["ids"].chunk(0).flatten(), head["lengths"].chunk(0).flatten().to_numpy(), allowed, avgdl)
                if now is None:
                    continue
                if role == 1:
                    segment, at, tf = part.column("segment").to_numpy(), part.column("at"), part.column("tf")
                    where = np.searchsorted(from_segment, segment)
                    where[where == len(from_segment)] = 0
                    ok = from_segment[where] == segment
                    if not ok.all():  # none of the segment's chunks is to be kept
                        chosen = pa.array(np.flatnonzero(ok))
                        part, where, at, tf = part.take(chosen), where[ok], at.take(chosen), tf.take(chosen)
                    phrase, sizes = part.column("phrase").to_numpy(), pc.list_value_length(at).to_numpy()
                    named.append((phrase, part.column("idf").to_numpy()))
                    now.blocks(phrase, sizes, at.flatten().to_numpy() + np.repeat(from_start[where], sizes), tf.flatten().to_numpy())
                    continue
                if isinstance(named, list):
                    named = tuple(np.concatenate(x) for x in zip(*named or [(np.zeros(0, np.int32), np.zeros(0))]))
                asks = part.column("asks")
                offsets, numbers = asks.offsets.to_numpy(), asks.flatten().to_numpy()
                weight = np.r_[named[1], 0.0][np.searchsorted(named[0], numbers)]  # of a phrase that is not there, any
                asks = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.StructArray.from_arrays([pa.array(numbers), pa.array(weight)], ["phrase", "idf"]))
                got = list(now.best(asks, part.column("least").to_numpy(zero_copy_only=False), top))
                if got:
                    of, at, scores = zip(*got)
                    chosen = pa.array(np.repeat(of, [len(x) for x in at]))
                    out = part.column("query_id").take(chosen), now.ids.take(pa.array(np.concatenate(at))), pa.array(-np.concatenate(scores) + 0.0)
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, to)], schema=to)

    def visit(asking: DataFrame, some: int) -> DataFrame:
        """asking (query_id, asks, least) scored over the first segments. A task has a group and a share of the questions;
        headers and blocks come before questions."""
        parallel = spark.sparkContext.defaultParallelism
        groups = min(max(some, 1), parallel * -(-max(some, 1) // (_TOGETHER * parallel)))
        there = held.where(F.col("place") < some) if some < segments else held
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        there = there.select("*", every(shares).alias("share")).withColumn("group", (F.pmod("place", F.lit(groups)) * shares + F.col("share")).cast("int")).drop("place", "share")
        going = asking.select("*", every(groups).alias("of"), F.lit(2).alias("role")).withColumn("group", (F.col("of") * shares + F.pmod(F.xxhash64("query_id"), F.lit(shares))).cast("int")).drop("of")
        met = there.unionByName(going, allowMissingColumns=True)
        turn = F.shiftleft(F.col("group").cast("long"), 40) + F.shiftleft(F.col("role").cast("long"), 32) + F.coalesce("phrase", F.lit(0))  # one number, quick to sort by
        return met.repartitionById(groups * shares, "group").sortWithinPartitions(turn).mapInArrow(score, shape)

    good = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    numbered = lambda df: df.withColumn("rank", F.row_number().over(good).cast("long")).where(F.col("rank") <= top).select("query_id", "rank", "chunk_id", "score")
    anything = lists.withColumn("least", F.lit(None).cast("double"))
    if segments <= _FEW:
        return numbered(visit(anything, segments))
    found = saved(visit(anything, max(_FIRST, segments // _SAMPLE)), "first")
    least = found.withColumn("n", F.row_number().over(good)).where(F.col("n") == top).select("query_id", (-F.col("score")).alias("least"))
    return numbered(visit(lists.join(least, "query_id", "left"), segments))
