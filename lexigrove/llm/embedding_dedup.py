"""Embedding near-dedup by product quantisation.

A bounded sample of unit vectors gives coarse centroids and, from residuals, a codebook for each subspace. Every
vector is listed under its nearest centroid with its residual's codes and their error. A query probes

- its own list, and each list whose border with its own is no farther than the linking distance: a linked vector
  can lie in no other, so the probes are sufficient;
- in a list, what its table of distances to the codes puts within the linking distance plus the code's error: by
  the triangle inequality no linked vector is farther.

What is left is ranked anew by the exact cosine. Only vectors with equal labels meet. Equal vectors are one class
that counts its copies. Lists longer than a block are worked off by pairs of blocks; a pair gives, for each vector,
a number of links and the smallest member it reaches in the pair, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import Scratch, components
from lexigrove.llm.top_k import usable

_BLOCK = 1024
_SPACES, _CODES = 8, 64


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(at, x[:, d], k)
            centres[count > 0, d] = total[count > 0] / count[count > 0]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, 1) for i in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centroids and residual codebooks over unit vectors padded to a common width."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        self.width = sample.shape[1]
        self.coarse = k_means(sample, lists, seed)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [k_means(rest[:, s], _CODES, seed + 1) for s in self.spaces()]

    def spaces(self) -> list[slice]:
        step = self.width // _SPACES
        return [slice(i * step, (i + 1) * step) for i in range(_SPACES)]

    def unit(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        most = np.abs(out).max(1, initial=1e-300)[:, None]
        out /= np.maximum(most, 1e-300)
        return out / np.maximum(np.sqrt((out**2).sum(1)), 1e-300)[:, None]

    def code(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each decoded vector is from the true one."""
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, s], b) for s, b in zip(self.spaces(), self.books)], 1) if len(x) else np.zeros((0, _SPACES), np.int64)
        error = sum((((rest[:, s] - b[codes[:, j]]) ** 2).sum(1) for j, (s, b) in enumerate(zip(self.spaces(), self.books))), np.zeros(len(x)))
        return codes.astype(np.uint8), np.sqrt(error)

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each vector, the later lists whose border with its own lies within reach."""
        d2 = ((x**2).sum(1)[:, None] - 2 * x @ self.coarse.T) + (self.coarse**2).sum(1)[None, :]
        apart = np.sqrt(np.maximum(((self.coarse[at][:, None, :] - self.coarse[None, :, :]) ** 2).sum(2), 0))
        own = d2[np.arange(len(x)), at][:, None]
        near = (d2 - own <= 2 * apart * reach + 1e-9) & (np.arange(len(self.coarse))[None, :] > at[:, None])
        return [np.flatnonzero(r) for r in near]

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Table-lookup distances of queries to the decoded vectors of one list."""
        rest = x - self.coarse[which]
        total = np.zeros((len(x), len(codes)))
        for j, (s, b) in enumerate(zip(self.spaces(), self.books)):
            q = rest[:, s]
            table = (q**2).sum(1)[:, None] - 2 * q @ b.T + (b**2).sum(1)[None, :]
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def _meet(pdf: pd.DataFrame, model: Quantiser, least: float, reach: float) -> pd.DataFrame:
    """One pair of blocks of a list: queries of one against listed vectors of the other."""
    kind, i, j, which = (int(pdf[c].iloc[0]) for c in ("kind", "i", "j", "list"))
    blk, query = pdf["blk"].to_numpy(), pdf["query"].to_numpy(bool)
    left, right = (pdf[query], pdf[~query]) if kind else (pdf[blk == i], pdf[blk == j])
    if not len(left) or not len(right):
        return pd.DataFrame({"cls": [], "node": [], "links": [], "low": []})
    x, y = (model.unit(list(p["vec"])) for p in (left, right))
    codes = np.stack([np.frombuffer(c, np.uint8) for c in right["codes"]])
    maybe = model.distances(x, which, codes) <= reach + right["error"].to_numpy(float)[None, :] + 1e-9
    same = kind == 0 and i == j
    if same:
        np.fill_diagonal(maybe, False)
    at, to = np.nonzero(maybe)
    linked = np.zeros_like(maybe)
    for lo in range(0, len(at), 65536):
        a, b = at[lo : lo + 65536], to[lo : lo + 65536]
        linked[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= least
    if same:
        linked |= linked.T
    ids = [p["node"].to_numpy(np.int64) for p in (left, right)]
    low = [v.copy() for v in ids]
    far = np.iinfo(np.int64).max
    while True:  # the smallest member that each reaches inside the pair
        new_l = np.minimum(low[0], np.where(linked, low[1][None, :], far).min(1))
        new_r = np.minimum(low[1], np.where(linked, new_l[:, None], far).min(0))
        if same:
            new_l = new_r = np.minimum(new_l, new_r)
        if (new_l == low[0]).all() and (new_r == low[1]).all():
            break
        low = [new_l, new_r]
    count = [linked @ right["copies"].to_numpy(np.int64), linked.T @ left["copies"].to_numpy(np.int64)]
    sides = [(left, count[0], low[0])] if same else [(left, count[0], low[0]), (right, count[1], low[1])]
    out = pd.concat([pd.DataFrame({"cls": p["cls"], "node": p["node"], "links": c, "low": m}) for p, c, m in sides])
    return out[(out["links"] > 0)]


def dedup_embeddings(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, sample: int = 16_000, per_list: int = 512
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: links are pairs with equal labels and cosine >= least.

    The quantiser is fitted on at most `sample` distinct vectors; every vector is listed. As only equal labels meet,
    the lists are as many as the largest label needs for `per_list` vectors a list, and at most a sixteenth of the
    sample: beyond that lists grow longer, and their pairs of blocks more.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows without a label
    and rows without an id have no links and are kept, being their own component; vectors of different dimensions
    are not linked; a repeated row is linked with its repetition, and as both have the component's smallest id,
    both are kept; an empty table gives an empty one; columns that are not named are ignored. Ids are integers.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("v")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fit = usable(v) & F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    src = src.withColumn("cls", F.when(fit, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json("v")), 256)))
    rows = scratch.save(src.select("id", "cls"), "rows")
    classes = src.where("cls is not null").groupBy("cls").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("vec"))
    classes = scratch.save(classes, "classes")

    picked = classes.orderBy("cls").limit(sample).select("vec").collect()  # at most `sample` vectors
    if not picked:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    largest = classes.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n"), F.max("dim")).first()
    width = -(-largest[1] // _SPACES) * _SPACES
    blank = Quantiser.__new__(Quantiser)
    blank.width = width
    lists = max(1, min(len(picked) // 16, largest[0] // per_list))
    model = Quantiser(blank.unit([r["vec"] for r in picked]), lists)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def place(frames):
        for pdf in frames:
            x = model.unit(list(pdf["vec"]))
            at = nearest(x, model.coarse)
            codes, error = model.code(x, at)
            probes = [p for lo in range(0, len(x), 512) for p in model.probes(x[lo : lo + 512], at[lo : lo + 512], reach)]
            yield pdf.assign(home=at.astype(np.int32), probes=[p.astype(np.int32) for p in probes], codes=[c.tobytes() for c in codes], error=error)

    placed = classes.mapInPandas(place, f"cls string, node long, copies long, label {classes.schema['label'].dataType.simpleString()}, vec array<double>, home int, probes array<int>, codes binary, error double")
    placed = scratch.save(placed.withColumn("dim", F.size("vec")), "placed")
    shape = ["label", "dim", "list", "query", "cls", "node", "copies", "vec", "codes", "error"]
    home = placed.withColumns({"list": F.col("home"), "query": F.lit(False)}).select(*shape)
    away = placed.withColumns({"list": F.explode("probes"), "query": F.lit(True)}).select(*shape)
    entries = home.unionByName(away)
    key = ["label", "dim", "list"]
    counts = entries.groupBy(*key).agg(F.ceil(F.count_if(~F.col("query")) / _BLOCK).cast("int").alias("homes"), F.ceil(F.count_if("query") / _BLOCK).cast("int").alias("queries"))
    cut = entries.join(counts.where("homes > 0"), key)
    cut = cut.withColumn("blk", F.pmod(F.xxhash64("cls"), F.when(F.col("query"), F.col("queries")).otherwise(F.col("homes"))).cast("int"))
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    b = F.col("blk")
    meets = F.when(F.col("query"), F.transform(every("homes"), lambda x: pair(1, b, x))).otherwise(
        F.concat(F.transform(every("homes"), lambda x: pair(0, F.least(b, x), F.greatest(b, x))), F.transform(every("queries"), lambda x: pair(1, x, b)))
    )
    cut = cut.withColumn("meet", F.explode(meets)).select(*shape, "blk", "meet.*")
    found = cut.groupBy(*key, "kind", "i", "j").applyInPandas(lambda p: _meet(p, model, least, reach), "cls string, node long, links long, low long")
    found = scratch.save(found, "found")

    comp = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), scratch, "comp")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    full = classes.select("cls", "node", "copies").join(links, "cls", "left").join(comp, F.col("node") == F.col("id"), "left")
    full = full.select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = rows.join(full, "cls", "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op10_embedding_dedup": """
WITH RECURSIVE ok AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)"""
}
