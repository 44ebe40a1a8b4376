"""Problem 9: mixing sources to target shares of tokens.

The size of the mix is the largest that every source can fill with its
``max_repeats``, unless a total is given; a source that can't reach its share
of a given total is used as often as it may be.  Each document of a source is
used ``floor(f)`` times, and once more for a sample drawn by the cube method:
the fractional part of f is the inclusion probability of each of its documents,
and the flight phase moves the probabilities along the null space of the
constraints (sum of tokens, number of documents) until all but two are 0 or 1.
Large documents go first, against all others of their block, so that they don't
stay for the end.  Blocks of a source fly by themselves; what each leaves is gathered and flies
again, level by level.  The last few documents are the landing problem: of all
ways to settle them, the one nearest to the wanted tokens is taken.

Defined results: null and empty texts have no tokens and are never used;
sources without a target get no share; a target without documents is reported
with no tokens; the spelling of a source doesn't matter; the same rows give the
same mix, however they are ordered or partitioned; repeated doc_ids count as
documents of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.text import plain_name
from netloom.llm.tokens import VOCABULARY, encode
from netloom.plans.materialise import materialise

#: So many copies of a document are numbered in one row.
COPIES = 1024
#: Documents of one block, which flies in one task.
BLOCK = 20_000
#: A document of more than this share of its block's wanted tokens is settled against all others.
LARGE = 1 / 500
SURE = 1e-9


def settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Settle the large documents one after another along the null space direction nearest to each alone."""
    wanted = float((p * size).sum())
    live = (p > SURE) & (p < 1 - SURE)
    for g in np.argsort(-size, kind="stable"):
        if size[g] <= LARGE * wanted or live.sum() < 3:
            return
        for _ in range(20):
            if not live[g] or live.sum() < 3:
                break
            at = np.flatnonzero(live)
            s = size[at].astype(float)
            centre = s - s.mean()
            spread = float((centre**2).sum())
            if not spread:
                return
            # e_g minus its projection on the two constraints
            u = -(1 / len(at) + centre * (size[g] - s.mean()) / spread)
            u[np.searchsorted(at, g)] += 1
            q = p[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > SURE, (1 - q) / u, np.where(u < -SURE, -q / u, np.inf)).min()
                down = np.where(u > SURE, q / u, np.where(u < -SURE, (q - 1) / u, np.inf)).min()
            if not np.isfinite(up + down) or up + down <= 0:
                break
            p[at] = q + u * (up if rng.random() < down / (up + down) else -down)
            p[p < SURE] = 0.0
            p[p > 1 - SURE] = 1.0
            live = (p > 0) & (p < 1)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities ``p`` until at most two lie between 0 and 1, keeping sum(p) and sum(p * size)."""
    p = p.astype(float).copy()
    settle_large(p, size, rng)
    open_ = rng.permutation([i for i in range(len(p)) if SURE < p[i] < 1 - SURE]).astype(int).tolist()
    window, nxt = open_[:3], 3
    draws = rng.random(len(open_) + 1)
    k = 0
    while len(window) == 3:
        a, b, c = window
        # the null space of the rows (1, 1, 1) and (size)
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for x, d in zip(window, u):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        step = up if draws[k] < down / (up + down) else -down
        k += 1
        keep = []
        for x, d in zip(window, u):
            p[x] += step * d
            if p[x] < SURE:
                p[x] = 0.0
            elif p[x] > 1 - SURE:
                p[x] = 1.0
            else:
                keep.append(x)
        while len(keep) < 3 and nxt < len(open_):
            keep.append(open_[nxt])
            nxt += 1
        window = keep
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few probabilities left as near to the wanted number of tokens as any choice of them."""
    open_ = np.flatnonzero((p > SURE) & (p < 1 - SURE))
    wanted = float((p[open_] * size[open_]).sum())
    best, gap = 0, np.inf
    for mask in range(1 << len(open_)):
        got = sum(int(size[i]) for j, i in enumerate(open_) if mask >> j & 1)
        if abs(got - wanted) < gap:
            best, gap = mask, abs(got - wanted)
    p = p.copy()
    for j, i in enumerate(open_):
        p[i] = float(best >> j & 1)
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "n_tokens", "copy"]).reset_index(drop=True)
    seed = zlib.crc32(f"{pdf.source[0]}|{pdf.block[0]}|{pdf.level[0]}".encode())
    p = flight(pdf.p.to_numpy(), pdf.n_tokens.to_numpy(), np.random.default_rng(seed))
    if pdf.final[0]:
        p = land(p, pdf.n_tokens.to_numpy())
    return pdf.assign(p=p)[["doc_id", "copy", "source", "n_tokens", "p"]]


def cube(docs: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(doc_id, copy, source, n_tokens, p) with p settled to 0 or 1; ``counts``: documents with an open p by source."""
    spark = docs.sparkSession
    schema = "doc_id bigint, copy bigint, source string, n_tokens bigint, p double"
    left, done, level = docs, None, 0
    while True:
        blocks = {s: max(1, -(-n // BLOCK)) for s, n in counts.items()}
        plan = F.broadcast(spark.createDataFrame([(s, n, n == 1) for s, n in blocks.items()] or [("", 1, True)], "source string, blocks bigint, final boolean"))
        ready = left.join(plan, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy", F.lit(level)), F.col("blocks"))).withColumn("level", F.lit(level))
        flown = materialise(ready.select("doc_id", "copy", "source", "n_tokens", "p", "block", "level", "final").groupBy("source", "block").applyInPandas(_fly, schema), f"cube-{level}")
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        left = flown.where("p > 0 and p < 1")
        counts = {r["source"]: r["n"] for r in left.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return done
        level += 1


def sizes(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, copy, source, n_tokens) of documents with tokens; ``copy`` numbers the rows that agree in all the rest, so it doesn't depend on their order.

    Equal rows are counted first; the few that repeat more than ``COPIES``
    times are spread over all tasks before they are numbered.
    """
    t = docs.select(F.struct("doc_id", plain_name(F.col("source")).alias("source")).alias("k"), "text")
    t = encode(t, key="k", path=path, count_only=True).where("n_tokens > 0").select("k.*", "n_tokens")
    each = materialise(t.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("n")), "p9-texts")
    number = lambda lo, hi: F.explode(F.sequence(lo, hi)).alias("copy")
    few = each.where(F.col("n") <= COPIES).select("doc_id", "source", "n_tokens", number(F.lit(1).cast("bigint"), F.col("n")))
    many = each.where(F.col("n") > COPIES).select("doc_id", "source", "n_tokens", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("run"))
    many = many.repartition("doc_id", "run").select("doc_id", "source", "n_tokens", number(F.col("run") * COPIES + 1, F.least(F.col("n"), (F.col("run") + 1) * COPIES)))
    return few.unionByName(many).select("doc_id", "copy", "source", "n_tokens")


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, list[tuple]]:
    """The sized documents, and (source, share, max_repeats, documents, tokens, times) of each target."""
    sized = materialise(sizes(docs), "p9-sizes")
    have = {r["source"]: (r["n"], r["tokens"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    want = {r["s"]: (r["target_share"], r["max_repeats"]) for r in targets.select(plain_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect()}
    whole = sum(w for w, _ in want.values()) or 1.0
    reach = [m * have[s][1] * whole / w for s, (w, m) in want.items() if s in have and w > 0]
    budget = total if total is not None else min(reach, default=0.0)
    rows = []
    for s, (w, m) in sorted(want.items()):
        n, tokens = have.get(s, (0, 0))
        rows.append((s, w / whole, m, n, tokens, min(float(m), w / whole * budget / tokens) if tokens else 0.0))
    return sized, rows


_PLAN = "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, times double"


def _draw(sized: DataFrame, rows: list[tuple]) -> DataFrame:
    spark = sized.sparkSession
    table = F.broadcast(spark.createDataFrame([(r[0], r[5]) for r in rows], "source string, times double"))
    docs = sized.join(table, "source").withColumn("base", F.floor(F.col("times") + SURE).cast("int"))
    docs = docs.withColumn("p", F.greatest(F.lit(0.0), F.col("times") - F.col("base"))).withColumn("p", F.when(F.col("p") > SURE, F.col("p")).otherwise(F.lit(0.0)))
    fixed = docs.where("p = 0").select("doc_id", "copy", "source", "n_tokens", F.col("base").alias("repeats"))
    counts = {r[0]: r[3] for r in rows if r[3] and r[5] + SURE - int(r[5] + SURE) > 2 * SURE}
    if not counts:
        return fixed.where("repeats > 0")
    drawn = cube(docs.where("p > 0").select("doc_id", "copy", "source", "n_tokens", "p"), counts)
    bases = F.broadcast(spark.createDataFrame([(r[0], int(r[5] + SURE)) for r in rows], "source string, base int"))
    picked = drawn.join(bases, "source").select("doc_id", "copy", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats"))
    return fixed.unionByName(picked).where("repeats > 0")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every document in the mix."""
    return _draw(*plan(docs, targets, total)).select("doc_id", "source", "n_tokens", "repeats")


def mix_report(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target: documents and tokens there are and in the mix, wanted and actual share of tokens."""
    sized, rows = plan(docs, targets, total)
    used = _draw(sized, rows).groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    table = sized.sparkSession.createDataFrame(rows, _PLAN).join(used, "source", "left").fillna(0, ["used_docs", "mix_tokens", "most_repeats"])
    whole = table.agg(F.sum("mix_tokens").alias("all"))
    share = F.when(F.col("all") > 0, F.col("mix_tokens") / F.col("all"))
    return table.join(F.broadcast(whole)).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "used_docs", "mix_tokens", "most_repeats", share.alias("actual_share"))
