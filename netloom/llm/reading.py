"""Problem 10: how demanding a document is, from the words it uses.

A word's acquisition grade is the grade up to which a quarter of its graded
texts lie, once every grade counts alike; only words of some texts are known.
A document's level is a mix of quantiles of the grades of its known words, put
on the scale of the grades by a line that is fitted, for each language, on the
graded texts.

Graded texts (text, lang, grade from 0 to GRADES) are a parameter.  For a
language without any, the documents grade themselves by how long their words
are against the rest of their language.  Scripts that don't set words apart are
read in units of their own: ideographs, kana and Thai consonants with their
vowels.  There the first grade comes from how advanced the units are (kana or Thai, the
first and second level of the national character sets, others).

The language of a document is settled by its words, each of which stands for
the language in whose documents it is most frequent, so wrong labels don't
matter.

The texts are read once; their words are kept as hashes with counts, and every
later pass works on whole batches of them.  Known words are looked up in an
array that is sent to all tasks up to ``SENT_WORDS`` words (16 bytes each), and
by a join beyond; both give the same levels.

Defined results: null and empty texts and texts without letters have a null
level; a document without a known word keeps its first grade; in a pair the
higher level wins, then the longer words, then the smaller doc_id; a document
without a level loses against any other; a doc_id of several rows has its mean
level.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.skew import salted_join
from netloom.plans.materialise import materialise

GRADES = 12
KNOWN_IN = 5
#: The share of a word's texts at its acquisition grade, and the quantiles of a document's known words.
ACQUIRED = 0.25
QUANTILES = (0.5, 0.75, 0.9)
#: So many known words are sent to all tasks (64 MB); more are joined by a shuffle instead.
SENT_WORDS = 4_000_000
_UNIT = r"[\p{Han}\p{Hiragana}\p{Katakana}]|[เแโใไ]?[ก-ฮ][ะ-ฺๅ-๎]*+"
UNIT = regex.compile(_UNIT)
WORD = regex.compile(rf"{_UNIT}|[\p{{L}}\p{{M}}--[ก-๛]]+(?:['’][\p{{L}}\p{{M}}]+)*", regex.V1)
ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
#: Hashes that one worker keeps.
HASHES = 1_000_000

_BASE = "row bigint, doc_id bigint, lang string, grade double, size double, h array<bigint>, n array<int>"


def words_of(text: str) -> list[str]:
    low = text.lower()
    return ASCII_WORD.findall(low) if low.isascii() else WORD.findall(low)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def advanced(unit: str) -> int:
    """How advanced a unit of an unspaced script is: 1 kana and Thai, 2 and 3 the levels of the national sets, 4 others."""
    if not regex.match(r"\p{Han}", unit):
        return 1
    for codec, first in (("gb2312", 0xD8), ("euc_jp", 0xD0), ("big5", 0xC9)):
        try:
            return 2 if unit.encode(codec)[0] < first else 3
        except UnicodeEncodeError:
            continue
    return 4


def _language(lang: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(lang), r"^\s*([a-z]{2})", 1), F.lit("")), F.lit("und"))


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, lang, grade, text to the rows of _BASE; ``size`` is the mean word length, or minus the mean advance of unspaced units."""
    known: dict[str, int] = {}
    for batch in batches:
        keep, sizes, hs, ns, ends = [], [], [], [], [0]
        for at, text in enumerate(batch.column(4).to_pylist()):
            counts = Counter(words_of(text)) if text else None
            if not counts:
                continue
            if len(known) > HASHES:
                known.clear()
            total = sum(counts.values())
            units = 0 if text.isascii() else sum(n for w, n in counts.items() if UNIT.fullmatch(w))
            if 2 * units > total:
                sizes.append(-sum(advanced(w) * n for w, n in counts.items() if UNIT.fullmatch(w)) / units)
            else:
                sizes.append(sum(len(w) * n for w, n in counts.items()) / total)
            for w in counts:
                if (h := known.get(w)) is None:
                    h = known[w] = word_hash(w)
                hs.append(h)
            ns.extend(counts.values())
            ends.append(len(hs))
            keep.append(at)
        rows = batch.take(pa.array(keep, pa.int64()))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((hs, pa.int64()), (ns, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(sizes, pa.float64()), *lists], names=["row", "doc_id", "lang", "grade", "size", "h", "n"])


def prepared(docs: DataFrame, graded: DataFrame | None = None) -> DataFrame:
    """The words of all documents, and of the graded texts (with their grade and no doc_id), written once."""
    texts = docs.select("doc_id", _language(F.col("lang")).alias("lang"), F.lit(None).cast("double").alias("grade"), "text")
    if graded is not None:
        texts = texts.unionByName(graded.where("grade is not null").select(F.lit(None).cast("bigint").alias("doc_id"), _language(F.col("lang")).alias("lang"), F.col("grade").cast("double"), "text"))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "grade", "text")
    return materialise(texts.where("text is not null").mapInArrow(_tokenised, _BASE), "p10-words")


class Words:
    """A batch of documents with their words as flat arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.row, self.doc_id, self.grade = get("row"), get("doc_id"), get("grade")
        self.lang, self.size = np.array(get("lang").to_pylist(), dtype=object), get("size").to_numpy()
        ends = get("h").offsets.to_numpy().astype(np.int64)
        self.h = get("h").values.to_numpy()[ends[0] : ends[-1]]
        self.n = get("n").values.to_numpy()[ends[0] : ends[-1]]
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        self.docs = batch.num_rows
        self.batch = batch

    def column(self, name: str) -> np.ndarray:
        """Values of a list column that goes with the words."""
        col = self.batch.column(self.batch.schema.get_field_index(name))
        ends = col.offsets.to_numpy().astype(np.int64)
        return col.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(float)


def language_key(lang: str) -> int:
    """A number to tell the words of languages apart in one table."""
    return word_hash(f"\x00{lang}")


def _sent(table: DataFrame, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """A small table as arrays, sorted by ``key``."""
    cols = table.select("key", *names).toArrow()
    key = cols.column("key").to_numpy()
    order = np.argsort(key)
    return {n: cols.column(n).to_numpy()[order] for n in ("key", *names)}


def _find(table: dict[str, np.ndarray], key: np.ndarray, name: str) -> np.ndarray:
    """The values of keys, NaN where there is none."""
    if not len(table["key"]):
        return np.full(len(key), np.nan)
    at = np.minimum(np.searchsorted(table["key"], key), len(table["key"]) - 1)
    return np.where(table["key"][at] == key, table[name][at].astype(float), np.nan)


def _joined(base: DataFrame, table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``base`` with the list ``name`` of the values of its words, in their order; for tables too large to send."""
    each = base.select("row", "lang", F.posexplode("h").alias("pos", "h"))
    found = salted_join(each, table.select(*keys, name), keys, "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.col(name).cast("double"), F.lit(float("nan"))).alias("v")))).alias("f"))
    return base.join(found, "row").withColumn(name, F.transform("f", lambda x: x["v"])).drop("f")


def _stands_for(base: DataFrame) -> DataFrame:
    """(h, n, stands_for) of each known word: in how many documents it is, and the language in which it is most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch)
            for lang in sorted(set(w.lang)):
                h, n = np.unique(w.h[(w.lang == lang)[w.doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    seen = base.mapInArrow(count, "lang string, h bigint, n bigint").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    mass = base.groupBy("lang").agg(F.count("*").alias("docs"))
    rate = F.struct((F.col("n") / F.col("docs")).alias("rate"), "lang")
    # languages are two letters, so there are few
    return seen.where(F.col("lang") != "und").join(F.broadcast(mass), "lang").groupBy("h").agg(F.sum("n").alias("n"), F.max(rate).alias("best")).where(F.col("n") >= KNOWN_IN).select("h", "n", F.col("best.lang").alias("stands_for"))


def _vote(w: Words, codes: np.ndarray, names: list[str]) -> np.ndarray:
    """The language most of a document's known words stand for; ties go to the first name, documents without known words keep their label."""
    ok = ~np.isnan(codes)
    votes = np.bincount(w.doc[ok] * len(names) + codes[ok].astype(np.int64), weights=w.n[ok], minlength=w.docs * len(names)).reshape(w.docs, len(names)) if names else np.zeros((w.docs, 1))
    best = votes.argmax(axis=1)
    return np.array([names[b] if votes[i, b] > 0 else w.lang[i] for i, b in enumerate(best)], dtype=object)


class Reader:
    """Documents with settled languages; passes over them, by arrays sent to the tasks or by joins."""

    def __init__(self, base: DataFrame, sent_words: int) -> None:
        self.spark, self.sent_words = base.sparkSession, sent_words
        known = materialise(_stands_for(base), "p10-languages")
        names = sorted(r[0] for r in known.select("stands_for").distinct().collect())
        code = F.array_position(F.lit(names or [""]), F.col("stands_for")) - 1
        known = known.select(F.col("h"), F.col("h").alias("key"), code.cast("int").alias("code"))
        if known.count() <= sent_words:
            table = self.spark.sparkContext.broadcast(_sent(known, ("code",)))
            self.base, self.settle = base, lambda w: _vote(w, _find(table.value, w.h, "code"), names)
        else:
            voting, columns = _joined(base, known, ["h"], "code"), base.columns

            def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    w = Words(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(_vote(w, w.column("code"), names).tolist(), pa.string()) if n == "lang" else batch.column(batch.schema.get_field_index(n)) for n in columns], names=columns)

            self.base = materialise(voting.mapInArrow(settled, _BASE), "p10-settled")
            self.settle = lambda w: w.lang

    def each(self, do: Callable[[Words], Iterator[pa.RecordBatch]], schema: str, base: DataFrame | None = None) -> DataFrame:
        settle = self.settle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    w = Words(batch)
                    w.lang = settle(w)
                    yield from do(w)

        return (self.base if base is None else base).mapInArrow(run, schema)

    def with_grades(self, known: DataFrame, do: Callable[[Words, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``do`` with the acquisition grade of each word."""
        if known.count() > self.sent_words:
            return self.each(lambda w: do(w, w.column("acquired")), schema, _joined(self.base, known, ["lang", "h"], "acquired"))
        langs = {r[0] for r in known.select("lang").distinct().collect()}
        keys = {x: language_key(x) for x in langs}
        pairs = self.spark.createDataFrame(list(keys.items()) or [("", 0)], "lang string, lk bigint")
        table = self.spark.sparkContext.broadcast(_sent(known.join(F.broadcast(pairs), "lang").select(F.col("h").bitwiseXOR(F.col("lk")).alias("key"), "acquired"), ("acquired",)))

        def looked_up(w: Words) -> Iterator[pa.RecordBatch]:
            key = np.array([keys.get(x, 0) for x in w.lang], dtype=np.int64)[w.doc]
            has = np.array([x in keys for x in w.lang])[w.doc]
            return do(w, np.where(has, _find(table.value, w.h ^ key, "acquired"), np.nan))

        return self.each(looked_up, schema)


def word_grades(reader: Reader, cuts: dict[str, list[float]], taught: set[str]) -> tuple[DataFrame, DataFrame]:
    """(lang, h, acquired) of each known word, from the graded texts of ``taught`` languages and the documents of the others."""

    def count(w: Words) -> Iterator[pa.RecordBatch]:
        grade = _grades(w, cuts, taught)
        for lang in sorted(set(w.lang[grade >= 0])):
            mine = ((w.lang == lang) & (grade >= 0))[w.doc]
            h, at = np.unique(w.h[mine], return_inverse=True)
            cells = np.bincount(at * GRADES + grade[w.doc[mine]], minlength=len(h) * GRADES)
            full = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(h[full // GRADES]), pa.array((full % GRADES).astype(np.int32)), pa.array(cells[full].astype(np.int64))], names=["lang", "h", "grade", "n"])

    def docs(w: Words) -> Iterator[pa.RecordBatch]:
        grade = _grades(w, cuts, taught)
        few = Counter(zip(w.lang[grade >= 0], grade[grade >= 0].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in few], pa.string()), pa.array([k[1] for k in few], pa.int32()), pa.array(list(few.values()), pa.int64())], names=["lang", "grade", "docs"])

    seen = reader.each(count, "lang string, h bigint, grade int, n bigint").groupBy("lang", "h", "grade").agg(F.sum("n").alias("n"))
    mass = reader.each(docs, "lang string, grade int, docs bigint").groupBy("lang", "grade").agg(F.sum("docs").alias("docs"))
    rated = seen.join(F.broadcast(mass), ["lang", "grade"])
    per = rated.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("grade", (F.col("n") / F.col("docs")).alias("rate")))).alias("dist"))
    per = per.where(F.col("n") >= KNOWN_IN).withColumn("goal", F.aggregate("dist", F.lit(0.0), lambda a, x: a + x["rate"]) * ACQUIRED)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(a: Column, x: Column) -> Column:
        now = a["sum"] + x["rate"]
        inside = x["grade"] + (F.col("goal") - a["sum"]) / x["rate"]
        return F.struct(now.alias("sum"), F.coalesce(a["at"], F.when(now >= F.col("goal"), inside)).alias("at"))

    return per.select("lang", "h", F.coalesce(F.aggregate("dist", state, step)["at"], F.lit(float(GRADES))).cast("float").alias("acquired"))


def _first(w: Words, cuts: dict[str, list[float]]) -> np.ndarray:
    """Which of the equal parts of its language's documents the size of each document falls in."""
    return np.array([np.searchsorted(cuts.get(x, []), s, side="left") for x, s in zip(w.lang, np.abs(w.size))], dtype=np.int64)


def _grades(w: Words, cuts: dict[str, list[float]], taught: set[str]) -> np.ndarray:
    """The grade a text teaches: that given, or the first grade where its language has no graded texts; -1 for none."""
    given = w.grade.to_numpy(zero_copy_only=False).astype(float)
    own = np.where(np.isin(w.lang.astype(str), sorted(taught)), -1, _first(w, cuts))
    return np.where(np.isnan(given), own, np.clip(np.floor(np.nan_to_num(given)), 0, GRADES - 1)).astype(np.int64)


def _quantiles(w: Words, acquired: np.ndarray) -> np.ndarray:
    """Of each document the QUANTILES and the mean of the grades of its known words, each word as often as it occurs."""
    ok = ~np.isnan(acquired)
    order = np.lexsort((acquired[ok], w.doc[ok]))
    n = w.n[ok][order]
    grades, doc = np.repeat(acquired[ok][order], n), np.repeat(w.doc[ok][order], n)
    size = np.bincount(doc, minlength=w.docs)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.full((w.docs, len(QUANTILES) + 1), np.nan)
    full = size > 0
    for i, q in enumerate(QUANTILES):
        at = q * (size[full] - 1)
        lo = np.floor(at).astype(np.int64)
        a, b = grades[start[full] + lo], grades[start[full] + np.ceil(at).astype(np.int64)]
        out[full, i] = a + (b - a) * (at - lo)
    out[full, -1] = np.bincount(doc, weights=grades, minlength=w.docs)[full] / size[full]
    return out


def levels(docs: DataFrame, sent_words: int = SENT_WORDS, graded: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, level, size): the level runs from about 0 to GRADES and is comparable within a language; ``graded``: text, lang, grade."""
    base = prepared(docs, graded)
    reader = Reader(base, sent_words)

    def sized(w: Words) -> Iterator[pa.RecordBatch]:
        given = ~np.isnan(w.grade.to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(w.lang.tolist(), pa.string()), pa.array(np.abs(w.size)), pa.array(given)], names=["lang", "size", "given"])

    sizes = reader.each(sized, "lang string, size double, given boolean")
    # languages are two letters, so there are few
    rows = sizes.groupBy("lang").agg(F.max("given").alias("taught"), F.percentile_approx(F.when(~F.col("given"), F.col("size")), [i / GRADES for i in range(1, GRADES)], 10_000).alias("cuts")).collect()
    cuts, taught = {r["lang"]: list(r["cuts"] or []) for r in rows}, {r["lang"] for r in rows if r["taught"]}
    known = materialise(word_grades(reader, cuts, taught), "p10-known")

    def measured(w: Words, acquired: np.ndarray) -> Iterator[pa.RecordBatch]:
        q = _quantiles(w, acquired).mean(axis=1)
        given = w.grade.to_numpy(zero_copy_only=False).astype(float)
        first = _first(w, cuts).astype(float)
        anchor = np.where(np.isnan(given), np.where(np.isin(w.lang.astype(str), sorted(taught)), np.nan, first), given)
        null = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        yield pa.RecordBatch.from_arrays([w.doc_id, pa.array(np.isnan(given)), pa.array(w.lang.tolist(), pa.string()), pa.array(np.abs(w.size)), null(first), null(anchor), null(q)], names=["doc_id", "own", "lang", "size", "first", "anchor", "raw"])

    measured_ = materialise(reader.with_grades(known, measured, "doc_id bigint, own boolean, lang string, size double, first double, anchor double, raw double"), "p10-quantiles")
    return _calibrated(measured_).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.avg("level").alias("level"), F.avg("size").alias("size"))


def _calibrated(df: DataFrame) -> DataFrame:
    """``level``: ``raw`` put on the scale of the anchors by a line for each language.

    On given grades the line is the least-squares one; on first grades, which
    are a ranking, it keeps their mean and spread.
    """
    known = df.where("raw is not null and anchor is not null")
    fit = known.groupBy("lang").agg(
        F.avg("raw").alias("mx"), F.avg("anchor").alias("my"), F.stddev_pop("raw").alias("sx"), F.stddev_pop("anchor").alias("sy"), F.corr("raw", "anchor").alias("r"), F.min("own").alias("ranked")
    )
    share = F.when(F.col("ranked"), F.lit(1.0)).otherwise(F.coalesce("r", F.lit(0.0)))
    slope = F.when(F.col("sx") > 0, share * F.col("sy") / F.col("sx")).otherwise(F.lit(0.0))
    level = F.coalesce(F.col("my") + (F.col("raw") - F.col("mx")) * slope, F.col("first"))
    return df.where("own").join(F.broadcast(fit), "lang", "left").select("doc_id", "lang", "size", level.alias("level"))


def harder(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, doc_id) of the more demanding document of each pair."""
    level = levels(docs).select("doc_id", F.struct(F.coalesce("level", F.lit(-1e9)).alias("level"), F.coalesce("size", F.lit(0.0)).alias("size")).alias("rank"))
    a = level.select(F.col("doc_id").alias("doc_id_a"), F.col("rank").alias("rank_a"))
    b = level.select(F.col("doc_id").alias("doc_id_b"), F.col("rank").alias("rank_b"))
    both = pairs.select("pair_id", "doc_id_a", "doc_id_b").join(a, "doc_id_a", "left").join(b, "doc_id_b", "left")
    b_wins = F.col("rank_b").isNotNull() & (F.col("rank_a").isNull() | (F.col("rank_b") > F.col("rank_a")) | ((F.col("rank_b") == F.col("rank_a")) & (F.col("doc_id_b") < F.col("doc_id_a"))))
    return both.select("pair_id", F.when(b_wins, F.col("doc_id_b")).otherwise(F.col("doc_id_a")).alias("doc_id"))
