"""Document fingerprints by consistent weighted sampling.

A text is a bag of word pairs weighted by their counts.  Each of K samples
draws, for every term, r ~ Gamma(2, 1), beta ~ U(0, 1) and c ~ Gamma(2, 1) from
the term's hash, quantises ln w to steps of r from beta on, and keeps the term
and step with the least ln a = ln c - r (t - beta) - r.  Two bags agree on a
sample with probability equal to their generalised Jaccard similarity,
sum min(w) / sum max(w).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import partitions, table, whole_texts
from .shingles import Words, mix, shingle_runs

SAMPLES = 64
WIDTH = 2
STEP = 512  # terms drawn at a time
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SEEDS = np.random.default_rng(4).integers(1, 1 << 63, size=4096, dtype=np.uint64)
_LOW = np.uint64((1 << 21) - 1)


def draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a-ordered value and 16-bit mark of every term (rows) in every sample (columns).

    beta * r and (1 - beta) * r of a gamma r are two independent exponentials;
    so weight 1, where t = 0, needs one of them, and a = c * u.
    """
    x = mix(terms[:, None] ^ _SEEDS[None, :samples])
    unit = np.float32(2.0**-21)
    u1 = ((x >> np.uint64(43)).astype(np.float32) + np.float32(0.5)) * unit
    u3 = (((x >> np.uint64(22)) & _LOW).astype(np.float32) + np.float32(0.5)) * unit
    u4 = ((x & _LOW).astype(np.float32) + np.float32(0.5)) * unit
    u3 *= u4
    a = np.log(u3)
    a *= u1
    np.negative(a, out=a)
    mark = ((x >> np.uint64(7)) ^ (x >> np.uint64(33))).astype(np.uint16)
    many = np.flatnonzero(weights > 1)
    if len(many):
        y = mix(x[many] + np.uint64(0x9E3779B97F4A7C15))
        e1, e2 = -np.log(u1[many]), -np.log(((y >> np.uint64(43)).astype(np.float32) + np.float32(0.5)) * unit)
        r = e1 + e2
        t = np.floor(np.log(weights[many].astype(np.float32))[:, None] / r + e2 / r)
        a[many] *= np.exp(-r * t)
        mark[many] = mix(x[many] + t.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.uint16) * (t > 0) + mark[many] * (t == 0)
    return a, mark


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The marks of the least draws; all zero for an empty bag."""
    least, best = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint16)
    for i in range(0, len(terms), STEP):
        a, mark = draws(terms[i : i + STEP], weights[i : i + STEP], samples)
        row = a.argmin(axis=0)
        low = a[row, np.arange(samples)]
        better = low < least
        least[better], best[better] = low[better], mark[row, np.arange(samples)][better]
    return best


def _bags(words: Words, texts: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    with np.errstate(over="ignore"):
        s, at = shingle_runs(*words.of(texts), width)
    return [np.unique(s[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]


def signatures(words: Words, texts: list[str], samples: int = SAMPLES, width: int = WIDTH) -> list[tuple[bool, np.ndarray]]:
    """(has terms, signature) of each text; A-Z count as lower case."""
    bags = _bags(words, [t.encode() for t in texts], width)
    with np.errstate(over="ignore"):
        return [(len(b[0]) > 0, signature(*b, samples)) for b in bags]


def likeness(a: tuple[bool, np.ndarray], b: tuple[bool, np.ndarray]) -> float:
    """Share of equal samples; two empty bags are alike, an empty and another one not."""
    if not (a[0] and b[0]):
        return float(a[0] == b[0])
    return float((a[1] == b[1]).mean())


def _text(s: tuple[bool, np.ndarray]) -> str:
    return s[1].astype(">u2").tobytes().hex() if s[0] else ""


KEY = "struct<a:boolean,b:bigint,c:bigint,d:bigint>"
#: Keys of each range that its bounds are taken from.
SAMPLED = 32


def _constant(values: list, schema: str) -> Column:
    """An array that the optimizer folds into one constant, however long it is."""
    return F.from_json(F.lit(json.dumps([dict(zip("abcd", v)) if isinstance(v, tuple) else v for v in values])), schema)


def _below(key: Column, bounds: list[tuple]) -> Column:
    """How many of the sorted bounds the key reaches: a binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    sorted_ = _constant(bounds, f"array<{KEY}>")
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(sorted_, p + s - 1) <= key, p + s).otherwise(p))


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    One exchange: rows go to ranges of (doc_id descending, null last; hash of
    the text; row), each range with a copy of the first row of the next one,
    and are read there in that order, so equal ids come by their texts' hash
    and a hot id is cut like any other; the last row's next is the first.
    Null texts count as empty, with fingerprint ''.  A text of any length
    counts whole.  A repeated row is a row of its own; other columns are not
    read, whatever their names; an empty table gives no rows.  docs must give
    the same rows in the same partitions each time, as a stored table does.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(doc.isNull().alias("a"), F.coalesce(F.bitwise_not(doc), F.lit(0)).alias("b"), F.xxhash64(text).alias("c"), F.monotonically_increasing_id().alias("d"))
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), key.alias("key"))
    keys, count = rows.select("key"), max(1, partitions(spark))
    total = keys.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    some = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 + total // (SAMPLED * count))) == 0)  # about SAMPLED rows a range, at most twice as many
    seen = sorted(tuple(r["key"]) for r in some.collect())
    bounds = sorted({seen[len(seen) * i // count] for i in range(1, count)} if seen else set())
    rows = rows.withColumn("to", _below(F.col("key"), bounds))
    firsts = {r["to"]: tuple(r["first"]) for r in rows.groupBy("to").agg(F.min("key").alias("first")).collect()}  # one row a range
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    first = F.get(_constant([firsts.get(b) for b in range(len(bounds) + 1)], f"array<{KEY}>"), F.col("to"))
    ghost = F.when(F.col("key") == first, F.get(_constant([before.get(b) for b in range(len(bounds) + 1)], "array<int>"), F.col("to")))
    copies = F.array(F.struct(F.col("to"), F.lit(0).alias("ghost")), F.struct(ghost.alias("to"), F.lit(1).alias("ghost")))
    sent = rows.select("doc_id", "text", "key", F.explode(F.filter(copies, lambda c: c["to"].isNotNull())).alias("c")).select("doc_id", "text", "key", "c.*")
    ordered = sent.repartitionById(len(bounds) + 1, F.col("to")).sortWithinPartitions("ghost", "key")

    def run(batches):
        words = Words()
        last = None  # the row whose next one is still to come, with its signature
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, texts, ghosts = (part.column(k).to_pylist() for k in (0, 1, 3))
                if 1 in ghosts:  # only the first of them is the next row
                    end = ghosts.index(1) + 1
                    ids, texts, ghosts = ids[:end], texts[:end], ghosts[:end]
                own = list(zip(ids, texts, signatures(words, texts, samples, width)))
                chain = ([last] if last else []) + own
                edited = []
                for (_, a, _), (_, b, _) in zip(chain, chain[1:]):
                    half = len(a) // 2
                    edited.append(a[: len(a) - half] + b[:half])
                out = []
                for (d, a, s), (_, _, t), e, x in zip(chain, chain[1:], signatures(words, edited, samples, width), edited):
                    out.append((d, len(a), hashlib.sha256(x.encode()).hexdigest(), _text(s), _text(e), likeness(s, e), likeness(s, t)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                last = chain[-1]
                if 1 in ghosts:
                    return

    return ordered.select("doc_id", "text", "to", "ghost").mapInArrow(run, SCHEMA)


def op4_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
