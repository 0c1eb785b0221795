"""Sources mixed to target weights, as a time-varying curriculum (problem 7).

Each source has a weight schedule over training time.  Its cumulative token
demand is the schedule's integral; inverting it turns the running token count of
the source's documents into training positions, by which all are range-sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.session import ship_package

SIZES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source_key", T.StringType()), T.StructField("n_tokens", T.LongType())])

#: Rows of one source that are put in order within one task at most, on average.
ROWS_PER_BUCKET = 20_000
#: Text handed to the tokenizer at once.
CHARS_PER_CALL = 1 << 22


def tokenizer_file(path: str | None) -> str:
    """``path``, or the byte-level vocabulary of the installed public tokenizers."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_LOADED: dict[str, object] = {}


def tokenizer(path: str | None):
    """The tiktoken encoding of a rank file, loaded once per Python worker."""
    file = tokenizer_file(path)
    if file not in _LOADED:
        import tiktoken

        try:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        except ImportError:
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[file] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[file]


def source_key(source: Column) -> Column:
    """Spellings of one source made equal: lower case, letters and digits only; null if none is left."""
    key = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]", "")
    return F.when(key != "", key)


def sizes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, source_key, n_tokens) of every document; null and empty texts have no tokens.

    Texts are tokenized whole, in batches of about four million characters, where they are read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_key(F.col(source)).alias("source_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode_ordinary_batch
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts: list[int] = []
            part: list[str] = []
            chars = 0
            for t in texts:
                part.append(t)
                chars += len(t)
                if chars > CHARS_PER_CALL:
                    counts += map(len, encode(part, num_threads=1))
                    part, chars = [], 0
            counts += map(len, encode(part, num_threads=1)) if part else ()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source_key", "n_tokens"])

    return rows.mapInArrow(run, SIZES)


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: tokens there are, wanted, and to be taken.

    ``wanted`` is target_share * budget_fraction of all tokens (documents of no
    or an unlisted source included), ``capacity`` max_repeats times the source's
    tokens, ``demand`` the lesser.  A source without documents has none.
    """
    by_source = sized.groupBy("source_key").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
    rows = targets.select("mix_id", "source", "target_share", "max_repeats", "budget_fraction", source_key(F.col("source")).alias("source_key"))
    out = rows.join(by_source, "source_key", "left").fillna(0, ["source_tokens", "n_docs"]).crossJoin(F.broadcast(total))
    out = out.withColumn("wanted", F.col("target_share") * F.col("budget_fraction") * F.col("total_tokens")).withColumn("capacity", F.col("max_repeats") * F.col("source_tokens"))
    return out.withColumn("demand", F.least(F.col("wanted"), F.col("capacity").cast("double"))).withColumn("short", F.col("capacity") < F.col("wanted"))


#: One stretch of a schedule: times, weights at its ends, shares of the demand made before and by its end.
SEGMENTS = "array<struct<t0:double,t1:double,v0:double,v1:double,c0:double,c1:double>>"


def ramp(planned: DataFrame, strength: float = 0.5) -> DataFrame:
    """The default schedule, one linear stretch.

    Weights have mean 1.  The larger a source's share within its mix, the more
    it fades (from 1 + strength to 1 - strength for the largest); the smallest
    grows by as much.  A mix of one source keeps weight 1.
    """
    rank = F.percent_rank().over(Window.partitionBy("mix_id").orderBy(F.col("target_share"), "source"))
    n = F.count(F.lit(1)).over(Window.partitionBy("mix_id"))
    tilt = F.when(n > 1, (2 * rank - 1) * strength).otherwise(0.0)
    one = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), (1 + tilt).alias("v0"), (1 - tilt).alias("v1"), F.lit(0.0).alias("c0"), F.lit(1.0).alias("c1"))
    return planned.withColumn("segments", F.array(one).cast(SEGMENTS))


def schedule(planned: DataFrame, knots: DataFrame) -> DataFrame:
    """Schedules of one's own: ``knots`` has mix_id, source, at (training time in [0, 1]) and weight (not below 0).

    Weights run linearly between knots and are level before the first and after
    the last; of several knots at one time the heaviest counts, rows with a null
    or a time outside [0, 1] are left out.  Only their course matters, as each
    source's integral is scaled to its demand.  A source without knots, or whose
    weights are all 0, has weight 1 throughout.
    """
    sound = F.col("at").between(0, 1) & (F.col("weight") >= 0)
    given = knots.where(sound).groupBy("mix_id", "source", F.col("at").cast("double").alias("at")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    own = Window.partitionBy("mix_id", "source")
    both = given.groupBy("mix_id", "source").agg(F.min(F.struct("at", "weight")).alias("a"), F.max(F.struct("at", "weight")).alias("b"))
    ends = both.select("mix_id", "source", F.inline(F.array(F.struct(F.lit(0.0).alias("at"), F.col("a.weight").alias("weight")), F.struct(F.lit(1.0).alias("at"), F.col("b.weight").alias("weight")))))
    whole = given.unionByName(ends).groupBy("mix_id", "source", "at").agg(F.max("weight").alias("weight"))
    step = own.orderBy("at")
    parts = whole.select("mix_id", "source", F.lag("at").over(step).alias("t0"), F.col("at").alias("t1"), F.lag("weight").over(step).alias("v0"), F.col("weight").alias("v1")).where(F.col("t0").isNotNull())
    area = (F.col("t1") - F.col("t0")) * (F.col("v0") + F.col("v1")) / 2
    upto = F.sum(area).over(own.orderBy("t0"))
    whole_area = F.sum(area).over(own)
    parts = parts.withColumn("c1", upto / whole_area).withColumn("c0", (upto - area) / whole_area).withColumn("all", whole_area).where((F.col("all") > 0) & (F.col("c1") > F.col("c0")))
    made = parts.groupBy("mix_id", "source").agg(F.sort_array(F.collect_list(F.struct("t0", "t1", "v0", "v1", "c0", "c1"))).cast(SEGMENTS).alias("segments"))
    level = F.array(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t0", "t1", "v0", "v1", "c0", "c1"), (0.0, 1.0, 1.0, 1.0, 0.0, 1.0))))).cast(SEGMENTS)
    return planned.join(made, ["mix_id", "source"], "left").withColumn("segments", F.coalesce("segments", level))


def position(fraction: Column, w0: Column, w1: Column) -> Column:
    """Training time t in [0, 1] by which a linear schedule has demanded ``fraction`` of its tokens.

    Solves w0 t + (w1 - w0) t^2 / 2 = fraction (w0 + w1) / 2, in the form that
    stays exact when w0 equals w1.
    """
    c = fraction * (w0 + w1)
    root = w0 + F.sqrt(F.greatest(w0 * w0 + (w1 - w0) * c, F.lit(0.0)))
    return F.when(root > 0, c / root).otherwise(0.0)


def placed(fraction: Column, segments: Column) -> Column:
    """:func:`position` under a schedule of several stretches: within the one that makes this part of the demand."""
    s = F.coalesce(F.get(F.filter(segments, lambda x: fraction < x["c1"]), 0), F.element_at(segments, -1))
    return s["t0"] + (s["t1"] - s["t0"]) * position((fraction - s["c0"]) / (s["c1"] - s["c0"]), s["v0"], s["v1"])


def select(sized: DataFrame, scheduled: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: mix_id, source, doc_id, copy_no, n_tokens, position, sorted by mix and position.

    A source's documents stand in a fixed random order; copy r of a document
    begins at r times the source's tokens plus the tokens before it, and is taken
    if it begins before the source's demand ends, so a mix overshoots by less
    than one document and never exceeds max_repeats.  Running token counts come
    from bucket sums plus an order within buckets of about ROWS_PER_BUCKET rows,
    so no source is gathered in one task.  Documents without tokens add nothing
    and are left out.
    """
    need = scheduled.where(F.col("demand") > 0)
    sources = need.groupBy("source_key").agg(F.first("n_docs").alias("n_docs"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    docs = sized.where(F.col("n_tokens") > 0).join(F.broadcast(sources), "source_key").withColumn("u", u)
    docs = docs.withColumn("bucket", F.floor(F.col("u") * (1 + F.floor(F.col("n_docs") / ROWS_PER_BUCKET)))).drop("n_docs")
    sums = docs.groupBy("source_key", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.select("source_key", "bucket", (F.sum("s").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("s")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source_key", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    ordered = docs.withColumn("inside", inside).join(before, ["source_key", "bucket"]).select("source_key", "doc_id", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))
    wanted = F.broadcast(need.select("mix_id", "source", "source_key", "source_tokens", "demand", "max_repeats", "segments"))
    # copies r = 0, 1, ... that begin before the demand ends; at most max_repeats by the demand's own bound
    last = F.least(F.ceil((F.col("demand") - F.col("start")) / F.col("source_tokens")).cast("int"), F.col("max_repeats")) - 1
    copies = ordered.join(wanted, "source_key").where(F.col("start") < F.col("demand")).withColumn("copy_no", F.explode(F.sequence(F.lit(0), last)))
    begins = F.col("copy_no") * F.col("source_tokens") + F.col("start")
    out = copies.withColumn("position", placed(begins / F.col("demand"), F.col("segments")))
    return out.select("mix_id", "source", "doc_id", "copy_no", "n_tokens", "position").orderBy("mix_id", "position", "doc_id", "copy_no")


def reached(selected: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan with what the selection holds: tokens, share of the mix, copies of the most used document."""
    got = selected.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("copy_no").alias("c"))
    size = got.groupBy("mix_id").agg(F.sum("mixed_tokens").alias("mix_tokens"))
    out = planned.join(got, ["mix_id", "source"], "left").join(size, "mix_id", "left").fillna(0, ["mixed_tokens", "mix_tokens"])
    return out.withColumn("reached_share", F.when(F.col("mix_tokens") > 0, F.col("mixed_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0))).withColumn("most_copies", F.coalesce(F.col("c") + 1, F.lit(0)))


def unmet(shares: DataFrame) -> DataFrame:
    """The rows of :func:`reached` whose source mixed fewer tokens than wanted, every copy allowed being used."""
    return shares.where(F.col("mixed_tokens") < F.col("wanted"))
