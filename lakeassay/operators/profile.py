"""Column profiles per load: nulls, distinct values, ranges, patterns, shifts (problem 5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.session import materialize


@dataclass(frozen=True)
class Rules:
    """Limits beyond which a load's column is reported."""

    nulls: float = 0.05
    invalid: float = 0.02
    distinct: float = 0.10
    shift: float = 0.25
    pattern: float = 0.02


@dataclass(frozen=True)
class NumericColumn:
    """A column to profile: where it stands, which values are sound, its accepted shares.

    ``buckets`` are (lower, upper, expected share); equal bounds mean the value
    itself, else the lower bound is included and the upper one not, save for
    ``closed_at``, which belongs to the last bucket.
    """

    name: str
    source: str
    valid: Column
    buckets: list[tuple[float, float, float]] = field(default_factory=list)
    closed_at: float | None = None
    check_distinct: bool = True


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted names and types of all columns, fields of structs one by one."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, name + ".")
        else:
            out.append((name, f.dataType))
    return out


def unnan(c: Column, kind: T.DataType) -> Column:
    """Null in place of NaN, for minimum and maximum."""
    return F.when(~F.isnan(c), c) if isinstance(kind, T.DoubleType | T.FloatType) else c


def standard_profile(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """Per load and column: rows, nulls, exact distinct values, minimum and maximum as text.

    One scan turns each row into (load, column, value) triples that are combined
    on the map side to distinct values with counts; everything else is computed
    from those.  A hot load is spread by its values.  NaN counts as a value but
    not for minimum and maximum; a null load is a load of its own; an empty
    table gives no rows.
    """
    types = dict(leaves(df.schema))
    names = columns or [n for n in types if n.replace("`", "") != load]
    label = lambda n: n.replace("`", "").rpartition(".")[2]
    orderable = lambda n: F.col(n).cast("double") if isinstance(types[n], T.NumericType) else F.lit(None).cast("double")
    triples = df.select(
        F.col(load).alias("load_id"),
        F.inline(F.array(*[F.struct(F.lit(label(n)).alias("column_name"), F.col(n).cast("string").alias("value"), unnan(orderable(n), T.DoubleType()).alias("number")) for n in names])),
    )
    values = triples.groupBy("load_id", "column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number"))
    sums = values.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"),
        F.count("value").alias("n_distinct"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
    )
    return sums.withColumn("null_rate", F.col("n_nulls") / F.col("n_rows"))


def invalid_counts(df: DataFrame, load: str, columns: list[NumericColumn]) -> DataFrame:
    """Per load and column with a rule: values that are not null, and those of them that are not sound."""
    prof = load_profile(df, load, [replace(c, buckets=[], check_distinct=False) for c in columns])
    counts = [F.struct(F.lit(c.name).alias("column_name"), F.col(f"{c.name}__n").alias("n_values"), (F.col(f"{c.name}__n") - F.col(f"{c.name}__valid")).alias("n_invalid")) for c in columns]
    return prof.select("load_id", F.inline(F.array(*counts)))


def bucket_of(c: Column, spec: NumericColumn) -> Column:
    """Number of the bucket a value falls into, null for none."""
    out = None
    for i, (lower, upper, _) in enumerate(spec.buckets):
        inside = (c == lower) if lower == upper else (c >= lower) & (c < upper)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    if out is None:
        return F.lit(None).cast("int")
    if spec.closed_at is not None:
        out = out.when(c == spec.closed_at, len(spec.buckets) - 1)
    return out


def load_profile(df: DataFrame, load: str, columns: list[NumericColumn]) -> DataFrame:
    """One row per load: counts for the rules, all from one scan with map-side combination.

    Distinct values are estimated here (HyperLogLog, 2 % standard error); see
    :func:`issues` for the exact recount where the estimate could matter.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    read = [F.col(load).alias("load_id")]
    for c in columns:
        v = F.col(c.source)
        # the bucket of a sound value, -1 for a sound one outside all; null for no sound value: found once a row
        b = F.when(v.isNotNull() & c.valid, F.coalesce(bucket_of(v, c), F.lit(-1))).alias(f"{c.name}__bucket")
        read += [v.alias(f"{c.name}__value"), b]
        b = F.col(f"{c.name}__bucket")
        aggs += [F.count(f"{c.name}__value").alias(f"{c.name}__n"), F.count(b).alias(f"{c.name}__valid")]
        aggs += [F.count_if(b == i).alias(f"{c.name}__b{i}") for i in range(len(c.buckets))]
        if c.check_distinct:
            aggs.append(F.approx_count_distinct(f"{c.name}__value", 0.02).alias(f"{c.name}__about"))
    return df.select(*read).groupBy("load_id").agg(*aggs)


def issues(df: DataFrame, load: str, columns: list[NumericColumn], text_column: str, expression: str, rules: Rules = Rules()) -> DataFrame:
    """(load_id, column_name, issue) for each rule that a load breaks.

    Shares are of a load's rows as stored, repeated ones included.  A share over
    no values (all null, or nothing valid) breaks no rule but ``nulls``.
    """
    prof = load_profile(df, load, columns)
    found = []

    def case(name: str, issue: str, cond: Column) -> None:
        found.append(F.when(cond, F.struct(F.lit(name).alias("column_name"), F.lit(issue).alias("issue"))))

    for c in columns:
        n, valid = F.col(f"{c.name}__n"), F.col(f"{c.name}__valid")
        case(c.name, "nulls", (F.col("n_rows") - n) > rules.nulls * F.col("n_rows"))
        case(c.name, "range", (n - valid) > rules.invalid * n)
        if c.buckets:
            held = [F.col(f"{c.name}__b{i}") for i in range(len(c.buckets))]
            rest = valid
            gap = F.lit(0.0)
            for h, (_, _, expected) in zip(held, c.buckets):
                rest = rest - h
                gap = gap + F.abs(h / valid - F.lit(expected))
            case(c.name, "distribution", F.when(valid > 0, (gap + rest / valid) / 2 > rules.shift).otherwise(False))
    direct = prof.select("load_id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    per_load = described_coverage(df, load, text_column, expression)
    broken = per_load.where(F.col("n_malformed") > rules.pattern * F.col("n_values"))
    direct = direct.unionByName(broken.select("load_id", F.lit(text_column).alias("column_name"), F.lit("pattern").alias("issue")))
    # The estimate is off by a factor of two only at 25 standard errors: beyond that
    # a load cannot break the rule, below it the distinct values are counted exactly.
    counted = [c for c in columns if c.check_distinct]
    if not counted:
        return direct
    near = prof.select("load_id", F.inline(F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(f"{c.name}__n").alias("n"), F.col(f"{c.name}__about").alias("about")) for c in counted])))
    near = near.where((F.col("n") > 0) & (F.col("about") < 2 * rules.distinct * F.col("n"))).select("load_id", "column_name", "n")
    values = df.select(F.col(load).alias("load_id"), F.inline(F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(c.source).cast("double").alias("value")) for c in counted])))
    exact = values.join(near, ["load_id", "column_name"]).groupBy("load_id", "column_name", "n", "value").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("load_id", "column_name", "n").agg(F.count("value").alias("d")).where(F.col("d") < rules.distinct * F.col("n"))
    return direct.unionByName(exact.select("load_id", "column_name", F.lit("distinct").alias("issue")))


# --- expressions by minimum description length -------------------------------------------

#: The accepted form of a column's values: an expression, or a test of the value.
Declared = str | Callable[[Column], Column]

#: Bits that one character costs under each class, and one character of an expression.
BITS = {"digit": 3.33, "letter": 5.7, "any": 6.57, "expression": 6.57, "length": 6.0}


def shape_of(value: Column) -> Column:
    """The value with every digit as 0; values of one shape differ in their digits alone."""
    return F.translate(value, "123456789", "000000000")


def spellings(shape: Column) -> list[tuple[str, Column, Column]]:
    """(level, expression, bits to spell a value of the shape given the expression), from specific to general.

    ``fixed``: digits vary, all else is literal.  ``classes``: digits and letters
    vary at fixed lengths.  ``runs``: lengths vary too.
    """
    escaped = F.regexp_replace(shape, r"([^A-Za-z0-9 _/\-])", r"\\$1")
    digits = F.length(F.regexp_replace(shape, "[^0]", ""))
    letters = F.length(F.regexp_replace(shape, "[^A-Za-z]", ""))
    n_runs = F.length(F.regexp_replace(F.regexp_replace(shape, "[A-Za-z]+|0+", "\u0001"), "[^\u0001]", ""))
    # letters are replaced first, so that the d of a digit class stays whole
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, "0", "\u0001"), "[A-Za-z]", "[A-Za-z]"), "\u0001", r"\\d")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, "0+", "\u0001"), "[A-Za-z]+", "[A-Za-z]+"), "\u0001", r"\\d+")
    varied = digits * BITS["digit"] + letters * BITS["letter"]
    return [("fixed", F.regexp_replace(escaped, "0", r"\\d"), digits * BITS["digit"]), ("classes", classes, varied), ("runs", runs, varied + n_runs * BITS["length"])]


def shapes(df: DataFrame, load: str, column: str) -> DataFrame:
    """(load_id, shape, n, n_values, witness): rows of each shape in each load, and one value of it.

    One pass over the column; written to the shared folder, as all that follows
    reads it.  ``n_values`` counts each distinct value once, in one of its loads.
    Values are combined per load before they are shuffled, so none is hot.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(load).alias("load_id"), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    once = counted.groupBy("value").agg(F.collect_list(F.struct("load_id", "n")).alias("loads"))
    rows = once.select("value", shape_of(F.col("value")).alias("shape"), F.posexplode("loads").alias("at", "in"))
    per = rows.groupBy(F.col("in.load_id").alias("load_id"), "shape").agg(F.sum("in.n").alias("n"), F.count_if(F.col("at") == 0).alias("n_values"), F.min("value").alias("witness"))
    return materialize(per, "shapes")


def _conforms(value: Column, declared: Declared | None) -> Column:
    return F.lit(True) if declared is None else value.rlike(declared) if isinstance(declared, str) else declared(value)


def describe(shaped: DataFrame, declared: Declared | None = None) -> DataFrame:
    """Per shape: the expression that describes it in the fewest bits, and the verdict on it.

    Columns: shape, n_values, n_rows, level, expression, own, kept, sound.  A set
    of expressions costs their own bits plus those of the values given them;
    values without an expression are spelt out.  Levels mix within a column: one
    ``runs`` expression stands for all of its shapes if that is cheaper than
    their ``classes`` expressions, and so on down to single values (level null).
    ``own`` and ``kept`` are the bits of the values spelt out and of the
    expression with its values.  Each shape is judged once, by its witness:
    ``sound`` says that it has the ``declared`` form, which must treat all
    digits alike.
    """
    t = shaped.groupBy("shape").agg(F.sum("n_values").alias("n_values"), F.sum("n").alias("n_rows"), F.min("witness").alias("witness"))
    nv = F.col("n_values")
    t = t.select("*", (nv * (F.length("shape") * BITS["any"] + BITS["length"])).alias("own"), *[x for level, e, bits in spellings(F.col("shape")) for x in (e.alias(level), (nv * bits).alias(f"{level}_bits"))])
    t = t.withColumn("fixed_cost", F.length("fixed") * BITS["expression"] + F.col("fixed_bits"))
    t = t.withColumn("fixed_best", F.least("own", "fixed_cost"))
    below = "fixed_best"
    for level in ("classes", "runs"):
        up = [level] if level == "runs" else ["classes", "runs"]
        costs = (t if level == "classes" else mid).groupBy(*up).agg(F.sum(f"{level}_bits").alias("bits"), F.sum(below).alias(f"{level}_parts"), *([F.sum("runs_bits").alias("runs_bits")] if level == "classes" else []))
        costs = costs.withColumn(f"{level}_cost", F.length(level) * BITS["expression"] + F.col("bits")).drop("bits")
        costs = costs.withColumn(f"{level}_best", F.least(f"{level}_cost", f"{level}_parts"))
        below = f"{level}_best"
        if level == "classes":
            mid = costs
    t = t.join(mid.drop("runs_bits"), ["classes", "runs"]).join(costs, "runs")
    general = [(F.col("runs_cost") < F.col("runs_parts"), "runs"), (F.col("classes_cost") < F.col("classes_parts"), "classes"), (F.col("fixed_cost") < F.col("own"), "fixed")]
    level, expression, bits = F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("own")
    for cond, name in reversed(general):
        level, expression, bits = F.when(cond, F.lit(name)).otherwise(level), F.when(cond, F.col(name)).otherwise(expression), F.when(cond, F.col(f"{name}_bits")).otherwise(bits)
    return t.select("shape", "n_values", "n_rows", level.alias("level"), expression.alias("expression"), "own", bits.alias("kept"), F.coalesce(_conforms(F.col("witness"), declared), F.lit(False)).alias("sound"))


def _expressions(described: DataFrame) -> DataFrame:
    out = described.where(F.col("level").isNotNull()).groupBy("level", "expression")
    out = out.agg(F.sum("n_values").alias("n_values"), F.sum("n_rows").alias("n_rows"), F.sum(F.col("own") - F.col("kept")).alias("saved"), F.min("sound").alias("sound"))
    return out.select("level", "expression", "n_values", "n_rows", F.round(F.col("saved") - F.length("expression") * BITS["expression"], 2).alias("gain"), "sound")


def induce_expressions(df: DataFrame, column: str, load: str, declared: Declared | None = None, shaped: DataFrame | None = None) -> DataFrame:
    """The set of expressions that describes a text column's distinct values in the fewest bits.

    Columns: level, expression, n_values, n_rows, gain (bits saved against
    spelling the values out), sound (every shape it stands for has the
    ``declared`` form; true if none is declared).  All distinct values count;
    nulls do not.  ``shaped`` is the result of :func:`shapes`, if at hand.
    """
    return _expressions(describe(shaped if shaped is not None else shapes(df, load, column), declared))


def coverage(df: DataFrame, load: str, column: str, induced: DataFrame, declared: Declared | None = None, shaped: DataFrame | None = None) -> DataFrame:
    """Per load: values that no induced expression covers, malformed values, the change against the load before.

    Columns: load_id, n_values, n_nonconforming, n_malformed, covered, change.
    Rows are counted by shape.  Shapes under a sound expression are well formed;
    the others are malformed unless their witness has the ``declared`` form
    (without one: the nonconforming rows are malformed).
    """
    shaped = shaped if shaped is not None else shapes(df, load, column)
    each = shaped.groupBy("shape").agg(F.min("witness").alias("witness"))
    each = each.select("shape", "witness", F.inline(F.array(*[F.struct(F.lit(level).alias("level"), e.alias("expression")) for level, e, _ in spellings(F.col("shape"))])))
    hit = each.join(induced.select("level", "expression", F.lit(True).alias("known"), "sound"), ["level", "expression"], "left")
    hit = hit.groupBy("shape", "witness").agg(F.coalesce(F.max("known"), F.lit(False)).alias("known"), F.coalesce(F.max("sound"), F.lit(False)).alias("sound"))
    bad = ~F.col("known") if declared is None else ~(F.col("sound") | F.coalesce(_conforms(F.col("witness"), declared), F.lit(False)))
    counts = shaped.join(hit.select("shape", "known", bad.alias("bad")), "shape").groupBy("load_id").agg(
        F.sum("n").alias("n_values"),
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("n_nonconforming"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_malformed"),
    )
    out = counts.withColumn("covered", 1 - F.col("n_nonconforming") / F.col("n_values"))
    # one row per load: the window is as small as the list of loads
    return out.withColumn("change", F.col("covered") - F.lag("covered").over(Window.orderBy("load_id")))


def described_coverage(df: DataFrame, load: str, column: str, declared: Declared | None = None) -> DataFrame:
    """:func:`coverage` by the column's own expressions, its shapes read once."""
    shaped = shapes(df, load, column)
    return coverage(df, load, column, induce_expressions(df, column, load, declared, shaped), declared, shaped)


def text_columns(df: DataFrame, load: str) -> list[str]:
    """The text columns beside the load, fields of structs included."""
    return [n for n, t in leaves(df.schema) if isinstance(t, T.StringType) and n.replace("`", "") != load]


def _per_text_column(df: DataFrame, load: str, describe: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What ``describe`` says of each text column, one below the other; each reads its own column only."""
    parts = []
    for n in text_columns(df, load):
        name = n.replace("`", "").rpartition(".")[2]
        parts.append(describe(df.select(F.col(load).alias(load), F.col(n).alias(name)), name).withColumn("column_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def all_expressions(df: DataFrame, load: str, declared: dict[str, Declared]) -> DataFrame:
    """:func:`induce_expressions` of every text column, with ``column_name``; ``declared`` by name where there is a form."""
    return _per_text_column(df, load, lambda d, name: induce_expressions(d, name, load, declared.get(name)))


def all_coverage(df: DataFrame, load: str, declared: dict[str, Declared]) -> DataFrame:
    """:func:`coverage` of every text column by its own expressions, with ``column_name``."""
    return _per_text_column(df, load, lambda d, name: described_coverage(d, load, name, declared.get(name)))
