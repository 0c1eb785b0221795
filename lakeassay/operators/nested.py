"""Nested reports as related flat tables with Merkle subtree identities (problem 2).

Objects are canonicalised and hashed bottom-up, stored once per identity, and
every occurrence is kept by a parent-child bridge row with its key or ordinal.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.operators.skew import heavy_keys, salted_join
from lakeassay.session import materialize, ship_package

NODE = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField(
            "edges",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("ordinal", T.IntegerType()),
                        T.StructField("key", T.StringType()),
                        T.StructField("child_kind", T.StringType()),
                        T.StructField("child_id", T.StringType()),
                        T.StructField("scalar", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
LEAF = T.StructType([T.StructField("evidence_path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("scalar", T.StringType())])
DECODED = T.StructType([T.StructField("root_id", T.StringType()), T.StructField("leaves", T.ArrayType(LEAF))])


class _Number(str):
    """A JSON number as written."""


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|NaN|-?Infinity)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def parse(text: str):
    """JSON of any depth, as the standard parser reads it; raises ValueError.

    Slower than that parser, which recurses: for what is nested too deeply for it.
    """
    stack: list = []  # containers that are open, with the key that waits for its value
    at, state = 0, "value"  # what may come next: value, first (value or end), key, first key, colon, after
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark = m.group(1)
        if state in ("key", "first key"):
            if m.group(2):
                stack[-1][1], at = scanstring(text, at, True)
                state = "colon"
                continue
            if mark != "}" or state == "key":
                raise ValueError(f"no key at {at}")
        elif state == "colon":
            if mark != ":":
                raise ValueError(f"no colon at {at}")
            state = "value"
            continue
        elif state == "after" and mark == ",":
            state = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif state != "after" and mark in ("{", "["):
            stack.append([{} if mark == "{" else [], None])
            state = "first key" if mark == "{" else "first"
            continue
        if mark in ("}", "]") and state in ("after", "first", "first key") and stack and isinstance(stack[-1][0], dict) == (mark == "}"):
            value = stack.pop()[0]
        elif mark or state == "after":
            raise ValueError(f"unexpected mark at {at}")
        elif m.group(2):
            value, at = scanstring(text, at, True)
        else:
            value = _Number(m.group(3)) if m.group(3) else _WORDS[m.group(4)]
        if not stack:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"more text at {at}")
            return value
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        state = "after"


def decode(text: str | None):
    """The object or list that evidence text stands for, unwrapped from texts within texts; else None.

    Numbers stay as written.  Of repeated keys the last counts.  Text that is no
    JSON or holds a mere scalar gives None; depth has no limit.
    """
    value = text
    while isinstance(value, str) and not isinstance(value, _Number):  # each turn leaves a shorter text
        try:
            value = json.loads(value, parse_float=_Number, parse_int=_Number, parse_constant=_Number)
        except RecursionError:
            try:
                value = parse(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict | list) else None


def _scalar(m) -> tuple[str, str | None]:
    """Kind and text of a scalar."""
    if m is None:
        return "null", None
    if isinstance(m, bool):
        return "boolean", "true" if m else "false"
    return "number" if isinstance(m, _Number) else "text", str(m)


def leaves(value) -> list[tuple[str, str, str]]:
    """(path, kind, text) of every scalar other than null below an object or list."""
    out = []
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, m) for k, m in v.items())
        elif isinstance(v, list):
            stack.extend((f"{path}[{i}]", m) for i, m in enumerate(v))
        elif v is not None:
            out.append((path, *_scalar(v)))
    return out


def identify(value, nodes: dict[str, tuple]) -> tuple[str, int]:
    """(identity, height) of an object or list; its subtrees go into ``nodes`` once each.

    Members of objects are ordered by key, so member order makes no identity;
    the order of lists does.  Iterative: depth costs no stack.
    """
    done: list[tuple[str, int]] = []
    stack: list[tuple[object, bool]] = [(value, False)]
    while stack:
        v, ready = stack.pop()
        members = [(k, v[k]) for k in sorted(v)] if isinstance(v, dict) else list(enumerate(v))
        inner = [m for _, m in members if isinstance(m, dict | list)]
        if not ready:
            stack.append((v, True))
            stack.extend((m, False) for m in reversed(inner))
            continue
        found = iter(done[len(done) - len(inner) :]) if inner else iter(())
        edges, parts, height = [], [], 1
        for i, (k, m) in enumerate(members):
            key = k if isinstance(v, dict) else None
            if isinstance(m, dict | list):
                child, h = next(found)
                height = max(height, h + 1)
                edges.append((i, key, "object" if isinstance(m, dict) else "list", child, None))
                parts.append([key, "node", child])
            else:
                kind, text = _scalar(m)
                edges.append((i, key, kind, None, text))
                parts.append([key, kind, text])
        if inner:
            del done[len(done) - len(inner) :]
        kind = "object" if isinstance(v, dict) else "list"
        digest = hashlib.blake2b(json.dumps([kind, parts], ensure_ascii=True, separators=(",", ":")).encode(), digest_size=16).hexdigest()
        nodes.setdefault(digest, (digest, kind, height, edges))
        done.append((digest, height))
    return done[-1]


def _decoder():
    """A function over Arrow columns: evidence text to its root, and the leaves its task has not sent yet."""
    roots: set[str] = set()

    @F.arrow_udf(DECODED)
    def decoded(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for text in texts.to_pylist():
            value = decode(text) if text else None
            if value is None:
                out.append(None)
                continue
            root, _ = identify(value, {})
            below = None if root in roots else [dict(zip(LEAF.names, x)) for x in leaves(value)]
            if len(roots) < 200_000:
                roots.add(root)
            out.append({"root_id": root, "leaves": below})
        return pa.array(out, to_arrow_type(DECODED))

    return decoded


def _node_reader():
    """A function over Arrow columns: evidence text to the nodes its task has not sent yet."""
    names = [f.name for f in NODE["edges"].dataType.elementType.fields]
    seen: set[str] = set()

    @F.arrow_udf(T.ArrayType(NODE))
    def read(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for text in texts.to_pylist():
            nodes: dict[str, tuple] = {}
            identify(decode(text), nodes)
            fresh = [n for d, n in nodes.items() if d not in seen]
            if len(seen) < 200_000:
                seen.update(n[0] for n in fresh)
            out.append([{"node_id": d, "kind": k, "height": h, "edges": [dict(zip(names, e)) for e in edges]} for d, k, h, edges in fresh])
        return pa.array(out, to_arrow_type(T.ArrayType(NODE)))

    return read


def latest_delivery(reports: DataFrame) -> DataFrame:
    """One row of each report: the delivery received last, ties settled by the content's text.

    A null report_id identifies no report: such rows are left out.
    """
    rest = [c for c in reports.columns if c != "report_id"]
    body = F.struct(F.col("received_at"), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    best = reports.where(F.col("report_id").isNotNull()).groupBy("report_id").agg(F.max_by(body, F.struct(body["received_at"], body["tie"])).alias("best"))
    return best.select("report_id", *[F.col("best.row").getField(c).alias(c) for c in rest])


def row_identity(*columns: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 32)


class Flattened:
    """The related tables of nested reports.  Keys: report_id; module_no; flag_no; node_id.

    Positions count null elements; a null element gives a row without content.
    ``module_rows`` and ``flag_rows`` hold what the reports say.  ``modules``
    and ``flags`` add the identity of their subtree (``node_id``), flags that of
    their decoded evidence (``root_id``, null if the evidence is null, no JSON
    or a scalar).  ``module_objects`` and ``flag_objects`` store each distinct
    one once; ``modules`` and ``flags`` are the bridge rows to them.  ``nodes``
    stores each distinct object or list of the evidence once, ``bridges`` each
    of its members: parent_id, ordinal, key (null in lists), child_kind, and
    child_id of an object or list or the scalar itself.  ``roots`` gives the
    scalars below each distinct evidence.  Extra columns of the reports stay in
    ``reports``.  Tables are made when first asked for; evidence is decoded once.
    """

    def __init__(self, reports: DataFrame):
        ship_package(reports.sparkSession)
        self.chosen = latest_delivery(reports)

    @property
    def reports(self) -> DataFrame:
        return self.chosen.withColumn("n_modules", F.greatest(F.coalesce(F.size("module_results"), F.lit(0)), F.lit(0))).drop("module_results")

    @property
    def module_rows(self) -> DataFrame:
        m = self.chosen.select("report_id", F.posexplode("module_results").alias("module_no", "m"))
        n_flags = F.greatest(F.coalesce(F.size("m.flags"), F.lit(0)), F.lit(0)).cast("long")
        return m.select("report_id", "module_no", *[F.col(f"m.{n}").alias(n) for n in MODULE_FIELDS], n_flags.alias("n_flags"))

    @property
    def _raw_flags(self) -> DataFrame:
        m = self.chosen.select("report_id", F.posexplode("module_results").alias("module_no", "m"))
        return m.select("report_id", "module_no", F.posexplode("m.flags").alias("flag_no", "f"))

    @property
    def flag_rows(self) -> DataFrame:
        return self._raw_flags.select("report_id", "module_no", "flag_no", *[F.col(f"f.{n}").alias(n) for n in FLAG_FIELDS], F.col("f.evidence").alias("evidence"))

    @cached_property
    def decoded(self) -> DataFrame:
        """Each flag with its decoded evidence beside it, so that no text is shuffled.

        Leaves that a task meets again it sends once; the rest of the copies
        meet at the grouping of roots.
        """
        return materialize(self._raw_flags.withColumn("d", _decoder()(F.col("f.evidence"))), "decoded")

    @property
    def flags(self) -> DataFrame:
        out = self.decoded.select("report_id", "module_no", "flag_no", *[F.col(f"f.{n}").alias(n) for n in FLAG_FIELDS], F.col("f.evidence").alias("evidence"), F.col("d.root_id").alias("root_id"))
        # the evidence counts by its identity where it has one, else by its text
        return out.withColumn("node_id", row_identity(*FLAG_FIELDS, F.coalesce("root_id", "evidence").alias("evidence")))

    @property
    def modules(self) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("flag_no", "node_id"))), lambda x: x["node_id"])
        below = self.flags.groupBy("report_id", "module_no").agg(F.sha2(F.concat_ws(",", ordered), 256).alias("flags_id"))
        out = self.module_rows.join(below, ["report_id", "module_no"], "left")
        return out.withColumn("node_id", row_identity(*MODULE_FIELDS, "flags_id")).drop("flags_id")

    @property
    def flag_objects(self) -> DataFrame:
        """Each distinct flag once, with the number of its occurrences."""
        return _distinct(self.flags, [*FLAG_FIELDS, "root_id"])

    @property
    def module_objects(self) -> DataFrame:
        """Each distinct module result once, with the number of its occurrences."""
        return _distinct(self.modules, [*MODULE_FIELDS, "n_flags"])

    @cached_property
    def _stored(self) -> DataFrame:
        # one text of each distinct evidence is taken apart; objects that several share meet at the grouping
        texts = self.decoded.where(F.col("d.root_id").isNotNull()).groupBy("d.root_id").agg(F.first("f.evidence").alias("evidence"))
        stored = texts.select(F.explode(_node_reader()(F.col("evidence"))).alias("n")).groupBy("n.node_id").agg(F.first("n").alias("n"))
        return materialize(stored.select("n.node_id", "n.kind", "n.height", "n.edges"), "nodes")

    @property
    def nodes(self) -> DataFrame:
        return self._stored.select("node_id", "kind", "height", F.size("edges").alias("n_members"))

    @property
    def bridges(self) -> DataFrame:
        return self._stored.select(F.col("node_id").alias("parent_id"), F.inline("edges"))

    @property
    def roots(self) -> DataFrame:
        """(root_id, leaves): the scalars below each distinct evidence, once however often it occurs."""
        return self.decoded.where(F.col("d.leaves").isNotNull()).groupBy(F.col("d.root_id").alias("root_id")).agg(F.first("d.leaves").alias("leaves"))


#: Scalar fields of a module result and of a flag.
MODULE_FIELDS = ["module_name", "coverage_statement", "access_mode_used"]
FLAG_FIELDS = ["module_name", "id", "reason", "confidence", "severity", "affected_asset", "recommended_disposition"]


def _distinct(rows: DataFrame, content: list[str]) -> DataFrame:
    return rows.groupBy("node_id").agg(*(F.first(c).alias(c) for c in content), F.count(F.lit(1)).alias("n_occurrences"))


def flatten(reports: DataFrame) -> Flattened:
    """Reports, modules, flags and evidence as related tables; of repeated deliveries the latest counts."""
    return Flattened(reports)


def occurrences(flat: Flattened) -> DataFrame:
    """Every scalar other than null at every place it occurs: report, module, flag, path, kind, value.

    The scalars of each distinct evidence, joined to the flags that have it;
    evidence that many flags share is salted.
    """
    flags = flat.decoded.where(F.col("d.root_id").isNotNull()).select("report_id", "module_no", "flag_no", F.col("d.root_id").alias("root_id"))
    hot = heavy_keys(flags, "root_id")
    met = salted_join(flags, flat.roots, "root_id", hot, F.struct("report_id", "module_no", "flag_no"))
    return met.select("report_id", "module_no", "flag_no", F.inline("leaves"))
