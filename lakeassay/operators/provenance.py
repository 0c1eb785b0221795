"""Content hashes, signed bundles and hash-chained logs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeassay.operators import ed25519
from lakeassay.schemas import flags
from lakeassay.session import ship_package

#: Fixed value: what the first record names as its predecessor's hash.
GENESIS = "0" * 64
CHAIN = T.StructType([T.StructField("chain_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("record_hash", T.StringType())])

# --- hashing ---------------------------------------------------------------------------


def canonical_json(value) -> str:
    """Sorted keys, no blanks, other types as their text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def hash_file(path: str) -> str:
    """SHA-256 of one file of any size, read in pieces."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 16):
            digest.update(piece)
    return digest.hexdigest()


def hash_config(config: dict | str) -> str:
    """SHA-256 of a configuration: of a dict's canonical JSON, or of the bytes of the file a path names."""
    return hash_file(config) if isinstance(config, str) else hashlib.sha256(canonical_json(config).encode()).hexdigest()


def content_duplicates(df: DataFrame, content: str, row_id: str) -> DataFrame:
    """(digest, n, first_id) of contents that occur more than once.  Nulls are no content."""
    rows = df.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(row_id).alias("id"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


# --- chains ----------------------------------------------------------------------------


#: Short escapes of JSON, by UTF-16 unit.
_ESCAPES = {"0008": r"\b", "0009": r"\t", "000A": r"\n", "000C": r"\f", "000D": r"\r", "0022": r"\"", "005C": r"\\"}


def json_text(text: Column) -> Column:
    """A text as an ASCII JSON string, byte for byte as ``json.dumps`` writes it; null as ``null``."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit(r"\\")), F.lit('"'), F.lit(r"\""))

    def unit(u: Column) -> Column:
        out = F.when(u.between("0020", "007E"), F.char(F.conv(u, 16, 10).cast("long"))).otherwise(F.concat(F.lit(r"\u"), F.lower(u)))
        for code, short in _ESCAPES.items():
            out = F.when(u == code, F.lit(short)).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1)
    body = F.when(text.rlike(r"\A[ -~]*\z"), plain).otherwise(F.array_join(F.transform(units, unit), ""))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def record_hash(payload: Column, prev_hash: Column, timestamp: Column) -> Column:
    """Hash of a record over its canonical JSON (keys in order: payload, prev_hash, timestamp); equal to :func:`next_hash`."""
    parts = [F.lit('{"payload":'), json_text(payload), F.lit(',"prev_hash":'), json_text(prev_hash), F.lit(',"timestamp":'), json_text(timestamp), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)


def next_hash(payload: str | None, prev_hash: str, timestamp: str | None) -> str:
    return hashlib.sha256(json.dumps({"payload": payload, "prev_hash": prev_hash, "timestamp": timestamp}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def build_chains(records: DataFrame, head: str | None = None) -> DataFrame:
    """Chains of (chain_id, seq, payload, timestamp): each record hashed with its predecessor's hash.

    A chain starts from the genesis value, or goes on from the hash in the
    column ``head``.  A chain is a recurrence and runs in one task by nature;
    tasks stream their chains one record at a time, so its length costs no
    memory.
    """
    ship_package(records.sparkSession)
    start = F.coalesce(F.col(head), F.lit(GENESIS)) if head else F.lit(GENESIS)
    rows = records.select(F.col("chain_id").cast("long").alias("chain_id"), F.col("seq").cast("long").alias("seq"), F.col("payload").cast("string").alias("payload"), F.col("timestamp").cast("string").alias("timestamp"), start.alias("head"))
    ordered = rows.repartition("chain_id").sortWithinPartitions("chain_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, chain, last = to_arrow_schema(CHAIN), object(), GENESIS
        for b in batches:
            out = []
            for c, s, p, t, first in zip(*(x.to_pylist() for x in b.columns)):
                if c != chain:
                    chain, last = c, first
                h = next_hash(p, last, t)
                out.append((c, s, last, p, t, h))
                last = h
            columns = zip(*out) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return ordered.mapInArrow(run, CHAIN)


def check_links(chain: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Each record with self_ok (its own hash holds) and link_ok (it names its predecessor's hash).

    Predecessors are found by position: within runs of ``run`` sequence numbers
    first, then between the first record of a run and the last one before it, so
    that a long chain is not one task.  The first record must name the genesis.
    """
    rows = chain.withColumn("__run", F.floor(F.col("seq") / run))
    inside = Window.partitionBy("chain_id", "__run").orderBy("seq")
    rows = rows.withColumn("__prev", F.lag("record_hash").over(inside))
    ends = rows.groupBy("chain_id", "__run").agg(F.max_by("record_hash", "seq").alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last", 1, GENESIS).over(Window.partitionBy("chain_id").orderBy("__run"))).drop("__last")
    rows = rows.join(ends, ["chain_id", "__run"])
    expected = F.coalesce("__prev", "__before")
    return rows.select(*chain.columns, (record_hash(F.col("payload"), F.col("prev_hash"), F.col("timestamp")) == F.col("record_hash")).alias("self_ok"), (F.col("prev_hash") == expected).alias("link_ok"))


def verify_chains(chain: DataFrame) -> DataFrame:
    """(chain_id, n_records, valid, broken_seq): the first record whose hash or link fails, null if none.

    A chain cut at its tail verifies; compare the head with one kept elsewhere.
    """
    bad = ~(F.coalesce("self_ok", F.lit(False)) & F.coalesce("link_ok", F.lit(False)))
    checked = check_links(chain).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_records"), F.min(F.when(bad, F.col("seq"))).alias("broken_seq"))
    return checked.select("chain_id", "n_records", F.col("broken_seq").isNull().alias("valid"), "broken_seq")


def heads(chain: DataFrame) -> DataFrame:
    """(chain_id, head): hash of each chain's last record."""
    return chain.groupBy("chain_id").agg(F.max_by("record_hash", "seq").alias("head"))


def lookup(chain: DataFrame, chain_id: int, seq: int) -> DataFrame:
    return chain.where((F.col("chain_id") == chain_id) & (F.col("seq") == seq))


class ChainLog:
    """An append-only hash-chained log in a Parquet folder, for one writer; several chains may share a folder."""

    def __init__(self, spark: SparkSession, path: str, chain_id: int = 0):
        self.spark, self.path, self.chain_id = spark, path, chain_id
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            spark.createDataFrame([], CHAIN).write.parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(CHAIN).parquet(self.path).where(F.col("chain_id") == self.chain_id)

    def append(self, payloads: list, when: datetime | None = None) -> int:
        """Add payloads (any JSON values) in order; returns the last sequence number."""
        last = self.table().agg(F.max("seq").alias("s"), F.max_by("record_hash", "seq").alias("h")).first()
        seq, prev, rows = last["s"] or 0, last["h"] or GENESIS, []
        for p in payloads:
            stamp = (when or datetime.now(UTC)).isoformat()
            text = canonical_json(p)
            h = next_hash(text, prev, stamp)
            seq += 1
            rows.append((self.chain_id, seq, prev, text, stamp, h))
            prev = h
        if rows:
            self.spark.createDataFrame(rows, CHAIN).coalesce(1).write.mode("append").parquet(self.path)
        return seq

    def get(self, seq: int) -> dict | None:
        row = self.table().where(F.col("seq") == seq).first()
        return None if row is None else row.asDict() | {"payload": json.loads(row["payload"])}

    def verify(self) -> tuple[bool, int | None]:
        row = verify_chains(self.table()).first()
        return (True, None) if row is None else (row["valid"], row["broken_seq"])

    def __len__(self) -> int:
        return self.table().count()


def chain_flags(verified: DataFrame, db_path: str) -> DataFrame:
    evidence = {"broken_sequence": F.col("broken_seq"), "db_path": F.lit(db_path), "chain_id": F.col("chain_id")}
    return flags(verified.where(~F.col("valid")), "provenance", F.lit("The log's hash chain is broken."), evidence, F.lit(1.0), F.lit("high"), F.lit(db_path), "quarantine")


# --- signatures ------------------------------------------------------------------------


def make_bundle(input_hash: str, model_hash: str, config_hash: str, output) -> dict:
    return {"input_hash": input_hash, "model_hash": model_hash, "preprocessing_config_hash": config_hash, "output": output, "timestamp": datetime.now(UTC).isoformat(), "nonce": uuid.uuid4().hex}


def sign_bundle(bundle: dict, secret: bytes) -> bytes:
    return ed25519.sign(secret, canonical_json(bundle).encode())


def verify_bundle(bundle: dict, signature: bytes, public: bytes) -> bool:
    """Whether the signature holds; anything malformed is False."""
    try:
        return ed25519.verify(public, canonical_json(bundle).encode(), signature)
    except Exception:
        return False


def is_hex(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A([0-9a-fA-F]{2})*\z"), F.lit(False))


def missing(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) == 0


def verify_signatures(records: DataFrame, public: bytes) -> DataFrame:
    """(record_index, state) of signed records (record_index, bundle, signature): missing, bad or ok.

    A bundle that is no JSON object or a signature that is no hexadecimal text
    is bad by itself and does not stop the rest.
    """
    ship_package(records.sparkSession)

    @F.pandas_udf("boolean")
    def holds(bundle: pd.Series, signature: pd.Series) -> pd.Series:
        def one(b: str, s: str) -> bool:
            try:
                return verify_bundle(json.loads(b), bytes.fromhex(s), public)
            except Exception:
                return False

        return pd.Series([one(b, s) for b, s in zip(bundle, signature)])

    gone = missing(F.col("signature")) | missing(F.col("bundle")) | (F.col("bundle") == "{}")
    state = F.when(gone, "missing").when(~is_hex(F.col("signature")), "bad").when(holds("bundle", "signature"), "ok").otherwise("bad")
    return records.select("record_index", state.alias("state"))


def signature_flags(checked: DataFrame) -> DataFrame:
    gone = F.col("state") == "missing"
    return flags(
        checked.where(F.col("state") != "ok"),
        "provenance",
        F.when(gone, "Record lacks a bundle or signature.").otherwise("Signature does not hold."),
        {"record_index": F.col("record_index")},
        F.lit(1.0),
        F.when(gone, "medium").otherwise("high"),
        F.concat(F.lit("signed_record["), F.col("record_index"), F.lit("]")),
        F.when(gone, "review").otherwise("quarantine"),
    )
