"""Secret scans over an incremental blob ledger.

Every version of a file is a blob, addressed by the SHA-256 of its text. The ledger holds, per blob, the rule versions it was scanned
with and what they found. A run scans each distinct blob only with the rule versions that the ledger lacks, appends the
findings, and joins them back to all paths (rows) that hold the blob.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import maybe_in, stage
from termloom.session import checkpoint_dir

# fixed values: the base rules; letters of names count in either case
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" for c in n) for n in ("password", "passwd", "secret", "token", "api_key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
PEM = re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\\s]*-----END [A-Z ]*PRIVATE KEY-----)?")
LOWER = {i: i + 32 for i in range(65, 91)}


def assignments(text: str) -> list[tuple[int, int]]:
    low = text.translate(LOWER)
    if not any(n in low for n in NAMES):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]


def access_keys(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []


def hex_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in HEX.finditer(text)]


def private_keys(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PEM.finditer(text)] if "-----BEGIN" in text else []


BASE = ("assign", "access", "hex")
# rule -> (version, scanner); a changed scanner takes a new version, and only its pairs are scanned again
RULES = {"assign": (1, assignments), "access": (1, access_keys), "hex": (1, hex_runs), "pem": (1, private_keys)}


def scan(rows: DataFrame, rules: dict) -> DataFrame:
    """(blob, rules, spans): rows (blob, text, todo) scanned with the rule versions in `todo`; spans are 'start:end,...' per rule."""
    by_name = {f"{name}@{version}": finder for name, (version, finder) in rules.items()}

    def run(batches):
        strings = pa.list_(pa.string())
        for batch in batches:
            todo = batch.column(2).to_pylist()
            found = [[",".join(f"{s}:{e}" for s, e in by_name[r](t or "")) for r in names] for t, names in zip(batch.column(1).to_pylist(), todo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(todo, strings), pa.array(found, strings)], names=["blob", "rules", "spans"])

    return rows.select("blob", "text", "todo").mapInArrow(run, "blob binary, rules array<string>, spans array<string>")


def findings(docs: DataFrame, ledger: str | None = None, rules: dict | None = None) -> DataFrame:
    """(doc_id, found): per row of `docs`, the map rule -> 'start:end,...' of its blob.

    `ledger` is a folder on shared storage that grows by one part per run; without it the run has a ledger of its own under the
    checkpoint folder. A null text is the empty blob. Rows that repeat, and different rows of one blob, share findings. An
    empty table scans nothing. Other columns are ignored.
    """
    spark, rules = docs.sparkSession, rules or RULES
    wanted = F.array(*[F.lit(f"{name}@{version}") for name, (version, _) in rules.items()])
    ledger = ledger or f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("text"))
    addressed = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"), F.xxhash64("text").alias("hash"), F.xxhash64("doc_id", "text").alias("row"))
    paths = stage(addressed)
    held = _ledger(spark, ledger)
    blobs = paths.groupBy("blob", "hash").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    if held is None:
        todo = stage(blobs.withColumn("todo", wanted))
    else:
        known = held.select(F.col("blob").alias("k"), F.explode("rules").alias("rule")).groupBy("k").agg(F.collect_set("rule").alias("known"))
        todo = stage(blobs.join(known, F.expr("blob = k"), "left").select("blob", "hash", "row", F.array_except(wanted, F.coalesce("known", F.array())).alias("todo"), F.col("known").isNotNull().alias("old"), "n"))
    # a blob that surely occurs once and is new is scanned where it lies; only copies and known blobs are joined
    special = "n > 1" if held is None else "n > 1 or old"
    rows = maybe_in(texts.select("doc_id", "text", F.xxhash64("text").alias("hash")), "hash", todo.where(special).select(F.col("hash").alias("id")))
    alone = rows.where("not maybe").select(F.unhex(F.sha2("text", 256)).alias("blob"), "text", wanted.alias("todo"))
    chosen = todo.where("size(todo) > 0").select("blob", F.col("row").alias("best"), "todo")
    others = rows.where("maybe").withColumn("row", F.xxhash64("doc_id", "text")).join(chosen, F.expr("row = best")).select("blob", "text", "todo")
    scan(alone.unionByName(others), rules).write.mode("append").parquet(ledger)
    # rows that repeat both doc_id and text are scanned more than once, with equal findings
    pairs = F.map_from_entries(F.arrays_zip("rules", "spans"))
    per_blob = _ledger(spark, ledger).dropDuplicates(["blob", "rules"]).select(F.col("blob").alias("b"), pairs.alias("found"))
    if held is not None:  # several parts may hold one blob, with different rules
        each = per_blob.select("b", F.explode("found")).where(F.array_contains(wanted, F.col("key"))).dropDuplicates(["b", "key"])
        per_blob = each.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("found"))
    return paths.join(per_blob, F.expr("blob = b")).select("doc_id", "found")


def _ledger(spark, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("blob binary, rules array<string>, spans array<string>").parquet(path)


def op8(docs: DataFrame) -> DataFrame:
    found = findings(docs)
    listed = lambda name: F.filter(F.split(F.coalesce(F.col("found")[f"{name}@{RULES[name][0]}"], F.lit("")), ","), lambda x: x != "")

    def marked(kind, name):
        return F.transform(listed(name), lambda x: F.struct(F.split(x, ":")[0].cast("long").alias("start"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{name}:"), x).alias("said")))

    def spans(names):
        return F.array_join(F.transform(F.array_sort(F.concat(*[marked(k, n) for k, n in enumerate(names)])), lambda x: x["said"]), ",")

    counts = [F.size(listed(n)).cast("long").alias(f"n_{n}") for n in BASE]
    return found.select("doc_id", *counts, F.sha2(spans(BASE), 256).alias("base_sha256"), spans(tuple(RULES)).alias("spans"))
