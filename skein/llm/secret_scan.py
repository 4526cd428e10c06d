"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  Only pairs
of blob and rule version that the ledger lacks are scanned, each blob once, and
findings are joined back to all paths that ever held the blob.  All of it is
built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.scratch import materialize

RULE_VERSION = 1

# The kinds in their order, their patterns, the group whose length counts, and its least length.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: What a text must hold for a rule to find anything; cheaper to look for than every match.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
_SPANS = "array<struct<start:int,kind:int,stop:int>>"
_STEPS = "array<struct<kind:int,nth:int,gap:int,whole:int,counted:int>>"


def _matches(text: Column, kind: int) -> Column:
    """Matches of one rule in order: lengths, in code points, of the text before each, of itself and of what must be long enough."""
    name, pattern, group, least = RULES[kind]
    if name == "hex":  # short runs are everywhere; taking them for text between matches leaves the others where they are
        pattern = "[0-9a-f]{%d,}" % least
    # Splitting and extracting walk the same matches, so the lengths of what
    # lies between and of the matches themselves add up to positions.
    found = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.char_length)
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), found(0).alias("whole"), found(group).alias("counted"))
    steps = F.transform(parts, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m["gap"].alias("gap"), m["whole"].alias("whole"), m["counted"].alias("counted")))
    return F.when(text.rlike(HINTS[name]), steps).otherwise(F.array().cast(_STEPS))


def find(texts: DataFrame, key: str = "blob", text: str = "text") -> DataFrame:
    """``(key, found)``: all spans ``(start, kind, stop)`` of each key's text by start, then kind.

    Rows of one key must hold one text, which is scanned whole.  Matches become
    rows, and positions running sums over them, so time is in proportion to the
    text's length and its matches, however many they are.
    """
    lengths = texts.select(key, F.concat(*[_matches(F.col(text), k) for k in range(len(RULES))]).alias("steps"))
    # A key's rows are alike; one is enough, and with it the rest is dealt by key.
    each = lengths.groupBy(key).agg(F.first("steps").alias("steps")).select(key, F.explode_outer("steps").alias("m")).select(key, "m.*")
    stop = F.sum(F.col("gap") + F.coalesce(F.col("whole"), F.lit(0))).over(W.partitionBy(key, "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    least = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("kind") + 1)
    placed = each.withColumn("stop", stop)
    span = F.struct((F.col("stop") - F.col("whole")).alias("start"), "kind", "stop")
    return placed.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("counted") >= least, span))).alias("found"))


def spans_text(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; return ``(findings by path, ledger afterwards)``.

    ``versions`` holds one row for each version of each path.  The ledger is
    ``(blob string, rule_version int, found array<struct<start,kind,stop>>)``.
    Findings are the path, ``blob`` and ``found``, one row for each version.

    A null text is the empty blob; repeated versions, and different paths with
    one text, share a blob that is scanned once; texts are scanned whole; a null
    path is kept as a path.  An empty table gives no findings and the same
    ledger.  Other columns are not read.

    Text is shuffled only by (blob, path), which no hot blob or hot path can
    skew: the blob's smallest path alone is scanned.
    """
    held = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = held.withColumn("blob", F.sha2(F.col("text"), 256))
    first = held.select("path", "blob").groupBy("blob").agg(F.min("path").alias("first"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    todo = held.join(first.withColumnRenamed("blob", "b"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("first")), "left_semi")
    # A path may hold the same text twice.
    scanned = find(todo.select("blob", "text")).select("blob", F.lit(rule_version).alias("rule_version"), "found")
    new = materialize(scanned, "ledger")
    after = new if ledger is None else ledger.select("blob", "rule_version", "found").unionByName(new)
    known = after.where(F.col("rule_version") == rule_version).select("blob", "found")
    # Most blobs have no finding: only the others travel.
    some = known.where(F.size("found") > 0)
    findings = held.select("path", "blob").join(some, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("found", F.array().cast(_SPANS)).alias("found"))
    return findings, after
