"""Near-duplicates by SimHash: an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most
three of their eight bytes, so at least five positional bytes are equal.  A list
for a single positional byte holds a 256th of all fingerprints, which is too
long at scale; the index therefore lists fingerprints under three positional
bytes of the same half.  Of any five equal positions three or more lie in one
half, so no pair is missed.  Within a list the equal positional bytes of each
pair are tallied, only pairs with five or more pass, and of those alone the
differing bits are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.rows import text_key, without
from skein.operators.components import connected_components
from skein.plans.joins import attach
from skein.plans.scratch import materialize
from skein.plans.ship import map_batches

SEED = 42
MAX_BITS = 3
#: Equal positional bytes that every pair within MAX_BITS has at least.
LEAST_BYTES = 8 - MAX_BITS
#: Byte positions (0 is the highest byte) of each list's key.
KEY_POSITIONS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7)]
#: Fingerprints of a list that are compared in one piece; longer lists are compared block by block.
BLOCK = 1024
#: Fingerprints of a list whose pairs are tallied together with those of other lists of its length.
SHORT = 12


def fingerprint(data: bytes, width: int = 3) -> int:
    """SimHash of a text's UTF-8 bytes over ``width``-word shingles, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    flat, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    span = min(width, len(words))
    ends = (starts + lengths)[span - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends)])  # noqa: B905  a shingle for each end
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id long, gone_key long, fp long)`` of every row, ``fp`` with the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, width) for x in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "gone_key", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("gone_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
    return source.transform(map_batches, run, "doc_id long, gone_key long, fp long")


def _passing(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs stay, by the exclusive-or of their fingerprints: the count filter first, bits only of what passes it."""
    tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1, dtype=np.int8)
    places = np.nonzero(tally >= 8 - max_bits)
    stay = np.zeros(x.shape, bool)
    stay[places] = np.bitwise_count(x[places]) <= max_bits
    return stay


def _short_links(fps: np.ndarray, starts: np.ndarray, n: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) of all lists of one short length ``n``, which begin at ``starts``."""
    i, j = np.triu_indices(n, 1)
    firsts, seconds = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
    stay = _passing(fps[firsts] ^ fps[seconds], max_bits)
    return seconds[stay], firsts[stay]


def _component_edges(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Enough of a list's links (as positions) to connect what all its links connect."""
    n = len(fps)
    label = np.arange(n)
    firsts, seconds = [], []
    for i in range(0, n, 128):
        a, b = np.nonzero(_passing(fps[i : i + 128, None] ^ fps[None, :], max_bits))
        keep = b < a + i
        firsts.append(a[keep] + i)
        seconds.append(b[keep])
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return [(int(i), int(label[i])) for i in np.nonzero(label != np.arange(n))[0]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        cuts = lists.offsets.to_numpy()
        fields = lists.values
        fp = fields.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
        rep = fields.field(1).to_numpy(zero_copy_only=False)
        sizes = np.diff(cuts)
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, SHORT + 1):
            starts = cuts[:-1][sizes == n].astype(np.int64)
            for at in range(0, len(starts), 4096):
                i, j = _short_links(fp, starts[at : at + 4096], n, MAX_BITS)
                src.append(rep[i])
                dst.append(rep[j])
        for k in np.nonzero(sizes > SHORT)[0].tolist():
            pairs = np.array(_component_edges(fp[cuts[k] : cuts[k + 1]], MAX_BITS), np.int64).reshape(-1, 2) + cuts[k]
            src.append(rep[pairs[:, 0]])
            dst.append(rep[pairs[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], names=["src", "dst"])


def fingerprint_links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``(src, dst)`` between representatives that connect all fingerprints within MAX_BITS.

    ``classes(fp, rep)`` holds each fingerprint once.  From a list come only the
    links of a spanning forest, never all pairs.  A list of more than ``block``
    fingerprints is dealt into blocks and each pair of blocks is its own piece of
    work, so no task ever holds more than two blocks.
    """
    byte = lambda p: F.shiftrightunsigned(F.col("fp"), 8 * (7 - p)).bitwiseAND(F.lit(255))
    keys = [
        F.lit(k).cast("long") * F.lit(1 << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)
        for k, (a, b, c) in enumerate(KEY_POSITIONS)
    ]
    postings = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"))
    long_lists = materialize(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "long-lists")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = attach(postings, long_lists, ["key"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    dealt = placed.select("key", "fp", "rep", "own", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    lists = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.struct("fp", "rep")).alias("list")).where(F.size("list") > 1).select("list")
    return lists.transform(map_batches, _links, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and group of every document.

    Returns ``(doc_id long, gone_key long, fp long, component_id long)`` with one
    row for each input row; ``component_id`` is the smallest id reachable over
    links of at most three differing bits.  Null and word-free texts have
    fingerprint zero and link like others.  Rows with equal fingerprints form one
    class, represented by its smallest id, so copies never become pairs; repeated
    ids are fine.  A class in which all ids are null has a null component and no
    links.  An empty table gives no rows; other columns play no part.
    """
    signed = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = fingerprint_links(classes.where("rep is not null"))
    components = materialize(connected_components(links), "components")
    named = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return attach(signed, materialize(named, "named"), ["fp"]).select("doc_id", "gone_key", "fp", "component_id")


def fingerprint_text() -> Column:
    """The column ``fp`` as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose id is their group's smallest; all columns stay.

    Rows that repeat an id stand or fall together with it, but of those only
    rows whose fingerprint is in the representative's group are judged by it.
    Rows with a null id stay.
    """
    groups = near_duplicates(docs, doc_id, text)
    gone = groups.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), "gone_key")
    return without(docs, gone, doc_id, text)
