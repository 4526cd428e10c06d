"""Benchmark decontamination with a positional inverted index over training tokens.

The index holds, for each term, the documents that have it and the positions
there.  It is a written table of those terms that can decide anything: the rarest
few of each window of the test texts.  A search joins windows to the postings of
their rarest term, then of the next, and intersects the position lists, each
shifted back by its term's offset in the window.  Postings of a rarest term also
carry the words around each position, as hashes, so what is left of an
intersection is compared word by word without going back to the texts.  The same
joined lists tell where a window's rarest terms stand near each other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.rows import text_key, without
from skein.plans.joins import fits
from skein.plans.scratch import materialize
from skein.plans.ship import map_batches

WINDOW = 13
#: Bytes of different terms that are looked for in one pass over the documents (a worker holds about ten times that); more take more passes.
PASS_BYTES = 4_000_000
#: Rarest terms of a window whose postings are stored and intersected.
ANCHORS = 3
#: Words within which a window's rarest terms count as near each other.
PROXIMITY = 2 * WINDOW
# Bytes of words stay (A-Z as lower case), all others become spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, lower-cased ASCII letters and all characters beyond ASCII."""
    return data.translate(_FOLD).split()


def _hash(word: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(word, 42), "big", signed=True)


def item_tokens(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item string, text_key, pos int, term string, hash long)`` of every word of the test items; a null id is the empty string."""
    own = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(data)
                for at in range(0, len(words), 65536):
                    part = words[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array([key] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), pa.array([w.decode("utf-8", "replace") for w in part], pa.string()), pa.array([_hash(w) for w in part], pa.int64())], names=["item", "text_key", "pos", "term", "hash"])

    source = own.select("item", text_key("text").alias("text_key"), F.col("text").cast("binary").alias("b"))
    return source.transform(map_batches, run, "item string, text_key long, pos int, term string, hash long")


def _slices(terms: DataFrame) -> list[DataFrame]:
    """Different terms (column ``term``), dealt into slices of at most about PASS_BYTES."""
    total = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    n = 1 if total <= PASS_BYTES else -(-int(total) * 2 // PASS_BYTES)
    return [terms if n == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) for k in range(n)]


def term_frequencies(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``(term, n)``: how many documents hold each of the terms, over all documents; terms that none holds are left out.

    A pass reads all documents and counts a slice of bounded size, which alone is
    broadcast; counts are summed in each task before the shuffle.
    """
    parts = []
    for part in _slices(terms):
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"].encode() for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts: Counter[bytes] = Counter()
            for b in batches:
                for data in b.column(0).to_pylist():
                    counts.update(shared.value.intersection(words_of(data)))
            yield pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        parts.append(docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("b")).transform(map_batches, run, "term string, n long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return materialize(found.groupBy("term").agg(F.sum("n").alias("n")), "frequencies")


def windows_of(tokens: DataFrame, frequencies: DataFrame, width: int = WINDOW) -> DataFrame:
    """The different windows of the test items that can occur, with their rarest terms.

    ``(items array<string>, size int, hashes array<long>, t1, o1, t2, o2, ...)``:
    a window's words as hashes in order, and its ANCHORS rarest different terms
    with their offsets, null where it has fewer.  A window with a term that no
    document holds is left out.
    """
    counted = tokens.join(frequencies, "term", "left").select("item", "text_key", "pos", "term", "hash", F.coalesce("n", F.lit(0)).alias("n"))
    own = W.partitionBy("item", "text_key")
    ahead = F.collect_list(F.struct("n", "term", "pos", "hash")).over(own.orderBy("pos").rowsBetween(0, width - 1))
    held = counted.select("item", "pos", F.count("*").over(own).alias("words"), ahead.alias("w")).where(F.size("w") == F.least(F.lit(width), F.col("words"))).where(~F.exists("w", lambda x: x["n"] == 0))
    rare = F.array_sort(F.transform("w", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"), (x["pos"] - F.col("pos")).alias("offset"))))
    plain = held.select("item", F.size("w").alias("size"), F.transform("w", lambda x: x["hash"]).alias("hashes"), rare.alias("rare"))
    out = plain.groupBy("hashes").agg(F.first("size").alias("size"), F.first("rare").alias("rare"), F.array_sort(F.collect_set("item")).alias("items"))
    for k in range(1, ANCHORS + 1):
        out = out.withColumns({f"t{k}": F.get("rare", F.lit(0))["term"], f"o{k}": F.get("rare", F.lit(0))["offset"]})
        out = out.withColumn("rare", F.expr(f"filter(rare, x -> x.term <> t{k})"))
    return materialize(out.drop("rare"), "windows")


def index_terms(windows: DataFrame) -> DataFrame:
    """``(term, before, after)``: what the index must hold, and how many words around a rarest term; null for the others."""
    first = index_extents(windows).withColumnRenamed("t1", "term")
    every = windows.select(F.explode(F.array(*[f"t{k}" for k in range(1, ANCHORS + 1)])).alias("term")).where("term is not null").distinct()
    return materialize(every.join(first, "term", "left").select("term", "before", "after"), "index-terms")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored index: ``(postings, sizes)``.

    ``postings(term, doc_id, gone_key, positions array<int>, context array<long>)``
    has a row for each term and document that holds it; ``context`` has the
    hashes of the words from ``before`` to ``after`` a position for one position
    after the other, zero beyond the text.  ``sizes(doc_id, gone_key, n_words)``
    has a row for each input row.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("gone_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
    raw = []
    for part in _slices(terms):
        shared = docs.sparkSession.sparkContext.broadcast({r["term"].encode(): None if r["before"] is None else (r["before"], r["after"]) for r in part.collect()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=not raw) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            keys = wanted.keys()
            for b in batches:
                sizes, rows, terms, lists, contexts = [], [], [], [], []
                for at, data in enumerate(b.column(2).to_pylist()):
                    words = words_of(data)
                    sizes.append(len(words))
                    held = keys & set(words)
                    if held:
                        places: dict[bytes, list[int]] = {t: [] for t in held}
                        for i, w in enumerate(words):
                            if w in places:
                                places[w].append(i)
                        for t in sorted(held):
                            rows.append(at)
                            terms.append(t.decode("utf-8", "replace"))
                            lists.append(places[t])
                            contexts.append(None if wanted[t] is None else _around(words, places[t], *wanted[t]))
                if first:
                    yield _index_batch(b, list(range(b.num_rows)), sizes, [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows)
                for k in range(0, len(rows), 8192):
                    cut = slice(k, k + 8192)
                    yield _index_batch(b, rows[cut], None, terms[cut], lists[cut], contexts[cut])

        raw.append(source.transform(map_batches, run, f"doc_id {kind}, gone_key long, n_words long, term string, positions array<int>, context array<long>"))
    held = raw[0]
    for r in raw[1:]:
        held = held.unionByName(r)
    held = materialize(held, "tokens")
    # Rows that repeat an id with its text have one posting.
    postings = held.where("term is not null").groupBy("term", "doc_id", "gone_key").agg(F.first("positions").alias("positions"), F.first("context").alias("context"))
    return materialize(postings, "postings"), held.where("term is null").select("doc_id", "gone_key", "n_words")


def _around(words: list[bytes], places: list[int], before: int, after: int) -> list[int]:
    n = len(words)
    return [_hash(words[i]) if 0 <= i < n else 0 for p in places for i in range(p - before, p + after + 1)]


def _index_batch(b: pa.RecordBatch, rows: list[int], sizes: list[int] | None, terms: list, lists: list, contexts: list) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(take), b.column(1).take(take), pa.array(sizes if sizes is not None else [None] * len(rows), pa.int64()), pa.array(terms, pa.string()), pa.array(lists, pa.list_(pa.int32())), pa.array(contexts, pa.list_(pa.int64()))],
        names=["doc_id", "gone_key", "n_words", "term", "positions", "context"],
    )


def _closest(lists: list[Column]) -> Column:
    """Words that the closest places of all the lists span, in one walk; null lists are left out."""
    def labelled(x: Column, k: int) -> Column:
        return F.transform(F.coalesce(x, F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(k).alias("k")))

    events = F.array_sort(F.concat(*[labelled(x, k) for k, x in enumerate(lists)]))
    none = F.lit(None).cast("int")
    start = F.struct(*[none.alias(f"l{k}") for k in range(len(lists))], none.alias("best"))

    def step(s: Column, e: Column) -> Column:
        last = [F.when(e["k"] == k, e["p"]).otherwise(s[f"l{k}"]) for k in range(len(lists))]
        # A list that isn't there never holds the others up.
        full = [F.when(x.isNull(), e["p"]).otherwise(y) for x, y in zip(lists, last, strict=True)]
        lowest = full[0]
        for f in full[1:]:
            lowest = F.when(lowest.isNull() | f.isNull(), none).otherwise(F.least(lowest, f))
        return F.struct(*[x.alias(f"l{k}") for k, x in enumerate(last)], F.least(s["best"], e["p"] - lowest + 1).alias("best"))

    return F.aggregate(events, start, step, lambda s: s["best"])


def search_index(postings: DataFrame, windows: DataFrame, proximity: int | None = None) -> DataFrame:
    """Matches of the windows: ``(doc_id, gone_key, items, size, starts array<int>, span int)``, one row for each window and document.

    ``starts`` are the exact occurrences and ``span`` the words that the closest
    places of the window's rarest terms span, whatever their order.  Rows without
    exact occurrence are there only if ``span`` is at most ``proximity``.
    """
    terms = index_extents(windows)
    plan = windows.join(F.broadcast(terms) if fits(terms) else terms, "t1")
    first = postings.where("context is not null").select(F.col("term").alias("t1"), "doc_id", "gone_key", F.col("positions").alias("p1"), "context")
    # Windows are a query set: broadcast if it proves small, else the adaptive planner splits what a hot term fills.
    found = first.join(F.broadcast(plan) if fits(plan) else plan, "t1")
    for k in range(2, ANCHORS + 1):
        side = postings.select(F.col("term").alias(f"u{k}"), F.col("doc_id").alias("_doc"), F.col("gone_key").alias("_key"), F.col("positions").alias(f"p{k}"))
        same = (F.col(f"t{k}") == F.col(f"u{k}")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("gone_key") == F.col("_key"))
        found = found.join(side, same, "left").where(f"t{k} is null or p{k} is not null").drop(f"u{k}", "_doc", "_key")
    shifted = lambda k: F.transform(f"p{k}", lambda p: p - F.col(f"o{k}"))
    common = F.filter(shifted(1), lambda s: s >= 0)
    for k in range(2, ANCHORS + 1):
        common = F.when(F.col(f"p{k}").isNull(), common).otherwise(F.array_intersect(common, shifted(k)))
    width = F.col("before") + F.col("after") + 1
    words_at = lambda i: F.slice("context", i * width + F.col("before") - F.col("o1") + 1, F.col("size"))
    equal = F.transform(F.filter(F.transform("p1", lambda p, i: F.struct(p.alias("p"), words_at(i).alias("w"))), lambda x: x["w"] == F.col("hashes")), lambda x: x["p"] - F.col("o1"))
    none = F.array().cast("array<int>")
    found = found.withColumn("starts", common).withColumn("starts", F.when(F.size("starts") > 0, F.array_intersect("starts", equal)).otherwise(none))
    span = _closest([F.col(f"p{k}") for k in range(1, ANCHORS + 1)]) if proximity is not None else F.lit(None).cast("int")
    out = found.select("doc_id", "gone_key", "items", "size", "starts", span.alias("span"))
    return out.where((F.size("starts") > 0) | (F.col("span") <= (-1 if proximity is None else proximity)))


def index_extents(windows: DataFrame) -> DataFrame:
    """``(t1, before, after)``: the words around each rarest term that the index holds."""
    return windows.groupBy("t1").agg(F.max("o1").alias("before"), F.max(F.col("size") - 1 - F.col("o1")).alias("after"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, percent: int = 5, proximity: int | None = None) -> DataFrame:
    """Contamination of every document by test items.

    Returns ``(doc_id, gone_key, n_words, n_hit, n_items, items array<string>,
    contaminated)``, one row for each input row, and with ``proximity`` also
    ``near array<string>``, the items of which a window's rarest terms stand
    within that many words.  A word is hit if it lies in an occurrence of
    ``width`` consecutive words of an item (all words of a shorter one); a
    document is contaminated if hit words make ``percent`` of its words.

    Null and word-free documents have no words and are clean; null or word-free
    items have no windows; repeated items count once under their id, a null item
    id is the empty string; an empty benchmark leaves all documents clean.  Other
    columns play no part.

    Items stay in Spark, whatever their number and size.  What is broadcast to
    Python is a slice of their different terms of at most PASS_BYTES.
    """
    tokens = materialize(item_tokens(benchmark, item_id, item_text), "item-tokens")
    frequencies = term_frequencies(docs, tokens.select("term").distinct(), text)
    windows = windows_of(tokens, frequencies, width)
    postings, sizes = build_index(docs, index_terms(windows), doc_id, text)
    found = search_index(postings, windows, proximity)
    exact = F.size("starts") > 0
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("size")).alias("stop")))
    # Places may repeat, as counting words allows for it; array_distinct would compare structs one by one.
    flat = lambda c: F.flatten(F.collect_list(c))
    named = lambda c: F.array_sort(F.array_distinct(flat(c)))
    near = [named(F.when(F.col("span") <= proximity, F.col("items"))).alias("near")] if proximity is not None else []
    matched = found.groupBy("doc_id", "gone_key").agg(F.array_sort(flat(spans)).alias("hits"), named(F.when(exact, F.col("items"))).alias("items"), *near)
    # Hits are in order of their starts: count each word once.
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, h: F.struct((s["n"] + F.greatest(h["stop"] - F.greatest(h["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], h["stop"]).alias("upto")),
        lambda s: s["n"],
    )
    names = ["items"] + ["near"] * (proximity is not None)
    matched = materialize(matched.select(F.col("doc_id").alias("_doc"), F.col("gone_key").alias("_key"), covered.alias("n_hit"), *names), "matches")
    side = F.broadcast(matched) if fits(matched) else matched
    every = sizes.join(side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("gone_key") == F.col("_key")), "left")
    nothing = F.array().cast("array<string>")
    out = every.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), **{c: F.coalesce(c, nothing) for c in names}})
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    return out.select("doc_id", "gone_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), *names, dirty.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that test items do not contaminate; all columns stay."""
    dirty = contamination(docs, benchmark, doc_id, text).where("contaminated").select(F.col("doc_id").alias("gone_id"), "gone_key")
    return without(docs, dirty, doc_id, text)


def items_digest(items: list[str]) -> str:
    """SHA-256 of sorted, comma-joined item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
