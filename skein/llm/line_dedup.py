"""Line deduplication by pairwise alignment of documents that share lines.

The shortest spans of neighbouring lines that have enough words to go nominate,
for each later document that holds one, the pair of that document and the first
one that holds the span.  A span in n documents thus makes n - 1 pairs, however
frequent it is, and every block that a document repeats from any earlier one is
covered by its pairs, wherever its single lines began.  Pairs are aligned on all
lines that both share, by patience diff: lines that occur once in both documents
are matched in their longest common order, so are lines that occur once in a gap
between them, and what is left in a gap by longest common order; matched lines
grow over equal neighbours.  Blocks that stand in another order are looked up.
Both run on what remains until there is no further block.  Aligned blocks go
from the later document.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.rows import text_key
from skein.plans.scratch import materialize
from skein.plans.ship import map_batches

#: Words that a block must have to be deleted; shorter common lines say nothing about where a text came from.
LEAST_WORDS = 5
#: Bits of the longest common order of a gap; beyond (50 MB) its blocks are left to the look-up, which finds them all.
ORDER_BITS = 400_000_000
_SPACE = re.compile(r"[ \t\x0b\f\r]+")
_LINE = pa.struct([("h", pa.int64()), ("words", pa.int32()), ("own", pa.list_(pa.struct([("pos", pa.int32()), ("at", pa.int32())])))])
_LINE_SQL = "struct<h:bigint,words:int,own:array<struct<pos:int,at:int>>>"


def _rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of anchors, sorted by their first places, whose second places rise too."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, p) in enumerate(anchors):
        i = bisect_left(tails, p)
        back.append(ends[i - 1] if i else -1)
        if i == len(tails):
            tails.append(p)
            ends.append(k)
        else:
            tails[i], ends[i] = p, k
    chain = []
    k = ends[-1] if ends else -1
    while k >= 0:
        chain.append(anchors[k])
        k = back[k]
    return chain[::-1]


def _common_order(own: list[int], theirs: list[int]) -> list[tuple[int, int]]:
    """Longest common subsequence as pairs of places; a row of bits for each line of ``theirs``."""
    masks: dict[int, int] = {}
    for i, h in enumerate(own):
        masks[h] = masks.get(h, 0) | 1 << i
    full = (1 << len(own)) - 1
    rows = [full]
    for h in theirs:
        at = rows[-1] & masks.get(h, 0)
        rows.append((rows[-1] + at | rows[-1] - at) & full)
    out = []
    i, j = len(own), len(theirs)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _matched(later: list[tuple[int, int]], earlier: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Positions matched in order, from ``(position, hash)`` of both: by lines unique on both sides, again in each gap, by longest common order where a gap has none."""
    out: list[tuple[int, int]] = []
    gaps = [(later, earlier)]
    while gaps:
        own, theirs = gaps.pop()
        n_own, n_theirs = Counter(h for _, h in own), Counter(h for _, h in theirs)
        own, theirs = [x for x in own if x[1] in n_theirs], [x for x in theirs if x[1] in n_own]
        place = {h: j for j, (_, h) in enumerate(theirs) if n_theirs[h] == 1}
        chain = _rising([(i, place[h]) for i, (_, h) in enumerate(own) if n_own[h] == 1 and h in place])
        if chain:
            i = j = 0
            for x, y in [*chain, (len(own), len(theirs))]:
                if i < x and j < y:
                    gaps.append((own[i:x], theirs[j:y]))
                i, j = x + 1, y + 1
        elif len(own) * len(theirs) <= ORDER_BITS:
            chain = _common_order([h for _, h in own], [h for _, h in theirs])
        out += [(own[x][0], theirs[y][0]) for x, y in chain]
    return sorted(out)


def patience(matches: list[tuple[int, int, list[int], list[int]]], least_words: int = LEAST_WORDS) -> list[int]:
    """Positions in the later document that align with the earlier one, in one order.

    ``matches`` has, for each common line, its hash, its words, and its positions
    in the later and in the earlier document.
    """
    later = {p: (h, n) for h, n, own, _ in matches for p in own}
    earlier = {p: h for h, _, _, theirs in matches for p in theirs}
    chain = _matched(sorted((p, h) for p, (h, _) in later.items()), sorted(earlier.items()))
    pairs: dict[int, int] = {}
    for a, b in chain:
        for step in (1, -1):
            i, j = a, b
            while i in later and i not in pairs and earlier.get(j) == later[i][0]:
                pairs[i] = j
                i, j = i + step, j + step
            if step == 1:
                a, b = a - 1, b - 1
    # Blocks of neighbours in both documents.
    gone: list[int] = []
    block: list[int] = []
    for i in sorted(pairs):
        if block and (i != block[-1] + 1 or pairs[i] != pairs[block[-1]] + 1):
            if sum(later[x][1] for x in block) >= least_words:
                gone += block
            block = []
        block.append(i)
    if sum(later[x][1] for x in block) >= least_words:
        gone += block
    return gone


def windows(words: list[int], least_words: int = LEAST_WORDS) -> set[tuple[int, int]]:
    """Spans of neighbouring lines that just reach ``least_words``: the shortest from each line and the shortest up to each.

    Every run of lines with that many words is the union of the spans inside it,
    and no span has more than ``least_words`` lines.
    """
    least = max(1, least_words)
    spans: set[tuple[int, int]] = set()
    end = total = 0
    for start in range(len(words)):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        spans.add((start, end))
        total -= words[start]
    start = total = 0
    for end, n in enumerate(words):
        total += n
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            spans.add((start, end + 1))
    return spans


def _runs(places: dict[int, int]) -> Iterator[list[int]]:
    """Positions that follow each other without a gap."""
    run: list[int] = []
    for p in sorted(places):
        if run and p != run[-1] + 1:
            yield run
            run = []
        run.append(p)
    if run:
        yield run


def _moved(matches: list[tuple[int, int, list[int], list[int]]], least_words: int) -> set[int]:
    """Positions in the later document of all blocks that the earlier one holds anywhere, in whatever order."""
    size = {h: n for h, n, _, _ in matches}
    earlier = {p: h for h, _, _, theirs in matches for p in theirs}
    later = {p: h for h, _, own, _ in matches for p in own}

    def spans(places: dict[int, int]) -> Iterator[tuple[tuple[int, ...], list[int]]]:
        for run in _runs(places):
            for i, j in windows([size[places[p]] for p in run], least_words):
                yield tuple(places[p] for p in run[i:j]), run[i:j]

    held = {lines for lines, _ in spans(earlier)}
    return {p for lines, at in spans(later) if lines in held for p in at}


def aligned(matches: list[tuple[int, int, list[int], list[int]]], least_words: int = LEAST_WORDS) -> list[int]:
    """Positions that the later document loses to the earlier one.

    Patience diff takes the blocks in order and a look-up those that moved; both
    run again on what remains, closed up, until there is no further block.
    """
    gone: list[int] = []
    while True:
        rest = [(h, n, [p - bisect_left(gone, p) for p in own], theirs) for h, n, own, theirs in matches]
        was = {q: p for (_, _, own, _), (_, _, new, _) in zip(matches, rest, strict=True) for p, q in zip(own, new, strict=True)}
        found = {was[q] for q in {*patience(rest, least_words), *_moved(rest, least_words)}}
        if not found:
            return gone
        gone = sorted({*gone, *found})
        matches = [(h, n, left, theirs) for h, n, own, theirs in matches if (left := [p for p in own if p not in found])]


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _read(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, spans = [], []
            for text in b.column(2).to_pylist():
                order: list[int] = []
                words: list[int] = []
                own: dict[int, dict] = {}
                for at, line in enumerate(_SPACE.sub(" ", text).split("\n")):
                    line = line.strip(" ")
                    if line:
                        h = _hash(line.encode())
                        own.setdefault(h, {"h": h, "words": line.count(" ") + 1, "own": []})["own"].append({"pos": len(order), "at": at})
                        order.append(h)
                        words.append(own[h]["words"])
                lines.append(list(own.values()))
                spans.append(list({_hash(b"".join(h.to_bytes(8, "little", signed=True) for h in order[i:j])) for i, j in windows(words, least_words)}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(_LINE)), pa.array(spans, pa.list_(pa.int64()))], names=["id", "key", "lines", "windows"])

    return run


def _align(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for matches in b.column(2).to_pylist():
                at = {x["pos"]: x["at"] for m in matches for x in m["own"]}
                found = aligned([(m["h"], m["words"], sorted(x["pos"] for x in m["own"]), sorted(m["theirs"])) for m in matches], least_words)
                gone.append([at[p] for p in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["gone_id", "gone_key", "gone"])

    return run


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``(gone_id, gone_key, gone array<int>)``: line numbers (from 0) that each document loses.

    Only documents that lose lines have a row.  Lines are compared by the hash of
    their trimmed text; blank lines are no evidence and do not part neighbours.  The
    earlier of two documents is the one with the smaller id; rows that share an
    id never delete from each other, rows without id take no part.
    """
    source = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))
    read = materialize(source.transform(map_batches, _read(least_words), f"id long, key long, lines array<{_LINE_SQL}>, windows array<long>"), "lines")
    spans = read.select("id", "key", F.explode("windows").alias("w"))
    # Of several texts under the first id, the one with the smallest key is the first.
    first = spans.groupBy("w").agg(F.min(F.struct("id", "key")).alias("first"), F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    # Written, so that the join below is between two exchanges and a hot window's partition can be split.
    first = materialize(first.select("w", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "first-windows")
    pairs = spans.join(first, "w").where("first_id < id").select("id", "key", "first_id", "first_key").distinct()
    # A row for each line of a document, however often it stands there.
    each = read.select("id", "key", F.explode("lines").alias("l")).select("id", "key", "l.*")
    held = each.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h")
    # Written for the same reason: a hot line's partition can be split.
    held = materialize(held, "shared-hashes")
    lines = materialize(each.join(held, "h", "left_semi").dropDuplicates(["id", "key", "h"]), "shared-lines")
    # The shorter document of a pair brings its lines, the longer one answers for those that it has too.
    sizes = materialize(lines.groupBy("id", "key").agg(F.count("*").alias("n")), "sizes")
    pairs = pairs.join(sizes, ["id", "key"]).join(sizes.toDF("first_id", "first_key", "first_n"), ["first_id", "first_key"])
    pairs = materialize(pairs.select("id", "key", "first_id", "first_key", (F.col("n") <= F.col("first_n")).alias("short")), "pairs")
    later = lines.select("id", "key", "h", "words", "own")
    earlier = lines.select(F.col("id").alias("first_id"), F.col("key").alias("first_key"), "h", F.col("own.pos").alias("theirs"))
    columns = ["id", "key", "first_id", "first_key", "h", "words", "own", "theirs"]
    by_later = pairs.where("short").join(later, ["id", "key"]).join(earlier, ["first_id", "first_key", "h"]).select(columns)
    by_earlier = pairs.where("not short").join(earlier, ["first_id", "first_key"]).join(later, ["id", "key", "h"]).select(columns)
    matches = by_later.union(by_earlier).groupBy("id", "key", "first_id", "first_key").agg(F.collect_list(F.struct("h", "words", "own", "theirs")).alias("matches"))
    gone = matches.select("id", "key", "matches").transform(map_batches, _align(least_words), "gone_id long, gone_key long, gone array<int>").where(F.size("gone") > 0)
    return gone.groupBy("gone_id", "gone_key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents without the lines that they repeat from earlier documents.

    All columns stay, ``text`` is what is left, and ``n_lines_removed`` int is
    added (a column of that name is replaced).  A document that loses every line with words has an empty text, or
    goes if ``drop_emptied``.  Null and empty texts, and rows without id, stay as
    they are; repeated rows lose the same lines; an empty table stays empty.
    """
    gone = materialize(repeated_lines(docs, doc_id, text, least_words), "gone-lines").toDF("_line_id", "_line_key", "_line_gone")
    columns = [c for c in docs.columns if c != "n_lines_removed"]
    keyed = docs.withColumns({"_line_key": text_key(text), "_line_id": F.col(doc_id).cast("long")})
    # Line numbers have no bound, so they are never broadcast; the key is a document, so nothing is hot.
    joined = keyed.join(gone.hint("shuffle_hash"), ["_line_id", "_line_key"], "left")
    lost = F.col("_line_gone")
    # Numbers are taken from each other by hash, and the lines split once, so a text's length counts once.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    left = F.array_join(F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(stay(lines), lambda i: F.get(lines, i)))[0], "\n")
    new = F.when(lost.isNull(), F.col(text)).when(~left.rlike(r"\S"), F.lit("")).otherwise(left)
    out = joined.select(*[new.alias(c) if c == text else F.col(c) for c in columns], F.coalesce(F.size(lost), F.lit(0)).alias("n_lines_removed"))
    return out.where((F.col("n_lines_removed") == 0) | (F.col(text) != "")) if drop_emptied else out
