"""Byte-level BPE encoding and decoding with the tokenizers library.

Text travels in Arrow batches.  Each batch is cut into chunks at places where
the split pattern always cuts, every chunk not seen before is encoded by the
library, and a document's ids are its chunks' ids in order.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.ship import map_batches

#: Chunks a worker remembers in each of two generations; forgetting costs time but no results.
CHUNK_MEMORY = 150_000

_DOUBLE_SPACE = re.compile(r"\s\s")
#: Before a space that follows anything but white space the pattern always cuts.
_CUT = re.compile(r"(?<=\S)(?= )")
#: Chunks that the split pattern cuts into letters and marks; all these letters are in its letter class.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?%$#&*|]*)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A tokenizer over a rank file (base64 token, space, rank on each line)."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core already
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        chars = byte_characters()
        spell = lambda token: "".join(map(chars.__getitem__, token))
        names = {token: spell(token) for token in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            # Any two known parts merge into a token, as ranks alone decide.
            cuts = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(names[token[:i]], names[token[i:]]) for _, _, i in sorted(cuts)]
        self.tokenizer = Tokenizer(models.BPE(vocab={names[t]: r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model = self.tokenizer.model
        self.spelling = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = bytes(map(back.__getitem__, names[token]))
        #: Packed ids of a whole chunk, and of a space before a chunk; the older generations give way when the younger are full.
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces that encode alone as they do in the text: whole ones, then ones that a space precedes."""
        bare = text.lstrip()
        if _DOUBLE_SPACE.search(bare):
            return [x for x in _CUT.split(text) if x], []
        first, *rest = bare.split(" ")
        lead = text[: len(text) - len(bare)]
        return [lead + first] if lead or first else [], rest

    def _word(self, word: str) -> bytes:
        """Packed ids of one match of the split pattern."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.spelling))]).tobytes()

    def _look_up(self, which: int, chunks: list[str]) -> list[bytes]:
        """Packed ids of each chunk, encoding those not remembered."""
        young, old = self.young[which], self.old[which]
        got = list(map(young.get, chunks))
        if None not in got:
            return got
        odd = []
        for c in {c for c, ids in zip(chunks, got, strict=True) if ids is None}:
            if c in old:
                young[c] = old[c]
            elif plain := _PLAIN.fullmatch(c):
                letters, marks = plain.groups()
                ids = young.get(letters) or old.get(letters) or self._word(" " * which + letters)
                young[c] = young[letters] = ids
                if marks:
                    young[c] = ids + self._word(marks)
            else:
                odd.append(c)
        for at in range(0, len(odd), 8192):
            part = odd[at : at + 8192]
            for chunk, encoding in zip(part, self.tokenizer.encode_batch_fast([" " + c for c in part] if which else part, add_special_tokens=False), strict=True):
                young[chunk] = array("I", encoding.ids).tobytes()
        return list(map(young.__getitem__, chunks))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(texts), 64):
            cut = [self.chunks(t) for t in texts[at : at + 64]]
            whole = iter(self._look_up(0, [c for x in cut for c in x[0]]))
            spaced = iter(self._look_up(1, [c for x in cut for c in x[1]]))
            out += [b"".join([*islice(whole, len(a)), *islice(spaced, len(b))]) for a, b in cut]
            if sum(map(len, self.young)) > CHUNK_MEMORY:
                self.old, self.young = self.young, ({}, {})
        return out

    def decode_packed(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.token_bytes.__getitem__, memoryview(packed).cast("I")))

    def offsets(self, packed: bytes) -> tuple[list[int], list[int]]:
        """Each token's first code point and the one after its last.

        A token that holds a part of a character covers the whole character, so
        the tokens that share one overlap there.
        """
        starts, ends, at = [], [], 0
        for i in memoryview(packed).cast("I"):
            raw = self.token_bytes[i]
            begun = sum(b & 0xC0 != 0x80 for b in raw)
            starts.append(at - (raw[0] & 0xC0 == 0x80))
            at += begun
            ends.append(at)
        return starts, ends


_LOADED: dict[str, ByteBpe] = {}


def load(rank_file: bytes, pattern: str) -> ByteBpe:
    """One tokenizer per worker process and rank file."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(rank_file, pattern)
    return _LOADED[key]


def decode_stream(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of tokens' bytes as it becomes whole: a split character waits for its last byte."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        if text := decoder.decode(piece):
            yield text
    if text := decoder.decode(b"", final=True):
        yield text


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_offsets: bool = False, with_decoded: bool | None = None) -> DataFrame:
    """Encode and decode the text of every row.

    Returns the ``keep`` columns, ``n_tokens`` long, ``ids_sha256`` and
    ``decoded_sha256``; with ``with_ids`` also ``ids array<int>``, with
    ``with_decoded`` (as ``with_ids`` if not given) ``decoded`` string, with ``with_offsets`` ``token_starts`` and
    ``token_ends`` in code points.

    Null and empty texts have no ids; texts of any length are encoded whole;
    repeated rows give repeated results; other columns are neither read nor
    returned.  Special tokens' names are ordinary text.
    """
    with open(rank_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    inner = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])
    with_decoded = with_ids if with_decoded is None else with_decoded
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_decoded + ", token_starts array<int>, token_ends array<int>" * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value, pattern)
        for batch in batches:
            packed = bpe.encode_packed(batch.column("_text").to_pylist())
            raw = [bpe.decode_packed(p) for p in packed]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array([hashlib.sha256(r).hexdigest() for r in raw])]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array([r.decode("utf-8", "replace") for r in raw], pa.string()))
                names.append("decoded")
            if with_offsets:
                spans = [bpe.offsets(p) for p in packed]
                columns += [pa.array([s[i] for s in spans], pa.list_(pa.int32())) for i in (0, 1)]
                names += ["token_starts", "token_ends"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return inner.transform(map_batches, run, schema)
