"""Language identification by Bayesian evidence fusion.

A multinomial model of byte trigrams gives each text's likelihood under every
language.  It is combined with what the source declares (a markup language or a
column), with the address (path prefix or suffix), and with a prior of the host
that a grouped aggregation smooths towards its domain's and that towards all
documents'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.joins import attach
from skein.plans.scratch import materialize
from skein.plans.ship import map_batches

#: Buckets that trigrams are hashed to.
BUCKETS = 1 << 15
#: Labelled rows of each language that the model is trained on, at most.
TRAIN_ROWS = 600
#: Languages that a model knows at most: the most frequent labels; others are taken for dirt and not learnt.
LANGUAGES = 64
#: Trigrams beyond which a longer text makes no stronger evidence: neighbouring trigrams are not independent.
FULL_WEIGHT = 120
#: How much likelier a source's declaration is to be right than each other language, and the same for an address.
DECLARED_ODDS, ADDRESS_ODDS = 20.0, 10.0
#: Documents that a domain's prior counts as in a host's, and all documents' in a domain's.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
#: Posterior below which no language is given.
LEAST_POSTERIOR = 0.6
# Country suffixes that point to a language.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es"}
_TAGS = re.compile(rb"<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>", re.S | re.I)


def _codes(data: bytes) -> np.ndarray:
    """Hashed trigrams of the letters of a text; every run of other bytes is one space."""
    raw = np.frombuffer(data, np.uint8)
    folded = _FOLD[raw]
    space = folded == 0x20
    folded = folded[~(space & np.concatenate(([False], space[:-1])))] if len(folded) else folded
    if len(folded) < 3 or not (folded != 0x20).any():
        return np.zeros(0, np.int64)
    x = folded.astype(np.int64)
    return ((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * 2654435761 >> 7) % BUCKETS


_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


def visible(data: bytes) -> bytes:
    """A page's text, roughly: what is outside of tags, scripts and comments."""
    return _TAGS.sub(b" ", data)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets, languages x BUCKETS."""

    languages: tuple[str, ...]
    logs: np.ndarray

    def log_likelihoods(self, data: bytes) -> np.ndarray | None:
        """Tempered log-likelihoods of a text; None if it has no letters."""
        codes = _codes(data)
        if not len(codes):
            return None
        return self.logs[:, codes].mean(axis=1, dtype=float) * min(len(codes), FULL_WEIGHT)


def _fold(text: str, folds: int) -> Column:
    """A text's fold; equal texts share one."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)), F.lit(folds))


def train(labelled: DataFrame, label: str = "lang", text: str = "text", rows: int = TRAIN_ROWS) -> TextModel:
    """Count trigrams of a bounded sample: of each of the LANGUAGES most frequent labels the ``rows`` texts whose hash is smallest.

    Null labels and texts are left out.  What goes to the driver is one fixed-size
    row of counts for each language and task.
    """
    return train_folds(labelled, label, text, rows, 1)[0]


def train_folds(labelled: DataFrame, label: str = "lang", text: str = "text", rows: int = TRAIN_ROWS, folds: int = 2) -> list[TextModel]:
    """A model for each fold of the texts, trained as by ``train`` on what is not in that fold (on all, for one fold).

    So no text is judged by a model that has seen its own label.
    """
    usable = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # A threshold on the hash rather than a sort of texts: counts tell what share of a language is needed.
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()}
    return [_train(usable if folds == 1 else usable.where(_fold("text", folds) != k), sizes, rows) for k in range(folds)]


def _train(usable: DataFrame, sizes: dict[str, int], rows: int) -> TextModel:
    bar = F.lit(None).cast("double")
    for name, n in sizes.items():
        bar = F.when(F.col("label") == name, min(1.0, rows / n)).otherwise(bar)
    chosen = usable.where(F.pmod("h", F.lit(1_000_003)) < bar * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.bincount(_codes(data), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], names=["label", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in chosen.select("label", F.col("text").cast("binary").alias("b")).coalesce(32).transform(map_batches, run, "label string, counts binary").toLocalIterator():
        total[r["label"]] = total.get(r["label"], 0) + np.frombuffer(r["counts"], "<i8")
    names = tuple(sorted(sizes))
    counts = np.array([total.get(n, np.zeros(BUCKETS)) for n in names], float).reshape(len(names), BUCKETS) + 0.2
    return TextModel(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def text_evidence(df: DataFrame, model: TextModel, text: str, keep: list[str], markup: bool = False) -> DataFrame:
    """``keep`` and ``evidence array<double>``: log-likelihoods by language, null for texts without letters."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.log_likelihoods(visible(x) if markup else x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array([None if f is None else f.astype(float).tolist() for f in found], pa.list_(pa.float64()))], names=[*keep, "evidence"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.transform(map_batches, run, f"{kinds}, evidence array<double>")


def markup_language(html: str = "html") -> Column:
    """Two-letter language that the html element declares, or null."""
    found = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})\b", 1))
    return F.when(found != "", found)


def address_language(url: str = "url", languages: tuple[str, ...] = ()) -> Column:
    """Language that a path segment, else the host's country suffix, points to, or null."""
    u = F.lower(F.coalesce(F.col(url), F.lit("")))
    segment = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*\.([a-z]{2})(?:[:/?#]|$)", 1)
    by_suffix = F.lit(None).cast("string")
    for country, language in SUFFIXES.items():
        by_suffix = F.when(suffix == country, language).otherwise(by_suffix)
    return F.when(segment.isin(*languages), segment).otherwise(by_suffix)


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda w: w / total)


def fuse(evidence: DataFrame, languages: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Combine evidence by Bayes' rule.

    ``evidence`` has ``keep``, ``evidence``, ``declared``, ``address``, ``host`` and
    ``domain``.  Returns ``keep``, ``language``, ``posterior`` and ``accepted``.
    Unknown declarations and addresses say nothing; null hosts share one prior.
    A model that has seen no labelled text knows no language: all are null, and
    every text with letters is accepted.
    """
    n = len(languages)
    if not n:
        nothing = F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior")
        return evidence.select(*keep, *nothing, F.col("evidence").isNotNull().alias("accepted"))

    def odds(c: str, weight: float) -> Column:
        right = F.array(*[(F.col(c) == x).cast("int") for x in languages])
        return F.when(F.col(c).isin(*languages), F.transform(right, lambda x: x * F.lit(float(np.log(weight))))).otherwise(F.array_repeat(F.lit(0.0), n))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    held = materialize(evidence, "evidence")
    own = held.withColumn("logs", add(add(F.coalesce("evidence", F.array_repeat(F.lit(0.0), n)), odds("declared", DECLARED_ODDS)), odds("address", ADDRESS_ODDS)))
    own = own.withColumns({"host": F.coalesce("host", F.lit("")), "domain": F.coalesce("domain", F.lit(""))})
    # Expected documents of each language, before any host's prior; texts without letters have no part in them.
    soft = own.where("evidence is not null").withColumn("p", _posterior(F.col("logs")))
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(n)]
    hosts = soft.groupBy("host", "domain").agg(*sums)
    hosts = materialize(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(n)])
    everything = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]).first()
    whole = [float(everything[i] or 0.0) + 1.0 for i in range(n)]
    prior = [x / sum(whole) for x in whole]
    sum_of = lambda letter: sum((F.col(f"{letter}{i}") for i in range(1, n)), F.col(f"{letter}0"))
    domain_prior = [(F.col(f"d{i}") + DOMAIN_WEIGHT * prior[i]) / (sum_of("d") + DOMAIN_WEIGHT) for i in range(n)]
    host_prior = [(F.col(f"n{i}") + HOST_WEIGHT * domain_prior[i]) / (sum_of("n") + HOST_WEIGHT) for i in range(n)]
    priors = materialize(hosts.join(domains, "domain").select("host", "domain", F.array(*[F.log(p) for p in host_prior]).alias("prior")), "priors")
    known = attach(own, priors, ["host", "domain"], rows=100_000)
    post = known.withColumn("post", _posterior(add(F.col("logs"), F.coalesce("prior", F.array(*[F.lit(float(np.log(p))) for p in prior])))))
    best = F.array_max("post")
    return post.select(*keep, F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("post", best).cast("int")).alias("language"), best.alias("posterior"), (F.col("evidence").isNotNull() & (best >= LEAST_POSTERIOR)).alias("accepted"))


def identify_pages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, language, posterior, accepted)`` of every page.

    Pages without letters take the language of the other evidence and are not
    accepted.  Null URLs and markup give no evidence; repeated rows count each;
    an empty table gives no rows; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    marked = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"), markup_language(html).alias("declared"), address_language(url, model.languages).alias("address"), host.alias("host"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"))
    keep = ["page_id", "declared", "address", "host", "domain"]
    return fuse(text_evidence(marked, model, "html", keep, markup=True), model.languages, ["page_id"])


def identify_documents(docs: DataFrame, model: TextModel | list[TextModel], keep: list[str], text: str = "text", declared: str = "lang", source: str = "source") -> DataFrame:
    """``keep``, ``language``, ``posterior``, ``accepted`` of every document; its source stands for host and domain.

    Of several models, those of ``train_folds``, each judges its own fold.  Texts
    of any length are read whole; null and letterless ones are not accepted;
    repeated rows count each; ties go to the language that is first by name; an
    empty table gives no rows; other columns are not read.
    """
    models = model if isinstance(model, list) else [model]
    marked = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"), F.col(declared).alias("declared"), F.lit(None).cast("string").alias("address"), F.col(source).alias("host"), F.col(source).alias("domain"))
    columns = [*keep, "declared", "address", "host", "domain"]
    evidence = [text_evidence(marked if len(models) == 1 else marked.where(_fold("_text", len(models)) == k), m, "_text", columns) for k, m in enumerate(models)]
    return fuse(reduce(DataFrame.unionByName, evidence), models[0].languages, keep)
