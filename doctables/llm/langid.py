"""Language identification that fuses text likelihoods with declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.wordcache import portions
from doctables.llm.work import saved

BITS = 14  #: letter trigrams are hashed to 2^BITS buckets
SAMPLE = 1000  #: documents of each label that the text model is fitted on, the bound of what it reads
EVIDENCE = 60.0  #: trigrams count as so many independent ones at most
STRENGTH = 20.0  #: pseudo-documents that a level of the hierarchy hands to the one below
EVEN = 0.2  #: weight of the even distribution in every label's, so that unseen trigrams cost little each
UNKNOWN = "und"
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"  #: what _grams takes as part of a trigram
_BLANK = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams of the texts, and how many each text has."""
    raw = [t.lower().encode().translate(_BLANK) for t in texts]
    codes = np.frombuffer(b" " + b"  ".join([*raw, b""]), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(r) + 2 for r in raw])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    real = ~(((a == 32) & (b == 32)) | ((b == 32) & (c == 32)))
    mixed = (((a << 16) | (b << 8) | c) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    total = np.concatenate(([0], np.cumsum(real)))
    stops = total[np.minimum(ends, len(real))]
    return mixed[real], np.diff(np.concatenate(([0], stops)))


@dataclass(frozen=True)
class TextModel:
    """Labels, and the log probability of each trigram bucket per label; the last column is no language."""

    labels: list[str]
    table: np.ndarray


def fit_text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Trigram counts of every label, from its `sample` documents that come first in a hash of their id.

    What comes back to the driver is the model: at most 2^BITS numbers for each label.
    A label of which no document has an id and letters has no column. Without labelled
    rows, the model knows no language.
    """
    first = Window.partitionBy("label").orderBy("h", "id")
    keys = (
        docs.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(LETTER) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.lit(1), F.col(id_col)).alias("h"))
        .withColumn("at", F.row_number().over(first))
        .filter(F.col("at") <= sample)
        .select("id", "label")
        .distinct()
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    chosen = rows.filter("label is not null and text is not null").join(keys, ["id", "label"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, texts in batch.groupby("label")["text"]:
                buckets = np.bincount(_grams(texts.tolist())[0], minlength=1 << BITS)
                at = np.flatnonzero(buckets)
                yield pd.DataFrame({"label": label, "bucket": at, "n": buckets[at]})

    counted = saved(
        chosen.select("label", "text").mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    )
    found = counted.toPandas()
    labels = sorted(set(found["label"]))
    size = 1 << BITS
    table = np.full((size, len(labels) + 1), -np.log(size))
    for label, own in found.groupby("label"):
        k, counts = labels.index(label), np.zeros(size)
        counts[own["bucket"].to_numpy(int)] = own["n"].to_numpy(float)
        table[:, k] = np.log((1 - EVEN) * counts / max(counts.sum(), 1.0) + EVEN / size)
    return TextModel(labels, table.astype(np.float32))


def text_evidence(text: Column, model: TextModel) -> Column:
    """struct(n, ll): number of letter trigrams, and their mean log likelihood per label, the last for no language."""
    shared = model.table

    @F.pandas_udf("n long, ll array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            plain = [t or "" for t in texts]
            counts, means = [], []
            for first, last in portions(map(len, plain), 1 << 21):
                grams, n = _grams(plain[first:last])
                sums = np.zeros((len(n), shared.shape[1]))
                filled = np.flatnonzero(n)
                if len(filled):
                    begins = (np.cumsum(n) - n)[filled]
                    for k in range(shared.shape[1]):
                        sums[filled, k] = np.add.reduceat(shared[grams, k].astype(np.float64), begins)
                counts.append(n)
                means.append(sums / np.maximum(n, 1)[:, None])
            yield pd.DataFrame(
                {"n": np.concatenate(counts) if counts else [], "ll": list(np.concatenate(means)) if means else []}
            )

    return run(text)


def host_of(url: Column) -> Column:
    """Lower-case host of an address, NULL if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    """Last label of a host name."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def declared_language(html: Column) -> Column:
    """Primary language of the lang attribute of the html element, NULL if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[#A-Za-z0-9]{1,31};", " ")


def identify(
    rows: DataFrame, model: TextModel, id: Column, text: Column, host: Column, suffix: Column, declared: Column,
    evidence: float = EVIDENCE, strength: float = STRENGTH, least: float = 0.5,
) -> DataFrame:
    """One row (row_id, language, posterior, accepted) per row.

    log P(language | row) is the sum of
    * the text's mean log likelihood times its trigrams, `evidence` at most;
    * log P(declared | language), from all rows' own text posteriors, smoothed;
    * log P(language | host): the host's summed text posteriors with `strength`
      pseudo-documents from its suffix, which has as many from all rows, which have
      as many spread evenly. A row's own text is taken out of each sum.

    No declared language, suffix or host (NULL) is no evidence. Texts without letters,
    empty and NULL texts are decided by the other evidence only and, as they show no
    language themselves, are not accepted. Accepted are rows with a language (not
    "und") and a posterior of `least`. Ties go to the label first in order. Counts are
    grouped sums; a host with a third of all rows is one group that map tasks
    pre-aggregate, and its join can be split.
    """
    labels = [*model.labels, UNKNOWN]
    count = len(labels)
    scored = rows.select(
        id.alias("row_id"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(suffix, F.lit("")).alias("suffix"),
        F.coalesce(declared, F.lit("")).alias("declared"),
        text_evidence(text, model).alias("e"),
    ).select("row_id", "host", "suffix", "declared", F.col("e.n").alias("n"), F.col("e.ll").alias("ll"))
    weight = F.least(F.col("n").cast("double"), F.lit(evidence))
    scored = scored.withColumn("t", F.transform("ll", lambda x: x * weight)).drop("ll")
    scored = saved(scored.withColumn("p", _shares(F.col("t"))))

    def sums(name: str, *keys: str) -> DataFrame:
        added = scored.groupBy(*keys).agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(count)])
        return added.select(*keys, F.array(*[f"s{k}" for k in range(count)]).alias(name))

    overall = [float(x or 0.0) for x in sums("g").first().g]
    hosts, suffixes, marks = saved(sums("h", "host")), saved(sums("s", "suffix")), saved(sums("d", "declared"))
    joined = scored.join(hosts, "host", "left").join(suffixes, "suffix", "left").join(marks, "declared", "left")
    everything = sum(overall)

    def without_own(name: str) -> Column:
        return F.zip_with(name, "p", lambda x, own: F.greatest(x - own, F.lit(0.0)))

    def level(name: str, key: str, above: Column) -> Column:
        lower = _let(
            _total(F.col("less")) + strength,
            lambda total: F.zip_with("less", above, lambda x, up: (x + up * strength) / total),
        )
        return F.when(F.col(key) == "", above).otherwise(lower)

    joined = joined.withColumn("q", F.lit([(x + strength / count) / (everything + strength) for x in overall]))
    for name, key in (("s", "suffix"), ("h", "host")):
        joined = joined.withColumn("less", without_own(name)).withColumn("q", level(name, key, F.col("q")))
    said = _let(
        (_total(F.col("d")) + 1.0) / (everything + 1.0),
        lambda share: F.zip_with(
            without_own("d"), F.lit([x + strength for x in overall]), lambda x, of: F.log((x + share * strength) / of)
        ),
    )
    joined = joined.withColumn("a", F.zip_with("t", "q", lambda t, q: t + F.log(q)))
    joined = joined.withColumn("a", F.when(F.col("declared") == "", F.col("a")).otherwise(F.zip_with("a", said, lambda x, y: x + y)))
    joined = joined.withColumn("r", _shares(F.col("a"))).withColumn("posterior", F.array_max("r"))
    language = F.element_at(F.lit(labels), F.array_position("r", F.col("posterior")).cast("int"))
    return joined.select("row_id", language.alias("language"), "posterior", "n").select(
        "row_id",
        "language",
        "posterior",
        ((F.col("n") > 0) & (F.col("language") != UNKNOWN) & (F.col("posterior") >= least)).alias("accepted"),
    )


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda x, y: x + y)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value found once; inside another lambda it would be found again for every element."""
    return F.transform(F.array(value), then)[0]


def _shares(logs: Column) -> Column:
    """exp of each, divided by their sum."""
    weights = _let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    return _let(weights, lambda w: _let(_total(w), lambda total: F.transform(w, lambda x: x / total)))


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Languages of web pages: (id, language, posterior, accepted); see `identify`."""
    host = host_of(F.col(url_col))
    html = F.col(html_col)
    found = identify(pages, model, F.col(id_col), visible_text(html), host, suffix_of(host), declared_language(html))
    return found.withColumnRenamed("row_id", id_col)


def identify_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Languages of documents, with their label as declared language and their source as host."""
    found = identify(
        docs, model, F.col(id_col), F.col(text_col), F.col(source_col).cast("string"), F.lit(None).cast("string"),
        F.col(lang_col).cast("string"),
    )
    return found.withColumnRenamed("row_id", id_col)
