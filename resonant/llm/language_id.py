"""Operator 5: language identification by Bayesian evidence fusion.

For each document and language the log posterior adds up

* the text: byte trigrams of the whole lower-cased text under an additively
  smoothed multinomial model, times ``dependence`` (trigrams overlap); a further
  class, ``und``, spreads its trigrams evenly and stands for what is no language;
* the declared markup language and the address suffix (last host label, or a
  path's first part, where it names a language), each right with a fixed
  reliability;
* the host's prior: posteriors from text and declaration alone, summed by grouped
  aggregation per host, per domain and over all, each level smoothed towards the
  next by ``alpha`` documents.

The text model is fitted on labelled rows of a table of its own: at most
``FIT_ROWS`` of each language, those of least hash; all other counts cover every
row. The label may not be the column that serves as evidence. Declarations and
labels are compared by their primary subtag (``en-US`` is ``en``). Priors are
joined by host, never collected or broadcast.

Defined cases: a text without a letter (null, empty, digits only) is ``und`` and
rejected; one too short for a trigram goes by its other evidence; a row whose
best posterior is below ``least`` is rejected; a null host takes
the overall prior; a null or unknown declaration is no evidence; of equal posteriors
the language of least name wins; repeated rows count each; without any label every
row is ``und``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .scratch import materialise
from .workers import returning

#: Labelled rows of each language that the text model is fitted on, at most.
FIT_ROWS = 1000
BUCKETS = 1 << 15
UND = "und"


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams with a letter and without a digit, the texts' offsets among them, and each text's letters."""
    low = bytescan.lower_latin(data)
    digit = (low >= 48) & (low < 58)
    letter = bytescan.ALPHANUMERIC[low] & ~digit
    letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[offsets])
    if len(low) < 3:
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64), letters
    code = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    use = (letter[:-2] | letter[1:-1] | letter[2:]) & ~(digit[:-2] | digit[1:-1] | digit[2:])
    for cut in (1, 2):  # a trigram lies within its text
        at = offsets[1:] - cut
        use[at[(at >= 0) & (at < len(use))]] = False
    so_far = np.concatenate([[0], np.cumsum(use), np.full(2, use.sum())])
    return code[use], so_far[offsets], letters


def primary(tag):
    """The primary subtag of a language tag, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.trim(tag.cast("string")), r"^([A-Za-z]+)", 1))


def _count(batches):
    """(label, bucket, n): trigrams of each batch by label, the buckets that occur."""
    for batch in batches:
        totals: dict[str, np.ndarray] = {}
        data, offsets = bytescan.text_buffer(batch.column("text"))
        labels = batch.column("label").to_pylist()
        for i, j in bytescan.pieces(offsets):
            codes, cuts, _ = _codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for t in range(j - i):
                own = totals.setdefault(labels[i + t], np.zeros(BUCKETS, np.int64))
                own += np.bincount(codes[cuts[t] : cuts[t + 1]], minlength=BUCKETS)
        for label, counts in totals.items():
            at = np.flatnonzero(counts)
            # a label whose texts are too short for a trigram is still a language
            at = at if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["label", "bucket", "n"])


def fit(rows: DataFrame, most: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and their log probability of each trigram bucket, from rows (text, label): at most ``most`` of each label.

    Counts are summed in the cluster; a vector of ``BUCKETS`` numbers for each language reaches the driver.
    """
    named = rows.select(primary(F.col("label")).alias("label"), F.col("text").cast("binary").alias("text")).where("label <> '' and text is not null")
    keyed = named.withColumn("key", F.xxhash64("text"))
    # the ranking's limit is applied before its shuffle, of which texts are no part
    rank = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    chosen = keyed.select("label", "key").withColumn("rank", rank).where(F.col("rank") <= most).select("label", "key").distinct()
    counted = keyed.join(chosen, ["label", "key"], "left_semi").dropDuplicates(["label", "key"]).select("label", "text").mapInArrow(returning(_count), "label string, bucket long, n long")
    found = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r[0] for r in found})
    counts = np.full((len(names), BUCKETS), 0.05)
    place = {n: i for i, n in enumerate(names)}
    for label, bucket, n in found:
        counts[place[label], bucket] += n
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)) if names else counts


def _score(names: list[str], model, dependence: float):
    def run(batches):
        table = model.value
        for batch in batches:
            data, offsets = bytescan.text_buffer(batch.column("text"))
            n = len(offsets) - 1
            out, seen = np.zeros((n, len(names) + 1)), np.zeros(n, np.int64)
            for i, j in bytescan.pieces(offsets):
                codes, cuts, seen[i:j] = _codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out[i:j, -1] = -np.log(BUCKETS) * np.diff(cuts)
                for c in range(len(names)):
                    total = np.concatenate([[0], np.cumsum(table[c][codes])])
                    out[i:j, c] = np.diff(total[cuts])
            lists = pa.FixedSizeListArray.from_arrays(pa.array((out * dependence).ravel()), len(names) + 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("declared"), batch.column("host"), batch.column("suffix"), pa.array(seen), lists],
                                             names=["doc_id", "declared", "host", "suffix", "seen", "text_ll"])

    return run


def identify(docs: DataFrame, training: DataFrame, text: str = "text", declared: str | None = "lang", address: str | None = "source", key: str = "doc_id",
             least: float = 0.5, alpha: float = 20.0, dependence: float = 0.2, trust_declared: float = 0.9, trust_suffix: float = 0.8, und_prior: float = 0.01) -> DataFrame:
    """doc_id (the column ``key``), language, confidence, second (runner-up), n_letters and accepted of every row.

    ``training`` holds text and label, from elsewhere than the column ``declared``;
    ``address`` is a host or a URL.
    """
    null = F.lit(None).cast("string")
    where = F.col(address).cast("string") if address else null
    host = F.lower(F.regexp_replace(F.regexp_extract(where, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1), r"^www\.|:[0-9]+$", ""))
    path = F.regexp_extract(where, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/_-]|$)", 1)
    tail = F.when(F.instr(host, ".") > 0, F.element_at(F.split(host, r"\."), -1))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), (primary(F.col(declared)) if declared else null).alias("declared"),
        F.when(host != "", host).alias("host"), F.when(path != "", F.lower(path)).otherwise(tail).alias("suffix"))
    names, model = fit(training)
    classes = [*names, UND]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, declared string, host string, suffix string, seen long, text_ll array<double>"
    scored = rows.mapInArrow(returning(_score(names, sent, dependence)), schema)

    def told(column: str, trust: float, c: str):
        known = F.col(column).isin(names) if names else F.lit(False)
        miss = float(np.log((1 - trust) / max(1, len(classes) - 1)))
        return F.when(known, F.when(F.col(column) == c, float(np.log(trust))).otherwise(miss)).otherwise(0.0)

    evidence = F.array(*[F.element_at("text_ll", i + 1) + told("declared", trust_declared, c) + told("suffix", trust_suffix, c) for i, c in enumerate(classes)])
    scored = materialise(scored.select("doc_id", "host", "seen", evidence.alias("ll")), "language-evidence")

    def posterior(rows: DataFrame, terms) -> DataFrame:
        """``rows`` with the column p, the normalised exponentials of an array of logs."""
        rows = rows.withColumn("p", terms)
        rows = rows.withColumn("p", F.transform("p", lambda x: F.exp(x - F.array_max("p"))))
        return rows.withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda t, y: t + y)))

    # hierarchical priors: all rows, domain (last two labels), host
    size = len(classes)
    per_host = posterior(scored, F.col("ll")).groupBy("host").agg(*[F.sum(F.element_at("p", i + 1)).alias(f"c{i}") for i in range(size)], F.count("*").alias("n"))
    per_host = per_host.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]+)$", 1))
    per_domain = per_host.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in range(size)], F.sum("n").alias("dn"))
    overall = per_domain.agg(*[F.sum(f"d{i}").alias(f"a{i}") for i in range(size)], F.sum("dn").alias("an"))
    floor = [(1 - und_prior) / max(1, len(names))] * len(names) + [und_prior]
    top = [(F.col(f"a{i}") + alpha * f) / (F.col("an") + alpha) for i, f in enumerate(floor)]
    mid = [(F.col(f"d{i}") + alpha * t) / (F.col("dn") + alpha) for i, t in enumerate(top)]
    own = [(F.col(f"c{i}") + alpha * m) / (F.col("n") + alpha) for i, m in enumerate(mid)]
    priors = (per_host.join(per_domain, per_host.domain.eqNullSafe(per_domain.domain)).join(F.broadcast(overall))
              .select(F.col("host").alias("_host"), F.array(*[F.log(F.when(F.col("host").isNull(), t).otherwise(o)) for t, o in zip(top, own)]).alias("prior")))
    fused = posterior(scored.join(priors, F.col("host").eqNullSafe(F.col("_host"))), F.zip_with("ll", "prior", lambda x, y: x + y))
    ranked = F.sort_array(F.transform("p", lambda x, i: F.struct((-x).alias("p"), F.element_at(F.array(*map(F.lit, classes)), i + 1).alias("c"))))
    out = fused.select("doc_id", "seen", ranked.alias("r"))
    best, second = F.element_at("r", 1), F.get("r", F.lit(1))
    none = F.col("seen") == 0
    return out.select(
        "doc_id", F.when(none, UND).otherwise(best.c).alias("language"), F.when(none, 0.0).otherwise(-best.p).alias("confidence"),
        F.when(~none, second.c).alias("second"), F.col("seen").alias("n_letters"),
        (~none & (best.c != UND) & (-best.p >= least)).alias("accepted"))


def of_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, the text of the page, and the language that its markup declares."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select("page_id", "url", F.regexp_replace(text, r"&[A-Za-z0-9#]+;", " ").alias("text"), F.when(declared != "", declared).alias("declared"))
