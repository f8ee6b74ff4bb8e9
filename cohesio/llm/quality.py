"""Quality rules for documents, and verdicts on hosts that shrink towards an empirical beta prior.

Rules of a document: ``short`` (under 50 words), ``repeats`` (over half of its words in repeated 3-word
windows), ``symbols`` (over one of ``#*$%&|<>`` for ten words), ``lines`` (over three in ten lines repeat an
earlier one) and ``lengths`` (mean word length outside 2 to 15). The first two are the base: either rejects.

Host rules: failures of each rule are summed by domain (that of the column source where it is a URL, else its
value), and a beta-binomial model is fitted to all domains by moments weighted by their documents: the spread of
rates beyond what chance gives at those sizes tells the prior. A domain's rate shrinks towards the common one:
(failures + a) / (documents + a + b). A domain where a shrunk rate is over one half is rejected; of it only
documents that fail no rule are kept. Clean documents thus stay, whatever their domain. Where the spread is no
more than chance gives, or can't be told (one domain, or one document each), every domain has the common rate.

Cases: a null or empty text has no words and fails; a null source counts as the domain ''; repeated rows
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("short", "repeats", "symbols", "lines", "lengths")
#: White space between words, and the symbols that are counted: fixed values.
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: A URL's domain, without user, port and www.
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]+)"

SALTS = 64


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    m = len(seen)
    if m < 1 << 20:
        windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * m + ids[2:]
    order = np.argsort(windows)
    equal = np.diff(windows[order]) == 0
    if not equal.any():
        return 0
    twice = np.zeros(len(windows) + 2, dtype=bool)
    twice[order[:-1][equal]] = twice[order[1:][equal]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def measure_text(text: str) -> tuple[int, int, int, int, int, int]:
    """The MEASURES of a text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words)


def domain(source: Column) -> Column:
    """The domain of a URL, lower case and without www., of any other value that value; null as ''."""
    source = F.coalesce(source, F.lit(""))
    found = F.regexp_extract(source, URL, 1)
    return F.when(found != "", F.lower(found)).otherwise(source)


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, host and MEASURES of every document (columns text and source), and the rules it fails."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure_text(x.as_py() or "") for x in batch.column(len(keys) + 1)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *(pa.array(found[:, k].copy()) for k in range(len(MEASURES)))], names=[*keys, "host", *MEASURES])

    rows = docs.select(*keys, domain(F.col("source")).alias("host"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(task, kinds + "".join(f", {m} long" for m in MEASURES))
    fails = {
        "short": "n_words < 50",
        "repeats": "100 * n_repeat_words > 50 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "lines": "10 * n_dup_lines > 3 * n_lines",
        "lengths": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    }
    return found.select("*", *(F.expr(fails[r]).alias(f"fails_{r}") for r in RULES))


def prior_weight(hosts: int, docs: float, squares: float, failed: float, spread: float) -> float | None:
    """a + b of the beta prior, None where the common rate is all there is.

    hosts, the sums of their documents n and of n * n, of failures k and of k * k / n.
    """
    if not docs or not 0 < failed < docs:
        return None
    rate = failed / docs
    room = docs - squares / docs - (hosts - 1)  # 0 where each has one document
    if room <= 1e-9 * docs:
        return None
    # The share of the variance that lies between hosts.
    between = ((spread - rate * failed) / (rate * (1 - rate)) - (hosts - 1)) / room
    return None if between <= 1e-9 else 1 / min(between, 1.0) - 1


def host_verdicts(measured: DataFrame, limit: float = 0.5) -> DataFrame:
    """host, n_docs, the shrunk failure rate of each rule, and host_rejected."""
    counts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES))
    n = F.col("n_docs").cast("double")
    sums = [F.sum(F.col(r)).alias(f"k_{r}") for r in RULES] + [F.sum(F.col(r) * F.col(r) / n).alias(f"kk_{r}") for r in RULES]
    found = counts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *sums).first()  # 13 numbers, whatever the data

    def shrunk(r: str):
        if not found["hosts"]:
            return F.lit(0.0).alias(f"rate_{r}")
        mean = found[f"k_{r}"] / found["n"]
        weight = prior_weight(found["hosts"], found["n"], found["nn"], float(found[f"k_{r}"]), found[f"kk_{r}"])
        if weight is None:
            return F.lit(mean).alias(f"rate_{r}")
        return ((F.col(r) + mean * weight) / (n + weight)).alias(f"rate_{r}")

    both = counts.select("host", "n_docs", *map(shrunk, RULES))
    return both.withColumn("host_rejected", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > limit)


def judged(measured: DataFrame) -> DataFrame:
    """measured with base_failed, host_rejected and kept; measured is read twice, so it should be a table."""
    # A host may have a third of all documents, so the join is salted; rejected hosts are few.
    bad = host_verdicts(measured).where("host_rejected").select("host", "host_rejected", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in measured.columns)), F.lit(SALTS)).cast("int")
    any_rule = F.greatest(*(F.col(f"fails_{r}") for r in RULES))
    base = F.col("fails_short") | F.col("fails_repeats")
    rejected = F.coalesce("host_rejected", F.lit(False))
    salted = measured.withColumn("_salt", salt).join(bad, ["host", "_salt"], "left").drop("_salt")
    return salted.withColumn("base_failed", base).withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & any_rule))
