"""Secret scans in Spark's own functions: patterns, and a randomness test battery.

Base kinds are found by pattern (leftmost, not overlapping, each kind on its own): ``assign`` (a key name, a
separator and a value of 6 or more), ``access`` (AKIA ids of 20 or more) and ``hex`` (24 or more).

The battery looks at every maximal run of 20 or more characters of ``A-Za-z0-9+/_-`` with a digit and a letter.
Its encoding is inferred as the smallest alphabet that holds it (hex in either case, base32, letters of one case and
digits, letters and digits, base64, base64url; in the last three with both cases). A run that fits none is cut: its
longest parts without ``/_-``, then those without ``/``, are candidates of their own where they have 20 characters,
a digit and a letter, and so is what lies between. A candidate that fits no encoding even then (a UUID) is tested
by its letters and digits, or, if they are fewer than 20, as a string over all 66 characters. Under "the symbols are drawn evenly and
independently" it gets three p-values: chi-squared of the symbol counts, runs above and below the middle of
the alphabet, and the correlation of neighbours. Fisher's rule combines them. Two rates of false decisions are then held by length
class, as the tests are stronger on longer strings:

* what is dismissed: the Benjamini-Hochberg procedure rejects randomness for structured strings, so that at most
  ``rate`` of the dismissed strings are random keys;
* what is reported: keys have even p-values, so those above one half tell how many there are (Storey's estimate, one
  added), and thus how many of the strings that would be reported aren't keys. Levels are left out, those of the
  smallest p-values first, until these are at most ``report_rate`` of the reported; a class where they never are
  reports nothing.

What stays, and doesn't lie within a base span, is a span of kind ``random``. P-values are rounded up to tenths of a
decade, so a class needs counts of 61 levels only, and the procedures are exact for the rounded values at any size of
the corpus.

Places are running sums over rows of matches, so a text costs in proportion to its matches.

Cases: a null or empty text has no spans; equal texts get equal spans; an empty table gives an empty result;
other columns are ignored. Places are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesio.storage import Tables

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings by name, alphabet and what else a string must hold.
ENCODINGS = (
    ("hex", "0123456789abcdef", ("[0-9]", "[a-f]")),
    ("HEX", "0123456789ABCDEF", ("[0-9]", "[A-F]")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ("[2-7]", "[A-Z]")),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ("[0-9]", "[A-Z]", "[a-z]")),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ("[0-9]", "[A-Z]", "[a-z]")),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", ("[0-9]", "[A-Z]", "[a-z]")),
)
#: The encodings of one case with all digits. The SQL of the query has ENCODINGS alone.
ONE_CASE = (
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", ("[0-9]", "[a-z]")),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("[0-9]", "[A-Z]")),
)
#: What the parts of a run that fits no encoding consist of, and the alphabet of what can't be told.
PARTS = ("A-Za-z0-9+", "A-Za-z0-9+_-")
ALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
LEAST = 20
#: Length classes begin at these lengths, in symbols.
CLASSES = (20, 28, 40, 64)


def pieces(text: Column, pattern: str, kind: int) -> Column:
    """Of all matches: kind, number, characters before it since the last one, its own, and those of group 1; candidates' text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == 0 else found
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("b"), found.alias("m"), value.alias("v")), lambda p: p["m"].isNotNull())
    one = lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(p["b"]).alias("gap"), F.char_length(p["m"]).alias("size"), F.char_length(p["v"]).alias("value"), (F.when(is_candidate(p["m"]), p["m"]) if kind == 3 else F.lit(None).cast("string")).alias("text"))
    return F.transform(pairs, one)


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, i, gap, size) with start and end in the keys' text."""
    so_far = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    return ends.withColumn("start", F.col("end") - F.col("size")).drop("i", "gap", "size")


def tail(z: Column) -> Column:
    """P(Z > z) of a normal Z for z >= 0 (a rational approximation with an error below 1e-7), at least 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * poly, F.lit(1e-7))


def fitting(text: str) -> tuple[Column, Column]:
    """Name and alphabet of the first encoding that holds the column, null where none does."""
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, letters, needs in reversed(ENCODINGS + ONE_CASE):
        fits = F.translate(text, letters, "") == ""
        for need in needs:
            fits = fits & F.col(text).rlike(need)
        name, alphabet = F.when(fits, key).otherwise(name), F.when(fits, letters).otherwise(alphabet)
    return name, alphabet


def is_candidate(text: Column) -> Column:
    return (F.char_length(text) >= LEAST) & text.rlike("[0-9]") & text.rlike("[A-Za-z]")


def divided(tokens: DataFrame, letters: str) -> DataFrame:
    """Rows that aren't ``whole`` give way to their longest parts of these letters, which are, and to what lies between."""
    own = rf"[{letters}]"
    pattern = rf"(?<!{own})(?={own}*[0-9])(?={own}*[A-Za-z]){own}{{{LEAST},}}+"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    each = tokens.where("not whole").select("row", F.col("start").alias("token"), F.posexplode(F.arrays_zip(F.split("text", pattern, -1).alias("b"), found.alias("m"))).alias("i", "p"))
    size = F.coalesce(F.char_length("p.m"), F.lit(0))
    parts = placed(each.select("row", "token", "i", F.char_length("p.b").alias("gap"), size.alias("size"), F.col("p.b").alias("between"), F.col("p.m").alias("part")), "row", "token")
    at = F.col("token") + F.col("start")
    inside = parts.where("part is not null").select("row", at.alias("start"), F.col("part").alias("text"), F.lit(True).alias("whole"))
    outside = parts.where(is_candidate(F.col("between"))).select("row", (at - F.char_length("between")).alias("start"), F.col("between").alias("text"), F.lit(False).alias("whole"))
    return tokens.where("whole").unionByName(inside).unionByName(outside)


def battery(tokens: DataFrame) -> DataFrame:
    """For rows with a column ``text``: encoding, the symbols tested under it, the three p-values and ``p`` of all."""
    bare = F.regexp_replace("text", "[+/_-]", "")
    rows = tokens.withColumn("symbols", F.when(fitting("text")[0].isNull() & (F.char_length(bare) >= LEAST), bare).otherwise(F.col("text")))
    name, alphabet = fitting("symbols")
    rows = rows.withColumn("encoding", F.coalesce(name, F.lit("all"))).withColumn("alphabet", F.coalesce(alphabet, F.lit(ALL)))
    rows = rows.withColumn("a", F.char_length("alphabet")).withColumn("n", F.char_length("symbols"))
    counts = F.expr("aggregate(transform(sequence(1, a), k -> n - char_length(replace(symbols, substr(alphabet, k, 1), ''))), 0D, (s, c) -> s + c * c)")
    rows = rows.withColumn("chi", F.col("a") * counts / F.col("n") - F.col("n"))
    rows = rows.withColumn("x", F.expr("transform(filter(split(symbols, ''), c -> c <> ''), c -> locate(c, alphabet) - 1)"))
    rows = rows.withColumn("high", F.expr("cast(size(filter(x, v -> 2 * v >= a)) as double)"))
    rows = rows.withColumn("runs", F.expr("1D + size(filter(sequence(1, n - 1), i -> (2 * x[i] >= a) <> (2 * x[i - 1] >= a)))"))
    rows = rows.withColumn("products", F.expr("aggregate(sequence(1, n - 1), 0D, (s, i) -> s + (x[i] - (a - 1) / 2D) * (x[i - 1] - (a - 1) / 2D))"))
    k, n, high = F.col("a") - 1, F.col("n"), F.col("high")
    z_chi = (F.pow(F.col("chi") / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    low = n - high
    mean = 2 * high * low / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when((high == 0) | (low == 0), 99.0).otherwise(F.abs(F.col("runs") - mean) / F.sqrt(var))
    z_serial = F.abs(F.col("products")) / ((F.col("a") * F.col("a") - 1) / 12 * F.sqrt(n - 1))
    rows = rows.withColumn("p_chi", F.when(z_chi >= 0, tail(z_chi)).otherwise(1 - tail(-z_chi))).withColumn("p_runs", F.least(2 * tail(z_runs), F.lit(1.0))).withColumn("p_serial", F.least(2 * tail(z_serial), F.lit(1.0)))
    h = -(F.ln("p_chi") + F.ln("p_runs") + F.ln("p_serial"))
    return rows.withColumn("p", F.exp(-h) * (1 + h + h * h / 2)).drop("alphabet", "a", "n", "chi", "x", "high", "runs", "products")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own) and the pieces of each text; no text is kept but that of candidates."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*(pieces(text, pattern, kind) for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, RUN))))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), found.alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end and, of candidates, text of all matches that count."""
    each = scanned.select("row", F.explode("found").alias("p")).select("row", "p.kind", "p.i", "p.gap", "p.size", "p.value", "p.text")
    return placed(each, "row", "kind").where("kind in (1, 2) or kind = 0 and value >= 6 or text is not null").drop("value")


def levels(found: DataFrame) -> DataFrame:
    """row and a row per candidate: start, end, encoding, class, p and its level."""
    tokens = found.where("kind = 3").select("row", "start", "text")
    tokens = tokens.withColumn("whole", fitting("text")[0].isNotNull())
    for letters in PARTS:
        tokens = divided(tokens, letters)
    tokens = tokens.withColumn("end", F.col("start") + F.char_length("text"))
    level = F.least(F.floor(-10 * F.log10("p")), F.lit(60)).cast("int")
    size = F.char_length("symbols")
    kind = F.lit(0)
    for k, least in enumerate(CLASSES):
        kind = F.when(size >= least, k).otherwise(kind)
    return battery(tokens).withColumn("class", kind).withColumn("level", level).drop("text", "symbols", "whole")


def level_counts(candidates: DataFrame) -> list[dict[int, int]]:
    """For each length class how many candidates have each level."""
    rows = candidates.groupBy("class", "level").count().collect()  # 4 classes by 61 levels at most
    return [{r["level"]: r["count"] for r in rows if r["class"] == k} for k in range(len(CLASSES))]


def rejected_from(own: dict[int, int], rate: float = 0.05) -> int:
    """The least level at which randomness is rejected (61: at none)."""
    out, total, reached = 61, sum(own.values()), 0
    for level in range(60, -1, -1):
        reached += own.get(level, 0)
        if own.get(level) and 10 ** (-level / 10) <= rate * reached / total:
            out = level
    return out


def reported_below(own: dict[int, int], least: int, rate: float = 0.5) -> int:
    """The level, at most ``least``, below which candidates are reported: at most that share of them aren't random."""
    keys = (1 + sum(n for level, n in own.items() if level < 3)) / (1 - 10**-0.3)
    for top in range(least, 0, -1):
        reported = sum(n for level, n in own.items() if level < top)
        if reported and reported - min(reported, keys * (1 - 10 ** (-top / 10))) <= rate * reported:
            return top
    return 0


def find(docs: DataFrame, store: Tables, rate: float = 0.05, report_rate: float = 0.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random."""
    scanned = store(scan(docs), "scanned")
    found = store(spans(scanned), "found")
    candidates = store(levels(found), "candidates")
    kept = F.lit(False)
    for k, own in enumerate(level_counts(candidates)):
        kept = kept | ((F.col("class") == k) & (F.col("level") < reported_below(own, rejected_from(own, rate), report_rate)))
    both = found.where("kind < 3").select("row", "start", "kind", "end").unionByName(candidates.where(kept).select("row", "start", F.lit(3).alias("kind"), "end"))
    # A base span that begins no later and ends no earlier holds a candidate.
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.coalesce(F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before), F.lit(-1))
    own = both.withColumn("held", held).where("kind < 3 or held < end").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    rows = scanned.select("row", "doc_id").join(own, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    kinds = F.array(*map(F.lit, KINDS))
    written = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter(every, lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(written(F.filter(every, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), written(every).alias("spans"), number(3).alias("n_random"))
