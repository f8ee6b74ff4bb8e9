"""Personal data replaced by surrogates, in Spark's own functions.

Detected: e-mail addresses, IPv4 addresses, IBANs, card and account numbers (13 to 19 digits), US social
security numbers, phone numbers, and names after a title (one or two names, with particles such as "de la"
between; a lower-case title needs its full stop). An entity is its normal form: an address in lower case, its
domain, a number's digits, each run of two or more letters in a name. So an entity gets one surrogate wherever it
stands and however it is written, "Smith-Jones" shares its halves with "Smith" and "Jones", and a family name
keeps its surrogate with and without the given name. Where a document has names after titles, their words are
replaced at all other places of that document too, if they begin with a capital there.

A surrogate follows from a secret key, the kind and the entity. It keeps type and format: letters give
letters and digits digits in the same case and layout, an address keeps its top-level domain, a card number
its first digit and whether its check digit is right, an IBAN its country and whether its check digits are right,
an IP address stays one, a phone number keeps its country code; given names keep gender (from the title) and
names their script (Latin or Cyrillic), hyphens, apostrophes and particles.
All distinct entities get surrogates together: one that two entities would share, or that is itself an
entity of the data, goes to nobody else; the others try again with the next attempt's number until all
surrogates are distinct. Domains, e-mail addresses and names grow longer with the attempts, so room never runs out;
numbers of a fixed length may fill their format, which raises an error. Names of all kinds share one space.

Only rows with a match are joined to their surrogates; the others pass by. A match in very many documents is
salted.

Cases: null and empty texts stay; equal rows get equal texts; an empty table stays empty; all other columns
come back as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohesio.storage import Tables

#: Titles with the gender they tell, those that count in lower case with a full stop, and particles.
MALE, FEMALE, EITHER = ("Mr", "Herr", "Señor", "Monsieur", "Господин"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"), ("Dr", "Prof")
LOWER = ("mr", "mrs", "ms", "mme", "dr", "prof")
PARTICLES = ("de", "la", "le", "van", "von", "der", "den", "del", "di", "da", "dos", "du", "el", "al", "bin", "ibn", "ter")
#: Syllables of made-up names, by script, and endings by script and gender.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro".split(), "cyrillic": "ба бе би бо да де ди до фа фе га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро".split()}
ENDINGS = {("latin", "f"): "lina", ("latin", "m"): "ndro", ("latin", "e"): "ris", ("latin", "family"): "mann", ("cyrillic", "f"): "лина", ("cyrillic", "m"): "слав", ("cyrillic", "e"): "рис", ("cyrillic", "family"): "енко"}
TITLES = "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
_NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}))+"
_BEFORE = "(?:(?:" + "|".join(f"[{p[0].upper()}{p[0]}]{p[1:]}" for p in PARTICLES) + ") )*"
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
        r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
        r"(?<![\w.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\w)",
        r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)",
        r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
        r"(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
        rf"(?<!\p{{L}})(?:(?:{TITLES})(?!\p{{L}})\.?|(?:{'|'.join(LOWER)})\.) {_BEFORE}{_NAME}(?: {_BEFORE}{_NAME})?",
    )
)
#: A word of a name: one letter alone says nothing.
WORD = r"\p{L}{2,}"
IS_NAME = rf"^(?:(?:{TITLES})(?!\p{{L}})|(?:{'|'.join(LOWER)})\. )"
SALTS = 8


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _is_particle(word: Column) -> Column:
    return F.lower(word).isin(*PARTICLES)


def parts(match: Column) -> Column:
    """The entities of a match: an array of (kind, normal form)."""
    one = lambda kind, norm: F.array(F.struct(F.lit(kind).alias("kind"), norm.alias("norm")))
    digits, spaced = F.regexp_replace(match, r"\D", ""), F.split(match, " ")
    title = F.lower(F.regexp_replace(spaced[0], r"\.$", ""))
    gender = F.when(title.isin(*map(str.lower, MALE)), "m").when(title.isin(*map(str.lower, FEMALE)), "f").otherwise("e")
    family = F.transform(words(F.element_at(spaced, -1)), lambda w: F.struct(F.lit("family").alias("kind"), F.lower(w).alias("norm")))
    first = F.filter(F.slice(spaced, F.lit(2), F.greatest(F.size(spaced) - 2, F.lit(0))), lambda w: ~_is_particle(w))
    given = F.transform(F.flatten(F.transform(first, words)), lambda w: F.struct(F.concat(F.lit("given-"), gender).alias("kind"), F.lower(w).alias("norm")))
    return (
        F.when(match.contains("@"), F.concat(one("host", F.lower(F.substring_index(match, "@", -1))), one("email", F.lower(match))))
        .when(match.rlike(r"^[\d.]+$") & (F.size(F.split(match, r"\.")) == 4), one("ip", match))
        .when(match.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]"), one("iban", F.regexp_replace(match, " ", "")))
        .when(match.rlike(IS_NAME), F.concat(given, family))
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), one("ssn", digits))
        .when(match.rlike(r"^\+"), one("phone", F.concat(F.lit("+"), F.regexp_extract(match, r"^\+(\d{1,3})", 1), F.lit(":"), digits)))
        .when(F.length(digits) >= 13, one("card", digits))
        .otherwise(one("phone", F.concat(F.lit("+:"), digits)))
    )


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """The sum by which a card number is right when it ends in 0."""
    return F.aggregate(chars(F.reverse(digits)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), lambda a, c: F.struct((a["i"] + 1).alias("i"), (a["s"] + F.when(a["i"] % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))).alias("s")), lambda a: a["s"])


def mod97(text: Column) -> Column:
    """The rest by 97 of an IBAN's digits, letters as numbers from 10; it is right where this is 1 with the head at the end."""
    return F.aggregate(chars(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def drawn(seed: Column, i: Column, letters: str) -> Column:
    """A letter, as the hash of a seed and a number has it."""
    return F.substr(F.lit(letters), F.pmod(F.xxhash64(seed, i), F.lit(10_000_000)).cast("int") % len(letters) + 1, F.lit(1))


def scrambled(text: Column, seed: Column) -> Column:
    """Every ASCII letter and digit of text replaced by one of its class, as the seed's hash has it."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: drawn(seed, i, letters)
        return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(chars(text), one), "")


def surrogate(kind: Column, norm: Column, attempt: int, key: str, host: Column) -> Column:
    """The surrogate of an entity's normal form, itself in normal form; host is that of an e-mail address's domain."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt))), 256)
    # Later attempts are longer, where the format allows it.
    more = F.concat(F.lit(""), *(drawn(seed, F.lit(1000 + k), "abcdefghijklmnopqrstuvwxyz") for k in range(max(0, attempt - 2))))
    domain = F.concat(scrambled(F.regexp_replace(norm, r"\.[^.]+$", ""), seed), more, F.lit("."), F.substring_index(norm, ".", -1))
    email = F.concat(scrambled(F.substring_index(norm, "@", 1), seed), more, F.lit("@"), host)
    octet = lambda k: (F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(254)) + 1).cast("string")
    ip = F.concat_ws(".", *map(octet, range(4)))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), scrambled(F.substr(norm, F.lit(2), F.length(norm) - 2), seed))
    right = F.pmod(F.lit(10) - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    # A right check digit stays right, a wrong one wrong.
    off = lambda n: F.pmod(F.xxhash64(seed, F.lit("off")), F.lit(n)) + 1
    card = F.concat(body, F.pmod(right + F.when(luhn(norm) % 10 == 0, 0).otherwise(off(9)), F.lit(10)).cast("string"))
    code = F.regexp_extract(norm, r"^\+(\d*):", 1)
    rest = F.substr(norm, 3 + 2 * F.length(code), F.length(norm))
    phone = F.concat(F.lit("+"), code, F.lit(":"), code, scrambled(rest, seed))
    country, account = F.substr(norm, F.lit(1), F.lit(2)), scrambled(F.substr(norm, F.lit(5), F.length(norm)), seed)
    check = 98 - mod97(F.concat(account, country, F.lit("00")))
    fine = mod97(F.concat(F.substr(norm, F.lit(5), F.length(norm)), F.substr(norm, F.lit(1), F.lit(4)))) == 1
    iban = F.concat(country, F.lpad(F.when(fine, check).otherwise(F.pmod(check - 2 + off(96), F.lit(97)) + 2).cast("string"), 2, "0"), account)

    def name(script: str) -> Column:
        some = F.array(*map(F.lit, SYLLABLES[script]))
        syllable = lambda k: F.element_at(some, (F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(len(SYLLABLES[script]))) + 1).cast("int"))
        ending = F.lit(ENDINGS[script, "family"])
        for g in "mfe":
            ending = F.when(kind == f"given-{g}", ENDINGS[script, g]).otherwise(ending)
        return F.concat(*(syllable(k) for k in range(3 + attempt)), ending)

    names = F.when(norm.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
    return F.when(kind == "host", domain).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ssn", scrambled(norm, seed)).otherwise(names)


def space(kind: Column) -> Column:
    """Entities of one space never share a surrogate: names of all kinds have one, other kinds each their own."""
    return F.when((kind == "family") | kind.startswith("given-"), "name").otherwise(kind)


def assign(entities: DataFrame, key: str, store: Tables, tag: str = "entities", attempts: int = 200) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities (kind, norm, and host for e-mail addresses): none is an entity, no two share one."""
    taken = store(entities.select(space(F.col("kind")).alias("space"), F.col("norm").alias("surrogate")).distinct(), f"{tag}-taken")
    settled, pending = None, entities
    for attempt in range(attempts):
        tried = pending.select("kind", "norm", space(F.col("kind")).alias("space"), surrogate(F.col("kind"), F.col("norm"), attempt, key, F.col("host")).alias("surrogate"))
        won = tried.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "norm")).alias("e"))
        won = won.join(taken, ["space", "surrogate"], "left_anti")
        if settled is not None:
            won = won.join(settled.select(space(F.col("kind")).alias("space"), "surrogate"), ["space", "surrogate"], "left_anti")
        won = store(won.select("e.kind", "e.norm", "surrogate"), f"{tag}-won-{attempt}")
        settled = won if settled is None else settled.unionByName(won)
        pending = store(pending.join(won, ["kind", "norm"], "left_anti"), f"{tag}-pending-{attempt}")
        if pending.isEmpty():
            return settled
    raise ValueError("more entities of a kind than its format has room for")


def cased(text: Column, like: Column) -> Column:
    """text with capitals where like has them, place by place."""
    return F.array_join(F.transform(chars(text), lambda c, i: F.when(F.substr(like, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")


def as_word(found: Column, word: Column) -> Column:
    """A name's surrogate written like the word: all in capitals, or with one."""
    return F.when(F.upper(word) == word, F.upper(found)).otherwise(F.concat(F.upper(F.substr(found, F.lit(1), F.lit(1))), F.substr(found, F.lit(2), F.length(found))))


def swapped_words(text: Column, found: Column) -> Column:
    """text with the words that begin with a capital replaced where the map found (lower case to surrogate) has them."""

    def one(gap: Column, word: Column) -> Column:
        new = F.when(word.rlike(r"^\p{Lu}"), F.element_at(found, F.lower(word)))
        return F.concat(gap, F.when(new.isNotNull(), as_word(new, word)).otherwise(F.coalesce(word, F.lit(""))))

    return F.array_join(F.zip_with(F.split(text, WORD, -1), words(text), one), "")


def laid_out(match: Column, found: Column) -> Column:
    """The surrogates of a match (found: kind, norm, surrogate of each part) in the match's own layout and case."""
    kind = F.element_at(found, 1)["kind"]
    of = lambda k: F.filter(found, lambda p: p["kind"] == k)[0]["surrogate"]
    email = F.concat(cased(F.substring_index(of("email"), "@", 1), F.substring_index(match, "@", 1)), F.lit("@"), cased(of("host"), F.substring_index(match, "@", -1)))
    only = found[0]["surrogate"]
    bare = F.when(kind == "phone", F.regexp_replace(only, r"^\+\d*:", "")).otherwise(only)
    # Letters and digits of the match before each place tell which of the surrogate stands there.
    seen = F.transform(chars(match), lambda c, i: F.struct(c.alias("c"), F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), "[^0-9A-Z]", "")).alias("n")))
    fill = F.array_join(F.transform(seen, lambda s: F.when(s["c"].rlike("[0-9A-Z]"), F.substr(bare, s["n"], F.lit(1))).otherwise(s["c"])), "")
    names = lambda given: F.map_from_entries(F.array_distinct(F.transform(F.filter(found, lambda p: p["kind"].startswith("given-") == given), lambda p: F.struct(p["norm"].alias("norm"), p["surrogate"].alias("surrogate")))))
    spaced = F.split(match, " ")
    each = F.transform(spaced, lambda w, i: F.when((i == 0) | ((i < F.size(spaced) - 1) & _is_particle(w)), w).when(i == F.size(spaced) - 1, _rewritten(w, names(False))).otherwise(_rewritten(w, names(True))))
    return F.when(kind.isin("host", "email"), email).when(kind == "ip", only).when(kind.isin("card", "phone", "ssn", "iban"), fill).otherwise(F.array_join(each, " "))


def _rewritten(word: Column, found: Column) -> Column:
    """A word of a name (with hyphens and the like) with all its parts replaced."""
    return F.array_join(F.zip_with(F.split(word, WORD, -1), words(word), lambda gap, w: F.concat(gap, F.coalesce(as_word(F.element_at(found, F.lower(w)), w), w, F.lit("")))), "")


def replaced(docs: DataFrame, store: Tables, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates for all personal data in the text, and a last column of matches replaced: n_entities,
    with underscores after it as long as docs has that name. The key is the caller's secret."""
    counted = "n_entities"
    while counted.lower() in (c.lower() for c in docs.columns):
        counted += "_"
    # Under names of our own, so that no column of docs clashes.
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    text = F.col(f"c{docs.columns.index(text_col)}")
    scanned = store(docs.select(*own).select("*", F.monotonically_increasing_id().alias("row"), matches(text).alias("found")), "scanned")
    none = F.coalesce(F.size("found"), F.lit(0)) <= 0
    some = scanned.where(~none)
    found = some.select("row", F.explode(F.array_distinct("found")).alias("match"))
    strings = store(found.select("match").distinct().withColumn("parts", parts(F.col("match"))), "strings")
    entities = store(strings.select(F.explode("parts").alias("p")).select("p.kind", "p.norm").distinct(), "entities")
    hosts = assign(entities.where("kind = 'host'").withColumn("host", F.lit("")), key, store, "hosts")
    domains = hosts.select(F.col("norm").alias("domain"), F.col("surrogate").alias("host"))
    others = entities.where("kind <> 'host'").withColumn("domain", F.when(F.col("kind") == "email", F.substring_index("norm", "@", -1))).join(domains, "domain", "left").drop("domain")
    settled = hosts.unionByName(assign(store(others, "others"), key, store, "others"))
    each = strings.select("match", F.explode("parts").alias("p")).select("match", "p.kind", "p.norm").join(settled, ["kind", "norm"])
    whole = each.groupBy("match").agg(F.array_sort(F.collect_set(F.struct("kind", "norm", "surrogate"))).alias("s"))
    names = F.filter("s", lambda p: space(p["kind"]) == "name")
    swaps = store(whole.select("match", laid_out(F.col("match"), F.col("s")).alias("swap"), names.alias("names")), "swaps")
    salted = swaps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = store(found.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["match", "salt"]).drop("salt"), "met")
    by_row = met.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("match", "swap"))).alias("swaps"))
    # Of a word that is both, the family name's surrogate stands elsewhere in the document.
    mentioned = met.select("row", F.explode("names").alias("p")).groupBy("row", "p.norm").agg(F.min(F.struct("p.kind", "p.surrogate")).alias("s"))
    mentioned = mentioned.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("norm", "s.surrogate"))).alias("names"))
    known = some.join(by_row, "row", "left").join(mentioned, "row", "left")
    gap = lambda g: F.when(F.col("names").isNotNull(), swapped_words(g, F.col("names"))).otherwise(g)
    woven = F.array_join(F.zip_with(F.split(text, PATTERN, -1), "found", lambda g, m: F.concat(gap(g), F.coalesce(F.element_at("swaps", m), m, F.lit("")))), "")

    def out(rows: DataFrame, new: Column, n: Column) -> DataFrame:
        columns = [(new if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)]
        return rows.select(*columns, n.cast("long").alias(counted))

    return out(scanned.where(none), text, F.lit(0)).unionByName(out(known, woven, F.size("found")))
