import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohesio.llm import quality, shared

SCHEMA = "doc_id long, text string, source string, host string, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup, lines = set(), 0, 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += 1
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é", " ", "  ", "\n", "\t", "\v", "\f", "\r", "#", "|", "　", "\x1c", "a b c ", "日"]), max_size=40).map("".join))
def test_measures_match_brute_force(text):
    assert quality.measure_text(text) == brute(text)


def test_host_verdicts(spark):
    good = lambda k: " ".join(f"word{k}x{j}" for j in range(80))
    rows = [(k, good(k), "good", "x", "y") for k in range(30)]
    rows += [(100 + k, "short text", "bad", "x", "y") for k in range(40)]
    rows += [(200, good(1), "bad", "x", "y"), (201, good(2) + " #" * 40, "bad", "x", "y"), (202, good(3) + " #" * 40, "good", "x", "y")]
    rows += [(300, "short", "small", "x", "y"), (301, good(4), None, "x", "y"), (302, None, None, "x", "y"), (303, "same words here " * 40, "good", "x", "y"), (303, "same words here " * 40, "good", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    measured = shared.saved(quality.measure(docs, ["doc_id"]), shared.work_dir(spark, "t"))
    got = defaultdict(list)
    for r in quality.judged(measured).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[k][0].kept for k in range(30)) and not any(got[100 + k][0].kept for k in range(40))
    # Of a rejected host clean documents stay, and documents with a softer failure go; elsewhere those stay.
    assert got[200][0].kept and got[200][0].host_rejected and not got[201][0].kept and not got[201][0].base_failed and got[202][0].kept
    assert got[301][0].kept and not got[302][0].kept and [r.base_failed for r in got[303]] == [True, True]

    # Rates shrink as a beta-binomial fitted by weighted moments has it.
    hosts = {r.host: r for r in quality.host_verdicts(measured).collect()}
    count, failed = Counter(r[2] or "" for r in rows), Counter(r[2] or "" for r in rows if brute(r[1])[0] < 50)
    n, h = sum(count.values()), len(count)
    mean = sum(failed.values()) / n
    spread = sum(m * (failed[x] / m - mean) ** 2 for x, m in count.items())
    rho = (spread / (mean * (1 - mean)) - (h - 1)) / (n - sum(m * m for m in count.values()) / n - (h - 1))
    weight = 1 / min(rho, 1) - 1
    for x in count:
        assert abs(hosts[x].rate_short - (failed[x] + mean * weight) / (count[x] + weight)) < 1e-9 and hosts[x].n_docs == count[x]


def test_single_documents_shrink_to_the_common_rate(spark):
    docs = spark.createDataFrame([(k, "short" if k < 20 else " ".join(f"word{k}x{j}" for j in range(80)), f"s{k}", "", "") for k in range(60)], SCHEMA)
    measured = shared.saved(quality.measure(docs, ["doc_id"]), shared.work_dir(spark, "t"))
    found = quality.host_verdicts(measured).collect()
    assert len(found) == 60 and all(abs(r.rate_short - 1 / 3) < 1e-12 and not r.host_rejected for r in found)


def test_the_fit_finds_the_prior():
    """Hosts drawn from a beta of known weight, and from one rate: noise alone is no spread."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 4000).astype(float)
    for rates, low, high in ((rng.beta(2, 6, 4000), 7, 9.2), (np.full(4000, 0.25), 150, None)):
        k = rng.binomial(n.astype(int), rates).astype(float)
        weight = quality.prior_weight(len(n), n.sum(), (n * n).sum(), k.sum(), (k * k / n).sum())
        assert weight is None or (weight > low and (high is None or weight < high))
    assert quality.prior_weight(0, 0, 0, 0, 0) is None and quality.prior_weight(2, 4, 8, 4, 4) is None


def test_domains(spark):
    cases = {"http://www.Example.com/a?b#c": "example.com", "https://u:p@a.b.example.org:80/x": "a.b.example.org", "//x.net": "x.net", "src3": "src3", "": "", None: "", "Mixed/Case": "Mixed/Case"}
    rows = spark.createDataFrame([(x,) for x in cases], "source string").select("source", quality.domain(F.col("source")).alias("d")).collect()
    assert {r.source: r.d for r in rows} == cases


def test_one_host_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "short", "a", "", ""), (2, "w " * 60, "a", "", "")], SCHEMA)
    for part, n in ((docs, 2), (docs.limit(0), 0)):
        measured = shared.saved(quality.measure(part, ["doc_id"]), shared.work_dir(spark, "t"))
        assert quality.judged(measured).count() == n
