"""URL filters: host reputation by empirical Bayes from host to registered domain to suffix, behind fixed rules."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import written

#: (action, host, path prefix) of the production rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_RULES = 1000
#: A prior weighs as at least and at most so many observations.
WEIGHT = (2.0, 200.0)
#: A host is blocked if its bad rate is over BAD_RATE with a posterior probability of SURE: if the 5 % quantile of its beta
#: posterior is.
BAD_RATE, SURE = 0.5, 0.95
#: Labels below a country code under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Hosts with more than this share of the pages, so at most 1024, are broadcast to their pages; suffixes are up to SUFFIXES.
HOT, SUFFIXES = 1024, 1 << 17


def with_host_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path; both are empty if the url is null or has no ``://``."""
    url = F.col(url_col)
    rest = F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.when(has, host).otherwise(""), "path": F.when(has, path).otherwise("")})


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits host and path, else nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; join them as a table instead")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _weight(groups: DataFrame, n: str, bad: str) -> DataFrame:
    """One row with the rate of ``groups`` and the weight of a beta prior, by the method of moments.

    The variance between groups beyond binomial noise gives the weight: rate * (1 - rate) / variance - 1.
    """
    total, got, squares, lost = F.sum(n), F.sum(bad), F.sum(F.col(bad) * F.col(bad) / F.col(n)), F.count(F.lit(1))
    s = groups.where(F.col(n) > 0).agg(total.cast("double").alias("t"), got.cast("double").alias("g"), squares.alias("q"), lost.cast("double").alias("k"), F.sum(F.col(n) * F.col(n)).cast("double").alias("nn"))
    rate = F.when(F.col("t") > 0, F.col("g") / F.col("t")).otherwise(F.lit(0.0))
    noise = F.col("rate") * (1 - F.col("rate"))
    spread = F.col("q") - F.col("t") * F.col("rate") * F.col("rate") - (F.col("k") - 1) * noise
    room = F.col("t") - F.col("nn") / F.col("t") - (F.col("k") - 1)
    weight = F.when((spread > 0) & (room > 0), noise / (spread / room) - 1).otherwise(F.lit(WEIGHT[1]))
    return s.withColumn("rate", rate).select("rate", F.coalesce(F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), weight)), F.lit(WEIGHT[1])).alias("w"))


def registered(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> tuple[Column, Column, Column]:
    """(name, domain, suffix) of a host: its name without user and port, its registered domain and public suffix.

    A suffix is the last label, or the last two where the last is a country code and the one before one of
    ``second_level``. Addresses are domains of their own under the suffix ``<address>``.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^\[.*\]$|^[0-9]+(\.[0-9]+){3}$")
    two = name.rlike(rf"(^|\.)({'|'.join(second_level)})\.[a-z][a-z]$")
    suffix = F.when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return name, F.when(address, name).otherwise(domain), F.when(address, "<address>").otherwise(suffix)


def beta_below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Probability that a beta variable of parameters a, b > 0 is at most x: the continued fraction of the incomplete beta."""
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log = np.array([math.lgamma(s + t) - math.lgamma(s) - math.lgamma(t) for s, t in zip(a.tolist(), b.tolist(), strict=True)])
    front = np.exp(log + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(a), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    value, m = d.copy(), 0
    while True:
        m += 1
        last = value
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + e * d, 1 + e / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value = value * d * c
        if not len(a) or np.abs(value / last - 1).max() < 1e-13:
            return np.where(swap, 1 - front * value, front * value)


def host_reputation(hosts: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """Posterior of the bad rate for each name: name, domain, suffix, n, bad -> name, n_labelled, bad_rate, bad_odds.

    A suffix shrinks to the overall rate, a registered domain to its suffix, a host to its domain; each level's prior
    weight is its own estimate. bad_odds is the posterior probability that the rate is over ``bad_rate``. Everything is
    aggregated before it is joined.
    """
    doms = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    sufs = doms.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    ws, wd, wh = (_weight(g, n, b) for g, n, b in ((sufs, "sn", "sb"), (doms, "dn", "db"), (hosts, "n", "bad")))
    top = ws.select(F.col("rate").alias("r0"), F.col("w").alias("w0")).crossJoin(wd.select(F.col("w").alias("w1"))).crossJoin(wh.select(F.col("w").alias("w2")))
    s = written(sufs.crossJoin(F.broadcast(top)).select("suffix", "w1", "w2", ((F.col("sb") + F.col("w0") * F.col("r0")) / (F.col("sn") + F.col("w0"))).alias("r1")), "suffixes")
    s = F.broadcast(s) if s.count() <= SUFFIXES else s
    d = doms.join(s, "suffix").select("domain", "w2", ((F.col("db") + F.col("w1") * F.col("r1")) / (F.col("dn") + F.col("w1"))).alias("r2"))
    a, b = F.col("bad") + F.col("w2") * F.col("r2"), F.col("n") - F.col("bad") + F.col("w2") * (1 - F.col("r2"))
    mean = F.col("a") / (F.col("a") + F.col("b"))

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.maximum(x.column(k).to_numpy(), 1e-9) for k in ("a", "b"))
            yield pa.RecordBatch.from_arrays([x.column("name"), x.column("n_labelled"), x.column("bad_rate"), pa.array(1 - beta_below(a, b, bad_rate))], names=["name", "n_labelled", "bad_rate", "bad_odds"])

    known = hosts.join(d, "domain").withColumns({"a": a, "b": b}).select("name", F.col("n").cast("long").alias("n_labelled"), mean.alias("bad_rate"), "a", "b")
    return known.mapInArrow(odds, "name string, n_labelled bigint, bad_rate double, bad_odds double")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_col: str = "page_id", url_col: str = "url", bad_rate: float = BAD_RATE) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, bad_rate, bad_odds for every page row.

    ``outcomes`` holds (``page_col``, bad 0/1); a page with several outcomes counts each, one with none or a null
    outcome counts as unlabelled. A host, without user and port, is blocked if its posterior bad rate is over
    ``bad_rate`` with a probability of SURE; a fitting rule decides before that. Null urls have empty host and path, fit
    no rule and share the reputation of the empty host. Ties of rules can't be: each has its own host and path. Repeated
    rows are judged alike and kept; an empty table gives an empty table; other columns are not read. Pages of a host
    that holds a large share meet its row where they are.
    """
    own = with_host_path(pages.select(page_col, url_col), url_col).select(page_col, "host", "path", registered(F.col("host"))[0].alias("name"))
    said = outcomes.where(F.col("bad").isNotNull()).groupBy(page_col).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("bad"))
    counted = own.select(page_col, "name").join(said, page_col, "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    _, domain, suffix = registered(F.col("name"))
    counted = written(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    known = written(host_reputation(counted, bad_rate), "reputations")
    least = (counted.agg(F.sum("pages")).first()[0] or 0) / HOT
    hot = counted.where(F.col("pages") > least).select("name")
    judged = own.join(F.broadcast(known.join(hot, "name")), "name").unionByName(own.join(F.broadcast(hot), "name", "left_anti").join(known, "name"))
    rule, action = rule_columns(rules)
    verdict = F.coalesce(action, F.when(F.col("bad_odds") > SURE, "block").otherwise("allow"))
    return judged.select(page_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_labelled", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_odds", 6).alias("bad_odds"))
