"""Mixing to target weights with soft membership. DataFrame expressions only.

A labelled table teaches a naive Bayes classifier over letter counts, which gives every document a posterior over the domains. How much
letters count beside a document's own label is found on labelled rows that the letter frequencies were not learned from. Rates
(how often a document is used) are then fitted by projected gradient on the least-squares gap between the expected tokens of each domain
and the targets: each round sums the domains' expected tokens over all documents (a handful of numbers), and moves every document's rate
along its own posterior, never below zero. Steps are scaled by how much the domains share their documents, so a few rounds do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, scratch, share, table

#: Letters that are counted.
LETTERS = "etaoinshrldcuwzgqjkñóäöüßéèç"


@dataclass(frozen=True)
class Params:
    #: Wanted share of tokens by domain; a domain that isn't named gets none. Empty: equal shares of all domains learned.
    targets: dict[str, float] = field(default_factory=dict)
    #: Without targets: shares in proportion to the domains' own tokens to this power; 0 makes them equal, 1 leaves them as they are.
    temper: float = 0.0
    #: Rounds end when every domain's gap is below this share of the total, or after so many rounds (then `gap` shows what is left).
    enough: float = 1e-4
    rounds: int = 40
    #: Rounds after which the rates reached are written down, so that the next ones need not repeat the steps.
    written: int = 8
    #: A document's evidence counts as at most so many letters, as letters of one text are not independent; of these numbers that one is
    #: taken which tells the labels of held-out rows best (0: letters tell nothing of the domain). judged: those rows, about.
    evidence: tuple[float, ...] = (0.0, 3.0, 10.0, 30.0, 60.0, 150.0, 400.0)
    judged: int = 20_000
    #: How often a document's own label is taken to be wrong.
    noise: float = 0.05
    #: Domains at most: each is a sum of every round, and the shared tokens of each two are summed once. More raise an error.
    domains: int = 200
    seed: int = 1


ADDED = ("tokens", "domain", "rate", "copies", "gap")


def counted(docs: DataFrame, label: str, keep: tuple[str, ...]) -> DataFrame:
    """row (the columns keep), domain (the label, may be null), tokens (words) and c, a count for each letter of LETTERS."""
    text = F.coalesce("text", F.lit(""))
    low = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{label}`").cast("string").alias("domain"), text.alias("text"), F.lower(text).alias("low"))
    letters = F.array(*[(F.length("low") - F.length(F.replace("low", F.lit(c)))).cast("double") for c in LETTERS])
    return low.select("row", "domain", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("tokens"), letters.alias("c"))


@dataclass(frozen=True)
class Bayes:
    domains: list[str]
    prior: list[float]
    logs: list[list[float]]
    evidence: float = 0.0


def learn(labelled: DataFrame, p: Params) -> Bayes:
    """Letter frequencies of each domain over all rows whose domain is not null, and how much letters count."""
    n = len(LETTERS)
    part = F.pmod(F.xxhash64("row.doc_id", F.lit(p.seed)), F.lit(2))
    known = labelled.where("domain is not null")
    sums = known.groupBy("domain", part.alias("part")).agg(F.count("*").alias("n"), *[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(n)])
    rows = sums.limit(2 * p.domains + 1).collect()
    names = sorted({r["domain"] for r in rows})
    if len(names) > p.domains or len(rows) > 2 * p.domains:
        raise ValueError(f"more than {p.domains} domains")

    def fitted(parts: tuple[int, ...]) -> tuple[list[float], list[list[float]]]:
        at = {d: np.zeros(n + 1) for d in names}
        for r in rows:
            if r["part"] in parts:
                at[r["domain"]] += [r["n"], *(r[f"c{k}"] for k in range(n))]
        total = sum(x[0] + 1 for x in at.values())
        return [math.log((at[d][0] + 1) / total) for d in names], [[math.log((c + 1) / (at[d][1:].sum() + n)) for c in at[d][1:]] for d in names]

    if not names:
        return Bayes([], [], [])
    size = sum(r["n"] for r in rows if r["part"] == 1)
    held = known.where((part == 1) & share("row.doc_id", p.judged / max(1, size)))
    return Bayes(names, *fitted((0, 1)), judged(held, Bayes(names, *fitted((0,))), p))


def judged(held: DataFrame, model: Bayes, p: Params) -> float:
    """The one of p.evidence under which the letters of held rows tell their labels best."""
    at = held.select("domain", F.greatest(total_of(F.col("c")), F.lit(1.0)).alias("t"), by_letters(model).alias("s"))
    own = F.array_position(F.array(*map(F.lit, model.domains)), F.col("domain")).cast("int")

    def likelihood(e: float):
        scores = F.transform("s", lambda x: x["prior"] + F.least(F.lit(1.0), F.lit(e) / F.col("t")) * x["sum"])
        return F.sum(F.element_at(scores, own) - F.array_max(scores) - F.log(total_of(F.transform(scores, lambda x: F.exp(x - F.array_max(scores))))))

    found = at.agg(*[likelihood(e).alias(f"l{k}") for k, e in enumerate(p.evidence)]).first()
    return max(zip((-1e300 if x is None else x for x in found), (-e for e in p.evidence), strict=True))[1] * -1


def total_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def by_letters(model: Bayes) -> Column:
    """name, prior and sum (of the letters' logarithms) for each domain, from column c."""
    classes = F.array(*[F.struct(F.lit(d).alias("name"), F.lit(a).alias("prior"), F.array(*map(F.lit, logs)).alias("logs")) for d, a, logs in zip(model.domains, model.prior, model.logs, strict=True)])
    return F.transform(classes, lambda m: F.struct(m["name"].alias("name"), m["prior"].alias("prior"), total_of(F.zip_with("c", m["logs"], lambda x, y: x * y)).alias("sum")))


def posteriors(rows: DataFrame, model: Bayes, p: Params) -> DataFrame:
    """row, tokens, p: array<double> with the chance of each of model.domains, from the letters and the document's own label.

    Without letters and label, the priors.
    """
    k = len(model.domains)
    right, wrong = (math.log(1 - p.noise), math.log(p.noise / (k - 1))) if k > 1 else (0.0, 0.0)
    told = lambda m: F.when(F.col("domain").isNull(), 0.0).when(F.col("domain") == m["name"], right).otherwise(wrong)
    weight = F.least(F.lit(1.0), F.lit(model.evidence) / F.greatest(total_of(F.col("c")), F.lit(1.0)))
    at = rows.select("row", "tokens", "domain", weight.alias("w"), by_letters(model).alias("s"))
    at = at.select("row", "tokens", F.transform("s", lambda m: m["prior"] + told(m) + F.col("w") * m["sum"]).alias("s"))
    exps = at.select("row", "tokens", F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e")).withColumn("t", total_of(F.col("e")))
    return exps.select("row", "tokens", F.transform("e", lambda x: x / F.col("t")).alias("p"), F.lit(1.0).alias("r"))


def fit_rates(members: DataFrame, model: Bayes, p: Params) -> tuple[DataFrame, dict]:
    """members (a table, which may be replaced) with their rates in column r, and how the rounds went.

    Tokens wanted in all: so many that a domain held in the largest excess keeps its documents just once and no document has to go.
    """
    k, moves = len(model.domains), []

    def moved() -> DataFrame:
        """Of each row: r <- max(0, r - p . gap), one round after the other."""
        if not moves:
            return members
        steps = F.array(*[F.array(*map(F.lit, m)) for m in moves])
        return members.withColumn("r", F.aggregate(steps, F.col("r"), lambda r, m: F.greatest(F.lit(0.0), r - total_of(F.zip_with(m, "p", lambda x, y: x * y)))))

    def sums() -> list[float]:
        return [float(x or 0) for x in moved().withColumn("t", F.col("tokens") * F.col("r")).agg(*[F.sum(F.col("t") * F.col("p")[j]).alias(f"e{j}") for j in range(k)]).first()]

    def shared() -> np.ndarray:
        """Tokens that each two domains share, over all documents: how far a step along one moves the other."""
        t = members.select(F.col("tokens").cast("double").alias("t"), "p", F.posexplode("p").alias("j", "x"))
        rows = t.groupBy("j").agg(*[F.sum(F.col("t") * F.col("x") * F.col("p")[i]).alias(f"m{i}") for i in range(k)]).collect()
        out = np.zeros((k, k))
        for r in rows:
            out[r["j"]] = [float(r[f"m{i}"] or 0) for i in range(k)]
        return out

    have = sums()
    wanted = [p.targets.get(d, 0.0) if p.targets else h**p.temper if h > 0 else 0.0 for d, h in zip(model.domains, have, strict=True)]
    share = [w / sum(wanted) for w in wanted] if sum(wanted) else wanted
    total = max((h / w for h, w in zip(have, share, strict=True) if w > 0), default=0.0)
    goal, now, rounds = [total * w for w in share], have, 0
    scale = np.linalg.pinv(shared(), rcond=1e-9, hermitian=True) if total > 0 else None
    while total > 0 and rounds < p.rounds and max(abs(n - g) for n, g in zip(now, goal, strict=True)) > p.enough * total:
        moves.append([float(x) for x in scale @ (np.array(now) - np.array(goal))])
        rounds += 1
        if len(moves) >= p.written:
            before, members, moves = members, materialize(moved(), "rates"), []
            discard(before)
        now = sums()
    return moved(), {"domains": model.domains, "goal": goal, "reached": now, "total": total, "rounds": rounds, "table": members}


def mix(docs: DataFrame, label: str, p: Params = Params(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row of docs, tokens (words), domain (likeliest), rate, copies, and gap.

    copies is rate rounded up or down by a hash of doc_id, so that sums keep their expectation. gap is what the domain's expected tokens
    still lack of its target (below 0) or have beyond it, as a share of all tokens wanted: within p.enough, unless the rounds ended first.
    label names the column that holds a document's domain where it is known; rows without one are members by their letters only.

    Null and empty texts have no tokens, and their label and the priors as membership. Texts are taken whole, whatever their length.
    Repeated rows stay, with equal rates; of domains equally likely the first in the alphabet is named. Without any label every rate is 1
    and domain is null. An empty table gives an empty table. Columns of docs beyond doc_id, text and label may have any name; columns of
    keep may not be named like those added.
    """
    if set(keep) & set(ADDED):
        raise ValueError(f"columns {sorted(set(keep) & set(ADDED))} would come twice")
    with scratch() as hold:
        rows = materialize(counted(docs, label, ("doc_id", *(k for k in keep if k != "doc_id"))), "letters")
        model = learn(rows, p)
        if not model.domains:
            out = hold(rows).select("row", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(0.0).alias("gap"))
            return out.select(*[F.col(f"row.`{k}`") for k in keep], *ADDED)
        members = materialize(posteriors(rows, model, p), "members")
        discard(rows)
        rates, report = fit_rates(members, model, p)
        hold(report["table"])
        at = F.array_position("p", F.array_max("p")).cast("int")
        names, gaps = F.array(*map(F.lit, model.domains)), F.array(*[F.lit((n - g) / report["total"] if report["total"] else 0.0) for n, g in zip(report["reached"], report["goal"], strict=True)])
        luck = F.pmod(F.xxhash64("row.doc_id", F.lit(p.seed)), F.lit(1_000_000)) / 1e6
        out = rates.select("row", "tokens", F.element_at(names, at).alias("domain"), F.round("r", 6).alias("rate"), F.element_at(gaps, at).alias("gap"))
        out = out.withColumn("copies", F.floor(F.col("rate") + luck).cast("int"))
    return out.select(*[F.col(f"row.`{k}`") for k in keep], *ADDED)


def op10_mixing_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that give the sources of documents equal expected tokens; source, where known, is the labelled table."""
    return mix(table(spark, sf_dir, "documents"), "source")
