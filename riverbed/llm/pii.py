"""Personal data by weak supervision. Spark expressions only, one pass over the texts.

Base spans (email, ip, card, phone) are fixed by patterns and tests. Looser patterns propose further candidates apart from them. Five
labelers vote on every candidate, base or not: the pattern's own test, a gazetteer, words in front, the shape of the value, and what touches it. How often
each combination of votes occurs is counted over the whole corpus (a few hundred rows at most, whatever its size); from these counts,
expectation-maximisation estimates how reliable each labeler is and how likely each combination is personal data. A logistic classifier
learns those likelihoods from votes, kind and length, and alone decides on the candidates that are not base spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import spans_where

KINDS = ("email", "ip", "card", "phone", "ssn", "name")
BASE = 4
#: Every pattern starts only where the plain one can (at the end of the last match, or not inside a run), so long runs cost no second look.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base: (kind, test that a text must pass, pattern).
LOOSE = (
    (0, r"(?i)[(\[]at[)\]]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?[(\[]at[)\]]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[]dot[)\]])\s?[A-Za-z0-9-]{2,63}){1,4}"),
    (1, r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    (3, r"[0-9]{3}[-. ][0-9]{4}", r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z])"),
    (4, r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    (5, r"(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z]", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?"),
)
NEAR_FOR = {0: "e-?mail|contact|write|reach|address|mailto", 1: "ip|host|server|login|address|client", 2: "card|visa|master|amex|credit|debit|payment", 3: "phone|tel|call|mobile|cell|fax|sms|dial|contact", 4: "ssn|social|security|tax", 5: "name|dear|patient|signed|contact|from"}
NEAR_AGAINST = "version|release|isbn|order|invoice|section|chapter|serial|build|part no|sku|example"
TOP_LEVEL = "com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu|us|it|nl|ch|at|example"
#: Common given and family names of English, German, French and Spanish; find(names=...) takes a gazetteer of any size.
NAMES = (
    "Adam|Agnes|Albert|Alejandro|Alexander|Alfred|Alice|Amanda|Ana|Andrea|Andreas|Andrew|Angela|Anna|Anne|Anthony|Antoine|Antonio|Arthur|Barbara|Beatriz|Benjamin|Bernard|Brian|Camille|Carlos|Carmen|Catherine|Charles|Charlotte|Christian|"
    "Christine|Claire|Claudia|Daniel|David|Deborah|Diego|Dorothy|Edward|Elena|Elizabeth|Emily|Emma|Eric|Ernst|Eva|Fernando|Francisco|Frank|Friedrich|Gabriel|George|Georg|Hannah|Hans|Heinrich|Helen|Helga|Henri|Henry|Ingrid|Isabel|Jacques|"
    "James|Javier|Jean|Jennifer|Jessica|Johann|John|Jorge|Jose|Joseph|Juan|Julia|Julie|Karen|Karl|Kevin|Klaus|Laura|Linda|Louis|Lucia|Luis|Manuel|Margaret|Maria|Marie|Mark|Martin|Mary|Matthew|Michael|Miguel|Monika|Nancy|Nicolas|Otto|"
    "Pablo|Patricia|Paul|Pedro|Peter|Petra|Philippe|Pierre|Rachel|Richard|Robert|Rosa|Ruth|Sabine|Samuel|Sandra|Sarah|Sofia|Sophie|Stefan|Stephen|Steven|Susan|Thomas|Ursula|Walter|Werner|William|Wolfgang|"
    "Anderson|Bauer|Becker|Bernard|Brown|Davis|Dubois|Durand|Fernandez|Fischer|Garcia|Gonzalez|Hernandez|Hoffmann|Johnson|Jones|Koch|Lambert|Leroy|Lopez|Martinez|Meyer|Miller|Moreau|Moore|Perez|Petit|Richter|Rodriguez|Roux|Sanchez|Schmidt|Schneider|Schulz|Simon|Smith|Taylor|Torres|Wagner|Weber|Williams|Wilson"
)
VOTES = 5
CONTEXT = 40


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits of d pass the check sum."""

    def add(acc, k):
        x = F.substring(d, F.length(d) - k, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(k % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def parts_fit(v: Column) -> Column:
    """Whether each part of a dotted address is at most 255."""
    return F.forall(F.transform(F.split(v, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "")), lambda x: F.when(F.length(x) <= 3, x.cast("int") <= 255).otherwise(False))


def holds(kind: int, v: Column) -> Column:
    """The base test of a kind."""
    n = F.length(digits(v))
    return (F.lit(True), parts_fit(v), F.when(n.between(16, 19), luhn(digits(v))).otherwise(False), n.between(8, 15))[kind]


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def judge(text: Column, c: Column, kind: int, base: bool, names: str = NAMES) -> Column:
    """struct of kind, base, start, end, votes v0.. and size (0..3) for one candidate."""
    v, d = c["value"], digits(c["value"])
    before = F.lower(F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT))))
    last = F.when(c["start"] > 0, F.substring(text, c["start"], F.lit(1))).otherwise("")
    after = F.substring(text, c["end"] + 1, F.lit(1))
    test = holds(kind, v) if kind < BASE and base else F.lit(None).cast("boolean")
    known = {0: F.lower(v).rlike(rf"[.)\]]\s?({TOP_LEVEL})$"), 1: ~v.rlike(r"^(0|127|255)\.") , 2: d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), 3: d.rlike("^(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), 4: ~v.rlike("^(000|666|9)|-00-|-0000$"), 5: v.rlike(rf"\b({names})\b")}[kind]
    shape = {0: ~v.rlike(r"(?i)^\S{0,1}@|\.\.|noreply|no-reply"), 1: F.lit(True), 2: ~d.rlike(r"^(\d)\1+$"), 3: ~d.rlike(r"(\d)\1{6}|1234567"), 4: ~d.rlike(r"^(\d)\1+$|^123456789$"), 5: F.length(v) > 6}[kind]
    votes = (
        vote(test, ~test),
        vote(known, ~known),
        vote(before.rlike(rf"\b({NEAR_FOR[kind]})\b"), before.rlike(NEAR_AGAINST)),
        vote(shape, ~shape),
        vote(~last.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]"), F.lit(True)),
    )
    size = F.least(F.lit(3), F.floor(F.length(v) / 10)).cast("int")
    sure = holds(kind, v) if base else F.lit(False)
    return F.struct(F.lit(kind).alias("kind"), F.coalesce(sure, F.lit(False)).alias("base"), c["start"].alias("start"), c["end"].alias("end"), *[F.coalesce(x, F.lit(0)).alias(f"v{k}") for k, x in enumerate(votes)], size.alias("size"))


def candidates(docs: DataFrame, names: str = NAMES) -> DataFrame:
    """doc_id and found: array of judged candidates, base spans and others that touch none of them."""
    text = F.col("text")
    at = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = {"m0": (text.contains("@"), EMAIL), "m1": (text.rlike(r"[0-9]\.[0-9]"), IP), "m2": (text.rlike("[0-9]"), CARD), "m3": (text.contains("+"), PHONE)}
    raw = at.select("doc_id", "text", *[spans_where(text, test, pattern).alias(k) for k, (test, pattern) in some.items()], *[spans_where(text, text.rlike(test), pattern).alias(f"x{k}") for k, (_, test, pattern) in enumerate(LOOSE)])
    likely = lambda k: (lambda c: F.length(digits(c["value"])) >= 12) if k == 2 else (lambda c: F.lit(True))  # noqa: E731  short runs of digits are no cards and need no vote
    judged = lambda k, base: lambda c: judge(text, c, k, base, names)
    lists = [F.transform(F.filter(F.col(f"m{k}"), likely(k)), judged(k, True)) for k in range(BASE)]
    lists += [F.transform(f"x{j}", judged(k, False)) for j, (k, _, _) in enumerate(LOOSE)]
    every = raw.select("doc_id", F.concat(*lists).alias("found")).withColumn("base", F.filter("found", lambda c: c["base"]))
    apart = lambda c: c["base"] | ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return every.select("doc_id", F.filter("found", apart).alias("found"))


def weigh(counts: list[tuple], rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation over (kind, votes.., size, n) rows: the chance that each combination is personal data.

    Each labeler has one accuracy for either truth, over all kinds, on what it does not abstain from; each kind has a prior.
    """
    rows = np.array(counts, float)
    kind, votes, n = rows[:, 0].astype(int), rows[:, 1 : 1 + VOTES], rows[:, -1]
    prior = np.full(len(KINDS), 0.5)
    right = np.full((2, VOTES), 0.8)  # chance of a right vote when the truth is no, yes
    for _ in range(rounds):
        yes, no = np.log(prior[kind]), np.log1p(-prior[kind])
        for j in range(VOTES):
            v = votes[:, j]
            yes = yes + np.where(v > 0, np.log(right[1, j]), np.where(v < 0, np.log1p(-right[1, j]), 0))
            no = no + np.where(v > 0, np.log1p(-right[0, j]), np.where(v < 0, np.log(right[0, j]), 0))
        chance = 1 / (1 + np.exp(np.clip(no - yes, -40, 40)))
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = (1 + (chance * n)[own].sum()) / (2 + n[own].sum())
        prior = np.clip(prior, 0.01, 0.99)
        for j in range(VOTES):
            v = votes[:, j]
            right[1, j] = (8 + (chance * n)[v > 0].sum()) / (10 + (chance * n)[v != 0].sum())
            right[0, j] = (8 + ((1 - chance) * n)[v < 0].sum()) / (10 + ((1 - chance) * n)[v != 0].sum())
        right = np.clip(right, 0.55, 0.99)  # no labeler is taken to vote against the truth
    return chance


def inputs(rows: np.ndarray) -> np.ndarray:
    """Classifier inputs of (kind, votes.., size) rows: 1, each vote for and against, kind, size."""
    v = rows[:, 1 : 1 + VOTES]
    return np.concatenate([np.ones((len(rows), 1)), v > 0, v < 0, rows[:, :1] == np.arange(len(KINDS)), rows[:, 1 + VOTES : 2 + VOTES] == np.arange(4)], axis=1).astype(float)


def train(counts: list[tuple]) -> np.ndarray:
    """Weights of a logistic classifier fitted to the chances that weigh() finds."""
    rows = np.array(counts, float)
    x, target, n = inputs(rows), weigh(counts), rows[:, -1]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - target)) + 0.5 * w
        hessian = (x * (n * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def chance(c: Column, w: np.ndarray) -> Column:
    """The classifier's probability for a judged candidate."""
    w = [float(x) for x in w]
    z = F.lit(w[0])
    for j in range(VOTES):
        z = z + F.when(c[f"v{j}"] > 0, w[1 + j]).when(c[f"v{j}"] < 0, w[1 + VOTES + j]).otherwise(0.0)
    for values, name, at in ((len(KINDS), "kind", 1 + 2 * VOTES), (4, "size", 1 + 2 * VOTES + len(KINDS))):
        z = z + F.element_at(F.array(*[F.lit(x) for x in w[at : at + values]]), c[name] + 1)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, threshold: float = 0.9, names: str = NAMES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added of every row of docs.

    A span is kind:start:end in code points, end exclusive, ordered by kind (email, ip, card, phone, ssn, name) and start. Candidates
    that are not base spans are added when the classifier's probability reaches threshold; of two that overlap the likelier one, then the
    one that begins first. names is the gazetteer, names joined by |. Texts are taken whole, whatever their length. Null and empty texts have no spans and the digest of the empty string; repeated rows stay; an empty table gives
    an empty table; other columns are not looked at.
    """
    found = materialize(candidates(docs, names), "pii")
    fields = ["kind", *[f"v{k}" for k in range(VOTES)], "size"]
    counts = found.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in fields]).count().collect()
    w = train(sorted(tuple(r) for r in counts)) if counts else np.zeros(1 + 2 * VOTES + len(KINDS) + 4)
    base = F.filter("found", lambda c: c["base"])
    likely = F.filter(F.transform(F.filter("found", lambda c: ~c["base"]), lambda c: F.struct((-F.round(chance(c, w), 9)).alias("p"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))), lambda c: c["p"] <= -threshold)
    take = lambda out, c: F.when(F.exists(out, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), out).otherwise(F.array_append(out, c))
    added = F.aggregate(F.array_sort(likely), F.filter(likely, lambda c: F.lit(False)), take)
    span = lambda x: F.transform(x, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    place = lambda x: F.array_sort(F.transform(x, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    label = lambda c: F.element_at(F.array(*[F.lit(k) for k in KINDS]), c["kind"] + 1)
    text = lambda x: F.array_join(F.transform(x, lambda c: F.concat_ws(":", label(c), c["start"].cast("string"), c["end"].cast("string"))), ",")
    of_kind = lambda k: lambda c: c["kind"] == k
    held = found.withColumn("base", base).withColumn("added", added).select("doc_id", place("base").alias("base"), place(F.concat(span("base"), span("added"))).alias("every"), F.size("added").cast("long").alias("n_added"))
    return held.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("every").alias("spans"),
        "n_added",
    )


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return find(table(spark, sf_dir, "documents"))
