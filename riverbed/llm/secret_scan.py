"""Secret scans: candidates by pattern, false positives removed by a random forest. Spark expressions only; no shuffle, no explode before the end.

The forest is trained on labelled findings: a seeded set of secrets in the forms that services hand out and of the things that scanners
mistake for them, each with words around it. More findings can be given as a table.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from .common import table
from .spans import cut_out, spans_where

#: What a value is assigned to, in front of a short candidate.
ASSIGNED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?"
#: A whole private key block of any length (possessive, so that long ones take no stack), an unbroken run of 16 or more characters that keys
#: are made of, with or without digits, or 6 to 15 characters that something secret is set to (the short look back rules most places out).
CANDIDATE = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]++|-(?!----END [A-Z ]{0,20}PRIVATE KEY-----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}+|(?<=[=:]|[=:][\"'\s]|[=:]\s[\"'])(?<=" + ASSIGNED.replace(r"\s?", r"\s{0,1}") + r")[^\s\"'`,;<>(){}\[\]]{6,15}(?![^\s\"'`,;<>(){}\[\]])"
#: Words in front of a candidate that speak for a secret, and against one.
FOR = r"(?i)(key|token|secret|passw|pwd|credential|auth|bearer|private|access|apikey)"
AGAINST = r"(?i)(commit|sha-?(1|256|512)|md5|checksum|digest|hash|uuid|guid|version|revision|etag|integrity|isbn|serial|order|ticket|invoice|build)"
PROVIDER = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|ya29\.|eyJ|npm_|SG\.|-----BEGIN)"
#: Word parts that dictionary words and paths are made of.
DICTIONARY = r"(?i)(the|and|ing|tion|ment|able|com|www|http|https|html|index|path|file|user|name|test|example|sample|config|data|image|static|assets|lib|src|main|page|view|item|list|type|class|value|node|module|package|version|update|create|default|your|here|change|placeholder|insert|dummy|foo|bar|xxxx|required|none|null|true|false|account|address|admin|article|auto|base|black|blue|book|button|cache|call|card|check|client|code|color|content|control|count|country|device|direct|document|download|element|email|error|event|feature|field|filter|format|forum|frame|green|group|guide|handler|header|home|info|input|input|language|level|light|link|load|local|login|manager|media|member|message|method|mobile|model|month|name|network|news|number|object|option|order|output|panel|parent|photo|point|policy|post|press|price|process|product|profile|project|public|query|random|record|request|resource|response|result|return|review|screen|script|search|section|select|server|service|session|setting|share|shop|side|simple|site|size|small|source|spring|start|state|store|stream|string|style|submit|support|system|table|target|task|template|theme|thread|time|title|tool|total|track|under|update|upload|video|volume|water|widget|window|world|write|year)"
#: Pairs of letters that words of European languages are full of, and pairs that they hardly have.
COMMON_PAIRS = "(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ei|ie|un|ge|be|la|el|qu|da|os|ue|di|no|na|ta|ca|po|pr|tr|us|em|et|ss|ai|ns|il|id|ol|ad|mi|su|lo|am|im)"
RARE_PAIRS = "(?i)(?=[bcdfgjkpqvwxz][bcdfgjkpqvwxz]|q[^u]|[jqvwxz][hjklmnpqrtvwxz]|[0-9][a-z]|[a-z][0-9])"
CONTEXT = 40
FEATURES = ("length", "transitions", "digits", "upper", "lower", "other", "distinct", "hex", "dictionary", "slashes", "dots", "dashes", "provider", "for_words", "against_words", "assigned", "quoted", "path", "uuid", "vowels", "common_pairs", "rare_pairs")


def candidate_spans(text: Column) -> Column:
    return spans_where(text, text.rlike("[A-Za-z0-9+/_=.-]{16}") | text.contains("PRIVATE KEY") | text.rlike(ASSIGNED), CANDIDATE)


def describe(text: Column, c: Column) -> Column:
    """struct of start, end and the FEATURES of candidate c (all double)."""
    v = c["value"]
    n = F.length(v).cast("double")
    before = F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))
    after = F.substring(text, c["end"] + 1, F.lit(1))
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    truth = lambda x: x.cast("double")
    values = (
        n,
        count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[A-Z])") / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("[^A-Za-z0-9]") / n,
        F.size(F.array_distinct(F.split(v, ""))).cast("double") / F.least(n, F.lit(40.0)),
        truth(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        (n - F.length(F.regexp_replace(v, DICTIONARY, ""))) / n,
        count("/") / n,
        count(r"\.") / n,
        count("[-_]") / n,
        truth(v.rlike(PROVIDER)),
        truth(before.rlike(FOR + r"[^A-Za-z]{0,12}$") | before.rlike(FOR + r"\S{0,12}\W{0,6}$")),
        truth(before.rlike(AGAINST)),
        truth(before.rlike(r"[=:]\s{0,2}[\"'`]?$") | v.rlike("^[A-Za-z_.-]{3,30}=[^=]")),
        truth(before.rlike("[\"'`]$") & after.rlike("[\"'`]")),
        truth(before.rlike(r"[/\\@:]$") | v.rlike(r"^\.{0,2}/|/[a-z]+/|\.[a-z]{2,4}$")),
        truth(v.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
        count("[aeiouAEIOU]") / n,
        count(COMMON_PAIRS) / n,
        count(RARE_PAIRS) / n,
    )
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), *[x.alias(name) for x, name in zip(values, FEATURES, strict=True)])


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, int]]:
    """n (text, 1 or 0): each text holds one candidate among words; 1 marks a secret. n bounds what the forest is fitted on."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    word = lambda: pick(string.ascii_lowercase, rng.randrange(2, 9))
    secrets = [lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35), lambda: pick(hexa, rng.choice((32, 40, 48, 64))), lambda: pick(hexa, 40), lambda: pick(alnum + "+/", rng.randrange(24, 64)), lambda: pick(alnum + "_-", rng.randrange(20, 44)), lambda: "eyJ" + pick(alnum, 33) + ".eyJ" + pick(alnum, 60) + "." + pick(alnum + "_-", 43)]
    # without a digit: application passwords, random keys, passphrases
    secrets += [lambda: pick(string.ascii_lowercase, 16), lambda: pick(string.ascii_letters, rng.randrange(20, 44)), lambda: rng.choice("-_.").join(word() for _ in range(rng.randrange(4, 7))).ljust(16, "a")]
    false = [lambda: pick(hexa, 40), lambda: pick(hexa, rng.choice((32, 64))), lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: pick(string.digits, rng.randrange(16, 24)), lambda: "/".join([word(), word(), word(), word() + str(rng.randrange(99))]) + ".html", lambda: "www." + word() + word() + ".com/" + word() + str(rng.randrange(999)), lambda: "_".join([word(), word(), word(), str(rng.randrange(99)), word()]), lambda: "-".join([word(), word(), word(), str(rng.randrange(2030)), word()]), lambda: word() + word() + word() + word() + str(rng.randrange(99)), lambda: "your-api-key-here-" + str(rng.randrange(999)), lambda: "x" * rng.randrange(16, 40) + "0", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)) + "-" + word() + "." + word(), lambda: word() + str(rng.randrange(99)) + "." + word() + "." + word() + word() + "=" * rng.randrange(3)]
    # short ones, which something is set to
    mixed = alnum + "!#$%&*+-?@^_"
    short = lambda: pick(mixed, rng.randrange(6, 16))
    settled = lambda: rng.choice(("required", "changed", "optional", "disabled", "unknown", "default", "required", "hidden", "expired", "rejected", word().ljust(6, "e") + "ing", word().ljust(6, "a"), word().ljust(7, "o") + "."))
    # without a digit: names, paths, hosts, long words, rules, elisions
    false += [lambda: rng.choice("_-.").join(word() for _ in range(rng.randrange(3, 6))).ljust(16, "a"), lambda: "/".join(["", *(word() for _ in range(4))]).ljust(16, "a"), lambda: "www." + word() + word() + ".example.com/" + word(), lambda: "".join(rng.choice(("in", "ter", "na", "tion", "al", "ment", "un", "ver", "ing", "able", "con", "re", "lich", "keit", "ung")) for _ in range(8)).ljust(16, "a"), lambda: word() + "".join(word().title() for _ in range(5)) + "Handler", lambda: rng.choice("-=._") * rng.randrange(16, 80), lambda: word() + "..." + word() + "..." + word() + "." * 12, lambda: "your-api-key-goes-here", lambda: "x" * rng.randrange(16, 40)]
    # long words of prose, which only what stands in front tells from an application password
    parts = ("in", "ter", "na", "tion", "al", "ment", "un", "ver", "ing", "able", "con", "re", "lich", "keit", "ung", "sch", "heit", "der", "er", "en", "on", "wh", "th", "st")
    long_word = lambda: pick(parts, rng.randrange(6, 12)).ljust(16, "e")
    false += [long_word, long_word, lambda: long_word().title(), lambda: long_word().upper(), lambda: long_word().upper() + ".", lambda: long_word() + ".", lambda: pick(string.ascii_lowercase, rng.randrange(16, 24)), lambda: pick(string.ascii_lowercase, 16) + "."]
    hints, wrong = ["token", "api_key", "apiKey", "secret", "password", "access_key", "auth_token", "private key", "client secret", "Authorization: Bearer", "credential"], ["commit", "sha256", "sha1", "md5", "checksum", "digest", "uuid", "build", "order", "version", "etag", "hash"]
    out = []
    for k in range(n):
        real = k % 2
        v = rng.choice(secrets if real else false)()
        if k % 8 < 2:  # what is set in a few characters
            v = (short if real else settled)()
            lead = rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "passphrase")) + rng.choice(("=", ": ", " = ", ":"))
        elif real:
            lead = rng.choice(hints) + rng.choice((" = ", "=", ": ", " := ", " ", " is "))
        elif v.strip(hexa + "-") == "" and rng.random() < 0.85:
            lead = rng.choice(wrong) + rng.choice((" ", ": ", "="))
        else:
            lead = rng.choice(("", "", rng.choice(hints) + " = ") if v.startswith(("your", "xx")) else ("",))
        quote = rng.choice(('"', "'", "", '"'))
        out.append((" ".join(word() for _ in range(rng.randrange(6))) + " " + lead + quote + v + quote + " " + " ".join(word() for _ in range(rng.randrange(6))), real))
    return out


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None, **forest_params) -> list:
    """The forest of labelled findings (text, is_secret). Features come from the same expressions that scan the corpus."""
    rows = json.dumps([{"t": t, "y": y} for t, y in (findings or labelled_findings())])
    df = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<t:string,y:int>>")).alias("r")).select("r.*")
    got = df.select("y", F.explode(candidate_spans(F.col("t"))).alias("c"), "t").select("y", describe(F.col("t"), F.col("c")).alias("f")).select("y", *[f"f.{n}" for n in FEATURES]).collect()
    data = np.array([tuple(r) for r in sorted(got)], float)
    return forest.fit(data[:, 1:], data[:, 0], **forest_params)


def scored(text: Column, model: list) -> Column:
    """array<struct<start, end, score>> of the candidates in text."""
    described = F.transform(candidate_spans(text), lambda c: describe(text, c))
    return F.transform(described, lambda f: F.struct(f["start"], f["end"], F.round(forest.apply(model, lambda k: f[FEATURES[k]]), 6).alias("score")))


def scan(docs: DataFrame, model: list, threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, start, end (code points, end exclusive), score (share of the trees' votes), is_secret.

    Null and empty texts give no row, an empty table none; texts and candidates are taken whole, whatever their length; repeated rows give
    theirs again; candidates never overlap, the one that begins first counts. Columns other than doc_id and text are not looked at.
    """
    found = docs.select("doc_id", scored(F.coalesce("text", F.lit("")), model).alias("found")).select("doc_id", F.explode("found").alias("x"))
    return found.select("doc_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.score").alias("score"), (F.col("x.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: list, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark and n_chars counted anew where it changed; every row and column stays."""
    held = docs.withColumn("__found", F.filter(scored(F.coalesce("text", F.lit("")), model), lambda x: x["score"] >= threshold))
    put = F.when(F.size("__found") > 0, cut_out(F.col("text"), F.col("__found"), lambda x: F.lit(mark))).otherwise(F.col("text"))
    changed = held.withColumn("text", put)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size("__found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every whole text of documents, with the forest's verdict."""
    return scan(table(spark, sf_dir, "documents"), train(spark))
