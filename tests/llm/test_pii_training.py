"""Training of the span classifier must not depend on the size of the input."""

import numpy as np

from riverbed.llm import pii


def test_weights_do_not_depend_on_size(monkeypatch):
    # what two labelers say together decides here, which single votes cannot tell: then the counts weigh
    monkeypatch.setattr(pii, "weigh", lambda counts: np.array([0.9, 0.1, 0.2, 0.8]))
    votes = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    rows = [(1, *v, *[0] * (pii.VOTES - 2), 1, n) for v, n in zip(votes, (900_000, 60_000, 40_000, 70_000), strict=True)]
    x = pii.inputs(np.array(rows, float))
    small, large = (1 / (1 + np.exp(-x @ pii.train([(*r[:-1], k * r[-1]) for r in rows]))) for k in (1, 100))
    assert np.abs(small - large).max() < 1e-3


def test_added_spans_on_planted_texts(spark):
    """Personal data beyond the base patterns, with other words around it than the labelers know, and things that look alike."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 8)))
    fill = lambda: " ".join(word() for _ in range(6))
    area = lambda: f"{rng.choice((212, 315, 404, 503, 617, 714))}"
    real = [
        lambda: ("please call me on ", f"({area()}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"),
        lambda: ("fax or phone ", f"{area()}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"),
        lambda: ("my social security number is ", f"{rng.randrange(100, 665)}-{rng.randrange(11, 99)}-{rng.randrange(1000, 9999)}"),
        lambda: ("yours, signed ", f"Dr. {rng.choice(('Maria', 'Peter', 'Julia'))} {word().title()}"),
        lambda: ("write to ", f"{word()}.{word()} [at] {word()} [dot] com"),
    ]
    false = [
        lambda: ("order ", f"{rng.randrange(700, 999)}-00-{rng.randrange(1000, 9999)}"),
        lambda: ("serial no of the build ", "000-00-0000"),
        lambda: ("version ", f"{rng.choice((666, 900, 999))}-{rng.randrange(10, 99)}-0000"),
    ]
    rows, truth = [], {}
    for k in range(600):
        is_real = k % 3 > 0
        lead, value = rng.choice(real if is_real else false)()
        text = f"{fill()} {lead}"
        truth[k] = (len(text), len(text) + len(value)) if is_real else None
        rows.append((k, f"{text}{value} {fill()}"))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where(F.col("n_added") > 0).collect()
    spans = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in found for x in r["spans"].split(",")}
    right = {(k, *v) for k, v in truth.items() if v}
    hit = len(spans & right)
    assert hit / len(spans) >= 0.95 and hit / len(right) >= 0.8, (hit, len(spans), len(right))
