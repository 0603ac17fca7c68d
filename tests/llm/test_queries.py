"""The registered queries over the smallest tables: their contracts' columns, and their SQL or a plain version of them."""

import hashlib
import re
import subprocess
import sys
import textwrap
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from riverbed.llm import license_scan, registry
from riverbed.llm.common import table

DATA = "/root/testdata/sf0.001"
TYPES = {
    "op1_quality_bradley_terry": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_embedding_nn_descent": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_pii_weak_supervision": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_secret_forest": "doc_id bigint, start bigint, end bigint, score double, is_secret boolean",
    "op5_language_centroids": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_bpe_forced_boundaries": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_ball_tree_top5": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_license_sentences": "doc_id bigint, n_notices bigint, licenses string",
    "op9_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint",
    "op10_mixing_soft_membership": "doc_id bigint, tokens bigint, domain string, rate double, copies int",
}


@pytest.fixture(scope="module")
def rows(spark):
    kept = {}

    def of(name):
        if name not in kept:
            df = registry.QUERIES[name](spark, DATA)
            wanted = [x.split() for x in TYPES[name].split(", ")]
            assert [list(x) for x in df.dtypes[: len(wanted)]] == wanted
            kept[name] = df.collect()
        return kept[name]

    return of


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(rows, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = c.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in rows(name)) == want and want


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_quality(rows, documents, spark):
    got = rows("op1_quality_bradley_terry")
    assert {r["doc_id"] for r in got} == set(documents) and all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    marks = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect() if r["quality"] is not None}
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)  # few labels


def test_personal_data(rows, documents):
    for r in rows("op3_pii_weak_supervision"):
        text, spans = documents[r["doc_id"]]["text"] or "", []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
            spans.append(("email", *m.span()))
        for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text):
            if all(int(x) <= 255 for x in m.group().split(".")):
                spans.append(("ip", *m.span()))
        for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
            d = [int(x) for x in re.sub("[^0-9]", "", m.group())][::-1]
            if 16 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
                spans.append(("card", *m.span()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                spans.append(("phone", *m.span()))
        base = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in spans) for k in ("email", "ip", "card", "phone")]


def test_language(rows, documents):
    got = rows("op5_language_centroids")
    assert len(got) == len(documents) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    held = [(r["lang_pred"], documents[r["doc_id"]]["lang"]) for r in got if r["held_out"] and documents[r["doc_id"]]["lang"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_tokens(rows, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in rows("op6_bpe_forced_boundaries"):
        ids = library.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_secrets(rows, documents):
    spans = {}
    for r in rows("op4_secret_forest"):
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["is_secret"]))
    for d, doc in documents.items():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', doc["text"] or ""):
            assert (*m.span(1), True) in spans[d]


def test_licences(rows, documents):
    own = license_scan.Recogniser()
    for r in rows("op8_license_sentences"):
        assert (r["n_notices"], r["licenses"]) == ((n := own.notices(documents[r["doc_id"]]["text"] or "")) and len(n) or 0, ",".join(sorted({x[0] for x in n})))


def test_mixture(rows, documents):
    got, sums = rows("op10_mixing_soft_membership"), {}
    assert {r["doc_id"] for r in got} == set(documents) and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 and abs(r["gap"]) <= 1e-4 for r in got)
    for r in got:
        s = documents[r["doc_id"]]["source"]
        sums[s] = sums.get(s, 0) + r["tokens"] * r["rate"]
    plain = {}
    for d in documents.values():
        plain[d["source"]] = plain.get(d["source"], 0) + len((d["text"] or "").split())
    assert max(sums.values()) / min(sums.values()) < 1.5 < max(plain.values()) / min(plain.values())


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A session whose workers start elsewhere, without the package on their path, runs every query."""
    root = Path(__file__).resolve().parents[2]
    script = f"""
        import os, sys
        os.environ.pop("PYTHONPATH", None)
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
        sys.path.insert(0, {str(root)!r})
        import pyarrow as pa
        from riverbed.llm import registry
        from riverbed.plans import catalog

        def absent(batches):
            import importlib.util

            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("river" + "bed") is None])], ["absent"])

        assert spark.range(1).mapInArrow(absent, "absent boolean").first()[0]
        for name, query in registry.QUERIES.items():
            assert query(spark, {DATA!r}).count() >= 0, name
        for name in ("flows_from_frames", "http_bodies_parsed", "live_flows_closed", "scan_automaton"):
            assert catalog.QUERIES[name](spark, {DATA!r}).count() > 0, name
        print("all ran")
    """
    (tmp_path / "run.py").write_text(textwrap.dedent(script))
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_empty_tables(spark, tmp_path):
    """Every query gives its columns and no row over empty tables."""
    for t in ("documents", "embeddings", "labels"):
        table(spark, DATA, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in registry.QUERIES.items():
        df = query(spark, str(tmp_path))
        assert df.count() == 0 and df.columns[: len(TYPES[name].split(", "))] == [x.split()[0] for x in TYPES[name].split(", ")], name
    import corpus_pipeline

    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert docs.agg(F.count("*")).first()[0] == 0
