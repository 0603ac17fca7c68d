"""The stages of the corpus pipeline on a small table, each against what it has to keep, and all of them in a row."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    words = {"en": "the and of with that house water small tree river", "de": "der und das nicht mit haus wasser klein baum fluss"}
    rows = []
    for lang, w in words.items():
        for k in range(40):
            v = w.split()
            rows.append((len(rows), " ".join(v[(k * j + j * j) % 10] + ("s" if (k + j) % 3 else "") + str(k % 9) * ((j * k) % 17 == 0) for j in range(30 + k)), lang, "src0", 1))
    rows.append((900, rows[3][1], "en", "src1", 1))
    rows.append((901, rows[4][1] + " more", "en", "src1", 1))
    rows.append((902, "123 !!!", None, None, None))
    rows.append((903, None, "en", "src1", 0))
    rows.append((904, 'here token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" the and of house water tree', "en", "src1", 1))
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_stage(spark, docs):
    kept = P.language_id(spark, docs, "")
    assert kept.columns == docs.columns and ids(kept) == [i for i in ids(docs) if i not in (902, 903)]


def test_near_copy_stage(spark, docs):
    kept = P.near_copies(spark, docs, "")
    assert kept.columns == docs.columns and not {900, 901} & set(ids(kept)) and {3, 4, 902, 903, 904} <= set(ids(kept))
    twice = P.near_copies(spark, docs.union(docs.where("doc_id = 7")), "")
    assert ids(twice).count(7) == 1


def test_texts_of_one_id_are_judged_apart(spark, docs):
    """An id with two texts loses only the one that is a copy; texts without a word are no copies of one another."""
    rows = docs.where("doc_id in (3, 5)").collect()
    more = spark.createDataFrame([(3, rows[1]["text"] + " end", "en", "s", 1), (950, rows[1]["text"], "en", "s", 1), (950, "quite other words stand in this row of the table", "en", "s", 1), (951, "", "en", "s", 0), (951, " ", "en", "s", 1), (None, rows[0]["text"], "en", "s", 1)], SCHEMA)
    kept = P.near_copies(spark, docs.union(more), "").collect()
    texts = lambda i: sorted(r["text"] for r in kept if r["doc_id"] == i)
    assert texts(950) == ["quite other words stand in this row of the table"] and texts(951) == ["", " "] and len(texts(None)) == 1
    assert texts(3) == sorted([rows[0]["text"], rows[1]["text"] + " end"]) and not texts(5)


def test_secret_stage(spark, docs):
    kept = {r["doc_id"]: r for r in P.secrets(spark, docs, "").collect()}
    assert sorted(kept) == ids(docs) and "[SECRET]" in kept[904]["text"] and kept[904]["n_chars"] == len(kept[904]["text"])


def test_mixture_stage(spark, docs):
    kept = P.mixture(spark, docs, "")
    assert kept.columns == docs.columns and set(ids(kept)) == set(ids(docs))


def test_all_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    assert len(P.STAGES) == 5 and out.count() >= 70 and out.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert not {900, 901, 902, 903} & set(ids(out))


def test_whole_texts_reach_python_in_small_batches(spark, docs, monkeypatch):
    """Arrow batches of 10,000 long texts take an executor hundreds of MB: the stages that hand texts to Python keep batches small."""

    def rows_of_batch(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({"doc_id": [n], "text": [""], "lang_pred": ["en"], "source": [""], "n_chars": [n], "rejected": [False]}, schema=arrow)

    import pyarrow as pa

    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang_pred", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("rejected", pa.bool_())])
    counted = lambda df, *_, **__: df.mapInArrow(rows_of_batch, "doc_id long, text string, lang_pred string, source string, n_chars long, rejected boolean")
    monkeypatch.setattr(P.langid, "fit", lambda df: None)
    monkeypatch.setattr(P.langid, "predict", counted)
    monkeypatch.setattr(P.bpe, "encode_documents", counted)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(10000).cast("long").alias("n_chars")).coalesce(1)
    for stage in (P.language_id, P.tokens):
        sizes = [r["n_chars"] for r in stage(spark, many, "").collect()]
        assert sum(sizes) == 3000 and max(sizes) <= 1000 and max(sizes) * 10_000 <= 5 << 20, stage.__name__
