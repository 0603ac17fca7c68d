"""Content records longer than a preview, which the driver's tables do not hold."""

from pathlib import Path

from riverbed.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def test_presentation_cuts_long_records(spark, tmp_path):
    for path in DATA.glob("*.parquet"):
        if path.stem != "conversations":
            (tmp_path / path.name).symlink_to(path)
    texts = ["a" * 4096, "a" * 4095 + "é" + "b" * 90, "é" * 3000, "a" * 4094 + "é" + "b", "a" * 4093 + "🙂" * 3]
    rows = [(k, 1, "user", t) for k, t in enumerate(texts)]
    kinds = spark.read.parquet(str(DATA / "conversations.parquet")).select("conv_id", "turn", "role", "text").schema
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["content_id"]: r["preview"] for r in catalog.QUERIES["content_presentation"](spark, str(tmp_path)).collect()}
    assert got == {f"r-{k}-1": t.encode()[:4096].decode(errors="replace") for k, t in enumerate(texts)}
