import bz2

from lexloom.plans import pipeline
from lexloom.streaming.deploy import deploy, deploy_stream


def page(title, text):
    return f"<page>\n<title>{title}</title>\n<ns>0</ns>\n<id>1</id>\n<revision><id>1</id><timestamp>t</timestamp><text>{text}</text></revision>\n</page>\n"


def test_stream_inserts_each_title_once(spark, tmp_path):
    rows = [(i, "m" if i % 2 else "x", (("ring", "field", "group") if i % 2 else ("cell", "blood", "heart"))[i // 2 % 3]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, target string, feature_union string")
    model = pipeline.fit(docs, "m", 10.0, size=20, n_grams=1, text="feature_union")
    model.key = "title"
    folder, out = tmp_path / "dumps", str(tmp_path / "out")
    folder.mkdir()
    for k, pages in enumerate((page("A", "ring group") + page("B", "cell blood"), page("A", "ring group") + page("C", "field ring"))):
        (folder / f"{k}.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{pages}</mediawiki>".encode()))
        deploy_stream(spark, str(folder), model, 0.5, out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect() if r.prediction >= 0.5) == ["A", "C"]
    assert {r.title for r in deploy(spark, str(folder / "0.xml.bz2"), model, 0.5).collect()} >= {"A"}
