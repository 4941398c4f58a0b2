from quire.sources.fixtures import build_pdf
from quire.streaming.intake import incoming, render_stream


def test_stream_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(build_pdf([b"0 0 %d 9 re f" % (i % 2 * 5 + 3)], 20, 10))
    render_stream(incoming(spark, source), out, state, 72.0).awaitTermination()
    assert spark.read.parquet(out).count() == 2  # two different contents
    (tmp_path / "in" / "new.pdf").write_bytes(build_pdf([b"0 0 2 9 re f"], 20, 10))
    render_stream(incoming(spark, source), out, state, 72.0).awaitTermination()
    assert spark.read.parquet(out).count() == 3
