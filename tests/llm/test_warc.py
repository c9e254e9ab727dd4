import zstandard

from dagbag.llm import warc
from tests.llm.conftest import prose


def pages(spark):
    rows = [(i, f"http://x/{i} y", "<p>" + prose(i, 30 + i) + "</p>") for i in range(60)]
    rows += [(None, None, None), (5, "http://x/5 y", rows[5][2]), (5, "http://x/5 y", rows[5][2]), (70, "u", ""), (71, "é", prose(3, 20_000))]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as frame", "2 as offset")


def test_every_record_comes_back_from_its_frame(spark):
    rows, df = pages(spark)
    got = []
    for b in warc.bundles(df, frame_bytes=2000, bundle_bytes=20_000).collect():
        index = warc.frame_index(bytes(b.content))
        assert len(index) == b.n_frames and sum(raw for _, _, raw in index) == b.raw_bytes
        for r in b.records:
            got.append((r.page_id, r.url, warc.read_record(bytes(b.content), r.frame, r.offset, r.length)))
        # a reader that knows nothing of the seek table reads the whole
        whole = zstandard.ZstdDecompressor().stream_reader(bytes(b.content), read_across_frames=True).read()
        assert len(whole) == b.raw_bytes and whole.startswith(b"WARC/1.1\r\n")
    key = lambda x: (str(x[0]), str(x[1]), x[2])
    assert sorted(got, key=key) == sorted([(i, u, warc.record(i, u, h)) for i, u, h in rows], key=key)


def test_record_is_well_formed():
    head, _, body = warc.record(1, "http://a b\n", "é").partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert fields["Content-Length"] == "2" and fields["WARC-Target-URI"] == "http://a%20b%20" and body == "é".encode() + b"\r\n\r\n"


def test_files_and_empty_table(spark, tmp_path):
    rows, df = pages(spark)
    index = warc.write_files(warc.bundles(df, 2000, 20_000), f"file://{tmp_path}/new").collect()
    assert len(index) == len(rows)
    again = warc.write_files(warc.bundles(df, 2000, 20_000), f"{tmp_path}/new").collect()
    assert sorted(map(str, again)) == sorted(map(str, index))
    r = next(r for r in index if r.page_id == 42)
    with open(r.path, "rb") as f:
        assert prose(42, 72).encode() in warc.read_record(f.read(), r.frame, r.offset, r.length)
    assert warc.bundles(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
