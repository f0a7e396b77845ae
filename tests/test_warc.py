import datetime as dt
import glob
import gzip
import os
import re

import pytest
from pyspark.sql import functions as F

from linkloom.operators.warc_records import to_warc_records
from linkloom.sources import warc
from linkloom.sources.warc import SCHEMA

PAYLOAD = bytes(range(32, 96)) + b"\r\n\r\nWARC/1.0\r\n"


def records(spark, n, partitions):
    rows = spark.range(0, n, numPartitions=partitions)
    return rows.select(
        F.concat(F.lit("<urn:uuid:"), F.col("id").cast("string"), F.lit(">")).alias("record_id"),
        F.lit("resource").alias("warc_type"),
        F.lit("http://a/").alias("target_uri"),
        F.lit(dt.datetime(2024, 1, 1)).alias("date"),
        F.lit(None).cast("string").alias("warcinfo_id"),
        F.lit("application/octet-stream").alias("content_type"),
        F.lit(len(PAYLOAD)).cast("long").alias("content_length"),
        F.lit(PAYLOAD).alias("payload"),
    )


def write(spark, df, path, **options):
    warc.register(spark)
    df.write.format("warc").options(**options).mode("append").save(str(path))
    return sorted(glob.glob(f"{path}/*.warc.gz"))


def members(path):
    """Header fields and payload of each record, checked against its length."""
    text = gzip.open(path).read()
    out = []
    while text:
        head, text = text.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.0"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        assert text[size : size + 4] == b"\r\n\r\n"
        out.append((fields, text[:size]))
        text = text[size + 4 :]
    return out


def test_single_file(spark, tmp_path):
    (path,) = write(spark, records(spark, 1000, 1), tmp_path / "out")
    read = members(path)
    assert read[0][0]["WARC-Type"] == "warcinfo"
    assert [p for _, p in read[1:]] == [PAYLOAD] * 1000
    assert {f["WARC-Warcinfo-ID"] for f, _ in read} == {read[0][0]["WARC-Record-ID"]}
    assert len(re.findall(b"\x1f\x8b\x08\x08", open(path, "rb").read())) >= 1001  # named gzip members


@pytest.mark.parametrize("n,tasks,limit", [(1000, 1, 10240), (10_000, 10, 100_000)])
def test_rotation(spark, tmp_path, n, tasks, limit):
    files = write(spark, records(spark, n, tasks), tmp_path / "out", maxBytes=limit)
    assert len(files) >= 2
    by_task = {}
    for f in files:
        by_task.setdefault(os.path.basename(f)[:10], []).append(f)
    for group in by_task.values():
        assert all(os.path.getsize(f) >= limit for f in group[:-1])
    assert sum(len(members(f)) - 1 for f in files) == n


def test_failed_write_leaves_nothing(spark, tmp_path):
    broken = records(spark, 100, 2).withColumn(
        "warc_type", F.when(F.col("record_id") == "<urn:uuid:99>", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("warc_type"))
    )
    with pytest.raises(Exception):
        write(spark, broken, tmp_path / "out")
    assert os.listdir(tmp_path / "out") == []


def test_overwrite_replaces(spark, tmp_path):
    write(spark, records(spark, 10, 2), tmp_path / "out")
    records(spark, 3, 1).write.format("warc").mode("overwrite").save(str(tmp_path / "out"))
    (path,) = glob.glob(f"{tmp_path}/out/*.warc.gz")
    assert len(members(path)) == 4


def test_responses_become_request_and_response(spark, tmp_path):
    row = ("http://h/p?q=1", dt.datetime(2024, 1, 1), 200, "text/html", b"\x00body\xff")
    df = spark.createDataFrame([row], "url string, ts timestamp, status int, content_type string, body binary")
    out = to_warc_records(df)
    assert [f.name for f in out.schema] == [c.split()[0] for c in SCHEMA.split(", ")]
    (path,) = write(spark, out, tmp_path / "out")
    info, request, response = members(path)
    assert request[1] == b"GET /p?q=1 HTTP/1.1\r\nHost: h\r\nUser-Agent: linkloom/1.0\r\n\r\n"
    assert response[1] == b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n\x00body\xff"
    assert response[0]["Content-Type"] == "application/http; msgtype=response"
    assert response[0]["WARC-Target-URI"] == "http://h/p?q=1" and response[0]["WARC-Date"] == "2024-01-01T00:00:00Z"
    assert response[0]["WARC-Warcinfo-ID"] == info[0]["WARC-Record-ID"]
