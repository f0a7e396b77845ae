"""The manifest is what commits an archive."""

import os

import pytest

from linkloom.sources import warc
from tests.test_warc import members, records


def save(spark, df, path, mode="append", **options):
    warc.register(spark)
    df.write.format("warc").options(**options).mode(mode).save(str(path))


def counted(path):
    return sum(len(members(f)) - 1 for f in warc.committed_files(str(path)))


def test_a_job_counts_once_and_others_add(spark, tmp_path):
    for job in ("monday", "monday", "tuesday"):
        save(spark, records(spark, 20, 2), tmp_path / "out", jobId=job)
    assert counted(tmp_path / "out") == 40
    save(spark, records(spark, 5, 1), tmp_path / "out")
    assert counted(tmp_path / "out") == 45
    found = warc.manifests(str(tmp_path / "out"))
    assert sorted(sum(n for _, _, n in m.files) for m in found.values()) == [5, 20, 20]
    for m in found.values():
        assert all(os.path.getsize(tmp_path / "out" / name) == size for name, size, _ in m.files)


def test_a_commit_that_was_killed_shows_nothing(spark, tmp_path, monkeypatch):
    writer = warc.WarcWriter(str(tmp_path), 1 << 20, overwrite=False, job="x")
    (tmp_path / "part-00000-left-0.warc.gz").write_bytes(b"half a file")
    message = warc.FilesWritten([("part-00000-left-0.warc.gz", 11, 1)])
    text = warc.Manifest.text
    for end in (0, 10, -1):  # at any place of the manifest
        monkeypatch.setattr(warc.Manifest, "text", lambda self: text(self)[:end])
        writer.commit([message])
        assert warc.committed_files(str(tmp_path)) == []
    monkeypatch.setattr(warc.Manifest, "text", text)
    save(spark, records(spark, 7, 1), tmp_path, jobId="x")  # the rerun does its work
    assert counted(tmp_path) == 7


def test_overwrite_leaves_its_own_files_only(spark, tmp_path):
    save(spark, records(spark, 10, 2), tmp_path / "out", jobId="a")
    save(spark, records(spark, 4, 2), tmp_path / "out", mode="overwrite", jobId="b")
    assert counted(tmp_path / "out") == 4
    on_disk = {n for n in os.listdir(tmp_path / "out") if n.endswith(".warc.gz")}
    assert on_disk == {os.path.basename(f) for f in warc.committed_files(str(tmp_path / "out"))}


def test_files_of_other_attempts_are_cleared(tmp_path):
    writer = warc.WarcWriter(str(tmp_path), 1 << 20, overwrite=False)
    for attempt in (1, 2):
        (tmp_path / f"part-00000-{writer.run}-{attempt}-0.warc.gz").write_bytes(b"x")
    (tmp_path / "part-00000-another-1-0.warc.gz").write_bytes(b"x")
    writer.commit([warc.FilesWritten([(f"part-00000-{writer.run}-2-0.warc.gz", 1, 0)]), None])
    assert [os.path.basename(f) for f in warc.committed_files(str(tmp_path))] == [f"part-00000-{writer.run}-2-0.warc.gz"]
    assert len([n for n in os.listdir(tmp_path) if n.endswith(".gz")]) == 2


@pytest.mark.parametrize("name", ["batch-7", "a/b c", "é" * 100])
def test_manifest_names_are_file_names(name):
    assert "/" not in warc._manifest_name(name) and len(warc._manifest_name(name)) < 80
