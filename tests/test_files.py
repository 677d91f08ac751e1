"""Lists of files, and files opened by path and by URI."""

import pytest

from octoloom.sources import files, tars
from octoloom.sources.blobs import read_chunks


@pytest.fixture
def folder(tmp_path):
    for name in ("a/1.bin", "a/2.tar", "b/3.bin", "a/.hid.bin", "top.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    return tmp_path


@pytest.mark.parametrize("form", ["{}", "file://{}"])
def test_found_by_folder_pattern_and_name(folder, form):
    root = form.format(folder)

    def names(path, suffix=""):
        return [n.removeprefix(f"{root}/") for n, _ in files.find(f"{root}{path}", suffix)]

    assert names("") == names("/") == ["top.bin"]
    assert names("/a") == ["a/1.bin", "a/2.tar"]
    assert names("/a", ".tar") == ["a/2.tar"]
    assert names("/*/*.bin") == ["a/1.bin", "b/3.bin"]
    assert names("/[ab]/?.tar") == ["a/2.tar"]
    assert files.find(f"{root}/top.bin") == [(f"{root}/top.bin", 7)]
    assert files.find(f"{root}/none") == [] == files.find(f"{root}/none/*")


def test_opened_and_written_by_uri(spark, folder):
    uri = f"file://{folder}"
    files.make_folder(f"{uri}/new/in")
    files.write_file(f"{uri}/new/in/x", b"body", "1")
    files.write_file(f"{uri}/new/in/x", b"again", "2")
    with files.open_file(f"{uri}/new/in/x") as file:
        file.seek(2)
        assert file.read() == b"ain"
    assert [p.name for p in (folder / "new/in").iterdir()] == ["x"]
    rows = read_chunks(spark, f"{uri}/*/*.bin", 4).orderBy("blob_id", "chunk_id").collect()
    assert [bytes(r.data) for r in rows] == [b"a/1.", b"bin", b"b/3.", b"bin"]
    for read in (tars.read_members, tars.read_shards, read_chunks):
        assert read(spark, str(folder / "none")).count() == 0
