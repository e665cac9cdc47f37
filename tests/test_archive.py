"""Hash trees over byte ranges against a plain computation."""

import hashlib
import os

import pytest

from pitstats.operators import archive


def plain(data, leaf, joined):
    level = [hashlib.sha256(data[i : i + leaf]).digest() for i in range(0, max(1, len(data)), leaf)]
    first = level
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + joined])).digest() for i in range(0, len(level), joined)]
    return level[0].hex(), len(first)


@pytest.mark.parametrize("leaf,joined", [(100, 3), (1_000, 256)])
def test_roots(spark, tmp_path, leaf, joined):
    sizes = {"a": 1, "b": 99, "c": 100, "d": 101, "e": 2_750, "f": 12_345}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(os.urandom(size))
    got = {r.file: (r.root, r.leaves) for r in archive.hash_tree(spark, str(tmp_path), leaf, joined).collect()}
    assert {k: got[k][1] for k in sizes} == {k: plain((tmp_path / k).read_bytes(), leaf, joined)[1] for k in sizes}
    for name in sizes:
        data = (tmp_path / name).read_bytes()
        assert got[name][0] == plain(data, leaf, joined)[0], name


def test_a_file_over_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:  # mostly a hole: takes no disk
        f.seek((2 << 30) + 5)
        f.write(b"end")
    r = archive.hash_tree(spark, str(tmp_path), leaf=256 << 20).collect()[0]
    assert r.bytes == (2 << 30) + 8 and r.leaves == 9
    hole, last = hashlib.sha256(bytes(256 << 20)).digest(), hashlib.sha256(bytes(5) + b"end").digest()
    assert r.root == hashlib.sha256(hole * 8 + last).hexdigest()
