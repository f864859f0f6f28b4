"""Changes of a folder over several polls."""

import os

import pytest

from lectern.sources.content_store import ContentStore
from lectern.streaming.folder import FolderWatch


def test_changes_by_content(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    watch, seen = FolderWatch(spark, str(folder), ContentStore(spark, str(tmp_path / "store"))), []

    def poll():
        seen.clear()
        watch.poll(lambda changes: seen.extend(sorted((r.source, r.change, r.was, bytes(r.content) if r.content is not None else None) for r in changes.collect())))
        return list(seen)

    write = lambda name, content, at: ((folder / name).write_bytes(content), os.utime(folder / name, (at, at)))
    write("a b+[1].md", b"one", 1000), write("b.txt", b"two", 1000), write("c.md", b"three", 1000), write("empty.md", b"", 1000), write("d.md", b"four", 1000)
    assert poll() == [("a b+[1].md", "added", None, b"one"), ("b.txt", "added", None, b"two"), ("c.md", "added", None, b"three"), ("d.md", "added", None, b"four")]
    assert poll() == []
    # Touched, changed with its size kept, renamed, removed, copied.
    os.utime(folder / "c.md", (2000, 2000))
    write("b.txt", b"TWO", 2000)
    os.rename(folder / "a b+[1].md", folder / "moved.md")
    os.unlink(folder / "d.md")
    write("copy.txt", b"TWO", 2000)
    assert poll() == [("b.txt", "changed", None, b"TWO"), ("copy.txt", "added", None, b"TWO"), ("d.md", "removed", None, None), ("moved.md", "renamed", "a b+[1].md", None)]
    assert poll() == []
    # A handler that fails gets its changes again; one of two polls is told.
    write("e.md", b"five", 3000)
    with pytest.raises(ZeroDivisionError):
        watch.poll(lambda changes: 1 / 0)
    assert poll() == [("e.md", "added", None, b"five")]
    write("e.md", b"", 4000)
    for name in set(os.listdir(folder)) - {"e.md", "empty.md"}:
        os.unlink(folder / name)
    assert {(s, c) for s, c, *_ in poll()} == {(n, "removed") for n in ("b.txt", "c.md", "copy.txt", "e.md", "moved.md")}
    os.unlink(folder / "e.md"), os.unlink(folder / "empty.md"), folder.rmdir()
    with pytest.raises(FileNotFoundError):
        poll()
