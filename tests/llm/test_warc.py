"""Archives written and read back against digests taken directly."""

import hashlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import warc

PAGES = [(1, "http://a/", "x" * 1000), (5, "http://b/", "x" * 1000), (3, None, "x" * 1000), (3, "http://c/\r\nWARC-Type: x", "x" * 999), (4, "http://é/", "x" * 999), (6, "u", None), (None, "v", ""), (7, "w", "é\r\n\r\nWARC/1.1\r\n" * 200), (None, "y", "é\r\n\r\nWARC/1.1\r\n" * 200), (8, "z", "big " * 500_000), (9, "r", "y" * 2000), (9, "r", "y" * 2000), (9, "q", "y" * 2000), (2, "q", "y" * 2000), (None, "n", "z" * 1500), (None, "n", "z" * 1500)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "a", "b") for p in PAGES], "page_id long, url string, html string, id string, digest string").repartition(4)


def want():
    groups = defaultdict(list)
    for i, u, h in PAGES:
        groups[h or ""].append((i if i is not None else -1, u is not None, u or ""))
    out = Counter()
    for h, g in groups.items():
        data = h.encode()
        digest, head = hashlib.sha1(data).hexdigest(), max(g)
        name = lambda i: None if i == -1 else str(i)
        for k, (i, *_) in enumerate(sorted(g, reverse=True)):
            small = len(data) < 1000
            out[name(i), "response" if small or not k else "revisit", None if small or not k else name(head[0]), digest, len(data)] += 1
    return out


def test_round_trip(pages, tmp_path):
    index = warc.write_archives(pages, f"file://{tmp_path}/a")
    assert index.count() == len(PAGES)
    got = warc.read_archives(index).collect()
    assert Counter((r.id, r.kind, r.refers_to, r.digest, r.length) for r in got) == want()
    for r in got:
        assert (r.payload is None) == (r.kind == "revisit")
        assert r.kind == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.digest
    some = warc.read_archives(index.filter("kind = 'revisit' OR id = '8'"))
    assert Counter(r.kind for r in some.collect()) == Counter(r[1] for r in want().elements() if r[1] == "revisit" or r[0] == "8")


def test_archives_are_gzip_members(pages, tmp_path):
    import gzip

    index = warc.write_archives(pages, f"file://{tmp_path}/a")
    for name in {r.file for r in index.select("file").collect()}:
        data = gzip.decompress(open(name.removeprefix("file://"), "rb").read())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and data.endswith(b"\r\n\r\n")


def test_empty(pages, tmp_path):
    index = warc.write_archives(pages.limit(0), f"file://{tmp_path}/a")
    assert index.count() == warc.read_archives(index).count() == 0


def test_damage_is_found(pages, tmp_path):
    index = warc.write_archives(pages.filter("page_id = 8"), f"file://{tmp_path}/a")
    r = index.first()
    path = r.file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[r.offset + r.length // 2] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="Error|digest"):
        warc.read_archives(index).collect()
