"""What a worker keeps between stages."""

import gc
import weakref

import public_tokenizers
import pyarrow as pa

from lodestone.llm import alignment
from lodestone.llm.packing import word_ids
from lodestone.llm.substrings import _requests


def test_memos_go_with_the_next_operator():
    path = public_tokenizers.path("word_bpe_49k.json")
    memo = weakref.ref(word_ids(path))
    gc.collect()
    assert memo() is word_ids(path)  # kept from task to task
    assert list(_requests(lambda b: (), 1)(iter([pa.record_batch({"x": [1]})]))) == []
    assert memo() is None
    assert len(word_ids(path)) == 0


def test_tokenizers_go_before_documents_are_put_together():
    side = weakref.ref(alignment.sides(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0])
    lists = [pa.array([], pa.list_(pa.int32()))] * 4
    left = pa.table({"batch": [3], "ids": [[7]], "sizes": [b"\0\0\0\0"], "segs": [b""]})
    right = pa.table([pa.array([], pa.int32()), *lists], ["seg", "a", "b", "a_last", "b_last"])
    names = ["batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own", "links", "number", "pair", "docs"]
    assert alignment.documents(left, right, names).select(names[:7]).to_pylist() == [{"batch": 3, "id": 7, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}]
    assert side() is None


def test_links_by_steps(monkeypatch):
    """Links of many segments are never one sorted array; by steps they are the same."""
    lists = [pa.array([[5, 6], [7], [5, 6], [8]], pa.list_(pa.int32())), pa.array([[1], [2, 3], [1], [4]], pa.list_(pa.int32())), pa.array([[1], [0], [1], [0]], pa.list_(pa.int32())), pa.array([[0], [1], [0], [0]], pa.list_(pa.int32()))]
    text, pairs, n = alignment.group_links(*lists)
    for step in (1, 3, 100):
        monkeypatch.setattr(alignment, "STEP", step)
        own, known, code, k = alignment.coded_links(*lists)
        assert own.to_pylist() == text.to_pylist() == ["5,6|1", "7|2,3", "5,6|1", "8|4"]
        assert known[code].tolist() == pairs.tolist() and k.tolist() == n.tolist() and len(known) == 5
    assert [len(x) for x in alignment.coded_links(*(x.slice(0, 0) for x in lists))] == [0, 0, 0, 0]
