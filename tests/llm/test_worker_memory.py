"""What a packing worker holds of an Arrow batch at a time."""

import tracemalloc

import pyarrow as pa
import pytest

from chatlens.llm import common, packing


class Enc:
    """Two bytes of ids per text."""
    width = 2

    def encode(self, texts):
        return [b'\x01\x00'] * len(texts)


@pytest.mark.parametrize('limit', [1, 7, 1 << 20])
@pytest.mark.parametrize('kind', [pa.string(), pa.large_string()])
def test_slices_hold_every_row_once(limit, kind):
    texts = ['', 'a' * 5, None, 'é' * 4, '', '', 'b' * 30, 'c']
    whole = pa.array(['skipped', *texts], kind)
    for column in (pa.array(texts, kind), whole.slice(1)):
        got = list(common.text_slices(column, limit))
        assert [(i, x) for lo, part in got for i, x in enumerate(part, lo)] == list(enumerate(texts))
        assert all(len(p) == 1 or sum(len((x or '').encode()) for x in p) <= limit or
                   sum(1 for x in p if x) == 1 for _, p in got)
    assert list(common.text_slices(pa.array([], kind), limit)) == []


def test_a_batch_is_not_held_as_python_texts():
    """20 MB of texts in one batch: a slice of it is in Python at a time."""
    n = 10_000
    batch = pa.record_batch([pa.array(range(n)), pa.array(['s'] * n), pa.array([f'{i:05d}' * 400 for i in range(n)])],
                            names=['doc_id', 'source', 'text'])
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in packing.cut_batches([batch], 0, Enc(), 0, 256))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n and batch.nbytes > 20_000_000
    assert peak < 6_000_000, peak


def test_slicing_changes_no_packet(monkeypatch):
    """Places, tokens and bytes are the same with one text a slice."""
    class Words(Enc):
        def encode(self, texts):
            return [b''.join(len(w).to_bytes(2, 'little') for w in t.split()) for t in texts]

    texts = ['', 'a bb ccc ' * 200, 'd', 'e ff ' * 300, 'g h']
    batch = pa.record_batch([pa.array([3, None, 5, 5, 1]), pa.array(['x', None, 'x', 'y', None]), pa.array(texts)],
                            names=['doc_id', 'source', 'text'])

    def cut():
        return [r for b in packing.cut_batches([batch, batch], 4, Words(), 9, 256) for r in b.to_pylist()]

    want = cut()
    monkeypatch.setattr(packing, 'GROUP_BYTES', 1)
    assert cut() == want
    assert sum(r['length'] for r in want) == 2 * sum(len(t.split()) + 1 for t in texts)
