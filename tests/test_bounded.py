"""Python workers hold a few rows at a time, whatever the batch they are sent."""

import io
import tracemalloc
import zipfile

import pyarrow as pa

from textquarry.plans import files as Q
from textquarry.sources import containers as C
from textquarry.sources import files as X
from textquarry.sources.shared import batches, rows_of


def peak(run, batch):
    tracemalloc.start()
    n = sum(part.num_rows for part in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, most


def test_batches_end_by_bytes():
    rows = [("a", b"x" * 1000)] * 50
    schema = pa.schema({"path": pa.string(), "content": pa.binary()})
    parts = list(batches(iter(rows), schema, most=10_000))
    assert sum(p.num_rows for p in parts) == 50 and max(p.num_rows for p in parts) <= 9
    assert list(rows_of(iter(parts))) == rows


def test_containers_and_messages_are_made_and_read_one_at_a_time():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", b"x" * 100_000)
    archives = pa.RecordBatch.from_pydict({"path": [f"{i}.zip" for i in range(800)], "content": [held.getvalue()] * 800})
    n, most = peak(C._unpack(C.RULES), archives)
    assert n == 800 and most < 30 << 20  # of 80 MB
    mail = b"Subject: s\nContent-Type: text/plain\n\n" + b"x" * 100_000
    n, most = peak(X._mime(None), pa.RecordBatch.from_pydict({"path": ["m"] * 800, "pos": list(range(800)), "raw": [mail] * 800}))
    assert n == 800 and most < 30 << 20


def test_items_of_feeds_pass_as_they_come():
    items = pa.RecordBatch.from_pydict({"value": ["<item/>"] * 3})
    first, own, last = Q._rooted(iter([items]))
    assert own is items and first.num_rows == last.num_rows == 1
