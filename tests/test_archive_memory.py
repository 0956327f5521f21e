"""Archives pass through tasks in batches of bounded size, however many rows come at once."""

import io
import zipfile

import pyarrow as pa

from credsieve.plans import catalog
from credsieve.sources import archives


def _batch(**columns):
    return pa.RecordBatch.from_pydict(columns)


def test_made_archives_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(catalog, "ARCHIVE_BYTES", 2000)
    batch = _batch(project=["p"] * 50, path=[f"f{i}" for i in range(50)], content=["text"] * 50)
    found = list(catalog._zip(iter([batch])))
    assert sum(b.num_rows for b in found) == 50 and max(b.num_rows for b in found) < 10


def test_members_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    batch = _batch(project=["p"] * 40, path=[f"f{i}" for i in range(40)], content=["x" * 300] * 40)
    found = list(archives._expand(catalog._zip(iter([batch]))))
    rows = [r for b in found for r in b.to_pylist()]
    assert max(sum(len(r["raw"] or b"") for r in b.to_pylist()) for b in found) <= 1300
    assert len(rows) == 120 and sum(r["raw"] == b"x" * 300 for r in rows) == 40


def test_an_archive_is_written_over_batches(tmp_path):
    rows = [("a", 1, f"f{i:02}", f"text {i}") for i in range(9)] + [("a", 2, "g", ""), ("b", 1, "h", "last")]
    columns = dict(zip(("project", "part", "path", "content"), map(list, zip(*rows))))
    whole = _batch(**columns)
    pieces = [whole.slice(i, 2) for i in range(0, len(rows), 2)]
    written = list(catalog._write_archives(str(tmp_path))(iter(pieces)))
    assert sum(b.column(0)[0].as_py() for b in written) == len(rows)
    for project, part in (("a", 1), ("a", 2), ("b", 1)):
        with zipfile.ZipFile(io.BytesIO((tmp_path / "all" / f"{project}-{part}.zip").read_bytes())) as archive:
            found = {n: archive.read(n).decode() for n in archive.namelist()}
        assert found == {r[2]: r[3] for r in rows if r[:2] == (project, part)} | {"../outside": "no"}


def test_no_rows_give_no_archives(tmp_path):
    assert list(catalog._zip(iter([]))) == [] == list(archives._expand(iter([])))
    assert [b.column(0).to_pylist() for b in catalog._write_archives(str(tmp_path))(iter([]))] == [[0]]
