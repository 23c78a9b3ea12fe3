import json
import random

import pytest

from quern.sources import ndjson
from quern.streaming import ingest


def test_lines_cut_at_every_byte(tmp_path):
    """A file that grows by a byte a batch gives each line once, when its end is there, in pieces of any size."""
    data = '{"event": "a"}\n\n\r\nnoise é {"event": "b"} tail\nlast\n'.encode() + b"\xff\ncut"
    for split in (1, 3, 1 << 20):
        file, at, got = tmp_path / f"log{split}", {"files": "{}"}, []
        reader = ndjson.LineStreamReader({"path": str(file), "splitBytes": str(split)})
        for n in range(len(data) + 1):
            file.write_bytes(data[:n])
            to = reader.latestOffset()
            new = [x[0] for p in reader.partitions(at, to) for x in reader.read(p)]
            assert bool(new) == (data[n - 1 : n] == b"\n")
            got, at = got + new, to
            if n % 7 == 0:  # a restart
                reader = ndjson.LineStreamReader({"path": str(file), "splitBytes": str(split)})
                assert reader.latestOffset() == at
        assert got == ["{\"event\": \"a\"}", "", "", 'noise é {"event": "b"} tail', "last", "\ufffd"]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_hold_each_line_once(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    for n in range(100):
        monkeypatch.setattr(ndjson, "CHUNK", rng.choice([1, 3, 7, 1 << 20]))
        kinds = [b"", b"x", b"{}\r", "é".encode(), b"a long line"]
        data = b"".join(rng.choice(kinds) + b"\n" for _ in range(rng.randint(0, 12))) + rng.choice([b"", b"cut"])
        (tmp_path / "log").write_bytes(data)
        for closed in ("true", "false"):
            reader = ndjson.LineReader({"path": str(tmp_path / "log"), "splitBytes": str(rng.choice([1, 2, 5, 100])), "closed": closed})
            got = [x[0] for p in reader.partitions() for x in reader.read(p)]
            lines = data.split(b"\n")
            want = [x.removesuffix(b"\r").decode() for x in lines[:-1]] + ([lines[-1].decode()] if lines[-1] and closed == "true" else [])
            assert got == want, (n, data, closed)


def test_streamed_log_of_events(spark, tmp_path):
    """Batches of a log that is written in between, one stopped within a line; a restart goes on from the checkpoint. Batch reads and missing folders besides."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    lines = [json.dumps({"event": f"e{i}", "source": "s", "name": None, "count": i}) for i in range(6)]
    whole = ("\n".join(["chatter", *lines[:3], "x " + lines[3] + " y", *lines[4:]])).encode()
    assert ingest.read_events(spark, str(logs)).count() == 0
    logs.mkdir()

    def run():
        stream = ingest.event_stream(spark, str(logs)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["event"] for r in spark.read.schema(ingest.EVENT).parquet(out).collect())

    (logs / "a.ndjson").write_bytes(whole[:100])
    (logs / ".hidden").write_bytes(whole)
    assert run() == ["e0"]
    (logs / "a.ndjson").write_bytes(whole)
    (logs / "b.ndjson").write_text(lines[0] + "\n")
    assert run() == ["e0", "e0", "e1", "e2", "e3", "e4"]  # the last line has no end yet
    (logs / "a.ndjson").write_bytes(whole + b"\n")
    assert run() == ["e0", "e0", "e1", "e2", "e3", "e4", "e5"]
    assert ingest.read_events(spark, str(logs), splitBytes="50").count() == 7
    (logs / "b.ndjson").write_text(lines[0] + "\n" + lines[1])
    assert ingest.read_events(spark, str(logs), closed="true").count() == 8
