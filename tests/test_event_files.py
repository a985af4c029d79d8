"""Event files: documents by file and byte, split ranges, files that grow."""

import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.operators import events
from statloom.sources.event_files import last_end, pieces, read_event_files, stream_event_files
from statloom.streaming import jobs


def document(n: int, text: str = "select 1\n  from t") -> str:
    return (f'<event name="rpc_completed" timestamp="2024-01-01T00:00:{n % 60:02d}.000Z"><data name="duration"><value>{n}</value></data>'
            f'<data name="statement"><value>{text}</value></data><action name="client_app_name"><value>app é</value></action></event>')


def plain_pieces(data: bytes) -> list[tuple[int, bytes]]:
    """Brute force: cut behind every end tag and before every start tag."""
    cuts = {0, len(data)} | {m.end() for m in re.finditer(rb"</event>", data)} | {m.start() for m in re.finditer(rb"<event(?=[\s>])", data)}
    edges = sorted(cuts)
    return [(a, data[a:b]) for a, b in zip(edges, edges[1:])]


PART = st.sampled_from([b"<event ", b"<event>", b"</event>", b"<events>", b"<event", b"</ev", b"\n", b" ", b"x" * 9, "é".encode()])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=12), st.integers(1, 40), st.integers(9, 30))
def test_ranges_own_every_piece_once(parts, width, block):
    data = b"".join(parts)
    got = [p for a in range(0, len(data), width) for p in pieces(io.BytesIO(data), a, min(len(data), a + width), len(data), block)]
    assert [p for p in got if p[1].strip()] == [p for p in plain_pieces(data) if p[1].strip()]
    assert last_end(io.BytesIO(data), len(data), block) == max([m.end() for m in re.finditer(rb"</event>", data)], default=0)


def rows(df):
    return sorted((r.file.rsplit("/", 1)[1], r.file_offset, r.event_xml) for r in df.collect())


def test_batch_splits_files_and_resumes(spark, tmp_path):
    one, two = "\n".join(document(n) for n in range(50)), document(50) + "\ncut <event name='x'" + document(51) + "\n"
    (tmp_path / "a_1.xel").write_text(one)
    (tmp_path / "a_2.xel").write_text(two)
    (tmp_path / "b.txt").write_text(document(99))
    (tmp_path / "_hidden").write_text(document(98))
    (tmp_path / "a_0.xel").write_text("")
    df = read_event_files(spark, f"{tmp_path}/a_*.xel", range_bytes=1000)
    assert df.rdd.getNumPartitions() > 10
    got = rows(df)
    assert got == rows(read_event_files(spark, f"file:{tmp_path}/a_*.xel"))
    assert [x for f, _, x in got if f == "a_1.xel"] == [document(n) for n in range(50)]
    assert [x for f, _, x in got if f == "a_2.xel"] == [document(50), "cut", "<event name='x'", document(51)]
    for file, at, text in got:
        raw = (tmp_path / file).read_bytes()
        assert raw[at:at + len(text.encode())] == text.encode()
    assert sorted(r.event_xml for r in events.event_rejects(df).collect()) == ["<event name='x'", "cut"]
    assert events.event_shred(df).count() == 52

    for seen in (0, 20, 49, 50, 53):
        file, at, _ = got[seen]
        assert rows(read_event_files(spark, f"{tmp_path}/a_*.xel", after=(f"{tmp_path}/{file}", at), range_bytes=1000)) == got[seen + 1:]
    assert rows(read_event_files(spark, f"{tmp_path}/a_2.xel")) == got[50:]


def test_missing_and_empty_folders(spark, tmp_path):
    assert rows(read_event_files(spark, f"{tmp_path}/none")) == []
    assert rows(read_event_files(spark, str(tmp_path))) == []


def test_stream_goes_on_in_files_that_grow(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        jobs.run_to_parquet(stream_event_files(spark, str(folder), range_bytes=700), out, checkpoint)
        return rows(spark.read.parquet(out))

    whole = "\n".join(document(n, "x" * n) for n in range(40)) + "\n"
    (folder / "a.xel").write_text(whole[:3333])
    first = run()
    assert [x for _, _, x in first] == [document(n, "x" * n) for n in range(len(first))] and 5 < len(first) < 40
    assert run() == first  # the last document is not complete yet
    with open(folder / "a.xel", "a") as file:
        file.write(whole[3333:])
    (folder / "b.xel").write_text(document(70) + document(71)[:50])
    assert run() == rows(read_event_files(spark, str(folder)))[:-1]  # a batch also has what is cut off
    with open(folder / "b.xel", "a") as file:
        file.write(document(71)[50:])
    assert run() == rows(read_event_files(spark, str(folder))) and len(run()) == 42


def test_stream_refuses_a_file_that_shrank(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xel").write_text(document(1) + document(2))
    target = (str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    jobs.run_to_parquet(stream_event_files(spark, str(folder)), *target)
    (folder / "a.xel").write_text(document(3))
    with pytest.raises(Exception, match="shorter than what has been read"):
        jobs.run_to_parquet(stream_event_files(spark, str(folder)), *target)


def test_compressed_files_are_read_whole_and_once(spark, tmp_path):
    import gzip
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        jobs.run_to_parquet(stream_event_files(spark, str(folder), range_bytes=700), out, checkpoint)
        return rows(spark.read.parquet(out))

    text = "\n".join(document(n, "x" * n) for n in range(40))
    (folder / "a.xel.gz").write_bytes(gzip.compress(text.encode()))
    (folder / "b.xel").write_text(document(70))
    got = rows(read_event_files(spark, str(folder), range_bytes=500))
    assert [x for _, _, x in got] == [*[document(n, "x" * n) for n in range(40)], document(70)]
    raw = text.encode()
    assert all(raw[at:at + len(x.encode())] == x.encode() for f, at, x in got if f == "a.xel.gz")
    assert rows(read_event_files(spark, str(folder), after=(f"{folder}/a.xel.gz", got[20][1]))) == got[21:]
    assert run() == got and run() == got
    (folder / "c.xel.gz").write_bytes(gzip.compress(document(80).encode()))
    assert run() == [*got, ("c.xel.gz", 0, document(80))]
    (folder / "c.xel.gz").write_bytes(gzip.compress((document(80) + document(81, "y" * 900)).encode()))
    with pytest.raises(Exception, match="has changed"):
        run()


def test_documents_are_dealt_out_and_written_compressed(spark, sf_dir, tmp_path):
    from statloom.fixtures.inputs import Inputs
    from statloom.fixtures.queries import _add_event_files
    made = Inputs(spark, sf_dir).event_documents(dealt=True)
    assert made.rdd.getNumPartitions() > 1  # the table is one row group
    _add_event_files(made, str(tmp_path / "in"))
    texts = sum(made.selectExpr("sum(octet_length(event_xml) + 1)").first())
    assert sum(p.stat().st_size for p in (tmp_path / "in").glob("part-*")) < texts / 4
    assert read_event_files(spark, str(tmp_path / "in")).count() >= made.count()


def test_parts_of_the_documents_are_chosen_before_they_are_built(spark, sf_dir):
    from statloom.fixtures.inputs import Inputs
    some = Inputs(spark, sf_dir).event_documents(dealt=True).filter("event_id % 16 < 2").select("event_xml")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "<event name=" in plan.split("RepartitionByExpression")[0] and "<event name=" not in plan.split("RepartitionByExpression")[1]
