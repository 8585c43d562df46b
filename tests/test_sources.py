"""Sources that many tasks read: quoted line breaks, archives, large JSON documents."""

import csv
import io
import json
import random
import zipfile

import pytest

from ledgerlens.sources import archives, documents, quoted, readers, sinks, splits


def small_splits(spark, size):
    """Files are cut into splits of ``size`` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture()
def tiny(spark):
    small_splits(spark, "600b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_state_of_a_line_follows_the_csv_rules():
    """Against the csv module: a line leaves a field open if the next line is read into the same record."""
    rng = random.Random(2)
    for _ in range(4000):
        line = "".join(rng.choice('"",ab ;') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            rows = list(csv.reader([*(['"x\n'] if inside else []), line + "\n", "NEXT"]))
            opened = rows[-1] != ["NEXT"]
            assert quoted.ends_inside(line, inside, ",") == opened, (line, inside)


def test_prefix_scan_equals_a_walk(spark):
    rng = random.Random(3)
    maps, want = [], {}
    for file in range(6):
        state = False
        for block in range(rng.randint(1, 30)):
            outside, inside = rng.choice([(False, True), (True, False), (False, False), (True, True)])
            want[file, block * 10] = state
            maps.append((file, block * 10, outside, inside, False))
            state = inside if state else outside
    got = quoted.begins_inside(spark.createDataFrame(maps, quoted.MAPS)).collect()
    assert {(r.file, r.block): r.inside for r in got} == want


def rows_like(n, rng):
    for i in range(n):
        note = rng.choice(["plain", 'two\nlines', 'a "quoted" word', 'end\r\n"of"\n\nit', "x,y", "", 'five" pipe', "l\n" * 300])
        yield [str(i), note, str(i * 2.5)]


@pytest.mark.parametrize("files", [1, 3])
def test_quoted_line_breaks_over_splits(spark, tiny, tmpdir_path, files):
    rng = random.Random(files)
    want = []
    for k in range(files):
        body = list(rows_like(100, rng))
        want += body
        with open(f"{tmpdir_path}/{k}.csv", "w", newline="") as f:
            writer = csv.writer(f, lineterminator="\r\n" if k % 2 else "\n")
            writer.writerows([["id", "the\nnote", "x"], *body])
    text = quoted.lines(spark, tmpdir_path)
    assert text.select("file", "block").distinct().count() > 20
    assert text.rdd.getNumPartitions() > 20
    df = readers.read_csv(spark, tmpdir_path)
    assert df.columns == ["id", "the\nnote", "x"] and [t for _, t in df.dtypes] == ["bigint", "string", "double"]
    got = sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)
    assert got == sorted(((int(a), b or None, float(c)) for a, b, c in want), key=str)


def test_plain_files_take_sparks_reader(spark, tiny, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write("a;b\n" + "\n".join(f'{i};"v;{i}"' for i in range(300)) + '\n\n5;an inch" mark\n')
    assert quoted.quoted_records(spark, tmpdir_path, ";") is None
    got = readers.read_csv(spark, tmpdir_path, sep=";").collect()
    forced = readers.read_csv(spark, tmpdir_path, sep=";", multi_line=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, forced)) and len(got) == 301


def test_unclosed_quote_and_odd_files(spark, tiny, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write('a,b\n1,x\n2,"open\n3,y\n4,z')
    got = readers.read_csv(spark, tmpdir_path).collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, "open\n3,y\n4,z")]
    with open(f"{tmpdir_path}/b.csv", "wb") as f:
        f.write(b'a,b\n5,"\xff\n"\n')
    got = sorted(map(tuple, readers.read_csv(spark, tmpdir_path).collect()))
    assert got[-1] == (5, "�\n")


def document(rng, rows):
    """A document's text and its rows under the reader's rule."""
    def value(depth):
        return rng.choice([1, -2.5, None, True, "plain", 'q"uo,te', "back\\slash\\", "{[,]}", "é日", ""] +
                          ([{"k": value(depth + 1), "l,": [value(depth + 1)]}, [value(depth + 1)] * 2] if depth < 3 else []))
    items = [rng.choice([{"id": i, "v": value(0)}, {"id": i, "w": {"x": value(1)}}]) for i in range(rows)]
    other = [{"id": -1}]
    kind = rng.randrange(4)
    doc = (items if kind == 0 else {"meta": {"a": [1, 2], "b": "["}, "rows": items, "more": other} if kind == 1 else
           {"rows": items, "z": "]"} if kind == 2 else {"id": 10**6, "note": "x" * rng.randint(0, 3000), "sub": {"l": [1, 2]}})
    text = json.dumps(doc, ensure_ascii=False, indent=rng.choice([None, None, 2]), separators=rng.choice([None, (",", ":")]))
    return rng.choice(["", "\n  "]) + text + rng.choice(["", "\n"]), items if kind < 3 else [doc]


def test_documents_over_splits(spark, tiny, tmpdir_path):
    rng = random.Random(4)
    want = []
    for k in range(12):
        text, rows = document(rng, rng.choice([0, 1, 60, 120]))
        want += rows
        with open(f"{tmpdir_path}/{k}.json", "w") as f:
            f.write(text)
    with open(f"{tmpdir_path}/blank.json", "w") as f:
        f.write(" \n")
    assert splits.pieces(spark, tmpdir_path, ",").select("file", "block").distinct().count() > 25
    got = [json.loads(r.value) for r in documents.elements(spark, tmpdir_path).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_a_document_of_scalars_and_one_that_is_none(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.json", "w") as f:
        f.write('[1, "two, three", [4, 5], null, {"k": 1}]')
    assert sorted(r.value for r in documents.elements(spark, tmpdir_path).collect()) == [
        '{"0":"two, three"}', '{"0":1}', '{"0":[4, 5]}', '{"0":null}', '{"k": 1}']
    with open(f"{tmpdir_path}/a.json", "w") as f:
        f.write("hello, world")
    with pytest.raises(Exception, match="not a JSON document"):
        documents.elements(spark, tmpdir_path).collect()


def test_cutter_takes_text_in_any_chunks():
    rng = random.Random(8)
    for _ in range(60):
        text, rows = document(rng, rng.randint(0, 9))
        raw = text.encode()

        class Opened(io.BytesIO):
            def read(self, n=-1):
                return super().read(rng.randint(1, 40) if n > 0 else n)

        got = [json.loads(x) for x in archives.json_rows(lambda: Opened(raw))]
        assert got == rows


def test_archives_are_read_member_by_member(spark, tmpdir_path):
    for k in range(5):
        with zipfile.ZipFile(f"{tmpdir_path}/{k}.zip", "w", zipfile.ZIP_DEFLATED) as zf:
            zf.writestr("t.csv", "a,b\n" + "".join(f"{k},{i}\n" for i in range(7000)))
            zf.writestr("sub/lines.json", '{"l": [1]}\n{"l": []}\n')
            zf.writestr("bad.json", '[{"a": 1}, {"a": ')
            zf.writestr("words.json", "no json")
    with open(f"{tmpdir_path}/4.zip", "r+b") as f:
        f.truncate(100)
    rows = readers.archive_members(spark, tmpdir_path)
    assert rows.rdd.getNumPartitions() == 4 * 4 + 1
    tables, failed = readers.archive_tables(spark, tmpdir_path)
    assert set(tables) == {f"{k}.zip/{m}" for k in range(4) for m in ("t.csv", "lines.json")}
    assert sorted(r.member or "" for r in failed.collect()) == ["", *["bad.json"] * 4, *["words.json"] * 4]
    both = readers.archive_table(spark, f"{tmpdir_path}/3.zip", "t.csv")
    assert both.count() == 7000 and dict(both.dtypes) == {"a": "bigint", "b": "bigint"}
    with pytest.raises(ValueError):
        readers.archive_table(spark, f"{tmpdir_path}/3.zip", "none.csv")
    assert readers.archive_members(spark, tmpdir_path).where("member = 'lines.json'").count() == 8


def test_archive_writer_streams_and_rereads(spark, tmpdir_path):
    df = spark.range(25_000).selectExpr("id", "concat('v', id, ',\"') AS v").repartition(3)
    sinks.write_archives(df, f"{tmpdir_path}/z", "t.csv").collect()
    back = readers.archive_table(spark, f"{tmpdir_path}/z", "t.csv")
    assert back.exceptAll(df).isEmpty() and back.count() == 25_000


def test_elements_go_on_as_lines_of_many(spark, tmpdir_path):
    rows = [{"id": i, "note": 'a, "b" [{', "of": [i, {"k": None}]} for i in range(30_000)]
    with open(f"{tmpdir_path}/a.json", "w") as f:
        f.write('{"meta": [],\n "x": 1}')
    with open(f"{tmpdir_path}/b.json", "w") as f:
        f.write('{"n": {"of": [1]}, "rows":\n[' + "\n,\t".join(map(json.dumps, rows)) + "\n], \"more\": [{}]}\n")
    lines = documents.element_lines(spark, tmpdir_path)
    assert lines.count() < 30
    got = [json.loads(r.value) for r in documents.elements(spark, tmpdir_path).collect()]
    assert sorted(got, key=lambda x: x["id"]) == rows  # the first document's own list is empty


@pytest.mark.parametrize(("chunk", "longest"), [(300, 40), (5000, 1 << 20)])
def test_blocks_of_any_size_and_lines_too_long(spark, tiny, tmpdir_path, monkeypatch, chunk, longest):
    """Lines of ``longest`` bytes are left out, so such files are read by commas; a file that is one such line has no piece at all."""
    monkeypatch.setattr(documents, "LINE", longest)
    monkeypatch.setattr(documents, "CHUNK", chunk)
    rng = random.Random(chunk + longest)
    want = []
    for k in range(5):
        text, rows = document(rng, rng.choice([0, 1, 30, 60]))
        want += rows
        with open(f"{tmpdir_path}/{k}.json", "w") as f:
            f.write(text)
    mixed = [1, {"a": 1}, "x, y", {"b": [{}, 2]}, [3], None] * 20
    with open(f"{tmpdir_path}/mixed.json", "w") as f:
        f.write(json.dumps(mixed, ensure_ascii=False, indent=1))
    want += [x if isinstance(x, dict) else {"0": x} for x in mixed]
    got = [json.loads(r.value) for r in documents.elements(spark, tmpdir_path).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_one_long_line_alone_is_read_by_commas(spark, tmpdir_path):
    rows = [{"id": i, "t": "x" * 90} for i in range(20_000)]
    with open(f"{tmpdir_path}/a.json", "w") as f:
        json.dump(rows, f)
    assert splits.pieces(spark, tmpdir_path, "\n", longest=documents.LINE).count() == 0
    df = readers.read_json(spark, tmpdir_path, multi_line=True)
    assert df.selectExpr("count(*)", "sum(id)", "min(length(t))").first() == (20_000, sum(range(20_000)), 90)


def test_written_documents_have_many_rows_on_a_line(spark, tmpdir_path):
    df = spark.range(5000).selectExpr("id", "repeat('w', IF(id = 7, 100000, 30)) AS w").repartition(3)
    sinks.write_json_documents(df, f"{tmpdir_path}/d", "rows")
    text = spark.read.text(f"{tmpdir_path}/d", wholetext=True).collect()
    assert sorted(r["id"] for t in text for r in json.loads(t.value)["rows"]) == list(range(5000))
    assert spark.read.text(f"{tmpdir_path}/d").count() < 30
    assert readers.read_json(spark, f"{tmpdir_path}/d", multi_line=True).selectExpr("count(*)", "sum(length(w))").first() == (5000, 30 * 4999 + 100_000)
