"""Large files by byte ranges against Spark's readers of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablewright.sources import ranges, readers
from tablewright.sources.csv_ranges import STATES, Grammar, csv_heads, csv_records, range_records
from tablewright.sources.files import list_files


def rows(df):
    return sorted(r["j"] for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("j")).collect())


TRICKY = ['plain', 'a]b[c', '{"x":[1,2]}', 'quote " inside', 'back\\slash', 'end\\', '\\\\"', 'comma, here',
          'ü "é" \\" ]', '', '\\', '"', 'line\nbreak', 'a: "b", c']


def array_text(n, pretty):
    draw = random.Random(4)
    items = [
        {"id": i, "s": draw.choice(TRICKY), "list": [draw.choice(TRICKY), None][: i % 3],
         "inner": None if i % 5 == 0 else {"k": draw.choice(TRICKY), "deep": [[i], []]}}
        for i in range(n)
    ]
    return json.dumps(items, indent=2 if pretty else None, ensure_ascii=False)


@pytest.mark.parametrize(("size", "pretty"), [(7, False), (64, True)])
def test_json_array_in_ranges(spark, tmp_path, size, pretty):
    path = tmp_path / "a.json"
    path.write_text(array_text(40, pretty), encoding="utf-8")
    whole = spark.read.option("multiLine", True).json(str(path))
    split = readers.read_json_array(spark, str(path), range_bytes=size)
    assert split.schema == whole.schema
    assert rows(split) == rows(whole)


def test_json_array_takes_a_task_per_range(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(array_text(2000, False), encoding="utf-8")
    size = path.stat().st_size // 16 + 1
    states = ranges.json_states(spark, str(path), size)
    found = ranges.array_rows(states, ()).select(F.spark_partition_id().alias("p"))
    per_task = [r["count"] for r in found.groupBy("p").count().collect()]
    assert len(per_task) >= 8 and sum(per_task) == 2000 and max(per_task) < 1000


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks go with the bytes and the cores, not with the number of ranges; no row is lost."""
    path = tmp_path / "a.json"
    path.write_text(array_text(2000, False), encoding="utf-8")
    size = path.stat().st_size // 300
    states = ranges.json_states(spark, str(path), size)
    assert states.count() >= 300
    most = 4 * spark.sparkContext.defaultParallelism
    assert states.rdd.getNumPartitions() <= most
    assert ranges.file_ranges(list_files(spark, str(path)), size).rdd.getNumPartitions() <= most
    assert ranges.array_rows(states, ()).count() == 2000
    monkeypatch.setattr(ranges, "RANGE", 4 * size)  # tasks of more bytes than that are not made
    assert ranges.range_tasks(states, size) >= 300 // 4


@pytest.mark.parametrize("text", ["[]", "[ ]", "[null, {\"a\":1}]", "[{\"a\":1}]\n", "[{\"a\":1},]",
                                  "[{\"a\":1}, {\"a\":", "[1, 2]", "{\"a\":1}", "[[{\"a\":1}]]"])
def test_json_array_edges(spark, tmp_path, text):
    """Empty arrays, NULLs, broken files and files that are no array of objects, as Spark reads them."""
    path = tmp_path / "e.json"
    path.write_text(text)

    def outcome(read):
        try:
            df = read()
            return df.schema, rows(df) if df.columns else df.count()
        except Exception as error:
            return type(error)

    whole = outcome(lambda: spark.read.option("multiLine", True).json(str(path)))
    assert outcome(lambda: readers.read_json_array(spark, str(path), range_bytes=2)) == whole


def test_json_array_of_many_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(array_text(30, True), encoding="utf-8")
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + array_text(9, False).encode())
    (tmp_path / "c.json").write_text("[]")
    whole = spark.read.option("multiLine", True).json(str(tmp_path))
    split = readers.read_json_array(spark, str(tmp_path), range_bytes=50)
    assert rows(split) == rows(whole)


def nested_text(n):
    return json.dumps({
        "meta": {"note": 'has "items": [ {', "few": [{"x": 1}, {"x": 2}], "n": [1, 2, 3] * n},
        "da\"ta": {"items": json.loads(array_text(n, False)), "more": {"empty": []}},
        "items": [{"z": i, "items": [{"q": 1}] * 5} for i in range(n // 2)],
        "tail": [[{"not": "reached"}] * (n * 3)],
    }, ensure_ascii=False, indent=1)


@pytest.mark.parametrize(
    ("size", "json_path"),
    [(11, None), (90, "$.meta.few"), (300, "meta.n"), (40, "`da\"ta`.items")],
)
def test_json_nested_in_ranges(spark, tmp_path, size, json_path):
    path = tmp_path / "n.json"
    path.write_text(nested_text(24), encoding="utf-8")
    whole = readers.read_json_nested(spark, str(path), json_path, range_bytes=10**9)
    split = readers.read_json_nested(spark, str(path), json_path, range_bytes=size)
    assert split.schema == whole.schema
    assert rows(split) == rows(whole)


# ---------------------------------------------------------------- CSV


CELLS = ['', 'x', 'two\nlines', 'crlf\r\nhere', 'quote "q"', 'a,b', '"', ' blank ', 'ü\n"é",\n', '\n', 'x"y']


def csv_text(n, newline="\n", seed=5):
    draw = random.Random(seed)

    def cell(c):
        return '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c

    lines = [",".join([str(i), cell(draw.choice(CELLS)), cell(draw.choice(CELLS))]) for i in range(n)]
    return newline.join(["id,a,b", *lines]) + newline


def whole_records(text, grammar):
    at, out = 0, []
    for end in grammar.starts(text, 0, "N"):
        if end > at:
            out.append(text[at : end - 1])
        at = end
    return [*out, *([text[at:]] if at < len(text) else [])]


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_csv_records_meet_at_every_border(tmp_path, newline):
    """Every place of the file as the border of two ranges."""
    text = csv_text(12, newline).encode() + b'13,plain "stray" quote,"closed"tail\n14,"open'.replace(
        b"\n", newline.encode())
    end = b"\r" if newline == "\r" else b"\n"
    grammar = Grammar(",", '"', end, "utf-8")
    path = tmp_path / "x.csv"
    path.write_bytes(text)
    want = [r.removesuffix(b"\r") if end == b"\n" else r for r in whole_records(text, grammar)]
    for cut in range(1, len(text)):
        state = grammar.ends(text[:cut])["N"]
        got = list(range_records(grammar, {"path": str(path), "start": 0, "stop": cut, "state": "N"}))
        got += range_records(grammar, {"path": str(path), "start": cut, "stop": len(text), "state": state})
        assert got == want, cut


def test_csv_cells_cut_off_in_quotes_stay_whole(tmp_path):
    """Delimiters and line breaks behind the quote of a cell that the border of two ranges cuts."""
    text = b'1,"a, b, ""c"", d\ne, f",2\n3,"g, h\ni, j",4\n'
    grammar = Grammar(",", '"', b"\n", "utf-8")
    path = tmp_path / "x.csv"
    path.write_bytes(text)
    want = [b'1,"a, b, ""c"", d\ne, f",2', b'3,"g, h\ni, j",4']
    for cut in range(1, len(text)):
        state = grammar.ends(text[:cut])["N"]
        got = list(range_records(grammar, {"path": str(path), "start": 0, "stop": cut, "state": "N"}))
        got += range_records(grammar, {"path": str(path), "start": cut, "stop": len(text), "state": state})
        assert got == want, cut


def test_csv_states_can_be_put_together():
    text = csv_text(8).encode() + b'"a""b",c"d,"e"f\n'
    grammar = Grammar(",", '"', b"\n", "utf-8")
    for cut in range(len(text) + 1):
        for state in STATES:
            between = grammar.ends(text[:cut])[state]
            assert grammar.ends(text[cut:])[between] == grammar.ends(text)[state], (cut, state)


@pytest.mark.parametrize("size", [5, 10**6])
def test_csv_line_breaks_in_ranges(spark, tmp_path, size, monkeypatch):
    path = tmp_path / "m.csv"
    path.write_text(csv_text(60), encoding="utf-8", newline="")
    o = readers.CsvOptions(multiline=True, nulls=())
    whole = (
        spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False,
                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(str(path)).collect()
    )
    heads = csv_heads(list_files(spark, str(path)), ",", '"', "UTF-8", 0, True)
    assert csv_records(heads, ",", '"', "UTF-8", size).count() == 60
    monkeypatch.setattr("tablewright.sources.readers.csv_records",
                        lambda *a: csv_records(*a, size=size))
    got = readers.read_csv(spark, str(path), o, types={"id": "BIGINT"})
    assert sorted((r.id, r.a, r.b) for r in got.collect()) == [(int(r.id), r.a, r.b) for r in whole]
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_csv_skip_with_line_breaks(spark, tmp_path):
    """Lines to skip hold a quote; the heading and cells hold line breaks; files differ in length."""
    (tmp_path / "d").mkdir()
    for i in range(3):
        body = "".join(f'{i}{j},"v\n{j}"\n' for j in range(i * 4))
        (tmp_path / "d" / f"{i}.csv").write_text(f'say "hi\nsecond\n\n"k\ney",v\n{body}')
    df = readers.read_csv(spark, str(tmp_path / "d"), readers.CsvOptions(skip=2))
    assert df.columns == ["k\ney", "v"]
    assert sorted(r.v for r in df.collect()) == sorted(f"v\n{j}" for i in range(3) for j in range(i * 4))


@pytest.mark.parametrize("size", [7, 40])
def test_csv_skip_with_delimiters_in_cut_cells(spark, tmp_path, size, monkeypatch):
    """Lines to skip, then cells with delimiters and line breaks that borders of ranges cut."""
    path = tmp_path / "s.csv"
    body = "".join(f'{i},"a, b, ""{i}"", c\nd, e",{i}\n' for i in range(9))
    path.write_text(f'said "once\nprinted, today\nk,t,n\n{body}')
    monkeypatch.setattr("tablewright.sources.readers.csv_records",
                        lambda *a: csv_records(*a, size=size))
    o = readers.CsvOptions(skip=2, nulls=())
    got = readers.read_csv(spark, str(path), o, types={"k": "BIGINT", "n": "BIGINT"})
    assert sorted(tuple(r) for r in got.collect()) == [(i, f'a, b, "{i}", c\nd, e', i) for i in range(9)]


def test_csv_ranges_of_packed_and_latin_files(spark, tmp_path):
    import gzip

    text = csv_text(20)
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(text.encode("latin-1")))
    (tmp_path / "b.csv").write_bytes(text.encode("latin-1"))
    o = readers.CsvOptions(encoding="latin-1", multiline=True)
    df = readers.read_csv(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.csv")], o)
    counts = df.groupBy("id", "a", "b").count()
    assert counts.count() == 20 and counts.where("count != 2").isEmpty()
    assert df.where("b LIKE '%ü%' OR a LIKE '%ü%'").count() > 0


def test_csv_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text('k,v\n1,"x\ny"\n')
    df = readers.read_csv(spark, str(tmp_path), readers.CsvOptions(multiline=True))
    assert [(r.k, r.v) for r in df.collect()] == [(1, "x\ny")]
