import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import expenses, league, receipts
from tablewright.sources import files, footer, markup, readers, writers
from tablewright.sources.catalog import Catalog

TINY = "id,name,city,amount,booked_on\n1,Anna,Berlin,10.5,2024-01-02\n2,Bob,,-3,2024-01-03\n" \
       "3,\"Klein, Carl\",Bonn,0,2024-02-01\n3,\"Klein, Carl\",Bonn,0,2024-02-01\n"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def parts(path, pattern="part-*"):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/{pattern}")))


def test_csv_types_and_nulls(spark, tmp_path):
    df = readers.read_csv(spark, write(tmp_path / "tiny.csv", TINY))
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "city": "string", "amount": "double", "booked_on": "date"
    }
    rows = df.orderBy("id").collect()
    assert rows[1].city is None and rows[2].name == "Klein, Carl"


def test_csv_subset_after_bad_rows(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n")
    o = readers.CsvOptions()
    df = readers.read_csv(spark, path, o)
    assert [r.a for r in df.select("a").orderBy("a").collect()] == [1, 3, 7]
    assert df.where("b IS NULL").count() == 1
    assert [r.row for r in readers.bad_csv_rows(spark, path, o).collect()] == ["4,5,6"]
    with pytest.raises(ValueError):
        readers.read_csv(spark, path, readers.CsvOptions(strict=True))


def test_csv_multiline_and_encoding(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'k;t\n1;"zwei\nZeilen"\n2;"sagt ""hallo"" müde"\n', "latin-1")
    df = readers.read_csv(spark, path, readers.CsvOptions(delim=";", multiline=True, encoding="latin-1"))
    assert [r.t for r in df.orderBy("k").collect()] == ["zwei\nZeilen", 'sagt "hallo" müde']


@pytest.mark.parametrize(
    ("text", "encoding", "expected"),
    [
        ("a;b;c\n1;2,5;x\n2;3,5;\"y;z\"\n", "utf-8", (";", 0, True, "utf-8", "LF", "")),
        ("title\n\nx\ty\n1\t2\n3\t4\n", "utf-8", ("\t", 2, True, "utf-8", "LF", "")),
        ("1,2\r\n3,4\r\n", "utf-8", (",", 0, False, "utf-8", "CRLF", "")),
        ("n|d\nö|13.01.2024\nb|02.01.2024\nc|03.01.2024\n", "latin-1", ("|", 0, True, "latin-1", "LF", "%d.%m.%Y")),
        ("n,d\na,01.02.2024\nb,02.01.2024\nc,03.01.2024\n", "utf-8", (",", 0, True, "utf-8", "LF", "")),
        ("only\nwords\n", "utf-8", (",", 0, True, "utf-8", "LF", "")),
        ("k,v\nä,1\n", "utf-16", (",", 0, True, "utf-16", "LF", "")),
    ],
)
def test_detect_csv(spark, tmp_path, text, encoding, expected):
    r = files.detect_csv(spark, write(tmp_path / "x.csv", text, encoding)).first()
    assert (r.delim, r.skip, r.header, r.encoding, r.line_ending, r.date_format) == expected


def test_inventory(spark, tmp_path):
    write(tmp_path / "a.csv", TINY)
    write(tmp_path / "b.json", '{"x":1}\n{"x":2}\n')
    write(tmp_path / "c.json", '{"x":\n1}')
    write(tmp_path / "d.json", "[{}]")
    write(tmp_path / "e.bin", "PAR1....")
    found = {r.path.rsplit("/", 1)[1]: r for r in files.inventory_files(spark, str(tmp_path)).collect()}
    assert {k: v.format for k, v in found.items()} == {
        "a.csv": "csv", "b.json": "ndjson", "c.json": "json", "d.json": "json", "e.bin": "parquet"
    }
    assert (found["a.csv"].est_rows, found["a.csv"].exact) == (4, True)


def test_read_many_errors(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(3).withColumnRenamed("id", "x").write.parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="different structure"):
        readers.read_many(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    write(tmp_path / "c.csv", TINY)
    write(tmp_path / "d.csv", TINY.replace("amount", "sum"))
    write(tmp_path / "e.csv", TINY.replace("10.5", "ten"))
    for other in ("d", "e"):
        with pytest.raises(ValueError, match=f"{other}.csv has a different structure"):
            readers.read_many(spark, [str(tmp_path / "c.csv"), str(tmp_path / f"{other}.csv")])
    write(tmp_path / "f.csv", TINY.replace("Bob", "Bea"))
    assert readers.read_many(spark, [str(tmp_path / "c.csv"), str(tmp_path / "f.csv")]).count() == 8
    write(tmp_path / "g.ndjson", '{"x":1}\n{"x":2}\n')
    write(tmp_path / "h.ndjson", '{"x":"1"}\n')
    write(tmp_path / "i.ndjson", '{"x":3}\n')
    with pytest.raises(ValueError, match="h.ndjson has a different"):
        readers.read_many(spark, [str(tmp_path / "g.ndjson"), str(tmp_path / "h.ndjson")])
    assert readers.read_many(spark, [str(tmp_path / "g.ndjson"), str(tmp_path / "i.ndjson")]).count() == 3
    with pytest.raises(ValueError, match="formats"):
        readers.read_many(spark, [str(tmp_path / "a"), str(tmp_path / "c.csv")])


def test_nested_json(spark, tmp_path):
    doc = {"meta": {"n": 1}, "a": [{"x": 1}], "b": {"c": [{"x": 1, "y": "u"}, {"x": 2, "y": "v"}]},
           "list": [1, 2, 3, 4]}
    path = write(tmp_path / "n.json", json.dumps(doc))
    assert [r.x for r in readers.read_json_nested(spark, path).orderBy("x").collect()] == [1, 2]
    assert readers.read_json_nested(spark, path, "$.a").columns == ["x"]
    docs = write(tmp_path / "deep.json", json.dumps({"q": [{"r": [{"s": 5}]}]}))
    assert readers.read_json_nested(spark, docs, "q[0].r").first().s == 5
    with pytest.raises(ValueError):
        readers.read_json_nested(spark, path, "meta")


def test_json_writers(spark, tmp_path):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, None, "a"), (big, [1, 2], 'q"')], "n bigint, l array<int>, s string").coalesce(1)
    writers.write_ndjson(df, str(tmp_path / "nd"))
    lines = [json.loads(x) for x in parts(tmp_path / "nd").splitlines()]
    assert lines == [{"n": 1, "l": None, "s": "a"}, {"n": str(big), "l": [1, 2], "s": 'q"'}]
    for pretty in (False, True):
        out = tmp_path / f"arr{pretty}"
        writers.write_json_array(df, str(out), pretty=pretty, single_file=True)
        assert json.loads(parts(out)) == lines
    deep = spark.sql(f"SELECT struct({big}L AS x, array({big}L, 1L, NULL) AS y) AS s, {-2**63 + 1}L AS m")
    text = writers.json_lines(deep).first().value
    assert json.loads(text) == {"s": {"x": str(big), "y": [str(big), 1, None]}, "m": str(-2**63 + 1)}
    writers.write_json_array(df.limit(0), str(tmp_path / "none"), single_file=True)
    assert json.loads(parts(tmp_path / "none")) == []


def test_csv_writer(spark, tmp_path):
    df = spark.createDataFrame([('a"b;c', [1]), (None, None)], "s string, l array<int>").coalesce(1)
    writers.write_csv(df, str(tmp_path / "c"), delim=";", gzip=True)
    text = gzip.open(glob.glob(f"{tmp_path}/c/part-*.gz")[0], "rt").read()
    assert text.splitlines()[:2] == ["s;l", '"a""b;c";[1]']


def test_document_writers_cap(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a|b\\{i}\nc<") for i in range(5)], "i int, t string").coalesce(1)
    writers.write_markdown(df, str(tmp_path / "m"), cap=2)
    assert parts(tmp_path / "m").splitlines() == [
        "| i | t |", "| --- | --- |", "| 0 | a\\|b\\\\0<br>c< |", "| 1 | a\\|b\\\\1<br>c< |", "",
        "> Note: output truncated to 2 rows.",
    ]
    writers.write_html(df, str(tmp_path / "h"), title="a<b", cap=5)
    html = parts(tmp_path / "h")
    assert html.count("<tr>") == 6 and "truncated" not in html and "a&lt;b" in html


def test_parquet_codecs(spark, tmp_path):
    for codec in writers.CODECS:
        path = str(tmp_path / codec)
        writers.write_parquet(spark.range(10), path, codec)
        found = footer.footer_profile(spark, path).first()
        assert found.codec == codec.upper() and found.null_count == 0
    with pytest.raises(ValueError):
        writers.write_parquet(spark.range(1), str(tmp_path / "x"), "lzma")


def test_write_table_modes(spark):
    assert writers.write_table(spark.range(3), "modes", "create") == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.write_table(spark.range(3), "modes", "create")
    assert writers.write_table(spark.table("modes").where("id > 0"), "modes", "replace") == 2
    assert writers.write_table(spark.range(1), "modes", "append") == 3
    spark.sql("DROP TABLE modes")


def test_replacing_a_table_keeps_its_rows_until_the_swap(spark, monkeypatch):
    """A failure while writing, or at the step that swaps, leaves the old rows under the old name."""
    writers.write_table(spark.range(5), "kept", "create")
    real = type(spark).sql

    def failing(word):
        def sql(self, text, *args, **kwargs):
            if word in text:
                raise RuntimeError("lost")
            return real(self, text, *args, **kwargs)

        return sql

    for word, new in (("SET LOCATION", spark.range(9)), ("RENAME TO kept", spark.range(9).withColumn("x", F.lit(1)))):
        monkeypatch.setattr(type(spark), "sql", failing(word))
        with pytest.raises(RuntimeError):
            writers.write_table(new, "kept", "replace")
        monkeypatch.setattr(type(spark), "sql", real)
        if word == "SET LOCATION":
            assert spark.table("kept").count() == 5
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    spark.sql("DROP TABLE IF EXISTS kept")
    writers.write_table(spark.range(5), "kept", "create")
    with pytest.raises(Exception, match="no"):
        writers.write_table(broken, "kept", "replace")
    assert spark.table("kept").count() == 5
    for n in (4, 7):
        assert writers.write_table(spark.table("kept").union(spark.range(n)), "kept", "replace") == (9 if n == 4 else 16)
    assert writers.write_table(spark.table("kept").withColumn("y", F.lit("z")), "kept", "replace") == 16
    assert spark.table("kept").columns == ["id", "y"]
    spark.sql("DROP TABLE kept")


def test_catalog_names(spark):
    c = Catalog(spark)
    names = [c.register(n, spark.range(1)) for n in ("My File.parquet", "my-file", "2024", "äö", "data")]
    assert names == ["my_file", "my_file_2", "t_2024", "file", "data_2"]
    assert c.sql("SELECT count(*) AS n FROM data JOIN my_file_2 USING (id)").first().n == 1


def test_markdown_edges(spark):
    text = (
        "# One\n\n| a | a |  |\n|---|:-:|---|\n| 1 | x\\|y | 3 | 4 |\n| 2 |\n\ntext | no table\n"
        "## Two #\nnot a heading any more\nh|i\n---|---\n---|---\nv|w\nplain\np|q\n-\nr|s\n"
    )
    df = spark.createDataFrame([(7, text), (8, "none")], "id int, t string")
    cells = markup.extract_markdown_tables(df, "id", "t").orderBy("table_no", "row_no", "col_no").collect()
    one = [(r.row_no, r.header, r.value) for r in cells if r.table_no == 1]
    assert one == [
        (1, "a", "1"), (1, "a_2", "x|y"), (1, "column3", "3"),
        (2, "a", "2"), (2, "a_2", ""), (2, "column3", ""),
    ]
    assert {(r.table_no, r.name) for r in cells} == {(1, "Table 1 — One"), (2, "Table 2"), (3, "Table 3")}
    assert [r.value for r in cells if r.table_no == 2] == ["---", "---", "v", "w"]
    assert [(r.header, r.value) for r in cells if r.table_no == 3] == [("p", "r"), ("q", "s")]


def test_html_edges(spark):
    html = (
        "<table><caption>C&amp;D</caption><tr><th>a<th>b<tr><td>1</td><td>2</td><td>x &#8211; <i>y</i></td></tr>"
        "</table><table></table><TABLE><TR><TD>q</TD></TR></TABLE>"
    )
    df = spark.createDataFrame([(1, html)], "id int, h string")
    cells = markup.extract_html_tables(df, "id", "h").orderBy("table_no", "row_no", "col_no").collect()
    got = [(r.table_no, r.row_no, r.col_no, r.value) for r in cells]
    assert got == [
        (1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, ""), (1, 2, 1, "1"), (1, 2, 2, "2"), (1, 2, 3, "x – y"),
        (2, 1, 1, "q"),
    ]
    assert cells[0].name == "Table 1 — C&D"


def test_receipts(spark):
    texts = [
        "Hotel Post\n2 Übernachtungen\n01.03.2024 - 2024-03-04\nZwischensumme 100,00\nMwSt enthalten 7,00\nSumme 1.107,00",
        "DB Fernverkehr\nvon Köln Hbf nach Berlin  ICE 5\nRückfahrt und Hinfahrt\n3. März 2024 Preis 59,90",
        "no receipt at all",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    a, b, c = receipts.extract_receipt_fields(df, "t").orderBy("i").collect()
    assert (a.kind, a.total, a.nights, a.check_in, a.check_out) == ("hotel", 1107.0, 2, "2024-03-01", "2024-03-04")
    assert a.amounts == [100.0, 7.0, 1107.0] and a.breakfast is False
    assert (b.kind, b.origin, b.destination, b.round_trip, b.dates) == ("bahn", "Köln Hbf", "Berlin", True, ["2024-03-03"])
    assert (c.kind, c.total, c.dates, c.origin) == ("unknown", None, [], None)


def test_guaranteed_ranks(spark):
    games = [("A", "a", "b", 2, 0), ("A", "a", "c", 1, 0), ("A", "a", "d", 3, 1), ("A", "b", "c", 0, 0),
             ("A", "b", "d", None, None), ("A", "c", "d", None, None)]
    matches = spark.createDataFrame(games, "grp string, home string, away string, home_goals int, away_goals int")
    teams = spark.createDataFrame([("A", t, i) for i, t in enumerate("abcde")], "grp string, team string, seed int")
    bounds = {r.team: r for r in league.rank_bounds(matches, teams).collect()}
    assert (bounds["a"].guaranteed, bounds["a"].best, bounds["a"].worst) == (1, 1, 1)
    assert bounds["b"].guaranteed is None and (bounds["b"].best, bounds["b"].worst) == (2, 4)
    table = league.league_table(matches, teams).orderBy("rank").collect()
    assert [r.team for r in table] == ["a", "b", "c", "e", "d"] or [r.points for r in table][0] == 9


def test_settlement_edges(spark):
    trips = spark.createDataFrame(
        [(1, "DE", "2024-05-01 08:00:00", "2024-05-01 16:00:00"), (2, "DE", "2024-05-01 08:00:00", "2024-05-01 16:01:00"),
         (3, "CH", "2024-05-01 22:00:00", "2024-05-03 01:00:00"), (4, "FR", "2024-05-02 10:00:00", "2024-05-01 10:00:00")],
        "trip_id int, country string, start string, end string",
    ).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    meals = spark.createDataFrame(
        [(2, "2024-05-01", True, True, True)], "trip_id int, day string, breakfast boolean, lunch boolean, dinner boolean"
    ).withColumn("day", F.col("day").cast("date"))
    days = expenses.per_diem(trips, meals).orderBy("trip_id", "day").collect()
    assert [(r.trip_id, r.kind, r.amount) for r in days] == [
        (1, "none", 0.0), (2, "single", 0.0), (3, "arrival", 51.2), (3, "full", 64.0), (3, "departure", 51.2),
    ]
    assert days[1].reduction == 28.0


def test_csv_columns_go_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,x\n")
    write(tmp_path / "b.csv", "b,a\ny,3\n")
    write(tmp_path / "c.csv", "")
    df = readers.read_csv(spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "x"), (3, "y")]
    multi = readers.CsvOptions(multiline=True)
    assert sorted((r.a, r.b) for r in readers.read_csv(spark, str(tmp_path), multi).collect()) == [(1, "x"), (3, "y")]
    for name, text in (("d", "a\n4\n"), ("e", "a,b,c\n4,z,5\n"), ("f", "a,B\n4,z\n")):
        odd = write(tmp_path / f"{name}.csv", text)
        paths = [str(tmp_path / f"{n}.csv") for n in ("a", "b")] + [odd]
        with pytest.raises(ValueError, match=f"{name}.csv has the columns"):
            readers.read_csv(spark, paths, readers.CsvOptions())
    odd = write(tmp_path / "g.csv", "1,2\n3,4\n")
    with pytest.raises(ValueError, match="written differently"):
        readers.read_csv(spark, [str(tmp_path / "a.csv"), odd])


def test_csv_columns_by_name_in_two_byte_files(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,é\n", "utf-16")
    write(tmp_path / "b.csv", "b,a\nü,3\n", "utf-16")
    df = readers.read_csv(spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "é"), (3, "ü")]


@pytest.mark.parametrize("cells", [["  ", " x ", "\t", "\n", "\r\n", " \n ", "a", None, "q\" "]])
def test_csv_keeps_blanks(spark, tmp_path, cells):
    two = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    writers.write_csv(two.repartition(3), str(tmp_path / "two"))
    assert {r.i: r.c for r in readers.read_csv(spark, str(tmp_path / "two")).collect()} == dict(enumerate(cells))
    one = two.where("c IS NOT NULL").select("c")
    writers.write_csv(one, str(tmp_path / "one"))
    back = readers.read_csv(spark, str(tmp_path / "one"), types={"c": "VARCHAR"})
    assert sorted(r.c for r in back.collect()) == sorted(c for c in cells if c is not None)


def test_markdown_time_grows_with_the_lines(spark):
    """Twice the lines, at most 2.5 times the time; many tables, one long table, repeated names."""
    import time

    def seconds(n):
        text = "| k | k |\n|---|---|\n" + "| a | b |\n" * n + "\n" + "a|b\n-|-\n1|2\n\n" * (n // 8)
        start = time.perf_counter()
        found = list(markup._pipe_tables(text))
        took = time.perf_counter() - start
        assert len(found) == 1 + n // 8 and len(found[0][2]) == n and found[0][1] == ["k", "k_2"]
        return took

    seconds(1000)
    small = min(seconds(16_000) for _ in range(3))
    assert min(seconds(32_000) for _ in range(3)) <= 2.5 * small
    df = spark.createDataFrame([(1, "|a|\n|-|\n" + "|x|\n" * 16_000)], "id long, t string")
    assert markup.extract_markdown_tables(df, "id", "t").count() == 16_000


def test_markdown_lines_between_tables(spark):
    text = "# T #\n\na|b\n---\nno pipe\n\n## Next\ntext\nx|y\n-|-\nlast|row\nc|d\n-\n\\|e|\n|-|\n"
    df = spark.createDataFrame([(None, text), (2, None), (3, "")], "id long, t string")
    got = [(r.id, r.table_no, r.name, r.header, r.value)
           for r in markup.extract_markdown_tables(df, "id", "t").orderBy("table_no", "row_no", "col_no").collect()]
    assert got == [(None, 2, "Table 2", "x", "last"), (None, 2, "Table 2", "y", "row"),
                   (None, 2, "Table 2", "x", "c"), (None, 2, "Table 2", "y", "d")]


@pytest.mark.parametrize("size", [1000, 1 << 20])
def test_inventory_counts_long_files(spark, tmp_path, size):
    """Rows of files longer than their head, lines of uneven length, line breaks in cells, no last line end."""
    n = 40_000
    rows = [f'{i},"a\nb, ""{i}"""' if i % 3 == 0 else f"{i},{'x' * (i % 50)}" for i in range(n)]
    (tmp_path / "a.csv").write_text("\n".join(["k,t", *rows]))
    (tmp_path / "b.ndjson").write_text("".join(json.dumps({"k": i, "t": '"' * (i % 9)}) + "\n" for i in range(n)))
    assert min(p.stat().st_size for p in tmp_path.iterdir()) > files.HEAD_BYTES
    found = files.inventory_files(spark, str(tmp_path), count=True, range_bytes=size).orderBy("path").collect()
    assert [(r.format, r.est_rows, r.exact) for r in found] == [("csv", n, True), ("ndjson", n, True)]
