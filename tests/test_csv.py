import pytest

from cairn.config import FileSpec
from cairn.sources.csv import pandas_style_names, read_csv
from cairn.sources.encoding import detect_bytes, encoding_inventory, read_csv_folder


def _write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def test_header_naming_like_pandas():
    assert pandas_style_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    assert pandas_style_names(["x", "", None]) == ["x", "Unnamed: 1", "Unnamed: 2"]
    assert pandas_style_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]


def test_detect_bytes_rules():
    assert detect_bytes(b"a,b\n1,2\n") == "ascii"
    assert detect_bytes("é,ü\n".encode("utf-8")) == "utf-8"
    assert detect_bytes(b"\xef\xbb\xbfa,b\n") == "utf-8-sig"
    assert detect_bytes("名前,値\n東京,1\n".encode("shift_jis")) == "shift_jis"
    assert detect_bytes("café,naïve\n".encode("windows-1252")) == "windows-1252"


def test_sample_csv_types_and_na_tokens(spark, tmp_path):
    p = _write(tmp_path / "s.csv", b"num,cat,target\n1.5,a,10\nNA,b,20\n3.0,,30\n4.5,a,n/a\n")
    df, kinds, enc = read_csv(spark, FileSpec(p))
    assert enc == "ascii"
    assert kinds == {"num": "numeric", "cat": "categorical", "target": "numeric"}
    rows = df.collect()
    assert [r.num for r in rows] == [1.5, None, 3.0, 4.5]
    assert [r.cat for r in rows] == ["a", "b", None, "a"]
    assert [r.target for r in rows] == [10.0, 20.0, 30.0, None]


def test_headerless_names(spark, tmp_path):
    p = _write(tmp_path / "h.csv", b"1,a,2\n3,b,4\n")
    df, _, _ = read_csv(spark, FileSpec(p, has_header=False))
    assert df.columns == ["0", "1", "2"]


def test_semicolon_decimal_comma_quotes_and_bom(spark, tmp_path):
    data = '﻿a;a;note;\n"1,5";2;"line one\nline two";x\n"2,5";3;"say ""hi""";y\n'.encode("utf-8")
    p = _write(tmp_path / "d.csv", data)
    df, kinds, enc = read_csv(spark, FileSpec(p, delimiter=";", decimal=","))
    assert enc == "utf-8-sig"
    assert df.columns == ["a", "a.1", "note", "Unnamed: 3"]
    rows = df.collect()
    assert [r["a"] for r in rows] == [1.5, 2.5]
    assert rows[0]["note"] == "line one\nline two"
    assert rows[1]["note"] == 'say "hi"'


def test_shift_jis_file(spark, tmp_path):
    data = "名前,値\n東京,1\n大阪,2\n".encode("shift_jis")
    p = _write(tmp_path / "j.csv", data)
    df, kinds, enc = read_csv(spark, FileSpec(p))
    assert enc == "shift_jis"
    assert df.columns == ["名前", "値"]
    assert [r["名前"] for r in df.collect()] == ["東京", "大阪"]


def test_folder_of_mixed_encodings(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    _write(d / "a.csv", "name,v\ncafé,1\n".encode("utf-8"))
    _write(d / "b.csv", "name,v\nnaïve,2\n".encode("windows-1252"))
    inv = {r.path.rsplit("/", 1)[-1]: r.encoding for r in encoding_inventory(spark, str(d)).collect()}
    assert inv == {"a.csv": "utf-8", "b.csv": "windows-1252"}
    df, kinds, encs = read_csv_folder(spark, FileSpec(str(d)))
    assert sorted(r.name for r in df.collect()) == ["café", "naïve"]
    assert kinds["v"] == "numeric"


def test_folder_groups_files_by_encoding_and_header(spark, tmp_path):
    d = tmp_path / "grouped"
    d.mkdir()
    _write(d / "a.csv", "name,v\ncafé,1\n".encode("utf-8"))
    _write(d / "b.csv", "name,v\nthé,2\n".encode("utf-8"))
    _write(d / "c.csv", "v,name,note\n3,crème,x\n".encode("utf-8"))
    _write(d / "d.csv", "name,v\nnaïve,4\n".encode("windows-1252"))
    heads = {r.path.rsplit("/", 1)[-1]: r.header for r in encoding_inventory(spark, str(d)).collect()}
    assert heads["a.csv"] == heads["b.csv"] == heads["d.csv"] != heads["c.csv"]
    df, kinds, encs = read_csv_folder(spark, FileSpec(str(d)))
    got = sorted((r.name, r.v, r.note) for r in df.collect())
    assert got == [("café", 1.0, None), ("crème", 3.0, "x"), ("naïve", 4.0, None), ("thé", 2.0, None)]
    assert encs == ["utf-8", "windows-1252"]


def test_multi_character_delimiter_is_literal(spark, tmp_path):
    p = _write(tmp_path / "m.csv", "a||b||c\n1||x.y||3\n4||z||6\n".encode("utf-8"))
    df, kinds, _ = read_csv(spark, FileSpec(p, delimiter="||"))
    assert df.columns == ["a", "b", "c"]
    assert sorted((r.a, r.b, r.c) for r in df.collect()) == [(1.0, "x.y", 3.0), (4.0, "z", 6.0)]
    assert kinds == {"a": "numeric", "b": "categorical", "c": "numeric"}


def test_ascii_files_join_the_folder_encoding(spark, tmp_path):
    d = tmp_path / "parts"
    d.mkdir()
    _write(d / "part-0.csv", "name,v\nplain,1\n".encode("ascii"))
    _write(d / "part-1.csv", "name,v\nnaïve,2\n".encode("windows-1252"))
    df, _, enc = read_csv(spark, FileSpec(str(d)))
    assert enc == "windows-1252"
    assert sorted(r.name for r in df.collect()) == ["naïve", "plain"]


@pytest.mark.parametrize("codec,expected", [("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16")])
def test_byte_order_marked_files(spark, tmp_path, codec, expected):
    p = _write(tmp_path / "bom.csv", "name,v\ncafé,1\n東京,2\n".encode(codec))
    df, _, enc = read_csv(spark, FileSpec(p))
    assert enc == expected
    assert df.columns == ["name", "v"]  # the mark is not part of the first header cell
    assert sorted((r.name, r.v) for r in df.collect()) == [("café", 1.0), ("東京", 2.0)]


def test_missing_file_is_rejected():
    with pytest.raises(ValueError, match="CSV not found"):
        FileSpec("/nonexistent/file.csv")


def test_rows_that_are_too_long_are_refused(spark, tmp_path):
    p = _write(tmp_path / "long.csv", b"a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="1 CSV row"):
        read_csv(spark, FileSpec(p))
    p = _write(tmp_path / "short.csv", b"a,b\n1,2\n6\n")
    assert sorted((r.a, r.b) for r in read_csv(spark, FileSpec(p))[0].collect()) == [(1.0, 2.0), (6.0, None)]


def test_folder_with_an_explicit_encoding_matches_columns_by_name(spark, tmp_path):
    d = tmp_path / "two"
    d.mkdir()
    _write(d / "x.csv", b"a,b\n1,2\n")
    _write(d / "y.csv", b"b,a\n30,3\n")
    df, _, enc = read_csv(spark, FileSpec(str(d), " UTF-8 "))
    assert enc == "utf-8" and sorted((r.a, r.b) for r in df.collect()) == [(1.0, 2.0), (3.0, 30.0)]


def test_header_names_that_differ_in_case_or_hold_back_ticks(spark, tmp_path):
    p = _write(tmp_path / "n.csv", b"A,a,x`y,s.t\n1,2,3,4\n")
    df, kinds, _ = read_csv(spark, FileSpec(p))
    assert df.columns == ["A", "a.1", "x`y", "s.t"] and tuple(df.first()) == (1.0, 2.0, 3.0, 4.0)
    df.write.parquet(str(tmp_path / "back"))


def test_last_column_of_a_csv_is_the_users(spark, tmp_path):
    from cairn.config import PipelineConfig, TargetSpec
    from cairn.plans import StepRegistry, run_regression

    lines = ["x,c,y"] + [f"{i},{'ab'[i % 2]},{(i * 37) % 11}" for i in range(60)]
    p = _write(tmp_path / "t.csv", "\n".join(lines).encode())
    steps = StepRegistry()
    steps.register("choose", lambda df: df.select("x", "y"))
    steps.register("twice", lambda df: df.union(df))
    res = run_regression(spark, PipelineConfig(file=FileSpec(p), target=TargetSpec("last_column")), steps=["choose", "twice"], registry=steps)
    assert res.target == "y" and res.kinds == {"x": "numeric"} and res.metrics["r2"] < 0.9
    assert res.split.count() == 120 and res.split.where("is_test").count() == 24


def test_large_files_are_read_in_splits_and_settings_stay(spark, tmp_path):
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    plain = _write(tmp_path / "plain.csv", "n,v\n東京,1\n".encode("shift_jis"))
    assert [r.n for r in read_csv(spark, FileSpec(plain))[0].collect()] == ["東京"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    rows = "".join(f"{i},word {i}\n" for i in range(40_000))
    p = _write(tmp_path / "big.csv", ("k,t\n" + rows).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        df, _, enc = read_csv(spark, FileSpec(p))
        assert enc == "ascii" and df.rdd.getNumPartitions() > 3 and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_rules_equal_whole_file_rules(spark, tmp_path):
    files = {
        "a": "plain\ntext".encode(), "b": "café\nplain\n".encode(), "c": "plain\r\ncafé\n".encode("windows-1252"),
        "d": "名前\n東京\nabc".encode("shift_jis"), "e": "①\n名\n".encode("cp932"), "f": b"x\ry\rz", "g": b"\xff\n\xfe",
    }
    for name, data in files.items():
        _write(tmp_path / name, data)
    got = {r.path.rsplit("/", 1)[-1]: r.encoding for r in encoding_inventory(spark, str(tmp_path)).collect()}
    assert got == {name: detect_bytes(data) for name, data in files.items()}


@pytest.mark.parametrize("row", ["3,4,,5", "3,4,5", '3,4,,"x, y"', '3,"4,5",,,,z', "3,4,NA"])
def test_every_surplus_field_counts(spark, tmp_path, row):
    for quoted in ("", '7,"line\nbreak"\n'):  # read by lines, and by records
        p = _write(tmp_path / f"s{len(quoted)}.csv", f"a,b\n1,2\n{quoted}{row}\n6\n".encode())
        with pytest.raises(ValueError, match="1 CSV row"):
            read_csv(spark, FileSpec(p))


def test_surplus_of_empty_fields_only_loses_nothing(spark, tmp_path):
    p = _write(tmp_path / "e.csv", b'a,b\n1,2\n3,4,\n5,6,,\n"7,x",8,,\n9\n')
    assert [tuple(r) for r in read_csv(spark, FileSpec(p))[0].collect()] == [("1", 2.0), ("3", 4.0), ("5", 6.0), ("7,x", 8.0), ("9", None)]


def _quoted_lines(seed, rows, end):
    """CSV text with line breaks, delimiters and quotes in and around quoted fields."""
    import random

    rng = random.Random(seed)
    field = lambda: rng.choice([
        "plain", "", '"q"', '"a,b"', f'"line{end}two"', f'"{end}{end}"', '"say ""hi"""', '""', f'"""{end}"', 'stray " quote', '5"', f'"x{end},""{end}y"', "é", "7",
        '"closed"more', " spaced "])
    return "k,u,v" + end + "".join(f"{i},{field()},{field()}{end}" for i in range(rows))


@pytest.mark.parametrize("end,codec", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "utf-8-sig"), ("\n", "windows-1252")])
def test_quoted_line_breaks_by_splits_equal_the_whole_file_read(spark, tmp_path, end, codec):
    from cairn.sources.csv import EXTRA, charsets, read_raw

    paths = [_write(tmp_path / f"q{k}.csv", _quoted_lines(k, 120, end).encode(codec)) for k in range(2)]
    paths.append(_write(tmp_path / "q2.csv", ("k,u,v" + end + f'1,"{("long " + end) * 300}",x' + end + f'2,"never closed{end}3,a').encode(codec)))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    enc = "utf-8" if codec == "utf-8-sig" else codec
    spec = FileSpec(paths[0], enc, multi_line=True)
    with charsets(spark, enc):
        want = sorted((r.k or "", r.u or "", r.v or "") for r in read_raw(spark, spec, enc, paths).collect())
    try:
        for size in ("400b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "64b")
            df = read_raw(spark, spec, enc, paths, in_parallel=True)
            got = sorted((r.k or "", r.u or "", r.v or "") for r in df.collect())
            assert got == want, size
            assert df.where(f"{EXTRA} IS NOT NULL").count() == 0
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_states_of_splits_compose(spark):
    import random

    from cairn.sources.records import split_states

    rng = random.Random(6)
    rows, want = [], {}
    for path in ("a", "b", "c"):
        state = False
        for start in range(40):
            out, inside = rng.choice([(False, True), (True, False), (True, True), (False, False)] if path != "c" else [(False, True), (True, False)])
            want[path, start] = state
            rows.append((path, start, out, inside))
            state = inside if state else out
    rng.shuffle(rows)
    got = split_states(spark.createDataFrame(rows, "path string, start long, out boolean, inside boolean"))
    assert {(r.path, r.start): r.begins for r in got.collect()} == want


def test_files_with_other_line_ends_are_read_whole(spark, tmp_path):
    p = _write(tmp_path / "mac.csv", b'a,b\r1,"x\ry"\r2,z\r')
    df, _, _ = read_csv(spark, FileSpec(p, multi_line=True))
    assert sorted(r.a for r in df.collect()) == [1.0, 2.0]


def test_given_encoding_asks_for_no_flags(spark, tmp_path):
    from cairn.sources.encoding import file_facts

    p = _write(tmp_path / "g.csv", "a,b\n1,é\n".encode())
    assert "utf8" not in file_facts(spark, p, encodings=False).columns
    assert [r.encoding for r in encoding_inventory(spark, p, " UTF-8 ").collect()] == ["utf-8"]
