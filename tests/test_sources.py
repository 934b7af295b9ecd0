"""Record files, checklists and folders."""

from corpusloom.sources import readers as S


def test_bad_records_carry_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q":1,"w":2}\n\n{"q":1}\n[1]\noops\n{"q":1,"w":2,"z":3}\n')
    (tmp_path / "b.jsonl").write_text("".join('{"q":1,"w":2}\n' for _ in range(20_000)) + '{"w":1}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")  # many blocks a file
    try:
        good, bad = S.json_records(S.lines_of(spark, str(tmp_path)), "value", ["q", "w"])
        assert good.count() == 20_001
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.problem) for r in bad.collect())
        lines = sorted(r.line for r in good.where("file like '%b.jsonl'").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a.jsonl", 3, "missing=w extra="), ("a.jsonl", 4, "not an object"), ("a.jsonl", 5, "invalid JSON"), ("a.jsonl", 6, "missing= extra=z"), ("b.jsonl", 20_001, "missing=q extra=")]
    assert lines == list(range(1, 20_001))


def test_checklists(spark):
    rows = ['{"work_id":"a","x":true,"y":false}', '{"work_id":"b","x":false,"y":true}', '{"work_id":"c","y":true,"priority":false}', '{"x":1}', '{"z":true,"x":true}', '{"x":null}', "7", " "]
    good, bad = S.checklists(spark.createDataFrame([(i, v, "f") for i, v in enumerate(rows)], "line int, value string, file string"), "value", ["x", "y"], ["y"])
    assert [tuple(r) for r in good.orderBy("work_id").collect()] == [("a", True, False, False), ("b", False, True, True), ("c", None, True, False)]
    assert [(r.line, r.problem) for r in bad.orderBy("line").collect()] == [(3, "not a boolean: x"), (4, "unknown item z"), (5, "not a boolean: x"), (6, "not an object")]


def test_folders_are_scanned_whole(spark, tmp_path):
    for name, text in {"a/b/one.md": "T\nmore\n", "two.md": "\n \n", "three.md": "U", "four.md": "V\n\nx", "skip.txt": "T"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = S.folder(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.text) for r in files.collect()} == {("one.md", "T\nmore\n"), ("two.md", "\n \n"), ("three.md", "U"), ("four.md", "V\n\nx")}
    pending = spark.createDataFrame([("T",), ("U",), ("U",)], "t string").selectExpr("sha1(t) as title_hash")
    assert {(r.path.rsplit("/", 1)[1], r.outcome) for r in S.folder_outcomes(files, pending).collect()} == {("one.md", "matched"), ("two.md", "empty"), ("three.md", "ambiguous"), ("four.md", "unmatched")}


def test_packed_folder_gives_every_file_whole_from_few_packs(spark, tmp_path):
    from corpusloom.sources.readers import packed_folder
    from corpusloom.sources.sinks import pack_folder

    rows = [(f"s/{i}.txt", ["a\nb", 'say "x"\r\n \x85\t\\', "", None, "  \n"][i % 5], i % 3) for i in range(600)]
    files = spark.createDataFrame(rows, "path string, text string, shelf int").coalesce(2)
    pack_folder(files, str(tmp_path / "f"), "shelf")
    assert len(list((tmp_path / "f").rglob("*.txt"))) <= 6
    assert sorted(packed_folder(spark, str(tmp_path / "f")).collect(), key=str) == sorted([(p, x) for p, x, _ in rows], key=str)
