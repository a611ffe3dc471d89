from tanglaw.sources import corpora, tables


def test_pipe(spark, tmp_path):
    (tmp_path / "a.txt").write_text("language|level|text\ntagalog|1| ang | aso \nbad line\n\nenglish|x|y\n")
    rows = {(r.language, r.text, r.split_role) for r in corpora.read_pipe(spark, str(tmp_path / "a.txt")).select("language", "text", "split_role").collect()}
    assert rows == {("tagalog", "ang | aso", "high_resource"), ("english", "y", "unknown")}


def test_titled_comma_levels(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Ang, Aso,2,May, aso\nno match\n")
    assert list(map(tuple, corpora.read_titled(spark, str(tmp_path / "t.txt"), "cebuano").collect())) == [("cebuano", 2, "Ang, Aso", "May, aso")]
    (tmp_path / "b.txt").write_text("Ang_Aso___Central_Bikol,1,x\n")
    assert corpora.read_titled(spark, str(tmp_path / "b.txt"), "bikol").first().title == "Ang Aso"
    (tmp_path / "c.txt").write_text("A,2,x, y\nB,7,z\nC,1,\n")
    assert {tuple(r) for r in corpora.read_comma(spark, str(tmp_path / "c.txt")).collect()} == {("A", 2, "x, y")}
    assert {tuple(r) for r in corpora.read_comma(spark, str(tmp_path / "c.txt"), "blank").collect()} == {("A", 2, "x, y"), ("C", 1, "blank")}
    (tmp_path / "tag_lvl3_data.txt").write_text("isa dalawa tatlo apat lima anim pito\n\n")
    assert tuple(corpora.read_levels(spark, str(tmp_path / "tag_lvl3_data.txt")).first()) == (3, "isa dalawa tatlo apat lima anim", "isa dalawa tatlo apat lima anim pito")


def test_tree_and_records(spark, tmp_path):
    folder = tmp_path / "hiligaynon" / "grade 2"
    folder.mkdir(parents=True)
    (folder / "Ang_Ido___x.txt").write_text("Titulo\n\nAng ido.")
    assert tuple(corpora.read_tree(spark, str(tmp_path / "hiligaynon")).first()) == ("hiligaynon", 2, "Ang Ido", "Titulo\n\nAng ido.")
    df = spark.createDataFrame([("a\nb",), ("c",)], "text string").coalesce(1)
    corpora.write_records(df, str(tmp_path / "records"))
    assert sorted(r.text for r in corpora.read_records(spark, str(tmp_path / "records")).collect()) == ["a\nb", "c"]


def test_anchors_buckets_and_shared_tables(spark, tmp_path):
    (tmp_path / "g.txt").write_text("an,9\nng,7\nsa,7\n")
    rows = corpora.read_anchors(spark, str(tmp_path / "g.txt"), "tagalog", 2).orderBy("gram_rank").collect()
    assert [(r.gram_rank, r.gram) for r in rows] == [(1, "an"), (2, "ng"), (3, "sa")]
    df = spark.createDataFrame([("bikol", 1, "a|b\nc"), ("tagalog", 2, "d")], "language string, level int, text string")
    corpora.write_buckets(df, str(tmp_path / "buckets"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "buckets")).collect()) == ["bikol|1|a/b c", "tagalog|2|d"]
    corpora.write_master(df, str(tmp_path / "master"), "text")
    assert {r.value for r in spark.read.text(str(tmp_path / "master")).collect()} == {"tagalog|2|d", "bikol|1|a/b c"}
    stored = tables.materialize(df, "test")
    assert stored.schema == df.schema and stored.count() == 2
    assert tables.spread(stored.coalesce(1)).rdd.getNumPartitions() >= 2
