import pytest
from pyspark.sql import functions as F

from glyphstream.sources import readers


def test_inspected_inventory(spark, tmp_path):
    base = tmp_path / "in put"
    (base / "deep").mkdir(parents=True)
    (base / "deep" / "a.fasta").write_text(">s1 first\nACGT\nAC\n>s2\nGG\n")
    (base / "none.fa").write_text("")
    (base / "b.csv").write_text('"k";v;w,x\n1;2;3\n')
    (base / "one.tsv").write_text("single\n1\n")
    (base / "x[1]+%.csv").write_text("a,b\n")
    (base / "empty.csv").write_text("")
    (base / "c.jsonl").write_text('{"k": 1, "v": {"w": 2}}\n{"z": 1}\n')
    (base / "d.json").write_text("[1, 2]\n")
    (base / "e.json").write_text("{\n}")
    (base / "f.json").write_text("")
    (base / "g.bin").write_text("x")
    spark.range(7).withColumn("v", F.lit("x")).coalesce(1).write.parquet(str(base / "p+q.parquet"))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.n_records, r["columns"], r.notes) for r in readers.inspected_inventory(spark, str(base)).collect()}
    part = [got.pop(k) for k in list(got) if k.startswith("part-")]
    assert part == [("table", 7, "id,v", "parquet")]
    got = {k: v for k, v in got.items() if not k.startswith(("_", "."))}
    assert got == {
        "a.fasta": ("sequence", 2, None, "min_len=2;max_len=6"), "none.fa": ("sequence", 0, None, ""),
        "b.csv": ("table", None, "k,v,w,x", "sep=;"), "one.tsv": ("table", None, "single", "sep=\\t"), "empty.csv": ("table", None, None, "empty table"),
        "x[1]+%.csv": ("table", None, "a,b", "sep=,"),
        "c.jsonl": ("json", None, "k,v", "keys of the first line"), "d.json": ("json", None, None, "first line: array"),
        "e.json": ("json", None, None, "first line is no json"), "f.json": ("json", 0, None, "empty json"), "g.bin": ("other", None, None, None),
    }
    assert {r.kind: r.n for r in readers.kinds(spark, str(base / "deep")).collect()} == {"sequence": 1}


def test_sources_are_detected(spark, tmp_path):
    for name in ("proj/seqs/x.fa", "proj/seqs/y.txt", "data/p/dataset_2.json", "data/p/dataset_1.json", "data/m/b_combined.csv", "data/m/a_combined.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    config = {"project_root": "proj", "parent_repo_root": str(tmp_path), "local_data_roots": ["seqs", "gone"], "metadata_paths": {"dedup_metadata": "own.csv"}}
    sources = readers.source_set(config, str(tmp_path))
    assert sources == readers.SourceSet(str(tmp_path), (f"{tmp_path}/proj/seqs", f"{tmp_path}/proj/gone"), None, f"{tmp_path}/proj/own.csv", ())
    got = readers.detect(spark, sources, "data/p/dataset_*.json", "data/m/*combined.csv", "data/m/*cache.csv")
    ends = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    assert ends(got["records"]) == ["x.fa"] and ends(got["paired"]) == ["dataset_1.json", "dataset_2.json"]
    assert got["rich"].endswith("a_combined.csv") and got["dedup"] == f"{tmp_path}/proj/own.csv"
    bare = readers.detect(spark, readers.SourceSet(str(tmp_path / "proj")), "p*", "r*", "d*")
    assert bare["records"] == [] and bare["rich"] is None


def test_metadata_scans(spark, tmp_path):
    (tmp_path / "rich.csv").write_text(
        "Isolate_Id,Subtype,Host,Location,Collection_Date,Clade,more\n"
        "E2,A / h1n1,Human ,Europe / France,2019-03-01,6B.1A.5a,1\nE1,,,Asia,n/a,,2\nE2,A / H3N2,Avian,X,2001,1.2.3,3\n"
    )
    rows = {r.epi_isl: r for r in readers.read_rich(spark, str(tmp_path / "rich.csv")).collect()}
    assert len(rows) == 2 and not rows["E1"].host_is_human
    assert (rows["E1"].metadata_subtype, rows["E1"].region, rows["E1"].country, rows["E1"].metadata_year, rows["E1"].major_clade_rich) == ("UNKNOWN", "Asia", None, None, None)
    assert (rows["E2"].metadata_subtype, rows["E2"].region, rows["E2"].country, rows["E2"].metadata_year, rows["E2"].major_clade_rich, rows["E2"].host_is_human) == ("H1N1", "Europe", "France", 2019, "6B.1A", True)
    (tmp_path / "dedup.csv").write_text("epi_isl,subtype,year,month,matched,clade,major_clade,extra\nE1,h5n1,2001,2,True,c,m,x\nE1,H1N1,2002,3,False,d,n,y\n")
    got = readers.read_dedup(spark, str(tmp_path / "dedup.csv"))
    assert got.columns == ["epi_isl", "dedup_subtype", "dedup_year", "dedup_month", "dedup_matched", "clade_dedup", "major_clade_dedup", "extra"]
    assert [tuple(r) for r in got.collect()] == [("E1", "H5N1", "2001", "2", "True", "c", "m", "x")]
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_rich(spark, str(tmp_path / "dedup.csv"))


def test_the_first_row_of_a_file_that_is_split(spark, tmp_path):
    (tmp_path / "d.csv").write_text("epi_isl,subtype,year,month,matched,clade,major_clade\n" + "".join(f"E{i % 10},H1N1,{i},,,,\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.read_dedup(spark, str(tmp_path / "d.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r.dedup_year) for r in got) == list(range(10))


def test_metrics_and_vectors(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a_sequence_metrics.parquet"))
    with pytest.raises(FileNotFoundError, match="codon"):
        readers.read_metrics(spark, str(tmp_path))
    spark.range(3).withColumn("gc", F.lit(0.5)).write.parquet(str(tmp_path / "b_sequence_metrics.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "a_codon_metrics.parquet"))
    got = readers.read_metrics(spark, str(tmp_path))
    assert got["sequence"].count() == 5 and got["sequence"].where("gc is null").count() == 2 and got["codon"].count() == 1
    for name, data in {"good": [(1, [1.0, 2.0]), (2, [0.0, 1.0])], "twice": [(1, [1.0]), (1, [2.0])], "odd": [(1, [1.0]), (2, [1.0, 2.0])], "null": [(1, None)]}.items():
        spark.createDataFrame(data, "k int, v array<float>").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert readers.read_vectors(spark, str(tmp_path / "good.parquet"), "k", "v").count() == 2
    for name in ("twice", "odd", "null"):
        with pytest.raises(ValueError, match="vectors of"):
            readers.read_vectors(spark, str(tmp_path / f"{name}.parquet"), "k", "v")
