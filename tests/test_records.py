"""Records from outside: edges of the operators, and plans that read no more than is asked for."""

from pyspark.sql import functions as F

from quillon.plans import records as R
from quillon.sources.pdf import pdf_pages
from quillon.sources.sinks import land_files


def test_gaps(spark):
    rows = [(1, "Questão 3"), (1, "01."), (1, None), (1, "x"), (2, "0"), (2, ""), (3, "1"), (3, "99999999999999"), (4, "2"), (4, "2")]
    d = spark.createDataFrame(rows, "e int, t string")
    assert sorted((r["e"], r["top"], r["missing"]) for r in R.gaps_of(d, "e", "t").collect()) == [(1, 3, [2]), (3, 1, []), (4, 2, [1])]


def test_density(spark):
    rows = [(1, "a" * 100, False), (1, "b" * 60, None), (2, "c" * 90, True), (3, "x" + " " * 200, True), (4, None, False), (5, "d" * 80, False)]
    got = {r["e"]: (r["pages"], r["chars_a_page"], r["seen_as"]) for r in R.density(spark.createDataFrame(rows, "e int, text string, has_image boolean"), "e").collect()}
    assert got == {1: (2, 80.5, "text"), 2: (1, 90.0, "images"), 3: (1, 2.0, "thin"), 4: (1, 0.0, "thin"), 5: (1, 80.0, "text")}


def test_only_asked_parts_are_read(spark, tmp_path):
    pages = R.page_folder(spark, "/root/testdata/sf0.01", str(tmp_path / "p"))
    asked = spark.createDataFrame([(3, 3), (19, 3), (5, 5)], "exam long, part int").where("exam < 20 AND part = 3")
    out = R.asked_pages(pages, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "part#" in plan.split("PartitionFilters")[1][:200]
    for f in (tmp_path / "p").glob("part=5/*.parquet"):
        f.write_bytes(b"torn")
    for f in (tmp_path / "p").glob("part=5/.*.crc"):
        f.unlink()
    assert {r["exam"] for r in out.select("exam").collect()} == {3, 19}


def test_sign_ins(spark):
    users = spark.createDataFrame([(5, "a", "a@old", "A", "p"), (2, "b", None, "B", None)], "id int, google_id string, email string, name string, picture string")
    infos = spark.createDataFrame([("b", "b@new", None, "q"), ("d", "d@new", "D", None), ("c", None, "C", "r")], "google_id string, email string, name string, picture string")
    assert sorted(map(tuple, R.signed_in(users, infos).collect())) == [(2, "b", None, None, "q"), (5, "a", "a@old", "A", "p"), (6, "c", None, "C", "r"), (7, "d", "d@new", "D", None)]
    assert [r["id"] for r in R.signed_in(users.where("false"), infos).orderBy("id").collect()] == [1, 2, 3]


def test_download_links(spark):
    a = lambda arq, code="t", acao="baixar": f'<A class=x data-arquivo="{arq}" data-code="{code}" data-acao="{acao}">'
    pages = [(a("Gabarito.pdf") + a("x.pdf", "") + a("y.pdf", acao="ver") + a("prova.pdf", "k") + a("z.pdf"), "u"), ("<p>", "u"), (None, "u")]
    d = spark.createDataFrame(pages, "h string, u string")
    assert [r[0] for r in d.select(R.download_link(F.col("h"), F.col("u"))).collect()] == ["https://www.pciconcursos.com.br/download/prova.pdf?token=k", "u", "u"]


def test_stored_files(spark, tmp_path):
    for exam, name, size in ((1, "1_a.pdf", 1001), (1, "1_b.pdf", 5000), (2, "2_a.pdf", 1000), (3, "3.txt", 9000)):
        (tmp_path / f"exam={exam}").mkdir(exist_ok=True)
        (tmp_path / f"exam={exam}" / name).write_bytes(b"x" * size)
    assert [tuple(r) for r in R.stored(spark, str(tmp_path), "exam", "*.pdf").collect()] == [(1, 5000)]


def test_stored_files_without_folders_of_exams(spark, tmp_path):
    sizes = {"1_a.pdf": 1001, "1_b_c.pdf": 5000, "2_a.pdf": 1000, "12_a.pdf": 7000, "-3_a.pdf": 2000, "0_a.pdf": 3000}
    others = {"07_a.pdf": 9000, "x_8.pdf": 9000, "9.pdf": 9000, "_10_a.pdf": 9000, "11_a.txt": 9000, "99999999999999999999_a.pdf": 9000}
    for i, (name, size) in enumerate((sizes | others).items()):
        (tmp_path / "in" / f"part={i % 2}").mkdir(exist_ok=True, parents=True)
        (tmp_path / "in" / f"part={i % 2}" / name).write_bytes(b"x" * size)
    out = R.stored(spark, str(tmp_path / "in"), "exam", "*.pdf")
    assert sorted(map(tuple, out.collect())) == [(-3, 2000), (0, 3000), (1, 5000), (12, 7000)] and dict(out.dtypes) == {"exam": "bigint", "bytes": "bigint"}


def test_landed_files_share_folders(spark, tmp_path):
    keys = [k for k, in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").select("s_suppkey").collect()]
    for _ in range(2):  # as a second attempt would
        R.exam_files(spark, "/root/testdata/sf0.01", str(tmp_path / "f"), together=40)
        files = [p for p in (tmp_path / "f").rglob("*") if p.is_file()]
        assert {p.name: p.read_bytes() for p in files} == {f"{k}_.txt": b"x" * (k % 25 * 100) + b"\n" for k in keys} and len(files) == 100
        assert len(list((tmp_path / "f").iterdir())) <= 3
    assert sorted(map(tuple, R.stored(spark, str(tmp_path / "f"), "exam", "*.txt").collect())) == sorted((k, k % 25 * 100 + 1) for k in keys if k % 25 >= 10)


def test_landed_files_edges(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.landed.link./in", f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "é" * 600), (2, None), (None, "x" * 2000), (4, "y" * 999), (5, "z" * 1000)], "exam long, t string")
    for folder in (f"file://{tmp_path}/a b", f"{tmp_path}/c", "viewfs://landed/in/d"):
        land_files(rows, folder, "exam", F.col("t"), 2)
        assert sorted(map(tuple, R.stored(spark, folder, "exam", "*.txt").collect())) == [(1, 1201), (5, 1001)], folder
        assert sorted(map(tuple, R.stored(spark, folder, "exam", "*.txt", 0).collect())) == [(1, 1201), (2, 1), (4, 1000), (5, 1001)], folder
        land_files(rows.where("false"), f"{folder}-none", "exam", F.col("t"))
        assert R.stored(spark, f"{folder}-none", "exam", "*.txt").collect() == []


def test_unreadable_pdfs_are_told_apart(spark, tmp_path):
    page = b"%PDF-1.4\n3 0 obj <</Type /Page /Contents 5 0 R>> endobj\n5 0 obj <<>> stream\nBT (one) Tj ET\nendstream endobj"
    for exam, content in ((1, page), (2, b"%PDF-1.5\n1 0 obj <</Type /ObjStm>> stream\nx\nendstream endobj"), (3, page + b" trailer <</Encrypt 9 0 R>>"), (4, b"%PDF-1.4 nothing")):
        (tmp_path / f"exam={exam}").mkdir()
        (tmp_path / f"exam={exam}" / "a.pdf").write_bytes(content)
    out = pdf_pages(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a.pdf", 0, "one"), (2, "a.pdf", None, None), (3, "a.pdf", None, None), (4, "a.pdf", None, None)]
    assert [tuple(r) for r in out.where("exam = 1").collect()] == [(1, "a.pdf", 0, "one")]
