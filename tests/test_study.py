"""Edge rows of answers, search, triage, extraction and layout, with results worked out by hand."""

from pyspark.sql import functions as F

from quillon.functions.semantics import falsy_coalesce
from quillon.operators.answers import given_answers, wrong
from quillon.operators.intake import best_versions, heal, image_places, number_order, standard_title
from quillon.operators.library import active_sources, copies, delete_exams, folder_name, numbered, relevance, skipped, source_label, source_of, target_words, union_hits
from quillon.operators.relational import upsert
from quillon.sources.sinks import SCHEMAS, append, evolved, own_path, reload_partitions, stored_files


def column(spark, value, schema="a string"):
    return [r[0] for r in spark.createDataFrame(value, schema).select(F.col("*")).collect()]


def test_answers(spark):
    q = spark.createDataFrame([(10, 1, "A", None), (12, 1, "B", ""), (15, 1, "C", "Math"), (20, 2, "d", "Law")], "id int, exam_id int, correct_answer string, subject string")
    texts = [None, "", "{}", "{torn", "[]", '{"x": "A", "0": "B"}', '{"-1": "A"}', '{"3": "A", "0": "a\\u00a0"}', '{"1": null, "2": " c "}', '{"0": "A", "1": "X", "0": "Z"}', '{"0": 3}']
    rows = [(k, 1, t) for k, t in enumerate(texts)] + [(99, 2, '{"0": "\\tD "}'), (98, 3, '{"0": "A"}')]
    a = spark.createDataFrame(rows, "attempt int, exam_id int, answers_json string")
    assert sorted((r.attempt, r.idx, r.given) for r in given_answers(a).collect() if r.attempt in (5, 7, 9)) == [(5, 0, "B"), (7, 0, "a\xa0"), (7, 3, "A"), (9, 0, "Z"), (9, 1, "X")]
    got = wrong(a, q).select("attempt", "id", falsy_coalesce(F.col("subject"), "Geral")).collect()
    assert sorted(map(tuple, got)) == [(5, 10, "Geral"), (9, 10, "Geral"), (9, 12, "Geral"), (10, 10, "Geral")]


def test_sources_to_plan():
    every = ["web", "idcap", "pci"]
    assert active_sources("provas ID CAP 2020", None, every) == ["web", "idcap"]
    assert active_sources("pciconcursos", "idcap", every) == ["web", "pci"]
    assert active_sources("analista", "Vunesp", every) == ["web", "pci"]
    assert active_sources("analista", "IDCAP Brasil", every) == every
    assert active_sources("analista", "n/a", every) == active_sources("analista", None, every) == every


def test_union_of_hits(spark):
    s = "url string, title string, score long, pos long"
    a = spark.createDataFrame([("u1", "a1", None, 1), ("u2", "a2", 5, 2), (None, "x", 1, 0), ("", "y", 1, 0), ("u3", "a3", 1, 3)], s)
    b = spark.createDataFrame([("u2", "b2", 9, 1), ("u4", "b4", 7, 2)], s)
    got = union_hits({"a": a, "b": b}, ["b", "a"], {"a": 2}).collect()
    assert sorted((r.url, r.title, r.source) for r in got) == [("u1", "a1", "a"), ("u2", "b2", "b"), ("u4", "b4", "b")]


def test_scores(spark):
    rows = [("PROVA analista porto", "prova de analista", None, None), ("x", "prova de", "n/a", ""), ("x", "analista", None, None), ("analista de porto", "analista", "Porto", "analista de porto"), ("y", "", None, "y")]
    d = spark.createDataFrame(rows, "t string, q string, o string, c string")
    words = target_words(F.col("q"), F.col("o"), F.col("c"))
    assert [r[0] for r in d.select(relevance(F.col("t"), words, F.col("c"))).collect()] == [100, 50, 10, 100, 30]
    assert [sorted(r[0]) for r in d.select(words).collect()] == [["analista"], [], ["analista"], ["analista", "porto"], []]
    names = spark.createDataFrame([("Estivador",), ("Gabarito",), ("RESULTADO final",), ("",), (None,)], "a string")
    assert [r[0] for r in names.select(skipped(F.col("a"))).collect()] == [False, True, True, False, None]
    shown = spark.createDataFrame([("IDCAP - x", "u"), ("x", "http://selecao.net.br"), (None, "http://pciconcursos/x"), ("Web - q", "http://cebraspe"), ("q", "http://CEBRASPE"), ("q", None)], "t string, u string").select(source_of(F.col("t"), F.col("u")).alias("s"))
    assert [tuple(r) for r in shown.select("s", source_label(F.col("s"))).collect()] == [("idcap", "IDCAP"), ("idcap", "IDCAP"), ("pci", "PCI Concursos"), ("web", "Web"), ("banco", "Banco Interno"), ("web", "Web")]


def test_folders_and_copies(spark):
    t = spark.createDataFrame([("Prova - Vila.pdf", 1), (".x", 2), ("y" * 60, 3), ("", 4)], "t string, i int")
    assert [r[0] for r in t.select(folder_name(F.col("t"), F.col("i"))).collect()] == ["Vila", "Pasta Prova 2", "y" * 40, "Pasta Prova 4"]
    x = spark.createDataFrame([(1, "a", "Aprovada", 5), (2, "a", "Aprovada", 5), (3, "a", "Pendente", 6), (4, None, "Pendente", 6), (5, None, "Aprovada", None), (6, "b", "Pendente", 7), (7, "b", "Negada", 8)], "id int, source_url string, status string, folder_id int")
    q = spark.createDataFrame([(100, 1, "s"), (101, 1, "t"), (102, 2, "u"), (103, None, "v")], "id int, exam_id int, statement string")
    assert sorted(tuple(r) for r in copies(x, q).collect()) == [(100, 3, "s"), (101, 3, "t")]
    f = spark.createDataFrame([(5,), (6,), (7,), (8,), (9,)], "id int")
    folders, left, children = delete_exams(f, x, q, x.where("id IN (1, 6, 7)").select("id"))
    assert sorted(r.id for r in folders.collect()) == [5, 6, 9] and sorted(r.id for r in left.collect()) == [2, 3, 4, 5] and sorted(r.id for r in children.collect()) == [102, 103]


def test_places(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "a int, b int").repartition(7)
    got = {r.n: r.a for r in numbered(df, ["a"], "n").collect()}
    assert got == {k + 1: k for k in range(1000)}
    assert numbered(df.limit(0), ["a"], "n").count() == 0
    stored, new = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "k int, score int, s string"), spark.createDataFrame([(1, None, None), (3, 1, "z")], "k int, score int, s string")
    assert sorted(tuple(r) for r in upsert(stored, new, "k", ["score", "s"], keep=("s",)).collect()) == [(1, None, "x"), (2, 6, "y"), (3, 1, "z")]


def test_titles(spark):
    cases = [
        ("Provas para download - IDCAP — Porto - Vigia - porto", "", "IDCAP", "", "", "IDCAP - PORTO - VIGIA"),
        ("Prova - Concurso Público para Vigia 2019", "", "", "", "2001", "[2019] PARA VIGIA 2019"),
        ("Vigia", "http://h/2017/a", "", "Vila", "n/a", "[2017] VILA - VIGIA"),
        ("Vigia", "", "Prefeitura de Vila", "vila", "2001", "[2001] PREFEITURA DE VILA - VIGIA"),
        ("Prefeitura - Vigia", "", "Prefeitura de Vila", "Serra", "", "PREFEITURA DE VILA - SERRA - VIGIA"),
        ("PROVA -", "", None, None, None, "GERAL / CONHECIMENTOS BÁSICOS"),
        ("Processo Seletivo Privado - Guarda - 001/2020 - Porto ( - )", "", "privado", "null", "", "[2020] GUARDA - PORTO"),
        ("Guarda - Edital nº 3 de 1 de maio de 2018 - Porto - 1ª Nota Pública x", "", "n/a", "", "", "[2018] GUARDA - PORTO"),
        ("A-b - a.b", "", "", "", "", "A - B"),
        ("Guarda Portuária - Guarda", "", "", "", "", "GUARDA PORTUÁRIA"),
    ]
    d = spark.createDataFrame([c[:5] for c in cases], "t string, u string, b string, p string, y string")
    got = [r[0] for r in d.select(standard_title(*(F.col(c) for c in "tubpy"))).collect()]
    assert got == [c[5] for c in cases]


def test_versions(spark):
    o = lambda n: {f"k{i}": "v\0" for i in range(n)} or None
    rows = [
        (1, " 1 ", "short", o(2), None, None, ["a"], 1), (1, "1", "longer text", o(1), "B", "Law", ["b"], 2), (1, "1", "longer text", o(2), "C\0", "Law", ["c"], 3), (1, "1", "longer text", o(2), "D", "Law", None, 4),
        (1, "01", "x", None, "A", None, None, 5), (1, "", "gone", None, "A", None, None, 6), (1, "2", "None", None, "A", None, None, 7), (1, "none", "gone", None, "A", None, None, 8),
        # the newcomer is as long as it came, the kept one as it is without its tag
        (2, "7", "q (Correta: A)", None, "A", None, None, 1), (2, "7", "qq", None, "B", None, None, 2), (2, "x", "z", None, None, None, None, 3),
    ]
    d = spark.createDataFrame(rows, "exam_id int, numero_questao string, enunciado string, opcoes map<string,string>, resposta string, disciplina string, images array<string>, seq int")
    got = {(r.exam_id, r.numero_questao): r for r in best_versions(d).collect()}
    assert set(got) == {(1, "1"), (1, "01"), (2, "7"), (2, "x")}
    a = got[1, "1"]
    assert (a.seq, a.statement, a.correct_answer, sorted(a.images), a.versions, "\0" in a.options) == (3, "longer text", "C", ["a", "b", "c"], 4, False)
    assert (got[2, "7"].seq, got[2, "7"].subject, got[2, "x"].correct_answer) == (2, "Geral", "A")
    n = spark.createDataFrame([("1",), ("01",), ("Q 12.",), ("0",), ("x",), ("9" * 20,)], "a string")
    assert [r[0] for r in n.select(number_order(F.col("a"))).collect()] == [1, 1, 12, 999999, 999999, 999999]


def test_healing(spark):
    m = spark.createDataFrame([(1, n) for n in range(1, 8)], "exam int, number int")
    left = heal(m, lambda x, k: x.where(F.col("number") % 3 == k), ["exam", "number"])
    assert sorted(r.number for r in left.collect()) == [2, 5]
    assert heal(m.limit(0), lambda x, k: x, ["exam", "number"]).count() == 0


def test_images(spark):
    q = [(1, 2, 0, 50.0, 200.0), (1, 2, 1, 50.0, 500.0), (1, 2, 2, 600.0, 300.0), (1, 3, 3, 50.0, 800.0), (1, 5, 4, 50.0, 105.0)]
    images = [
        (1, 2, 60.0, 250.0, 160.0, 290.0),  # below question 0, in its column
        (1, 2, 610.0, 330.0, 700.0, 400.0),  # below question 2
        (1, 2, 60.0, 600.0, 80.0, 620.0), (1, 2, 70.0, 610.0, 90.0, 640.0),  # one picture below the last question
        (1, 2, 60.0, 20.0, 90.0, 60.0),  # in the head of the page
        (1, 3, 50.0, 200.0, 90.0, 240.0),  # above all on its page: the last of the page before
        (1, 1, 50.0, 200.0, 90.0, 240.0),  # before all questions: a cover
        (1, 4, 50.0, 300.0, 69.0, 320.0),  # 380 large: too small
        (1, 4, 50.0, 400.0, 90.0, 440.0),  # but joined with the other on a page without questions
        (1, 6, 50.0, 400.0, 451.0, 440.0),  # thinner than 1 to 10
        (2, 1, 5.0, 500.0, 95.0, 560.0), (2, 2, 5.0, 500.0, 95.0, 560.0), (2, 3, 5.0, 500.0, 95.0, 560.0),  # a mark
    ]
    got = image_places(spark.createDataFrame(images, "exam int, page int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(q, "exam int, page int, index int, x double, y double")).collect()
    assert sorted((r.page, r.gap, r.x0, r.y0, r.x1, r.y1, r["index"]) for r in got) == [
        (2, 2, 60.0, 250.0, 160.0, 290.0, 0), (2, 3, 610.0, 330.0, 700.0, 400.0, 2), (2, 4, 60.0, 600.0, 90.0, 640.0, 1), (3, 1, 50.0, 200.0, 90.0, 240.0, 2), (4, 1, 50.0, 300.0, 90.0, 440.0, 3),
    ]


def test_tables(spark):
    path = own_path(spark, "t")
    rows = lambda *x: spark.createDataFrame(x, "id int, exam int")
    append(rows((1, 1), (2, 2)), path, "exam")
    append(rows((3, 2)), path, "exam")
    for _ in range(2):
        reload_partitions(rows((9, 2)), path, "exam")
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "exam").collect())) == [(1, 1), (9, 2)]
    old = evolved(spark.createDataFrame([(1, "t")], "id int, title string"), "exams").first()
    assert (old.status, old.match_score, old.source_url) == ("Pendente", 0, None) and len(old) == len(SCHEMAS["exams"].split(","))
    files = stored_files(spark, "/root/testdata/sf0.001", "*.parquet", 1000).collect()
    assert {"orders.parquet"} <= {r.name for r in files} and all(r.bytes > 1000 for r in files)


def test_streams_over_a_folder(spark, tmp_path):
    from quillon.plans import catalogue

    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/events.parquet").repartition(3).write.parquet(f"file://{tmp_path}/events.parquet")
    for name in ("q37_daily_counts", "q38_stream_latest_state", "q73_stream_progress", "q74_stream_keys"):
        of = lambda at: sorted(map(str, map(tuple, catalogue.QUERIES[name](spark, at).collect())))  # noqa: B023, E731
        assert of(str(tmp_path)) == of(d) != [], name


def test_pdf_pages(spark, tmp_path):
    import zlib

    text = zlib.compress(b"BT /F1 12 Tf (Quest\\343o 1\\)) Tj T* [(Ca) -20 (sa)] TJ ET")
    pages = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 4 0 R]>> endobj\n"
    pages += b"3 0 obj <</Type /Page /Contents 5 0 R>> endobj\n4 0 obj <</Type/Page /Contents [6 0 R 7 0 R]>> endobj\n"
    pages += b"5 0 obj <</Filter /FlateDecode /Length 9>> stream\n" + text + b"\nendstream endobj\n6 0 obj <<>> stream\nBT (two) Tj ET\nendstream endobj\n7 0 obj <<>> stream\nBT (more) Tj ET\nendstream endobj"
    (tmp_path / "a.pdf").write_bytes(pages)
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"")
    from quillon.sources.pdf import is_pdf, pdf_pages

    assert sorted(tuple(r) for r in pdf_pages(spark, f"file://{tmp_path}").collect()) == [("a.pdf", 0, "Quest\xe3o 1)\nCasa"), ("a.pdf", 1, "two\nmore")]
    kinds = spark.createDataFrame([(b"%PDF-1", None), (b"x", "Application/PDF; a"), (b"x", "text/html"), (None, None)], "c binary, t string")
    assert [r[0] for r in kinds.select(is_pdf(F.col("c"), F.col("t"))).collect()] == [True, True, False, False]


def test_notebook_of_a_subject(spark):
    from quillon.plans import catalogue

    q, d = catalogue.QUERIES["q09_error_notebook"], "/root/testdata/sf0.01"
    every = q(spark, d, limit=10_000).collect()
    assert {r.subject for r in every} >= {"Geral", "LARGE"} or len(every) > 0
    for subject in {r.subject for r in every}:
        assert sorted(map(tuple, q(spark, d, subject, 10_000).collect())) == sorted(tuple(r) for r in every if r.subject == subject)
