from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quillforge import cli

SF = Path("/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "conversations", "embeddings")
SOME = ("tokenize_counts", "tokenize_keyed", "glue_merges_3", "eval_scores", "idf_l2", "merge_adjacent", "retrieve_skew", "facet_dirichlet_normalized", "kmeans_assign_l1", "kl_rank", "cluster_pretty")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, str(SF))
    want = db.sql(__spark_entry__.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_command_line(spark, tmp_path, capsys):
    text = tmp_path / "in.txt"
    text.write_text("The cats ran\nA dog ran and ran\n")

    def run(*argv):
        assert cli.run(spark, [str(a) for a in argv]) == 0

    def out(name):
        return [line for p in sorted((tmp_path / name).glob("part-*")) for line in p.read_text().splitlines()]

    run("tokenize", text, "--out", tmp_path / "t")
    assert out("t") == ["cat ran", "dog ran ran"]
    run("collect", text, "--out", tmp_path / "c")
    assert "#eol 2" in out("c")
    (tmp_path / "df").write_text("#eol 2\nran 2\ndog 1\n")
    run("compile", text, "--df-file", tmp_path / "df", "--out", tmp_path / "v")
    assert len(out("v")) == 2
    seg = tmp_path / "seg.txt"
    seg.write_text("a b a b a b\nc a b\n")
    for program in ("glue", "ubt", "descent"):
        run(program, seg, "--out", tmp_path / program, "--iteration", 1, "--support", 3) if program != "descent" else run(program, seg, "--out", tmp_path / program, "--iteration", 1)
        assert out(f"{program}/output.final") == ["ab ab ab", "c ab"]
    run("evaluate", seg, seg)
    assert "[W] 100.00 100.00 100.00" in capsys.readouterr().out
    docs = tmp_path / "docs"
    docs.write_text("d1 x x y\nd1:facet en\nd2 y z\n")
    run("index", docs, "--out", tmp_path / "index")
    (tmp_path / "q").write_text("1 x\n")
    run("query", tmp_path / "q", "--model", tmp_path / "index", "--out", tmp_path / "r")
    assert out("r/result")[0].startswith("1 Q0 d1 1 -7.82")
    assert out("r/facet")[0].startswith("1 Q0 en 1 1")
    run("merge", docs, "--out", tmp_path / "m")
    assert len(out("m")) == 3
    run("ok")
    assert capsys.readouterr().out == "OK\n"


def test_standard_streams_and_formats(spark, tmp_path, capsys, monkeypatch):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("The cats ran\n\nA dog\n"))
    assert cli.run(spark, ["tokenize", "-"]) == 0
    assert capsys.readouterr().out == "cat ran\n\ndog\n"
    docs = tmp_path / "docs"
    docs.write_text("d1 x x y\nd1:facet en s1\nd2 y z\nd2:facet en\n")
    assert cli.run(spark, ["index", str(docs), "--out", str(tmp_path / "index")]) == 0
    (tmp_path / "q").write_text("1 y\n")
    for method in ("count", "simple"):
        assert cli.run(spark, ["query", str(tmp_path / "q"), "--model", str(tmp_path / "index"), "--method", method, "--no-result", "--out", str(tmp_path / method)]) == 0
    out = lambda name: [line for p in sorted((tmp_path / name).glob("part-*")) for line in p.read_text().splitlines()]
    assert sorted(out("count/facet")) == ["1 Q0 en 1 2 facet:count", "1 Q0 s1 2 1 facet:count"]
    assert all(line.split()[-2:] in (["facet:simple", "2"], ["facet:simple", "1"]) for line in out("simple/facet"))
    (tmp_path / "c").write_text("".join(f"{c} w{c}{i} {1 / (i + 1):.3f}\n" for c in range(6) for i in range(2 - (c == 1))))
    assert cli.run(spark, ["prettyprint-cluster", str(tmp_path / "c")]) == 0
    lines = capsys.readouterr().out.split("\n")
    assert [len(x) // 34 for x in lines] == [5, 5, 0, 1, 1, 0, 0]
    assert lines[1].split() == ["w01", "0.500000", "0.000000", "w21", "0.500000", "w31", "0.500000", "w41", "0.500000"]


def test_numbers_as_the_programs_print_them(spark):
    from quillforge.functions.columns import general

    values = [0.0, 1.0, 0.5, -7.823247, 1234567.0, 123456.0, 0.0001, 0.00001234567, -2.5e-10, 1e20, 999999.5, 100.0, float("inf"), float("nan"), 0.693147180559]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(general("v")).collect()]
    assert got == ["%g" % v for v in values]


def test_lines_of_files_in_splits(spark, tmp_path):
    from quillforge.sources import lines

    texts = [[f"line {k} of {n}" if k % 7 else "" for k in range(n)] for n in (900, 1, 0, 40)]
    for k, t in enumerate(texts):
        (tmp_path / f"f{k}").write_text("".join(x + "\n" for x in t))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = lines.read_lines(spark, *[str(tmp_path / f"f{k}") for k in range(4)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["file"], r["line_id"], r["text"]) for r in rows) == [(k, i, x) for k, t in enumerate(texts) for i, x in enumerate(t)]


def test_places_and_runs_across_chunks(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from quillforge.operators import merge, order, retrieve

    monkeypatch.setattr(order, "CHUNK", 5)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a:1", "a:2", "b", "c:facet", ""]), [f"t{i}"]) for i in range(200)]
    df = spark.createDataFrame(rows, "line_id long, key string, toks array<string>").repartition(7)
    want, last = [], None
    for _, k, t in rows:
        if not k:
            continue
        k = k if k.endswith(":facet") else k.split(":")[0]
        if k == last:
            want[-1][1].extend(t)
        else:
            want.append((k, list(t)))
        last = k
    assert [(r["key"], r["toks"]) for r in merge.merge_adjacent(df).orderBy("run").collect()] == want
    _, facets = retrieve.attach_facets(df)
    doc, found = None, []
    for _, k, t in rows:
        if k.endswith(":facet"):
            found += [(doc, x) for x in t] if doc is not None else []
        else:
            doc = k
    assert sorted((r["docno"], r["facet"]) for r in facets.collect()) == sorted(found)
    numbered = order.numbered(df.select("line_id"), "line_id").where(F.col("at") != F.col("line_id"))
    assert numbered.count() == 0
