from millrace import sources as S
from millrace.functions.logmath import log_add
from millrace.streaming import running_word_count


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lines_and_documents(spark, tmp_path):
    df = S.read_lines(spark, write(tmp_path / "t.txt", "a\n\nb c\n"))
    assert [r["line"] for r in df.orderBy("doc_id").collect()] == ["a", "", "b c"] and df.select("doc_id").distinct().count() == 3
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, S.document_lines(docs).collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (3, 0, "")]


def test_tbl(spark, tmp_path):
    df = S.read_tbl(spark, write(tmp_path / "n.tbl", "3|CANADA|1|x|\n24|UNITED STATES|1|y|\n"), "nation")
    assert [(r["n_nationkey"], r["n_name"]) for r in df.collect()] == [(3, "CANADA"), (24, "UNITED STATES")]


def test_adjacency_and_instances(spark, tmp_path):
    adj = S.read_adjacency(spark, write(tmp_path / "a.txt", "1 2  3\n2\n\n7\t1 x\n"))
    assert sorted((r["id"], tuple(r["adjacency"])) for r in adj.collect()) == [(1, (2, 3)), (2, ()), (7, (1,))]
    inst = S.read_instances(spark, write(tmp_path / "i.txt", "d1 spam 1 2 2\nd2 ham\nbroken\n"))
    assert [(r["doc_id"], r["y"], r["features"]) for r in inst.collect()] == [("d1", 1.0, [1, 2, 2]), ("d2", 0.0, [])]


def test_model_roundtrip(spark, tmp_path):
    model = spark.createDataFrame([(1, 0.5), (-2, -1e-7)], "feature int, weight double")
    S.write_model(model, f"{tmp_path}/m")
    assert sorted(map(tuple, S.read_model(spark, f"{tmp_path}/m").collect())) == [(-2, -1e-7), (1, 0.5)]
    S.write_text(model, f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t").count() == 2


def test_log_add(spark):
    inf = float("-inf")
    df = spark.createDataFrame([(0.0, 0.0), (inf, 1.0), (inf, inf), (-1000.0, -1001.0)], "a double, b double")
    got = [r[0] for r in df.select(log_add(df.a, df.b)).collect()]
    assert abs(got[0] - 0.693147) < 1e-5 and got[1] == 1.0 and got[2] == inf and abs(got[3] + 999.686738) < 1e-5


def test_streaming_word_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.txt", "x y\nx\n")
    stream = running_word_count(spark.readStream.text(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    write(tmp_path / "in" / "b.txt", "x\n")
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("running").collect()} == {("x", 3), ("y", 1)}


def test_spread(spark, tmp_path):
    from millrace.session import spread

    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/one")
    table = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert spread(table).rdd.getNumPartitions() == cores and spread(table).count() == 50
    assert spread(spark.range(0, 50, 1, cores)).rdd.getNumPartitions() == cores
