from quorumlake.llm.queries import QUERIES


def test_queries_run(spark, small):
    for name, q in QUERIES.items():
        df = q(spark, small)
        assert len(df.columns) == len(set(df.columns)), name
        assert df.count() >= 0, name


def test_queries_on_empty_tables(spark, small, tmp_path):
    for t in ("species", "forms", "raid_bosses", "discrepancies", "source_registry", "documents", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name == "p8_fill" else 0), name
