import pytest
from compare import compare, duck

from methyloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    ok, said = compare(spark, duck(sf), name, queries.QUERIES[name], queries.SQL.get(name), sf)
    assert ok is not False, said


def test_unknown_modifications_stay_groups_of_their_own(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from methyloom.llm import queries

    records = spark.read.parquet(f"{sf}/annotated_records_multiple.parquet").where("n_mod is not null").limit(3)
    odd = records.withColumn("mod_type", F.explode(F.array(F.lit("h"), F.lit(None), F.lit("a"))))
    odd.write.parquet(f"{tmp_path}/annotated_records_multiple.parquet")
    assert {r.mod_type for r in queries.p3_daily(spark, str(tmp_path)).collect()} == {"h", None, "6mA"}
