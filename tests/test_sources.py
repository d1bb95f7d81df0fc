import json

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from veilwright.operators.generalize import generalize
from veilwright.plans.classbased import k_anonymity, l_diversity
from veilwright.sources.delimited import read_delimited, read_with_row_key
from veilwright.sources.records import write_records
from veilwright.spec import parse_rules
from veilwright.streaming import generalize_stream

PEOPLE = '''ID,Age,Gender,Zipcode,Note,Score,Born
1,40,Female,01234,"a, ""b""",1.5,1984-07-12
2,45,Male,45678,NA,nan,1979-03-25
3,,Male,45678,x,2,
'''


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_missing_values(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path, "people.CSV", PEOPLE))
    kinds = dict(df.dtypes)
    assert kinds == {
        "ID": "bigint", "Age": "bigint", "Gender": "string", "Zipcode": "bigint", "Note": "string", "Score": "double", "Born": "date"
    }
    first, second, third = df.orderBy("ID").collect()
    assert first.Note == 'a, "b"' and second.Note is None and second.Score is None and third.Age is None


def test_schema_keeps_leading_zeros(spark, tmp_path):
    schema = "ID int, Age double, Gender string, Zipcode string, Note string, Score double, Born date"
    df = read_delimited(spark, write(tmp_path, "people.csv", PEOPLE), schema)
    assert dict(df.dtypes)["Zipcode"] == "string"
    assert df.filter("ID = 1").first().Zipcode == "01234"


def test_tsv_slashed_dates_and_line_ends(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path, "p.tsv", "a\tb\r\n1\t1984/7/12\r\n2\tx,y\r\n"))
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert rows(df) == [(1, "1984/7/12"), (2, "x,y")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, "m.csv", 'a,b\n1,"two\nlines"\n')
    assert rows(read_delimited(spark, path, multiline=True)) == [(1, "two\nlines")]


def test_other_suffixes_are_refused_before_reading(spark):
    with pytest.raises(ValueError, match="must end in"):
        read_delimited(spark, "/nowhere/data.xlsx")


def test_row_key_identifies_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 100, 1, 4).select(F.lit(1).alias("x")).write.parquet(path)
    df = read_with_row_key(spark, path)
    assert df.select("row_key").distinct().count() == 100
    assert k_anonymity(df, ["x"], 200, threshold=0.25, key=["row_key"]).count() == 75


def test_records(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ'1970-01-02 00:00:00.5' AS t, 1/3D AS d")
    write_records(df, str(tmp_path / "plain"))
    write_records(df, str(tmp_path / "epoch"), epoch=True)

    def read(name):
        text = "".join(p.read_text() for p in (tmp_path / name).glob("*.json"))
        return [json.loads(line) for line in text.splitlines()]

    assert read("plain") == [{"a": 1, "b": None, "t": "1970-01-02T00:00:00.500", "d": 1 / 3}]
    assert read("epoch") == [{"a": 1, "b": None, "t": 86400500, "d": 0.3333333333}]


RULES = parse_rules(
    {
        "o_totalprice": {"method": "ordering", "layers": [{"min": 0, "max": 250000}]},
        "o_orderdate": {"method": "dates", "layers": [{"min": "1995-01-01", "max": "1998-01-01"}]},
        "o_orderpriority": {"method": "masking", "maskingString": "a**"},
    }
)


def test_stream_is_generalised_like_a_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    folder = str(tmp_path / "in")
    table.write.parquet(folder)
    stream = spark.readStream.schema(table.schema).parquet(folder)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    running = (
        generalize_stream(stream, RULES).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", marks).trigger(availableNow=True).start()
    )
    running.awaitTermination(60)
    assert rows(spark.read.parquet(out)) == rows(generalize(table, RULES))


def test_class_models_refuse_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)
    stream = spark.readStream.schema("id bigint").parquet(folder)
    with pytest.raises(ValueError, match="batch table"):
        k_anonymity(stream, ["id"], 2)
    with pytest.raises(ValueError, match="batch table"):
        l_diversity(stream, ["id"], "id", 2, 2)
    with pytest.raises(ValueError, match="streaming table"):
        generalize_stream(spark.range(3), {})


def test_schema_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("Disease,ID,Age\nFlu, 1,30\n NA ,2,NA\n")
    table = read_delimited(spark, str(path), schema="ID int, Age int, Disease string")
    assert table.columns == ["ID", "Age", "Disease"]
    assert sorted(map(tuple, table.collect())) == [(1, 30, "Flu"), (2, None, " NA ")]
    with pytest.raises(ValueError, match="Weight"):
        read_delimited(spark, str(path), schema="ID int, Weight int")


def test_line_breaks_inside_quotes_belong_to_the_value(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('ID,Note\n1,"two\nlines"\n2,plain\n')
    path = str(tmp_path / "notes.csv")
    assert rows(read_delimited(spark, path)) == rows(read_delimited(spark, path, "ID bigint, Note string")) == [(1, "two\nlines"), (2, "plain")]
