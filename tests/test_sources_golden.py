"""Sources plus golden relations G1-G5 on inlined rows shaped like the
reference's sample files (first column id, nulls in two measure columns,
one duplicate row when id is ignored)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableprep.operators import clean, order, reshape
from tableprep.plans.prep import PrepPlan, apply_plan
from tableprep.sources import catalog, files

CSV = """id,sepal length (cm),sepal width (cm),target,species
0,5.1,3.5,0,setosa
1,,3.0,0,setosa
2,4.7,NA,0,setosa
3,4.6,3.1,0,setosa
4,5.1,3.5,0,setosa
5,7.0,3.2,1,versicolor
6,,,1,versicolor
7,6.3,3.3,2,virginica
"""


@pytest.fixture
def sample(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text(CSV)
    return files.read_csv(spark, str(p))


def test_read_csv_types_and_tokens(sample):
    assert dict(sample.dtypes) == {"id": "bigint", "sepal length (cm)": "double", "sepal width (cm)": "double",
                                   "target": "bigint", "species": "string"}
    assert sample.where(F.col("`sepal width (cm)`").isNull()).count() == 2


def test_headers_blank_and_duplicate(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(",a,a,b\n,1,2,True\n,3,4,False\n")
    df = files.read_csv(spark, str(p))
    assert df.columns == ["Unnamed: 0", "a", "a.1", "b"]
    assert dict(df.dtypes)["b"] == "boolean" and dict(df.dtypes)["Unnamed: 0"] == "double"
    dropped, did = files.drop_empty_lead_column(df)
    assert did and dropped.columns == ["a", "a.1", "b"]
    assert files.normalize_headers(["x", "", "x", "x"]) == ["x", "Unnamed: 1", "x.1", "x.2"]


def test_empty_file_fails(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("a,b\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p))


def test_write_roundtrip(spark, sample, tmp_path):
    out = str(tmp_path / "out")
    files.write_table(sample, out, fmt="csv")
    back = files.read_csv(spark, out)
    assert back.count() == sample.count()


def test_g1_remove_first_and_drop_nulls(sample):
    plan = PrepPlan(index="remove", missing=(("sepal length (cm)", "drop"), ("sepal width (cm)", "drop")))
    out = apply_plan(sample, plan)
    assert out.columns == ["sepal length (cm)", "sepal width (cm)", "target", "species"]
    assert out.count() == 5


def test_g2_g3_index_then_drop_keeps_gaps(sample):
    plan = PrepPlan(index="yes", missing=(("sepal length (cm)", "drop"),), casts=(("id", "datetime"),))
    out = apply_plan(sample.select("*"), PrepPlan(index="yes", index_order_by=("id",)))
    assert [r[0] for r in out.orderBy("Index").select("Index").collect()] == list(range(1, 9))
    out = apply_plan(sample, PrepPlan(index="yes", index_order_by=("id",),
                                      missing=(("sepal length (cm)", "drop"),), casts=(("id", "datetime"),)))
    got = out.orderBy("Index").collect()
    assert [r["Index"] for r in got] == [1, 3, 4, 5, 6, 8]
    assert {r["id"] for r in got} == {dt.date(1970, 1, 1)}
    _ = plan


def test_g2_file_order_index(sample, spark, tmp_path):
    # numbering a freshly read file without an explicit order uses file order
    raw = spark.read.option("header", True).csv(str(tmp_path / "d.csv"))
    got = order.add_row_index(raw).orderBy("Index").select("Index", "id").collect()
    assert [(r[0], int(r[1])) for r in got] == [(i + 1, i) for i in range(8)]


def test_g5_remove_first_then_dedupe(sample):
    out = apply_plan(sample, PrepPlan(index="remove", dedupe=True))
    assert out.count() == 7


def test_dataset_summary(sample):
    s = catalog.dataset_summary({"d": sample}, {"d": "classification"}).collect()[0]
    assert (s["name"], s["task"], s["rows"], s["columns"]) == ("d", "classification", 8, 5)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_quotes_commas_and_newlines(spark, tmp_path):
    p = write(tmp_path / "q.csv", 'id,txt,n\n1,"say ""hi"", ok",10\n2,"a\nb",20\n3,x\n')
    assert [tuple(r) for r in files.read_csv(spark, p, multi_line=True).collect()] == [(1, 'say "hi", ok', 10), (2, "a\nb", 20), (3, "x", None)]


def test_too_many_fields_fail(spark, tmp_path):
    with pytest.raises(Exception, match="more than 2 fields"):
        files.read_csv(spark, write(tmp_path / "w.csv", "a,b\n1,2\n3,4,5\n")).collect()


def test_folder_of_differing_headers_fails(spark, tmp_path):
    write(tmp_path / "f" / "1.csv", "a,b\n1,x\n")
    write(tmp_path / "f" / "2.csv", "b,a\ny,2\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        files.read_csv(spark, str(tmp_path / "f")).collect()


def test_codes_stay_text(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path / "c.csv", "a,b,c,d\n10D,0x1p3,1e3,1f\n20F,7,-.5,2\n"))
    assert [t for _, t in df.dtypes] == ["string", "string", "double", "string"]
