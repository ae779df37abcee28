"""Tables of SQLite files: equal to the file's own answers, in parallel and with pushed filters."""

import sqlite3

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from strideframe.operators import prompts
from strideframe.sources import database


@pytest.fixture
def path(tmp_path):
    file = str(tmp_path / "links #1.db")
    with sqlite3.connect(file) as db:
        db.execute('CREATE TABLE "My Videos" (video_id TEXT PRIMARY KEY, title VARCHAR(90), views INTEGER, score REAL, raw BLOB, n NUMERIC)')
        rows = [(f"v{k}", None if k % 7 == 0 else f"Squat {k} 100%_é", k * 3, k / 4, bytes([k % 256]), k) for k in range(1, 501)]
        db.executemany('INSERT INTO "My Videos" VALUES (?, ?, ?, ?, ?, ?)', rows)
        db.execute("""INSERT INTO "My Videos" VALUES ('odd', 12, 'many', 'x', 5, NULL)""")
        db.execute('DELETE FROM "My Videos" WHERE rowid BETWEEN 100 AND 300')
        db.execute("CREATE TABLE keyed (a INTEGER PRIMARY KEY, b TEXT) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES (1, 'x'), (2, NULL)")
        db.execute("CREATE TABLE bare (a INTEGER)")
    return file


def test_whole_table_in_ranges(spark, path):
    df = database.database_table(spark, path, "My Videos", 5)
    assert [t for _, t in df.dtypes] == ["string", "string", "bigint", "double", "binary", "double"]
    assert df.rdd.getNumPartitions() == 5
    found = {r["video_id"]: r for r in df.collect()}
    assert len(found) == 300 and found["v8"]["title"] == "Squat 8 100%_é" and found["v8"]["score"] == 2.0 and bytes(found["v8"]["raw"]) == b"\x08"
    odd = found["odd"]
    assert (odd["title"], odd["views"], odd["score"], odd["raw"], odd["n"]) == ("12", None, None, None, None)
    assert sorted(r["a"] for r in database.database_table(spark, path, "keyed").collect()) == [1, 2]
    assert database.database_table(spark, path, "bare").count() == 0
    with pytest.raises(Exception, match="no table"):
        database.database_table(spark, path, "absent").count()


def test_filters_give_what_spark_gives(spark, path):
    df = database.database_table(spark, path, "My Videos", 3)
    plain = spark.createDataFrame(df.collect(), df.schema)
    title, views = F.col("title"), F.col("views")
    for where in (
        title.contains("5"), title.contains("100%_"), title.startswith("Squat 3"), title.endswith("é"), title.contains("squat"), title == "Squat 9 100%_é", title.isNull(), ~title.contains("7"),
        title.isNotNull() & (views > 300), views.isin(3, 6, 9, 4000), (views >= 30) & (views < 60), (views == 33) | (views == 36), F.col("score") <= 3, F.col("n") > 490, F.upper(title).contains("SQUAT 44"), title.like("%1_0%"),
    ):
        ids = lambda rows: sorted(r["video_id"] for r in rows.where(where).select("video_id").collect())  # noqa: E731, B023
        assert ids(df) == ids(plain)
    chosen = lambda rows: sorted(r["video_id"] for r in prompts.select_chapters(rows, ["squat 4", "33"], ["7"]).collect())
    assert chosen(df) == chosen(plain) != []


def test_conditions_reach_the_statement(path):
    source = database.SqliteTable({"path": path, "table": "My Videos"})
    reader = source.reader(source.schema())
    kept = list(reader.pushFilters([ds.StringContains(("title",), "Squat"), ds.GreaterThan(("views",), 600), ds.EqualTo(("raw", "x"), 1), ds.EqualTo(("title",), 3), ds.Not(ds.In(("views",), (603,)))]))
    assert [type(f) for f in kept] == [ds.EqualTo, ds.EqualTo]
    assert len(reader.wheres) == 3 and reader.values == ["Squat", 600, 603]
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    with sqlite3.connect(path) as db:
        assert rows == db.execute("""SELECT count(*) FROM "My Videos" WHERE instr(title, 'Squat') AND typeof(views) = 'integer' AND views > 600 AND views <> 603""").fetchone()[0] > 50
