import duckdb

from versemill.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def equals_sql(spark, at, rows):
    spark.createDataFrame(rows, TURNS).repartition(2).write.parquet(f"{at}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS FROM '{at}/conversations.parquet/*.parquet'")
    want = duck.sql(ORACLES["literal_files"]).fetchall()
    return sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in QUERIES["literal_files"](spark, at).collect())


def test_long_literals(spark, tmp_path):
    rows = [(1, 0, "u", 'say "so" \\ ' * 30_000), (1, 1, "u", '"' * 50_000), (2, 0, "u", "x" * 300_000)]
    assert equals_sql(spark, str(tmp_path), rows)


def test_odd_turns(spark, tmp_path):
    """Carriage returns, lines that look like cases, numbers below zero, nulls."""
    rows = [(1, 0, "u", "a\rb\r\nc"), (1, 1, "u", '";\n    case 3: return s"x";'), (-4, 2, "u", "below"), (5, -1, "u", "zero")]
    rows += [(6, 0, "u", None), (6, None, "u", "no number"), (None, 1, "u", "no book"), (None, None, "u", None), (7, 0, "u", "")]
    assert equals_sql(spark, str(tmp_path), rows)
